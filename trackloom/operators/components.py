"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.storage import forget, written


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` of longs, as (node, component)
    with the smallest node of each component; nodes come from edges alone.

    Alternates large-star and small-star steps: each keeps the edges linear in number, and
    the rounds grow with the logarithm of the diameter. Each round is written to the shared
    folder. Null ends and loops are ignored; an empty input gives no rows.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        out = both.join(least, both.a == least.k).where("b > a" if large else "true")
        made = out.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            made = made.union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
        return made.where("a <> b").distinct()

    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        new = written(star(star(now, True), False), "edges")
        forget(now)
        now = new
        got = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(got) == mark:
            break
        mark = tuple(got)
    stars = now.groupBy("a").agg(F.min("b").alias("b"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select("b", "b").distinct())
