"""Benchmark decontamination by spaced seeds.

A mask selects five of eight neighbouring words and ignores the rest. Hashes of selected
words are joined between benchmark and documents; each hit names an alignment (a shift of the
item along the document). An alignment is a leak if some window of WINDOW words (the whole
item if that is shorter) agrees in at least SHARE of its places. Each mask alone meets every
window of 13 words with two substitutions, so no such leak is missed.

Words are runs of letters, marks and digits in lower case. Items whose words are all equal
count as one and carry the least item_id. Items of fewer than 12 words, whose whole is the
window, are cut into one segment more than the substitutions allowed, one of which is then
intact and is their seed; items of fewer than SPAN words are matched whole and exactly.

Defined cases: a null text has no words; rows without id are reported with a null id; equal
rows give one report; empty tables give no rows; other columns are ignored, or passed through
by :func:`clean`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import free_name, let, written

#: Offsets of the selected words; a mask and its mirror image.
MASKS = ((0, 1, 3, 6, 7), (0, 1, 4, 6, 7))
SPAN = 8
WINDOW = 13
SHARE = 0.8
#: Items of fewer words are found by segments, as the masks don't meet all their substitutions.
SHORT = 12
#: What may be broadcast, in bytes by measured rows; beyond, the join shuffles.
BROADCAST_BYTES = 10_000_000
#: A row of three longs.
NARROW = 24


def tokens(text: Column) -> Column:
    cut = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+")
    return let(cut, lambda w: F.when(F.array_contains(w, ""), F.filter(w, lambda x: x != "")).otherwise(w))


def _seeds(w: Column) -> Column:
    """Hashes of all places and masks; the place is the index divided by the masks."""
    at = lambda i: F.array(*[F.xxhash64(F.lit(k), *[F.get(w, i + o) for o in m]) for k, m in enumerate(MASKS)])
    return F.when(F.size(w) < SPAN, F.array().cast("array<bigint>")).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.size(w) - SPAN), at)))


def segments(n: int) -> list[tuple[int, int]]:
    """(offset, words) of the segments of an item of ``n`` words, below SHORT."""
    parts = 1 if n < SPAN else n - math.ceil(SHARE * n) + 1
    cuts = [n * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _gram(w: Column, at: Column, n: int) -> Column:
    """The hash of ``n`` words in a row; null beyond the end."""
    return F.when(at + n <= F.size(w), F.xxhash64(F.lit(len(MASKS) + n), *[F.get(w, at + o) for o in range(n)]))


def _small(df: DataFrame, width: Column | None = None) -> DataFrame:
    """The frame, to be broadcast if its rows of ``width`` bytes were summed up and are few."""
    total = df.agg(F.sum(F.lit(NARROW) if width is None else width)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, n_compared, n_equal): each leaked item of each document, with the words of
    the window that agrees best."""
    items = written(benchmark.select(F.col(item_col).alias("item"), tokens(F.col(item_text)).alias("t")).where(F.size("t") > 0).groupBy("t").agg(F.min("item").alias("item")), "items")
    place = lambda name: F.expr(f"cast(pos div {len(MASKS)} as bigint)").alias(name)
    known = items.where(F.size("t") >= SPAN).select("item", F.posexplode(_seeds(F.col("t"))).alias("pos", "h")).select("h", "item", place("at"))
    sizes = [r["n"] for r in items.select(F.size("t").alias("n")).where(F.col("n") < SHORT).distinct().collect()]
    for n in sizes:
        cut = F.array(*[F.struct(_gram(F.col("t"), F.lit(a), k).alias("h"), F.lit(a).cast("long").alias("at")) for a, k in segments(n)])
        known = known.union(items.where(F.size("t") == n).select("item", F.explode(cut).alias("s")).select("s.h", "item", "s.at"))
    known = written(known, "seeds")
    given = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
    seen = given.select("id", F.posexplode(_seeds(F.col("w"))).alias("pos", "h")).select("id", "h", place("here"))
    grams = sorted({k for n in sizes for _, k in segments(n)})
    if grams:
        at = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.array(*[_gram(F.col("w"), i, k) for k in grams]))
        short = given.where(F.size("w") > 0).select("id", F.posexplode(F.flatten(at)).alias("pos", "h")).where("h is not null")
        seen = seen.union(short.select("id", "h", F.expr(f"cast(pos div {len(grams)} as bigint)").alias("here")))
    hits = seen.join(_small(known), "h").select("id", "item", (F.col("here") - F.col("at")).alias("shift")).distinct()
    hits = written(hits, "hits").withColumnRenamed("id", "hit")
    both = given.join(_small(hits), F.col("id").eqNullSafe(F.col("hit")))
    wide = F.aggregate("t", F.lit(NARROW).cast("long"), lambda n, x: n + 16 + F.octet_length(x))
    both = both.join(_small(items, wide), "item")

    def best(t: Column, w: Column, shift: Column) -> Column:
        k = F.least(F.lit(WINDOW), F.size(t))
        first, last = F.greatest(F.lit(0), -shift), F.least(F.size(t), F.size(w) - shift) - 1
        equal = F.transform(F.sequence(first, last), lambda p: (F.get(t, p) == F.get(w, p + shift)).cast("int"))
        sums = lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - k), lambda s: F.aggregate(F.slice(e, s + 1, k), F.lit(0), lambda a, x: a + x))
        return F.when(last - first + 1 >= k, let(equal, lambda e: F.array_max(sums(e))))

    scored = both.select("id", "item", F.least(F.lit(WINDOW), F.size("t")).alias("n_compared"), best(F.col("t"), F.col("w"), F.col("shift").cast("int")).alias("n_equal"))
    return scored.groupBy("id", "item", "n_compared").agg(F.max("n_equal").alias("n_equal")).where(F.col("n_equal") >= F.ceil(F.lit(SHARE) * F.col("n_compared")))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a leak, with their columns as they were."""
    (bad,) = free_name(docs, "leaked")
    found = written(leaks(docs, benchmark, id_col, text_col).select(F.col("id").alias(bad)).distinct(), "leaked")
    return docs.join(_small(found), docs[id_col].eqNullSafe(found[bad]), "anti")
