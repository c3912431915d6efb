"""Mixing sources to target weights by systematic sampling: the documents of a source stand in a
row, each with its expected copies; their prefix sums begin at one random offset of the source,
and a document is emitted once for each whole number that its own step crosses.

All documents of a source have the same expected copies, target over size of the source, so a
prefix sum is a rank times that. The row is by size: the copies up to any place differ from their
expectation by less than one, so a source's words differ from its target by less than its largest
document. Ranks are counted in two steps, since a source may hold a third of all rows: narrow rows
are cut into ranges of (source, size, id), ranked within their range, and the ranges' counts are
summed up.

Defined cases: a null text has no words; a null source is a source of its own, after the others; a
source without words takes none; a null id comes before others of its size; rows that are equal
take copies one by one, so together they take what one of them would in as many places; texts of
any length are counted whole; an empty table gives no rows; other columns are carried by
:func:`mixed` and ignored by :func:`copies`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import free_name, words, written

#: Weights of the sources in order of their names, from the first again after the last.
WEIGHTS = (3, 1, 2)
#: All targets together, as a part of all words.
SHARE = 1.5
#: A target is at most so many times its source's size; a document is emitted so often at most.
LIMIT = 2
SEED = 11


def _key(source: Column) -> Column:
    """Sources in code point order, null last and different from any text."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def offset(key: Column, seed: int = SEED) -> Column:
    """A number from 0 on and below 1 that follows from the source and the seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("double") / float(16**13)


def targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """``totals(key, source_size)`` with ``target``: words by weight, none above ``limit`` times
    the source's size, the excess of those shared by weight among the others. With sources in
    order of limit over weight, those whose limit is reached come first; the others' words for
    one unit of weight are the largest level that stays below its own limit."""
    by_name, by_level = Window.orderBy("key"), Window.orderBy("ratio", "key")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(limit)).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.sum("source_size").over(every) * float(share) - before) / left)
    level = F.max(F.when(F.col("level") < F.col("ratio"), F.col("level"))).over(every)
    return rows.select("key", "source_size", F.coalesce(F.least("cap", level * F.col("weight")), F.col("cap")).alias("target"))


def copies(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """(id, hash, key, size, source_size, target, copies) of every row: how often the mix takes it."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), _key(F.col(source_col)).alias("key"), F.size(words(F.col(text_col))).cast("long").alias("size"))
    order = ("size", "id", "hash")
    ranged = written(rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("key", *order, "tie").withColumn("part", F.spark_partition_id()), "sizes")
    parts = ranged.groupBy("key", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    share_of = targets(parts.groupBy("key").agg(F.sum("words").alias("source_size")), weights, share, limit)
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = parts.select("key", "part", earlier.alias("earlier")).join(share_of, "key")
    rank = F.row_number().over(Window.partitionBy("key", "part").orderBy(*order))
    placed = ranged.select("id", "hash", "key", "part", "size", rank.alias("rank")).join(known, ["key", "part"])
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    up_to = lambda k: F.floor(offset(F.col("key"), seed) + expected * k)
    k = F.col("earlier") + F.col("rank")
    return placed.select("id", "hash", "key", "size", "source_size", "target", (up_to(k) - up_to(k - 1)).cast("long").alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of the mix with their columns as they were, each as often as it is taken. Rows of
    one id, text and source share their copies evenly."""
    i, h, k, rank, total, rows, times = free_name(docs, "id", "hash", "key", "rank", "total", "rows", "times")
    taken = copies(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how).groupBy("id", "hash", "key").agg(F.sum("copies").alias(total), F.count("*").alias(rows)).where(F.col(total) > 0)
    taken = taken.select(F.col("id").alias(i), F.col("hash").alias(h), F.col("key").alias(k), total, rows)
    given = docs.withColumn(h, F.xxhash64(text_col)).withColumn(k, _key(F.col(source_col)))
    met = given.alias("d").join(taken.alias("t"), F.col(f"d.{h}").eqNullSafe(F.col(f"t.{h}")) & F.col(f"d.{k}").eqNullSafe(F.col(f"t.{k}")) & F.col(f"d.{id_col}").eqNullSafe(F.col(f"t.{i}")))
    met = met.select("d.*", f"t.{total}", f"t.{rows}")
    once = met.where(F.col(rows) == 1).withColumn(times, F.col(total))
    place = F.row_number().over(Window.partitionBy(id_col, h, k).orderBy(F.lit(1)))
    again = met.where(F.col(rows) > 1).withColumn(rank, place).withColumn(times, F.floor(F.col(total) / F.col(rows)) + (F.col(rank) <= F.col(total) % F.col(rows)).cast("long")).drop(rank)
    out = once.unionByName(again).where(F.col(times) > 0)
    return out.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)
