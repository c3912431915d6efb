"""Indexes of visits by their vectors: what is still to be indexed, filling it, searching it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions import vectors as ve


def pending(visits: DataFrame, index: DataFrame, limit: int = 32, id_col: str = "best_event") -> DataFrame:
    """The latest visits whose picture isn't in the index yet, ``limit`` at most: one step of a
    background indexer, whose next step takes the next ones."""
    new = visits.where(F.col(id_col).isNotNull()).join(index.select(F.col("vec_id").alias(id_col)), id_col, "left_anti")
    return new.orderBy(F.desc("us_end"), id_col).limit(limit)


def indexed(todo: DataFrame, embed: Callable[[DataFrame], DataFrame], dimensions: int, id_col: str = "best_event") -> DataFrame:
    """(vec_id, embedding) of pending rows. ``embed`` gives (vec_id, embedding) of those whose
    picture is there; the others get a vector of zeros, which no search finds and which keeps
    them from being tried again. Vectors of any numeric type become floats, the index's own type;
    one of another length than ``dimensions`` fails the step before anything is written."""
    zero = F.array_repeat(F.lit(0.0), dimensions).cast("array<float>")
    made = embed(todo).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("v"))
    other = F.raise_error(F.concat(F.lit(f"a vector must have {dimensions} numbers, one has "), F.size("v").cast("string"))).cast("array<float>")
    checked = F.when(F.col("v").isNull(), zero).when(F.size("v") == dimensions, F.col("v")).otherwise(other)
    ids = todo.select(F.col(id_col).cast("bigint").alias("vec_id")).distinct()
    return ids.join(made, "vec_id", "left").select("vec_id", checked.alias("embedding"))


def index_step(visits: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame], dimensions: int, limit: int = 32) -> int:
    """Index one step's rows into the Parquet table ``path``, for use in ``foreachBatch`` or a
    scheduled job; the number of rows that were added. Repeating a step adds nothing."""
    spark = visits.sparkSession
    todo = pending(visits, spark.read.schema("vec_id bigint, embedding array<float>").parquet(path), limit)
    rows = indexed(todo, embed, dimensions).persist()
    try:
        n = rows.count()
        rows.write.mode("append").parquet(path)
    finally:
        rows.unpersist()
    return n


def search(asked: DataFrame, index: DataFrame, k: int = 12) -> DataFrame:
    """(query, id, sim, rank): the nearest indexed rows; zero vectors are never found."""
    real = index.where(F.exists("embedding", lambda x: x != 0))
    return ve.nearest(asked, real, k, itself=True)


def age_stamp(rows: DataFrame, clock: str = "stream", t: str = "us") -> DataFrame:
    """``rows`` with their age in seconds by the wall clock, or by the latest row of their own
    camera, so that streams that run behind by minutes don't age each other's rows."""
    if clock == "wall":
        return rows.withColumn("age_s", (F.unix_micros(F.current_timestamp()) - F.col(t)) / 1e6)
    now = rows.groupBy("camera").agg(F.max(t).alias("__now"))
    return rows.join(now, "camera").withColumn("age_s", (F.col("__now") - F.col(t)) / 1e6).drop("__now")
