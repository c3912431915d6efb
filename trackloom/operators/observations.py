"""Observations: one row for each object seen by a camera at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

FRAME_W, FRAME_H = 1920.0, 1080.0


def from_events(events: DataFrame) -> DataFrame:
    """The shared events table read as observations: camera = event type, gid = user."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        "event_id", F.col("event_type").alias("camera"), F.col("user_id").alias("gid"), us.alias("us"), (us / 1e6).alias("t"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("quality"), ((F.col("value") % 100) / 100).alias("x"), (k / F.lit(100.0)).alias("y"),
        F.when(F.col("user_id") % 7 == 0, F.concat(F.lit("person_"), F.col("user_id"))).alias("name"), k.alias("k"),
    )


def boxes(obs: DataFrame) -> DataFrame:
    """Adds the box in pixels, whose foot is the observed point."""
    return obs.withColumns({
        "x1": (F.col("x") - 0.05) * FRAME_W, "y1": (F.col("y") - 0.2) * FRAME_H, "x2": (F.col("x") + 0.05) * FRAME_W, "y2": F.col("y") * FRAME_H,
    })


def frames(obs: DataFrame, seconds: int = 3600) -> DataFrame:
    """Adds the number of the frame: ``seconds`` of time each."""
    return obs.withColumn("frame", F.floor(F.col("us") / (seconds * 1_000_000)).cast("bigint"))


def per_track(*keys: str) -> WindowSpec:
    """Rows of one track in order of time."""
    return Window.partitionBy(*(keys or ("camera", "gid"))).orderBy("us", "event_id")


def before(column: str | Column, *keys: str) -> Column:
    """The value of the row before in the same track."""
    return F.lag(column).over(per_track(*keys))
