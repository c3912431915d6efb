"""Visits: observations of one identity at one camera without a gap longer than allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP_S = 172_800
MIN_OBS, MIN_DURATION_S = 3, 0.5


def visits(obs: DataFrame, gap_s: int = GAP_S) -> DataFrame:
    """One row for each visit. A gap of exactly ``gap_s`` continues a visit.

    The name is that of the first named row (best distance where ``face_dist`` exists), the
    position the last one, quality the best one, and ``best_event`` the first row of best
    quality. Spark keeps partial sessions per task, so a key's rows are merged, not gathered.
    """
    ts = F.timestamp_micros("us")
    order = F.struct("us", "event_id")
    by = obs.groupBy("gid", "camera", F.session_window(ts, f"{gap_s} seconds"))
    named = F.when(F.col("name").isNotNull(), order)
    return by.agg(
        F.min("us").alias("us_start"), F.max("us").alias("us_end"), F.count("*").alias("n_obs"), F.greatest(F.max("quality"), F.lit(0.0)).alias("quality"),
        F.max_by("event_id", F.struct(F.col("quality"), -F.col("us"), -F.col("event_id"))).alias("best_event"),
        F.min_by("name", named).alias("name"), F.max_by("x", order).alias("map_x"), F.max_by("y", order).alias("map_y"),
    ).drop("session_window")


def gated(found: DataFrame, min_obs: int = MIN_OBS, min_s: float = MIN_DURATION_S) -> DataFrame:
    """Visits with evidence enough; both bounds are included."""
    return found.where((F.col("n_obs") >= min_obs) & ((F.col("us_end") - F.col("us_start")) / 1e6 >= min_s))


def numbered(found: DataFrame) -> DataFrame:
    """Adds the visit's number within its identity, by start."""
    return found.withColumn("visit", F.row_number().over(Window.partitionBy("gid").orderBy("us_start", "camera")))


def visits_stream(obs: DataFrame, gap_s: int = GAP_S, late: str = "30 seconds") -> DataFrame:
    """The streaming form: a visit is given out when the watermark passes its end."""
    timed = obs.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", late)
    return timed.groupBy("gid", "camera", F.session_window("ts", f"{gap_s} seconds")).agg(
        F.min("us").alias("us_start"), F.max("us").alias("us_end"), F.count("*").alias("n_obs"), F.max("quality").alias("quality")
    ).drop("session_window")
