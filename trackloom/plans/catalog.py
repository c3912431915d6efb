"""Where query modules register their queries and the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The events table read as observations.
OBS = """o AS (SELECT event_id, event_type AS camera, user_id AS gid, epoch_us(ts) AS us, epoch_us(ts) / 1e6 AS t,
  least(value / 100, 1.0) AS quality, (value % 100) / 100 AS x, CAST(json_extract_string(props, '$.k') AS BIGINT) / 100.0 AS y,
  CASE WHEN user_id % 7 = 0 THEN 'person_' || user_id END AS name, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
BOXES = OBS + """, b AS (SELECT *, (x - 0.05) * 1920 AS x1, (y - 0.2) * 1080 AS y1, (x + 0.05) * 1920 AS x2, y * 1080 AS y2 FROM o)"""
#: Visits with a gap of two days.
VISITS = OBS + """, g AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 172800000000 THEN 0 ELSE 1 END AS fresh FROM o WINDOW w AS (PARTITION BY gid, camera ORDER BY us, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY gid, camera ORDER BY us, event_id) AS ses FROM g),
v AS (SELECT gid, camera, min(us) AS us_start, max(us) AS us_end, count(*) AS n_obs, greatest(max(quality), 0.0) AS quality,
  first(event_id ORDER BY quality DESC, us, event_id) AS best_event, first(name ORDER BY us, event_id) FILTER (name IS NOT NULL) AS name,
  last(x ORDER BY us, event_id) AS map_x, last(y ORDER BY us, event_id) AS map_y FROM s GROUP BY gid, camera, ses)"""
