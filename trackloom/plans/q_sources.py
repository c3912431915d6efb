"""Scans and sinks over literal rows and the shared tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from trackloom.operators import sequence as sq
from trackloom.plans.catalog import BOXES, OBS, query, table
from trackloom.plans.q_geometry import boxed, obs
from trackloom.sources import readers as rd
from trackloom.sources import sinks as sk


def parsed(spark, rows: list, schema: str):
    """Rows of JSON text as a file scan would give them."""
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string").select(F.from_json("value", schema).alias("r")).select("r.*")


@query("src01_observation_log", "SELECT * FROM (VALUES ('c1', 7::BIGINT, 3::BIGINT, 1.0::DOUBLE, NULL::BIGINT), ('c1', 4, 4, 0.5, 9)) t(camera, track, raw_id, quality, gid)")
def observation_log(spark, sf):
    rows = parsed(spark, [{"camera": "c1", "local_id": 3, "stable_id": 7, "t": 1.0}, {"camera": "c1", "local_id": 4, "quality": 0.5, "gid": 9}, "broken {"], rd.OBSERVATION)
    return rd.observations_of(rows).select("camera", "track", "raw_id", "quality", "gid")


@query("src04_track_csv", "SELECT * FROM (VALUES ('c1', 1::BIGINT, 5::BIGINT, 'P5'), ('c1', 2, -1, 'T')) t(camera, frame, gid, label)")
def track_csv(spark, sf):
    raw = spark.createDataFrame([("c1", "1", "5"), ("c1", "2", "-1"), ("c1", "3", "x")], "Cam string, frame_idx string, global_id_stab string")
    rows = rd.aliased(raw).withColumn("gid", F.col("gid").try_cast("bigint")).where("gid is not null")
    return rows.select("camera", F.col("frame").try_cast("bigint").alias("frame"), "gid", F.coalesce("label", F.when(F.col("gid") < 0, "T").otherwise(F.concat(F.lit("P"), "gid"))).alias("label"))


@query("src05_face_csv", "SELECT * FROM (VALUES (5::BIGINT, 'c1', 3, 0.5::DOUBLE)) t(gid, camera, n, first)")
def face_csv(spark, sf):
    rows = spark.createDataFrame([("c1", 5, "0.5;1;-2")], "camera string, gid bigint, face string")
    v = rd.vector_of(F.col("face"))
    return rows.select("gid", "camera", F.size(v).alias("n"), F.get(v, 0).cast("double").alias("first"))


@query("src06_annotations", "SELECT * FROM (VALUES ('c1', 1::BIGINT, 'bob')) t(camera, global_id, person_id)")
def annotations(spark, sf):
    rows = spark.createDataFrame([("s", "m", "c1", "1", "ann", 1), ("s", "m", "c1", "1", "bob", 2), ("s", "m", "c1", "2", "NaN", 3), ("s", "x", "c1", "3", "cid", 4)], "scenario string, model string, camera string, global_id string, person_id string, n int")
    return rd.annotations(rows, "m", "s")


@query("src07_detection_index", f"WITH {OBS} SELECT us // 21600000000 AS frame, camera, count(*) AS n, array_to_string(list(event_id ORDER BY event_id), ',') AS ids FROM o GROUP BY 1, 2")
def detection_index(spark, sf):
    from trackloom.operators import observations as ob

    f = ob.frames(obs(spark, sf), 6 * 3600)
    return f.groupBy("frame", "camera").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("event_id")), ",").alias("ids"))


@query("src08_camera_config", "SELECT * FROM (VALUES ('a', 'rtsp://a', 5.0::DOUBLE, true), ('d', '/d.mp4', 25.0, false)) t(camera_id, uri, fps, live)")
def camera_config(spark, sf):
    doc = {"cameras": [{"camera_id": "a", "source": {"type": "rtsp", "uri": "rtsp://a", "fps": 25}, "processing": {"fps": 5}}, {"camera_id": "b", "enabled": False, "source": {"uri": "x"}}, {"camera_id": "c", "source": {"uri": ""}}, {"camera_id": "d", "source": {"type": "file", "uri": "/d.mp4", "fps": 25}}]}
    return rd.camera_sources(parsed(spark, [doc], rd.CAMERAS)).drop("i")


@query("src09_desired_state", "SELECT * FROM (VALUES ('edge-unknown', 1, 'c1', 'traffic', 10.0::DOUBLE)) t(edge_id, revision, camera_id, solution_pack, fps)")
def desired(spark, sf):
    return rd.desired_state(parsed(spark, [{"cameras": [{"camera_id": "c1", "solution_pack": "traffic", "apps": ["anpr"]}]}], rd.DESIRED)).drop("source", "apps")


@query("src12_source_resolver", "SELECT * FROM (VALUES ('rtsp://x', 'rtsp://x')) t(source, resolved)")
def resolver(spark, sf):
    return spark.createDataFrame([("rtsp://x", rd.resolve_source("rtsp://x"))], "source string, resolved string")


@query("src17_ground_truth", f"WITH {OBS} SELECT 'click' AS cam, k AS frame, gid FROM o WHERE camera = 'click' UNION ALL SELECT 'view', k, gid FROM o WHERE camera = 'view'")
def ground_truth(spark, sf):
    o = obs(spark, sf)
    one = lambda c: o.where(F.col("camera") == c).select(F.lit(c).alias("cam"), F.col("k").alias("frame"), "gid")
    return one("click").unionByName(one("view"))


@query("snk10_local_events", f"WITH {OBS} SELECT event_id, 'traffic' AS solution_pack, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%SZ') AS timestamp_utc, camera || '_' || strftime(make_timestamp(us), '%Y%m%dT%H%M%S') || '_' || event_id AS snapshot FROM o")
def local_events(spark, sf):
    return sk.event_log(obs(spark, sf).select("event_id", "camera", "us"), "traffic").select("event_id", "solution_pack", "timestamp_utc", "snapshot")


@query("snk11_outbox", f"WITH {OBS} SELECT event_id, '{{\"edge_id\":\"e1\",\"event_type\":\"' || camera || '\",\"payload\":{{\"gid\":' || gid || '}}}}' AS line FROM o")
def outbox(spark, sf):
    line = F.to_json(F.struct(F.lit("e1").alias("edge_id"), F.col("camera").alias("event_type"), F.struct("gid").alias("payload")))
    return obs(spark, sf).select("event_id", line.alias("line"))


@query("snk14_replay_rows", f"WITH {BOXES} SELECT camera, us // 3600000000 AS frame, event_id AS track_id, gid AS global_id, round(x1, 3) AS x1, round(y2, 3) AS y2 FROM b")
def replay_rows(spark, sf):
    from trackloom.operators import observations as ob

    f = ob.frames(boxed(spark, sf))
    return f.select("camera", "frame", F.col("event_id").alias("track_id"), F.col("gid").alias("global_id"), F.round("x1", 3).alias("x1"), F.round("y2", 3).alias("y2"))


@query("snk18_mapper_log", "SELECT * FROM (VALUES (1::BIGINT, '1,2,3', 2::BIGINT, 0.1::DOUBLE)) t(survivor, gids, cameras, least)")
def mapper_log(spark, sf):
    rows = spark.createDataFrame([(1, 1, "a", 0.3), (1, 2, "b", 0.1), (1, 3, "b", 0.2)], "survivor bigint, gid bigint, camera string, d double")
    return rows.groupBy("survivor").agg(F.array_join(F.sort_array(F.collect_set("gid")), ",").alias("gids"), F.count_distinct("camera").alias("cameras"), F.min("d").alias("least"))


@query("snk15_gallery_counts", "SELECT label AS gid, count(*) AS n FROM embeddings GROUP BY label")
def gallery_counts(spark, sf):
    return table(spark, sf, "embeddings").groupBy(F.col("label").alias("gid")).agg(F.count("*").alias("n"))


@query("flt14_use_case_rules", "SELECT * FROM (VALUES ('counting', 'l1', 'z1'), ('counting', 'l3', '')) t(use_case, line, zones)")
def use_case_rules(spark, sf):
    """Lines whose purpose fits the use case, kept where there are no constraint zones or one
    is touched; with the zones that each touches."""
    from trackloom.functions import geometry as g

    pt = "array<struct<x:double,y:double>>"
    lines = spark.createDataFrame([("counting", "l1", "count", [(0.0, 0.0), (2.0, 2.0)], 1), ("counting", "l2", "count", [(8.0, 8.0), (9.0, 9.0)], 1), ("counting", "l3", "count", [(8.0, 8.0), (9.0, 9.0)], 0), ("counting", "l4", "other", [(0.0, 0.0), (2.0, 2.0)], 1)], f"use_case string, line string, purpose string, points {pt}, cam int")
    zones = spark.createDataFrame([(1, "z1", [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)])], f"cam int, zone string, poly {pt}")
    rules = spark.createDataFrame([("counting", "count")], "use_case string, purpose string")
    met = lines.join(rules, ["use_case", "purpose"]).join(zones, "cam", "left").withColumn("hit", F.col("zone").isNotNull() & g.line_touches_zone(F.col("points"), F.col("poly")))
    per = met.groupBy("use_case", "line").agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col("hit"), F.col("zone")))), ",").alias("zones"), F.count("zone").alias("n"))
    return per.where("n = 0 or zones <> ''").drop("n")


@query("win16_live_cadence", f"WITH {OBS}, s AS (SELECT event_id, camera, gid, us, row_number() OVER (PARTITION BY camera, gid ORDER BY us, event_id) AS n FROM o) SELECT event_id FROM s WHERE n = 3")
def live_cadence(spark, sf):
    """The row at which a visit first passes the gate of three observations."""
    from trackloom.operators import observations as ob

    return obs(spark, sf).withColumn("n", F.row_number().over(ob.per_track())).where("n = 3").select("event_id")


@query("idn29_throttled_observe", f"""WITH RECURSIVE {OBS}, f AS (SELECT gid, min(us) AS us, 1 AS n FROM o GROUP BY gid UNION ALL SELECT f.gid, (SELECT min(us) FROM o WHERE o.gid = f.gid AND o.us >= f.us + 86400000000), n + 1 FROM f WHERE f.us IS NOT NULL AND n < 10) SELECT gid, us FROM f WHERE us IS NOT NULL""")
def throttled(spark, sf):
    from pyspark.sql import Window

    rows = sq.cooldown(obs(spark, sf).select("gid", "us", "event_id"), ["gid"], 86_400)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("gid").orderBy("us"))).where("n <= 10").select("gid", "us")


@query("str10_crop_jobs", f"WITH {OBS}, j AS (SELECT event_id, row_number() OVER (PARTITION BY camera ORDER BY us, event_id) - 1 AS rn, camera FROM o WHERE quality > 0.2) SELECT camera, rn // 16 AS batch, count(*) AS n FROM j GROUP BY 1, 2")
def crop_jobs(spark, sf):
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("camera").orderBy("us", "event_id")) - 1
    return obs(spark, sf).where("quality > 0.2").withColumn("batch", F.floor(rn / 16)).groupBy("camera", "batch").agg(F.count("*").alias("n"))


@query("str12_scoped_rules", f"WITH {OBS} SELECT event_id FROM o WHERE camera IN ('view', 'signup')")
def scoped_rules(spark, sf):
    from trackloom.streaming.processors import scoped

    return scoped(obs(spark, sf), {"view", "signup"}).select("event_id")
