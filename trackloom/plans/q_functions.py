"""Scalar functions, plates, and the control plane over literal rows and shared tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions import scalars as sc
from trackloom.operators import plates
from trackloom.plans.catalog import BOXES, OBS, VISITS, query, table
from trackloom.plans.q_geometry import boxed, obs


@query("fn01_normalise_plate", "SELECT c_custkey, regexp_replace(upper(c_name || '-x.9'), '[^A-Z0-9]', '', 'g') AS plate FROM customer")
def normalise_plate(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", sc.normalise_plate(F.concat("c_name", F.lit("-x.9"))).alias("plate"))


@query("fn03_source_names", "SELECT * FROM (VALUES ('cam-00000001', 'gate'), ('cam-00000002', 'gate_00000002'), ('cam-3', 'cam-3'), ('cam-00000004', 'a_b')) t(camera_id, name)")
def source_names(spark, sf):
    rows = spark.createDataFrame([(1, "cam-00000001", "gate"), (2, "cam-00000002", "gate "), (3, "cam-3", None), (4, "cam-00000004", "a // b")], "i int, camera_id string, name string")
    named = rows.withColumn("n", sc.source_name(F.coalesce("name", "camera_id", F.concat(F.lit("camera_"), "i"))))
    k = F.row_number().over(Window.partitionBy("n").orderBy("i"))
    return named.withColumn("k", k).select("camera_id", F.when(F.col("k") == 1, F.col("n")).otherwise(F.concat("n", F.lit("_"), F.right("camera_id", F.lit(8)))).alias("name"))


@query("fn08_compact_json", "SELECT event_id, '{\"user\":' || user_id || ',\"k\":' || json_extract_string(props, '$.k') || '}' AS payload FROM events")
def compact_json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.col("user_id").alias("user"), F.get_json_object("props", "$.k").cast("int").alias("k"))).alias("payload"))


@query("fn10_snk12_app_of_event", "SELECT event_id, CASE event_type WHEN 'click' THEN 'intrusion_app' WHEN 'view' THEN 'counting_app' ELSE event_type END AS app_id FROM events")
def app_of_event(spark, sf):
    apps = F.create_map(F.lit("click"), F.lit("intrusion_app"), F.lit("view"), F.lit("counting_app"))
    return table(spark, sf, "events").select("event_id", F.coalesce(F.try_element_at(apps, F.col("event_type")), "event_type", F.lit("analytics")).alias("app_id"))


@query("fn27_28_crop_quality", f"WITH {BOXES} SELECT event_id, round(least((k * 4) / 200, 1.5) * least((x2 - x1) / 60, 1.5) * quality, 6) AS face, round(0.4 * least(1, (y2 - y1) / 300) + 0.3 * least(1, k / 50) + 0.3 * quality, 6) AS body FROM b")
def crop_quality(spark, sf):
    face = sc.face_quality(F.col("k") * 4, F.col("x2") - F.col("x1"), F.col("quality"))
    body = 0.4 * F.least(F.lit(1.0), (F.col("y2") - F.col("y1")) / 300) + 0.3 * F.least(F.lit(1.0), F.col("k") / 50) + 0.3 * F.col("quality")
    return boxed(spark, sf).select("event_id", F.round(face, 6).alias("face"), F.round(body, 6).alias("body"))


@query("fn29_agg31_pose_coverage", f"WITH {OBS}, p AS (SELECT gid, CASE WHEN abs(k - 50) <= 15 THEN 'frontal' WHEN k - 50 < 0 AND k - 50 >= -40 THEN 'left' WHEN k - 50 > 0 AND k - 50 <= 40 THEN 'right' END AS bin FROM o) SELECT bins.bin, count(gid) AS vectors, count(DISTINCT gid) AS people FROM (VALUES ('frontal'), ('left'), ('right')) bins(bin) LEFT JOIN p USING (bin) GROUP BY bins.bin")
def pose_coverage(spark, sf):
    bins = spark.createDataFrame([("frontal",), ("left",), ("right",)], "bin string")
    p = obs(spark, sf).select("gid", sc.pose_bin((F.col("k") - 50).cast("double"), 15.0, 40.0).alias("bin"))
    return bins.join(p, "bin", "left").groupBy("bin").agg(F.count("gid").alias("vectors"), F.count_distinct("gid").alias("people"))


@query("fn33_34_topology_parse", "SELECT * FROM (VALUES ('a', 'b', 1.0::DOUBLE, 9.0::DOUBLE), ('c', 'd', 0.0, 5.0)) t(cam_a, cam_b, min_s, max_s)")
def topology_parse(spark, sf):
    rows = spark.createDataFrame([({"a -> b": (1.0, 9.0), "c->d": (0.0, 5.0)},)], "m map<string,struct<min:double,max:double>>")
    e = rows.select(F.explode("m").alias("key", "v"))
    pair = F.transform(F.split("key", "->"), lambda c: F.trim(c))
    return e.select(F.get(pair, 0).alias("cam_a"), F.get(pair, 1).alias("cam_b"), F.col("v.min").alias("min_s"), F.col("v.max").alias("max_s"))


@query("fn35_capacity", "SELECT * FROM (VALUES ('e1', 62.0::DOUBLE, true), ('e2', 10.0, false)) t(edge, score, over)")
def capacity(spark, sf):
    rows = spark.createDataFrame([("e1", 10.0, ["body", "face"], 4), ("e1", 10.0, ["body"], 4), ("e2", 10.0, [], 8)], "edge string, fps double, uses array<string>, cores int")
    has = lambda k, w: F.when(F.array_contains("uses", k), w).otherwise(0.0)
    cost = F.col("fps") * (1 + has("body", 1.5) + has("face", 1.2) + has("gait", 1.0) + has("plate", 1.0) + has("ocr", 0.8))
    got = rows.groupBy("edge").agg(F.sum(cost).alias("score"), F.max("cores").alias("cores"))
    return got.select("edge", "score", (F.col("score") > F.greatest(F.lit(30.0), F.col("cores") * 4 * 1.0)).alias("over"))


_READS = [("c", 1, t, 0.9, i, 100.0) for i, t in enumerate(["ka01ab1234", "KA 01 AB 1234", "KA01AB1284", "KA01AB1234", "MH02CD5678"])] + [("c", 2, "KA01AB1234", 0.3, 1, 100.0)] + [("c", 3, t, 0.8, i, 0.0) for i, t in enumerate(["22BH1234A"] * 3)]


@query("ocr01_02_plate_confirmed", "SELECT * FROM (VALUES ('c', 1::BIGINT, 'KA01AB1234', 3::BIGINT, 4)) t(camera, track_id, plate, frame_idx, reads)")
def plate_confirmed(spark, sf):
    rows = spark.createDataFrame(_READS, "camera string, track_id bigint, text string, confidence double, frame_idx bigint, plate_width double")
    return plates.confirmed(rows)


@query("snk09_sequence_numbers", f"WITH {OBS} SELECT event_id, row_number() OVER (PARTITION BY camera ORDER BY us, event_id) AS seq FROM o")
def sequence_numbers(spark, sf):
    return obs(spark, sf).select("event_id", F.row_number().over(Window.partitionBy("camera").orderBy("us", "event_id")).alias("seq"))


@query("snk01_camera_envelope", f"WITH {OBS}, s AS (SELECT camera, us // 86400000000 AS day, count(*) AS n, count(*) FILTER (quality > 0.5) AS good FROM o GROUP BY 1, 2) SELECT camera, day, '{{\"schema_version\":\"5.0\",\"message_type\":\"camera_analytics\",\"camera\":\"' || camera || '\",\"summary\":{{\"objects\":' || n || ',\"good\":' || good || '}}}}' AS payload FROM s")
def camera_envelope(spark, sf):
    s = obs(spark, sf).groupBy("camera", F.floor(F.col("us") / 86_400_000_000).alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("quality") > 0.5).alias("good"))
    body = F.struct(F.lit("5.0").alias("schema_version"), F.lit("camera_analytics").alias("message_type"), "camera", F.struct(F.col("n").alias("objects"), "good").alias("summary"))
    return s.select("camera", "day", F.to_json(body).alias("payload"))


@query("agg30_face_roster", f"WITH {OBS} SELECT name AS person, count(*) AS vectors, count(*) FILTER (camera = 'view') AS front, count(*) FILTER (camera = 'click') AS \"left\", max(us) AS last_us FROM o WHERE name IS NOT NULL GROUP BY name")
def face_roster(spark, sf):
    n = lambda c, a: F.count_if(F.col("camera") == c).alias(a)
    return obs(spark, sf).where("name is not null").groupBy(F.col("name").alias("person")).agg(F.count("*").alias("vectors"), n("view", "front"), n("click", "left"), F.max("us").alias("last_us"))


@query("top06_best_matched", f"WITH {VISITS} SELECT gid, first(best_event ORDER BY n_obs DESC, quality DESC, best_event) AS best FROM v GROUP BY gid")
def best_matched(spark, sf):
    from trackloom.operators import visits as vi

    v = vi.visits(obs(spark, sf))
    return v.groupBy("gid").agg(F.min_by("best_event", F.struct(-F.col("n_obs"), -F.col("quality"), F.col("best_event"))).alias("best"))


@query("top13_exemplars", "SELECT * FROM (VALUES (1, 'app', 0), (2, 'app', 1), (3, 'face', 0)) t(pos, modality, slot)")
def exemplars(spark, sf):
    rows = spark.createDataFrame([("face", 0), ("app", 1), ("app", 0)], "modality string, slot int")
    return rows.select(F.row_number().over(Window.orderBy("modality", "slot")).alias("pos"), "modality", "slot")  # one person's


# ---- control plane: configuration-sized tables --------------------------------------------

#: fixed values: what apps need, by pack; (pack, asked kind, asked, given kind, given)
RULES = [
    ("surveillance", "any", "*", "data", "person_tracks"),
    ("surveillance", "app", "reid", "data", "body_embeddings"),
    ("surveillance", "app", "face_recognition", "data", "face_embeddings"),
    ("surveillance", "app", "face_recognition", "data", "global_person_id"),
    ("surveillance", "app", "face_recognition", "service", "enrolled_face_gallery"),
    ("surveillance", "app", "face_recognition", "service", "identity_anchor"),
    ("surveillance", "data", "global_person_id", "data", "body_embeddings"),
    ("surveillance", "data", "global_person_id", "service", "global_reid_service"),
    ("traffic", "app", "anpr", "data", "vehicle_tracks"),
    ("traffic", "app", "wrong_way", "data", "vehicle_tracks"),
    ("traffic", "app", "vehicle_counting", "data", "vehicle_tracks"),
    ("traffic", "app", "illegal_parking", "data", "vehicle_tracks"),
    ("traffic", "app", "pedestrian_counting", "data", "pedestrian_tracks"),
]
#: fixed values: which node runs what; (pack, position, node, needed kind, needed or *)
NODES = [
    ("surveillance", 1, "person_detector", "any", "*"), ("surveillance", 2, "person_tracker", "any", "*"), ("surveillance", 3, "person_cropper", "data", "body_embeddings"),
    ("surveillance", 4, "body_embedder", "data", "body_embeddings"), ("surveillance", 5, "face_cropper", "data", "face_embeddings"), ("surveillance", 6, "face_embedder", "data", "face_embeddings"),
    ("surveillance", 7, "global_reid_service", "service", "global_reid_service"), ("surveillance", 8, "enrolled_face_gallery", "service", "enrolled_face_gallery"),
    ("surveillance", 9, "identity_anchor", "service", "identity_anchor"), ("traffic", 1, "vehicle_detector", "any", "*"), ("traffic", 2, "vehicle_tracker", "data", "vehicle_tracks"),
    ("traffic", 2, "vehicle_tracker", "data", "pedestrian_tracks"),
]
MODELS = [("person_detector", "person_detector"), ("body_embedder", "body_reid_embedder"), ("face_embedder", "face_embedder"), ("vehicle_detector", "vehicle_detector")]


def _needs(spark):
    """(camera, pack, kind, name) of everything that each camera's apps need: the rules are
    applied twice, as a rule may ask for what another gives."""
    cameras = spark.createDataFrame([("c1", "surveillance", ["face_recognition", "intrusion"]), ("c2", "traffic", ["anpr"]), ("c3", "surveillance", ["reid"])], "camera string, pack string, apps array<string>")
    rules = spark.createDataFrame(RULES, "pack string, asks string, asked string, kind string, name string")
    have = cameras.select("camera", "pack", F.lit("app").alias("kind"), F.explode("apps").alias("name")).union(cameras.select("camera", "pack", F.lit("any"), F.lit("*")))
    for _ in range(2):
        h = have.select("camera", "pack", F.col("kind").alias("asks"), F.col("name").alias("asked"))
        have = have.union(h.join(rules, ["pack", "asks", "asked"]).select("camera", "pack", "kind", "name")).distinct()
    return have


@query("cp01_requirements", "SELECT * FROM (VALUES ('c1', 'body_embeddings,face_embeddings,global_person_id,person_tracks', 'enrolled_face_gallery,global_reid_service,identity_anchor'), ('c2', 'vehicle_tracks', ''), ('c3', 'body_embeddings,person_tracks', '')) t(camera, data, services)")
def requirements(spark, sf):
    have = _needs(spark)
    pick = lambda k: F.array_join(F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("name")))), ",")
    return have.groupBy("camera").agg(pick("data").alias("data"), pick("service").alias("services"))


def _nodes(spark):
    nodes = spark.createDataFrame(NODES, "pack string, pos int, node string, kind string, name string")
    return _needs(spark).join(nodes, ["pack", "kind", "name"]).select("camera", "pack", "pos", "node").distinct()


@query("cp02_03_nodes_edges", "SELECT * FROM (VALUES ('c1', 'person_detector>person_tracker>person_cropper>body_embedder>face_cropper>face_embedder>global_reid_service>enrolled_face_gallery>identity_anchor'), ('c2', 'vehicle_detector>vehicle_tracker'), ('c3', 'person_detector>person_tracker>person_cropper>body_embedder')) t(camera, nodes)")
def nodes(spark, sf):
    chain = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node"))), lambda s: s["node"]), ">")
    return _nodes(spark).groupBy("camera").agg(chain.alias("nodes"))


@query("cp04_feature_flags", "SELECT * FROM (VALUES ('c1', true, true, false), ('c2', false, false, true), ('c3', true, false, false)) t(camera, body, face, vehicle)")
def flags(spark, sf):
    has = lambda n, a: F.coalesce(F.bool_or(F.col("name") == n), F.lit(False)).alias(a)
    return _needs(spark).groupBy("camera").agg(has("body_embeddings", "body"), has("face_embeddings", "face"), has("vehicle_tracks", "vehicle"))


@query("cp05_06_models_services", "SELECT * FROM (VALUES ('surveillance', 'body_reid_embedder,face_embedder,person_detector'), ('traffic', 'vehicle_detector')) t(pack, models)")
def models(spark, sf):
    m = spark.createDataFrame(MODELS, "node string, model string")
    return _nodes(spark).join(m, "node").groupBy("pack").agg(F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"))


@query("cp07_device_placement", "SELECT * FROM (VALUES ('face_embedder', 'GPU'), ('identity_store', 'CPU'), ('vehicle_detector', 'NPU')) t(service, device)")
def placement(spark, sf):
    wants = spark.createDataFrame([("face_embedder", ["TPU", "gpu", "cpu"]), ("vehicle_detector", ["NPU"]), ("identity_store", None)], "service string, wants array<string>")
    have = ["CPU", "GPU", "NPU"]
    first = F.get(F.filter(F.transform("wants", F.upper), lambda d: d.isin(have)), 0)
    chosen = F.when(F.col("wants").isNull(), "CPU").otherwise(F.coalesce(first, F.raise_error(F.lit("no device fits")).cast("string")))
    return wants.select("service", chosen.alias("device"))


@query("cp08_plan_per_pack", "SELECT * FROM (VALUES ('surveillance', 'c1,c3', 2::BIGINT), ('traffic', 'c2', 1::BIGINT)) t(pack, cameras, n)")
def plan(spark, sf):
    c = _needs(spark).select("camera", "pack").distinct()
    return c.groupBy("pack").agg(F.array_join(F.sort_array(F.collect_list("camera")), ",").alias("cameras"), F.count("*").alias("n"))


@query("cp09_topics", "SELECT * FROM (VALUES ('e1.surveillance.c1.intrusion'), ('e1.traffic.anpr')) t(topic)")
def topics(spark, sf):
    rows = spark.createDataFrame([("e1", "surveillance", "c1", "intrusion"), ("e1", "traffic", "", "anpr")], "edge string, pack string, camera string, app string")
    return rows.select(sc.topic(*[F.col(c) for c in rows.columns]).alias("topic"))


@query("cp10_11_config_rendering", "SELECT * FROM (VALUES ('anpr', 'c2'), ('face_recognition', 'c1'), ('intrusion', 'c1'), ('reid', 'c3')) t(app, cameras)")
def rendering(spark, sf):
    apps = _needs(spark).where("kind = 'app'")
    return apps.groupBy(F.col("name").alias("app")).agg(F.array_join(F.sort_array(F.collect_set("camera")), ",").alias("cameras"))


@query("cp12_model_verification", "SELECT * FROM (VALUES ('a', true), ('b', false)) t(model, ok)")
def verification(spark, sf):
    rows = spark.createDataFrame([("a", bytearray(b"abc"), "BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD"), ("b", bytearray(b"abd"), "00")], "model string, content binary, sha256 string")
    return rows.select("model", (F.sha2("content", 256) == F.lower("sha256")).alias("ok"))


@query("cp14_actions", "SELECT * FROM (VALUES ('a', 'keep'), ('b', 'stop'), ('c', 'start')) t(pack, action)")
def actions(spark, sf):
    running, wanted = spark.createDataFrame([("a",), ("b",)], "pack string").withColumn("r", F.lit(1)), spark.createDataFrame([("a",), ("c",)], "pack string").withColumn("w", F.lit(1))
    return running.join(wanted, "pack", "full").select("pack", F.when(F.col("r").isNull(), "start").when(F.col("w").isNull(), "stop").otherwise("keep").alias("action"))
