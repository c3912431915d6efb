"""History, dossiers, audits, boards, joins over visits, top-k and set queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions import geometry as g
from trackloom.functions import scalars as sc
from trackloom.operators import crowds
from trackloom.operators import joins as jn
from trackloom.operators import observations as ob
from trackloom.operators import visits as vi
from trackloom.plans.catalog import BOXES, OBS, VISITS, query, table
from trackloom.plans.q_geometry import boxed, obs

HOUR = 3_600_000_000
_V = f"WITH {VISITS}"


def seen(spark, sf):
    return vi.visits(obs(spark, sf))


@query("jn01_event_nearest_visit", f"""{_V}, c AS (SELECT gid, us_start, min(best_event) AS id FROM v WHERE n_obs >= 2 GROUP BY gid, us_start)
SELECT o.event_id, (SELECT first(c.id ORDER BY abs(c.us_start - o.us), c.us_start, c.id) FROM c WHERE c.gid = o.gid) AS nearest FROM o""")
def event_nearest(spark, sf):
    crops = seen(spark, sf).where("n_obs >= 2").select("gid", F.col("us_start").alias("us"), F.col("best_event").alias("id"))
    return jn.asof_nearest(obs(spark, sf).select("event_id", "gid", "us"), crops, "gid", "us", "id").select("event_id", "nearest")


@query("jn02_visit_vectors", f"{_V}, m AS (SELECT best_event, string_agg(label || ':' || vec_id, ',' ORDER BY label, vec_id) AS vectors FROM v JOIN embeddings e ON e.vec_id = v.best_event GROUP BY best_event) SELECT v.gid, v.camera, v.us_start, m.vectors FROM v LEFT JOIN m USING (best_event)")
def visit_vectors(spark, sf):
    have = table(spark, sf, "embeddings").groupBy("vec_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("label", "vec_id"))), lambda s: F.concat_ws(":", s["label"], s["vec_id"])), ",").alias("vectors"))
    v = seen(spark, sf)
    return v.join(have, v.best_event == have.vec_id, "left").select("gid", "camera", "us_start", "vectors")


@query("jn03_with_vector", f"{_V} SELECT gid, camera, us_start FROM v WHERE EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = v.best_event)")
def with_vector(spark, sf):
    v, e = seen(spark, sf), table(spark, sf, "embeddings").select("vec_id")
    return v.join(e, v.best_event == e.vec_id, "left_semi").select("gid", "camera", "us_start")


@query("jn04_without_vector", f"{_V} SELECT gid, camera, us_start FROM v WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = v.best_event) ORDER BY us_start DESC, gid, camera LIMIT 50")
def without_vector(spark, sf):
    v, e = seen(spark, sf), table(spark, sf, "embeddings").select("vec_id")
    return v.join(e, v.best_event == e.vec_id, "left_anti").orderBy(F.desc("us_start"), "gid", "camera").limit(50).select("gid", "camera", "us_start")


@query("jn06_labelled_detections", f"WITH {OBS}, a AS (SELECT camera, gid, max(name) AS person FROM o WHERE name IS NOT NULL AND gid % 2 = 0 GROUP BY camera, gid) SELECT count(*) AS n, count(a.person) AS labelled, round(count(a.person) / count(*), 6) AS coverage FROM o LEFT JOIN a USING (camera, gid)")
def labelled(spark, sf):
    o = obs(spark, sf)
    notes = o.where("name is not null and gid % 2 = 0").groupBy("camera", "gid").agg(F.max("name").alias("person"))
    got = o.join(notes, ["camera", "gid"], "left").agg(F.count("*").alias("n"), F.count("person").alias("labelled"))
    return got.withColumn("coverage", F.round(F.col("labelled") / F.col("n"), 6))


_IOU = f"""WITH {BOXES}, f AS (SELECT *, us // {HOUR} AS frame FROM b), p AS (SELECT t.event_id, r.event_id AS match, greatest(0, least(t.x2, r.x2) - greatest(t.x1, r.x1)) * greatest(0, least(t.y2, r.y2) - greatest(t.y1, r.y1)) AS i,
  (t.x2 - t.x1) * (t.y2 - t.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) AS s FROM f t JOIN f r USING (frame, camera) WHERE t.event_id % 2 = 0 AND r.event_id % 2 = 1 AND r.gid % 3 <> 0),
q AS (SELECT event_id, match, i / (s - i) AS score, row_number() OVER (PARTITION BY event_id ORDER BY i / (s - i) DESC, match) AS n FROM p)"""


@query("jn07_iou_best_match", f"{_IOU} SELECT event_id, match, round(score, 6) AS score FROM q WHERE n = 1 AND score >= 0.4")
def iou_match(spark, sf):
    f = ob.frames(boxed(spark, sf))
    box = lambda s: tuple(F.col(f"{s}.{c}") for c in ("x1", "y1", "x2", "y2"))
    got = jn.best_match(f.where("event_id % 2 = 0"), f.where("event_id % 2 = 1 and gid % 3 <> 0"), ["frame", "camera"], "event_id", g.iou(box("t"), box("r")), 0.4, "event_id")
    return got.select("event_id", "match", F.round("score", 6).alias("score"))


@query("jn08_gt_assignment", f"{_IOU.replace('USING (frame, camera)', 'ON r.camera = t.camera AND r.frame = t.frame * 2 + 1')} SELECT event_id, match, round(score, 6) AS score FROM q WHERE n = 1 AND score >= 0.4")
def gt_assignment(spark, sf):
    f = ob.frames(boxed(spark, sf))
    box = lambda s: tuple(F.col(f"{s}.{c}") for c in ("x1", "y1", "x2", "y2"))
    runs = f.where("event_id % 2 = 0").withColumn("frame", F.col("frame") * 2 + 1)
    got = jn.best_match(runs, f.where("event_id % 2 = 1 and gid % 3 <> 0"), ["frame", "camera"], "event_id", g.iou(box("t"), box("r")), 0.4, "event_id")
    return got.select("event_id", "match", F.round("score", 6).alias("score"))


@query("jn13_same_frame_pairs", f"WITH {OBS}, f AS (SELECT DISTINCT us // {HOUR} AS frame, camera, gid FROM o) SELECT a.frame, a.camera AS ca, b.camera AS cb, a.gid AS ga, b.gid AS gb FROM f a JOIN f b USING (frame) WHERE a.camera < b.camera")
def same_frame(spark, sf):
    f = ob.frames(obs(spark, sf)).select("frame", "camera", "gid").distinct()
    return f.alias("a").join(f.alias("b"), "frame").where("a.camera < b.camera").select("frame", F.col("a.camera").alias("ca"), F.col("b.camera").alias("cb"), F.col("a.gid").alias("ga"), F.col("b.gid").alias("gb"))


_IV = f"{_V}, i AS (SELECT * FROM v WHERE n_obs >= 3)"


def intervals(spark, sf):
    return seen(spark, sf).where("n_obs >= 3").select("gid", "camera", "us_start", "us_end")


@query("jn14_covisible", f"{_IV} SELECT a.gid AS ga, b.gid AS gb, a.camera, a.us_start AS sa, b.us_start AS sb FROM i a JOIN i b USING (camera) WHERE a.gid < b.gid AND a.us_start <= b.us_end AND b.us_start <= a.us_end")
def covisible(spark, sf):
    i = intervals(spark, sf)
    return jn.overlaps(i, i, ["camera"], "us_start", "us_end", 12 * HOUR).where("a.gid < b.gid").select(F.col("a.gid").alias("ga"), F.col("b.gid").alias("gb"), "a.camera", F.col("a.us_start").alias("sa"), F.col("b.us_start").alias("sb"))


@query("jn15_covisible_margin", f"{_IV} SELECT DISTINCT a.gid AS ga, b.gid AS gb FROM i a JOIN i b USING (camera) WHERE a.gid < b.gid AND least(a.us_end, b.us_end) - greatest(a.us_start, b.us_start) > 1500000")
def covisible_margin(spark, sf):
    met = crowds.together(intervals(spark, sf), "gid", "camera", "us_start", "us_end", 1_500_001, lambda a, b: a == b)
    return met.select(F.col("a").alias("ga"), F.col("b").alias("gb"))


@query("jn16_concurrent_conflict", f"{_IV} SELECT DISTINCT a.gid AS ga, b.gid AS gb FROM i a JOIN i b ON a.camera <> b.camera WHERE a.gid < b.gid AND least(a.us_end, b.us_end) - greatest(a.us_start, b.us_start) > 1500000 AND NOT (least(a.camera, b.camera) = 'click' AND greatest(a.camera, b.camera) = 'view')")
def conflict(spark, sf):
    declared = [("click", "view")]
    met = crowds.together(intervals(spark, sf), "gid", "camera", "us_start", "us_end", 1_500_001, lambda a, b: a != b and (min(a, b), max(a, b)) not in declared)
    return met.select(F.col("a").alias("ga"), F.col("b").alias("gb"))


_MOVES = f"""{_V}, m AS (SELECT gid, camera AS cam_b, us_start, lag(camera) OVER w AS cam_a, (us_start - lag(us_end) OVER w) / 1e6 AS gap_s FROM v WINDOW w AS (PARTITION BY gid ORDER BY us_start, camera))"""


def moves(spark, sf):
    w = Window.partitionBy("gid").orderBy("us_start", "camera")
    rows = seen(spark, sf).withColumns({"cam_a": F.lag("camera").over(w), "gap_s": (F.col("us_start") - F.lag("us_end").over(w)) / 1e6})
    return rows.where("cam_a is not null and cam_a <> camera").select("gid", "us_start", "cam_a", F.col("camera").alias("cam_b"), "gap_s")


@query("jn17_transition_window", f"""{_MOVES} SELECT gid, us_start, cam_a, cam_b,
  coalesce(gap_s >= 0 AND CASE WHEN least(cam_a, cam_b) = 'click' AND greatest(cam_a, cam_b) = 'view' THEN gap_s BETWEEN 3600 - 2 AND 86400 + 2 WHEN least(cam_a, cam_b) = 'error' AND greatest(cam_a, cam_b) = 'view' THEN gap_s BETWEEN -2 AND 43202 ELSE false END, false) AS mapper,
  coalesce(gap_s >= 0 AND CASE WHEN least(cam_a, cam_b) = 'click' AND greatest(cam_a, cam_b) = 'view' THEN gap_s BETWEEN 3600 AND 86400 WHEN least(cam_a, cam_b) = 'error' AND greatest(cam_a, cam_b) = 'view' THEN gap_s BETWEEN 0 AND 43200 ELSE gap_s BETWEEN 0 AND 7200 END, false) AS gallery
FROM m WHERE cam_a IS NOT NULL AND cam_a <> cam_b""")
def transition(spark, sf):
    topology = spark.createDataFrame([("view", "click", 3600.0, 86400.0), ("error", "view", 0.0, 43200.0)], "cam_a string, cam_b string, min_s double, max_s double")
    once = jn.transitions(moves(spark, sf), topology, None, 2.0).withColumnRenamed("ok", "mapper")
    return jn.transitions(once, topology, (0.0, 7200.0)).withColumnRenamed("ok", "gallery").drop("gap_s")


@query("jn20_name_substring", "SELECT n_name AS name, q FROM nation, (VALUES ('united'), ('AN'), ('china republic')) t(q) WHERE contains(lower(n_name), lower(q)) OR contains(lower(q), lower(n_name))")
def name_substring(spark, sf):
    asked = spark.createDataFrame([("united",), ("AN",), ("china republic",)], "q string")  # a handful of typed queries
    n, q = F.lower("n_name"), F.lower("q")
    return table(spark, sf, "nation").join(F.broadcast(asked), F.contains(n, q) | F.contains(q, n)).select(F.col("n_name").alias("name"), "q")


_ALERTS = [(1, "Ann", "c1", 10.04, None), (2, "ann", "c1", 20.0, None), (3, "Bob", "c2", 5.0, "seen")]


def _alerts(spark):
    return spark.createDataFrame(_ALERTS, "id int, employee string, camera string, t double, manual string")


def _key(t="t"):
    return F.concat_ws("|", F.lower("employee"), "camera", F.bround(t, 1).cast("string"))


@query("jn21_22_alert_outcome", "SELECT * FROM (VALUES (1, 'investigated'), (2, 'failed'), (3, 'seen')) t(id, status)")
def alert_outcome(spark, sf):
    calls = spark.createDataFrame([("ANN", "c1", 10.0, "dialled", 1), ("ANN", "c1", 10.0, "acknowledged", 2), ("ann", "c1", 20.0, "failed", 3)], "employee string, camera string, t double, status string, n int")
    last = calls.withColumn("key", _key()).groupBy("key").agg(F.max_by("status", "n").alias("call"))
    found = _alerts(spark).withColumn("key", _key()).join(last, "key", "left")
    return found.select("id", F.coalesce(F.when(F.col("call") == "acknowledged", "investigated").otherwise(F.col("call")), "manual").alias("status"))


@query("jn24_audit_faces", "SELECT * FROM (VALUES (1, 'c1', 'c2', 0.2::DOUBLE)) t(gid, ca, cb, dist)")
def audit_faces(spark, sf):
    tracks = spark.createDataFrame([("c1", 1, 5, 1), ("c2", 3, 6, 1), ("c2", 4, 6, 1), ("c1", 2, 9, 2)], "camera string, frame int, local_id int, gid int")
    faces = spark.createDataFrame([("c1", 1, 5, [1.0, 0.0]), ("c2", 3, 6, [0.8, 0.6]), ("c2", 4, 6, [0.6, 0.8])], "camera string, frame int, local_id int, face array<double>")
    f = tracks.join(faces, ["camera", "frame", "local_id"])
    dot = F.aggregate(F.zip_with("a.face", "b.face", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return f.alias("a").join(f.alias("b"), "gid").where("a.camera < b.camera").groupBy("gid", F.col("a.camera").alias("ca"), F.col("b.camera").alias("cb")).agg(F.round(F.min(1 - dot), 6).alias("dist"))


# ---- aggregations over history ----------------------------------------------------------


@query("agg02_history_summary", f"{_V} SELECT count(*) AS visits, sum(n_obs)::BIGINT AS observations, count(DISTINCT gid) AS people, min(us_start) AS first_us, max(us_end) AS last_us, count(*) FILTER (name IS NOT NULL) AS named, count(*) FILTER (n_obs >= 3) AS long FROM v")
def summary(spark, sf):
    return seen(spark, sf).agg(F.count("*").alias("visits"), F.sum("n_obs").alias("observations"), F.count_distinct("gid").alias("people"), F.min("us_start").alias("first_us"), F.max("us_end").alias("last_us"), F.count("name").alias("named"), F.count_if(F.col("n_obs") >= 3).alias("long"))


@query("agg03_dossier", f"{_V} SELECT gid, camera, count(*) AS visits, min(us_start) AS first_us, max(us_end) AS last_us, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS names FROM v GROUP BY gid, camera")
def dossier(spark, sf):
    return seen(spark, sf).groupBy("gid", "camera").agg(F.count("*").alias("visits"), F.min("us_start").alias("first_us"), F.max("us_end").alias("last_us"), F.array_join(F.sort_array(F.collect_set("name")), ",").alias("names"))


@query("agg04_identity_audit", f"{_V} SELECT gid, count(*) AS visits, count(name) AS named, count(*) - count(name) AS unnamed, string_agg(DISTINCT camera, ',' ORDER BY camera) AS cameras, first(best_event ORDER BY quality DESC, us_start, camera) AS best, count(DISTINCT name) > 1 AS contaminated FROM v GROUP BY gid")
def identity_audit(spark, sf):
    best = F.min_by("best_event", F.struct(-F.col("quality"), F.col("us_start"), F.col("camera")))
    return seen(spark, sf).groupBy("gid").agg(F.count("*").alias("visits"), F.count("name").alias("named"), F.count_if(F.col("name").isNull()).alias("unnamed"), F.array_join(F.sort_array(F.collect_set("camera")), ",").alias("cameras"), best.alias("best"), (F.count_distinct("name") > 1).alias("contaminated"))


@query("agg06_event_counters", f"WITH {OBS} SELECT count(*) FILTER (camera = 'click') AS click, count(*) FILTER (camera = 'view') AS view, count(*) FILTER (camera = 'error') AS error, count(*) AS total, (SELECT count(*) FROM (SELECT gid FROM o GROUP BY gid HAVING count(DISTINCT camera) > 1)) AS multi FROM o")
def counters(spark, sf):
    o = obs(spark, sf)
    multi = o.groupBy("gid").agg(F.count_distinct("camera").alias("n")).agg(F.count_if(F.col("n") > 1).alias("multi"))
    n = lambda c: F.count_if(F.col("camera") == c).alias(c)
    return o.agg(n("click"), n("view"), n("error"), F.count("*").alias("total")).join(F.broadcast(multi))  # two single rows


@query("agg07_cross_camera_board", f"WITH {OBS}, c AS (SELECT gid, camera, count(*) AS n FROM o GROUP BY gid, camera) SELECT gid, string_agg(camera || '=' || n, ',' ORDER BY camera) AS per_camera, sum(n)::BIGINT AS total FROM c GROUP BY gid HAVING count(*) >= 2")
def board(spark, sf):
    c = obs(spark, sf).groupBy("gid", "camera").agg(F.count("*").alias("n"))
    per = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("camera", "n"))), lambda s: F.concat(s["camera"], F.lit("="), s["n"])), ",")
    return c.groupBy("gid").agg(per.alias("per_camera"), F.sum("n").alias("total"), F.count("*").alias("k")).where("k >= 2").drop("k")


@query("agg29_camera_pairs", f"WITH {OBS}, d AS (SELECT DISTINCT gid, camera FROM o) SELECT a.camera AS ca, b.camera AS cb, count(*) AS n FROM d a JOIN d b USING (gid) WHERE a.camera < b.camera GROUP BY 1, 2 ORDER BY n DESC, ca, cb LIMIT 10")
def camera_pairs(spark, sf):
    sets = obs(spark, sf).groupBy("gid").agg(F.sort_array(F.collect_set("camera")).alias("c"))
    pairs = F.flatten(F.transform("c", lambda a: F.transform(F.filter("c", lambda b: b > a), lambda b: F.struct(a.alias("ca"), b.alias("cb")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.ca", "p.cb").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ca", "cb").limit(10)


@query("agg32_throughput", f"WITH {OBS}, s AS (SELECT camera, us, row_number() OVER (PARTITION BY camera ORDER BY us, event_id) AS seq FROM o), h AS (SELECT camera, us // {HOUR} AS h, max(seq) AS seq, max(us) AS us FROM s GROUP BY 1, 2) SELECT camera, h, round(CASE WHEN us > lag(us) OVER w THEN greatest(0, (seq - lag(seq) OVER w) / ((us - lag(us) OVER w) / 1e6)) END, 9) AS fps FROM h WINDOW w AS (PARTITION BY camera ORDER BY h)")
def throughput(spark, sf):
    s = obs(spark, sf).withColumn("seq", F.row_number().over(Window.partitionBy("camera").orderBy("us", "event_id")))
    h = ob.frames(s).groupBy("camera", F.col("frame").alias("h")).agg(F.max("seq").alias("seq"), F.max("us").alias("us"))
    w = Window.partitionBy("camera").orderBy("h")
    fps = (F.col("seq") - F.lag("seq").over(w)) / ((F.col("us") - F.lag("us").over(w)) / 1e6)
    return h.select("camera", "h", F.round(F.when(fps < 0, 0.0).otherwise(fps), 9).alias("fps"))


@query("agg34_best_verified_gid", f"{_V} SELECT name, gid FROM (SELECT name, gid, row_number() OVER (PARTITION BY name ORDER BY min(1 - quality), count(*) DESC, max(us_end), gid) AS r FROM v WHERE name IS NOT NULL GROUP BY name, gid HAVING count(*) >= 2) WHERE r = 1")
def best_verified(spark, sf):
    per = seen(spark, sf).where("name is not null").groupBy("name", "gid").agg(F.min(1 - F.col("quality")).alias("best"), F.count("*").alias("n"), F.max("us_end").alias("last")).where("n >= 2")
    return per.groupBy("name").agg(F.min_by("gid", F.struct("best", -F.col("n"), "last", "gid")).alias("gid"))


@query("agg37_multi_camera_ids", f"WITH {OBS} SELECT gid, count(DISTINCT camera) AS cameras, count(*) AS n FROM o GROUP BY gid HAVING count(DISTINCT camera) > 1")
def multi_camera(spark, sf):
    return obs(spark, sf).groupBy("gid").agg(F.count_distinct("camera").alias("cameras"), F.count("*").alias("n")).where("cameras > 1")


# ---- sorts, limits, top-k ---------------------------------------------------------------


@query("top01_recent_events", f"WITH {OBS} SELECT event_id, us FROM o ORDER BY us DESC, event_id DESC LIMIT 100")
def recent(spark, sf):
    return obs(spark, sf).orderBy(F.desc("us"), F.desc("event_id")).limit(100).select("event_id", "us")


@query("top02_sightings_list", f"{_V} SELECT gid, us_start, n_obs FROM v WHERE camera = 'view' AND n_obs >= 2 ORDER BY us_start DESC, gid LIMIT 200")
def sightings(spark, sf):
    return seen(spark, sf).where("camera = 'view' and n_obs >= 2").orderBy(F.desc("us_start"), "gid").limit(200).select("gid", "us_start", "n_obs")


@query("top03_path", f"{_V} SELECT camera, us_start FROM v WHERE gid = 7 ORDER BY us_start, camera LIMIT 200")
def path_of(spark, sf):
    return seen(spark, sf).where("gid = 7").orderBy("us_start", "camera").limit(200).select("camera", "us_start")


@query("top05_best_display", f"WITH {BOXES}, d AS (SELECT camera, gid, event_id, round(0.45 * CASE WHEN (y2 - y1) / (x2 - x1) BETWEEN 2.0 AND 3.5 THEN 1.0 ELSE greatest(0, 1 - abs((y2 - y1) / (x2 - x1) - 2.75) / 2.75) END + 0.35 * least(1, (y2 - y1) / 300) + 0.2 * quality, 4) AS score FROM b) SELECT camera, gid, first(event_id ORDER BY score DESC, event_id) AS best, max(score) AS score FROM d GROUP BY camera, gid")
def best_display(spark, sf):
    h, w = F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")
    rows = boxed(spark, sf).select("camera", "gid", "event_id", sc.display_score(h, w, F.col("quality")).alias("score"))
    return rows.groupBy("camera", "gid").agg(F.min_by("event_id", F.struct(-F.col("score"), F.col("event_id"))).alias("best"), F.max("score").alias("score"))


@query("top08_camera_balanced_cap", f"WITH {OBS}, r AS (SELECT gid, camera, event_id, row_number() OVER (PARTITION BY gid, camera ORDER BY quality DESC, event_id) AS k FROM o), q AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY k, camera) AS n FROM r) SELECT gid, event_id FROM q WHERE n <= 10")
def balanced_cap(spark, sf):
    k = F.row_number().over(Window.partitionBy("gid", "camera").orderBy(F.desc("quality"), "event_id"))
    rows = obs(spark, sf).withColumn("k", k).withColumn("n", F.row_number().over(Window.partitionBy("gid").orderBy("k", "camera")))
    return rows.where("n <= 10").select("gid", "event_id")


@query("top09_retention_policies", f"WITH {OBS}, r AS (SELECT gid, event_id, row_number() OVER (PARTITION BY gid ORDER BY us DESC, event_id DESC) AS a, row_number() OVER (PARTITION BY gid ORDER BY quality DESC, event_id) AS b FROM o) SELECT gid, event_id, a <= 8 AS ring, b <= 8 AS quality_topk FROM r WHERE a <= 8 OR b <= 8")
def retention(spark, sf):
    w = Window.partitionBy("gid")
    rows = obs(spark, sf).select("gid", "event_id", F.row_number().over(w.orderBy(F.desc("us"), F.desc("event_id"))).alias("a"), F.row_number().over(w.orderBy(F.desc("quality"), "event_id")).alias("b"))
    return rows.where("a <= 8 or b <= 8").select("gid", "event_id", (F.col("a") <= 8).alias("ring"), (F.col("b") <= 8).alias("quality_topk"))


@query("top10_eviction", f"WITH {OBS}, l AS (SELECT gid, max(us) AS last FROM o GROUP BY gid), m AS (SELECT max(us) AS now FROM o) SELECT gid, last FROM l, m WHERE now - last <= 86400000000 ORDER BY last DESC, gid LIMIT 40")
def eviction(spark, sf):
    last = obs(spark, sf).groupBy("gid").agg(F.max("us").alias("last"))
    now = last.agg(F.max("last").alias("now"))  # one row
    return last.join(F.broadcast(now)).where(F.col("now") - F.col("last") <= 86_400_000_000).orderBy(F.desc("last"), "gid").limit(40).select("gid", "last")


@query("top11_ring_buffer", f"WITH {OBS} SELECT event_id FROM o WHERE camera = 'click' ORDER BY us DESC, event_id DESC LIMIT 30")
def ring(spark, sf):
    return obs(spark, sf).where("camera = 'click'").orderBy(F.desc("us"), F.desc("event_id")).limit(30).select("event_id")


# ---- sets -------------------------------------------------------------------------------


@query("set01_name_union", "WITH u AS (SELECT n_name AS name, 0 AS src, n_nationkey AS i FROM nation UNION ALL SELECT lower(r_name), 1, r_regionkey FROM region), r AS (SELECT name, row_number() OVER (PARTITION BY lower(name) ORDER BY src, i) AS k FROM u) SELECT name FROM r WHERE k = 1")
def name_union(spark, sf):
    u = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit(0).alias("src"), F.col("n_nationkey").cast("int").alias("i"))
    u = u.unionByName(table(spark, sf, "region").select(F.lower("r_name").alias("name"), F.lit(1).alias("src"), F.col("r_regionkey").cast("int").alias("i")))
    return u.withColumn("k", F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("src", "i"))).where("k = 1").select("name")


@query("set02_multi_file_union", "SELECT event_id AS id, event_type AS kind, NULL::VARCHAR AS status FROM events UNION ALL SELECT o_orderkey, NULL, o_orderstatus FROM orders")
def file_union(spark, sf):
    a = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    return a.unionByName(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), allowMissingColumns=True)


@query("set03_camera_sets", f"WITH {OBS}, s AS (SELECT gid, list_sort(list(DISTINCT camera)) AS c FROM o GROUP BY gid) SELECT a.gid AS ga, b.gid AS gb, array_to_string(list_sort(list_intersect(a.c, b.c)), ',') AS both, array_to_string(list_sort(list_concat(list_filter(a.c, lambda x: NOT list_contains(b.c, x)), list_filter(b.c, lambda x: NOT list_contains(a.c, x)))), ',') AS differ FROM s a JOIN s b ON b.gid = a.gid + 1")
def camera_sets(spark, sf):
    s = obs(spark, sf).groupBy("gid").agg(F.sort_array(F.collect_set("camera")).alias("c"))
    a, b = s.select(F.col("gid").alias("ga"), F.col("c").alias("a")), s.select((F.col("gid") - 1).alias("ga"), F.col("gid").alias("gb"), F.col("c").alias("b"))
    text = lambda c: F.array_join(F.sort_array(c), ",")
    return a.join(b, "ga").select("ga", "gb", text(F.array_intersect("a", "b")).alias("both"), text(F.concat(F.array_except("a", "b"), F.array_except("b", "a"))).alias("differ"))


@query("set06_retention", f"{_V}, m AS (SELECT max(us_end) AS now FROM v) SELECT gid, camera, us_start FROM v, m WHERE now - us_end <= 864000000000")
def retention_keep(spark, sf):
    v = seen(spark, sf)
    now = v.agg(F.max("us_end").alias("now"))  # one row
    return v.join(F.broadcast(now)).where(F.col("now") - F.col("us_end") <= 864_000_000_000).select("gid", "camera", "us_start")
