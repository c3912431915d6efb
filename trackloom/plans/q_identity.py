"""Identity, clustering and tracking queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions import vectors as ve
from trackloom.operators import crowds
from trackloom.operators import identity as idn
from trackloom.operators import observations as ob
from trackloom.operators import trackers
from trackloom.operators import visits as vi
from trackloom.plans.catalog import OBS, VISITS, query, table
from trackloom.plans.q_geometry import boxed, obs

HOUR = 3_600_000_000
_V = f"WITH {VISITS}"


@query("idn01_first_binding", f"WITH {OBS} SELECT camera, gid, first(event_id ORDER BY us, event_id) AS event_id, count(DISTINCT k % 2) > 1 AS changed FROM o GROUP BY 1, 2")
def first_binding(spark, sf):
    order = F.struct("us", "event_id")
    return obs(spark, sf).groupBy("camera", "gid").agg(F.min_by("event_id", order).alias("event_id"), (F.count_distinct(F.col("k") % 2) > 1).alias("changed"))


@query("idn02_same_frame_gids", f"WITH {OBS} SELECT camera, us // {6 * HOUR} AS frame, array_to_string(list_sort(list(DISTINCT gid)), ',') AS gids FROM o GROUP BY 1, 2")
def same_frame_gids(spark, sf):
    f = ob.frames(obs(spark, sf), 6 * 3600)
    return f.groupBy("camera", "frame").agg(F.array_join(F.sort_array(F.collect_set("gid")), ",").alias("gids"))


def remap(spark):
    return spark.createDataFrame([(i, i - 1) for i in range(2, 15)] + [(30, 20), (20, 10)], "id bigint, target bigint")


@query("idn04_11_canonical", f"WITH {OBS} SELECT CASE WHEN gid BETWEEN 2 AND 14 OR gid IN (20, 30) THEN 1 ELSE gid END AS person, count(*) AS n FROM o GROUP BY 1")
def canonical(spark, sf):
    final = idn.resolve(remap(spark))
    o = obs(spark, sf)
    return o.join(final, o.gid == final.id, "left").groupBy(F.coalesce("final", "gid").alias("person")).agg(F.count("*").alias("n"))


@query("idn05_person_merge", f"WITH {OBS}, p AS (SELECT gid // 2 AS person, * FROM o) SELECT person, array_to_string(list_sort(list(DISTINCT camera)), ',') AS cameras, first(event_id ORDER BY quality DESC, event_id) AS best, first(name ORDER BY quality DESC, event_id) FILTER (name IS NOT NULL) AS link FROM p GROUP BY person")
def person_merge(spark, sf):
    best = F.struct(-F.col("quality"), F.col("event_id"))
    named = F.when(F.col("name").isNotNull(), best)
    return obs(spark, sf).groupBy(F.floor(F.col("gid") / 2).alias("person")).agg(F.array_join(F.sort_array(F.collect_set("camera")), ",").alias("cameras"), F.min_by("event_id", best).alias("best"), F.min_by("name", named).alias("link"))


@query("idn07_person_prune", f"WITH {OBS}, l AS (SELECT gid, max(us) AS last FROM o GROUP BY gid) SELECT gid FROM l WHERE (SELECT max(us) FROM o) - last <= 172800000000")
def person_prune(spark, sf):
    last = obs(spark, sf).groupBy("gid").agg(F.max("us").alias("last"))
    now = last.agg(F.max("last").alias("now"))  # one row
    return last.join(F.broadcast(now)).where(F.col("now") - F.col("last") <= 172_800_000_000).select("gid")


_ASK = "r AS (SELECT g AS a, g + 1 AS b FROM range(0, 60) t(g) UNION ALL SELECT 1, 100000)"


@query("idn09_merge_verdicts", f"""{_V}, {_ASK}, c AS (SELECT DISTINCT a, b FROM r JOIN v x ON x.gid = a JOIN v y ON y.gid = b AND x.camera = y.camera WHERE x.us_start <= y.us_end AND y.us_start <= x.us_end),
l AS (SELECT gid, max(us_end) AS e, arg_max(camera, (us_end, camera)) AS cam FROM v GROUP BY gid), f AS (SELECT gid, min(us_start) AS s, arg_min(camera, (us_start, camera)) AS cam FROM v GROUP BY gid),
t AS (SELECT r.a, r.b, c.a IS NOT NULL AS clash, (f.s - l.e) / 1e6 AS gap, least(l.cam, f.cam) AS lo, greatest(l.cam, f.cam) AS hi, l.gid IS NULL OR f.gid IS NULL AS no_history FROM r LEFT JOIN c USING (a, b) LEFT JOIN l ON l.gid = r.a LEFT JOIN f ON f.gid = r.b)
SELECT a, b, CASE WHEN clash THEN 'impossible' WHEN gap >= 0 AND lo = 'click' AND hi = 'view' AND (gap < 60 OR gap > 3600) THEN 'implausible' ELSE 'plausible' END AS verdict, no_history FROM t""")
def merge_verdicts(spark, sf):
    asked = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(1, 100_000)], "a bigint, b bigint")
    topology = spark.createDataFrame([("view", "click", 60.0, 3600.0)], "cam_a string, cam_b string, min_s double, max_s double")
    return idn.verdicts(asked, vi.visits(obs(spark, sf)), topology)


def close_pairs(spark, sf):
    """Each row with its three nearest rows."""
    e = table(spark, sf, "embeddings")
    near = ve.nearest(e, e, 3)
    return near.select(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b"), F.round(1 - F.col("sim"), 9).alias("d")).distinct()


@query("idn12_components", """WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT a.vec_id AS a, b.vec_id AS b, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id) AS r FROM e a JOIN e b ON a.vec_id <> b.vec_id),
p AS (SELECT a, b FROM n WHERE r = 1 UNION SELECT b, a FROM n WHERE r = 1), w AS (SELECT a AS id, a AS root FROM p UNION SELECT p.b, w.root FROM w JOIN p ON p.a = w.id) SELECT id, min(root) AS root FROM w GROUP BY id""")
def component_roots(spark, sf):
    e = table(spark, sf, "embeddings")
    return idn.connected(ve.nearest(e, e, 1).select(F.col("query").alias("a"), F.col("id").alias("b")))


@query("idn13_16_linked_clusters")
def linked(spark, sf):
    return idn.linked_clusters(close_pairs(spark, sf))


@query("idn17_cannot_link", f"WITH {OBS}, f AS (SELECT DISTINCT camera, us // {HOUR} AS frame, gid FROM o) SELECT DISTINCT a.gid AS ga, b.gid AS gb FROM f a JOIN f b USING (camera, frame) WHERE a.gid < b.gid")
def cannot_link(spark, sf):
    met = crowds.sharing(ob.frames(obs(spark, sf)), "gid", "camera", "frame")
    return met.select(F.col("a").alias("ga"), F.col("b").alias("gb"))


@query("idn23_entry_merge", f"WITH {OBS} SELECT gid // 3 AS entry, min(us) AS created, max(us) AS last_seen, count(*) AS seen FROM o GROUP BY 1")
def entry_merge(spark, sf):
    return obs(spark, sf).groupBy(F.floor(F.col("gid") / 3).alias("entry")).agg(F.min("us").alias("created"), F.max("us").alias("last_seen"), F.count("*").alias("seen"))


@query("idn25_27_score_fusion", f"WITH {OBS} SELECT gid, round(avg(1 - quality), 6) AS mean, round(sum(k * (1 - quality)) / nullif(sum(k) FILTER (k > 0), 0), 6) AS weighted FROM o GROUP BY gid")
def score_fusion(spark, sf):
    d = 1 - F.col("quality")
    w = F.when(F.col("k") > 0, F.col("k"))
    return obs(spark, sf).groupBy("gid").agg(F.round(F.avg(d), 6).alias("mean"), F.round(F.sum(w * d) / F.sum(w), 6).alias("weighted"))


@query("idn26_geff_weight", f"WITH {OBS} SELECT gid, round(0.45 * least(1, 2 * count(name) / count(*)), 6) AS weight FROM o GROUP BY gid")
def geff(spark, sf):
    return obs(spark, sf).groupBy("gid").agg(F.round(0.45 * F.least(F.lit(1.0), 2 * F.count("name") / F.count("*")), 6).alias("weight"))


@query("idn34_face_bootstrap", "SELECT * FROM (VALUES (1, 10), (2, 20), (3, 1003), (4, 1004)) t(track, gid)")
def face_bootstrap(spark, sf):
    rows = spark.createDataFrame([(1, "ann", 0.3), (2, "bob", 0.3), (3, "cid", 0.3), (4, "ann", 0.9)], "track int, name string, dist double")
    best = spark.createDataFrame([("ann", 10)], "name string, verified int")
    known = spark.createDataFrame([("ann", 11), ("bob", 20)], "name string, named int")
    hit = rows.join(best, "name", "left").join(known, "name", "left")
    fresh = 1000 + F.col("track")
    return hit.select("track", F.when(F.col("dist") <= 0.45, F.coalesce("verified", "named", fresh)).otherwise(fresh).alias("gid"))


@query("idn39_40_colour_memory", f"WITH {OBS}, r AS (SELECT gid, camera, event_id, row_number() OVER (PARTITION BY gid, camera ORDER BY us DESC, event_id DESC) AS n FROM o) SELECT gid, camera, count(*) AS kept, min(event_id) AS oldest FROM r WHERE n <= 12 GROUP BY 1, 2")
def colour_memory(spark, sf):
    n = F.row_number().over(Window.partitionBy("gid", "camera").orderBy(F.desc("us"), F.desc("event_id")))
    return obs(spark, sf).withColumn("n", n).where("n <= 12").groupBy("gid", "camera").agg(F.count("*").alias("kept"), F.min("event_id").alias("oldest"))


@query("idn44_unique_guard", f"WITH {OBS}, f AS (SELECT camera AS stream, us // {6 * HOUR} AS frame, gid % 20 AS gid, gid AS track, min(us) OVER (PARTITION BY camera, gid) AS since FROM o), g AS (SELECT DISTINCT * FROM f) SELECT stream, frame, gid, track, row_number() OVER (PARTITION BY stream, frame, gid ORDER BY since, track) = 1 AS keeps FROM g")
def unique_guard(spark, sf):
    f = ob.frames(obs(spark, sf), 6 * 3600).withColumn("since", F.min("us").over(Window.partitionBy("camera", "gid")))
    rows = f.select(F.col("camera").alias("stream"), "frame", (F.col("gid") % 20).alias("gid"), F.col("gid").alias("track"), "since").distinct()
    return idn.unique_guard(rows).drop("since")


@query("idn45_deny_list", f"WITH {OBS}, d AS (SELECT gid AS track, camera AS g, us FROM o WHERE k = 7) SELECT event_id FROM o WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.track = o.gid AND d.g = o.camera AND o.us >= d.us AND (o.us - d.us) / 1e6 <= 86400)")
def deny_list(spark, sf):
    o = obs(spark, sf).select("event_id", "us", F.col("gid").alias("track"), F.col("camera").alias("gid"), "k")
    return idn.denied(o, o.where("k = 7"), 86_400).select("event_id")


def tracked(spark, sf, make):
    rows = ob.frames(boxed(spark, sf), 6 * 3600).select("camera", "frame", "event_id", "x1", "y1", "x2", "y2", F.col("quality").alias("score"), (F.col("k") % 2).alias("class"))
    return trackers.track(rows, make)


@query("trk01_centroid_tracker")
def centroid(spark, sf):
    return tracked(spark, sf, trackers.Centroid)


@query("trk02_tracker_stage")
def stage(spark, sf):
    """Every fifth frame goes without detections."""
    rows = ob.frames(boxed(spark, sf), 6 * 3600).select("camera", "frame", "event_id", "x1", "y1", "x2", "y2", F.col("quality").alias("score"), (F.col("k") % 2).alias("class"))
    empty = F.lit(None).cast("double")
    skipped = rows.where("frame % 5 = 0").select("camera", "frame").distinct().select("camera", "frame", F.lit(None).cast("bigint").alias("event_id"), *[empty.alias(c) for c in ("x1", "y1", "x2", "y2", "score")], F.lit(None).cast("bigint").alias("class"))
    found = trackers.track_stage(rows.where("frame % 5 <> 0").unionByName(skipped))
    return found.select("camera", "frame", "event_id", "track", "predicted", "missed", "hits", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("trk03_iou_tracker")
def greedy(spark, sf):
    return tracked(spark, sf, trackers.Greedy)


@query("trk04_sort_tracker")
def kalman(spark, sf):
    return tracked(spark, sf, trackers.Kalman)


@query("trk05_two_stage_tracker")
def two_stage(spark, sf):
    return tracked(spark, sf, lambda: trackers.TwoStage(high=0.3, new=0.35, low=0.05))


@query("trk06_appearance_tracker")
def appearance(spark, sf):
    """Rows without a vector go by overlap, as all rows of their frame do."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("event_id"), F.col("embedding").alias("v"))
    rows = ob.frames(boxed(spark, sf), 6 * 3600).select("camera", "frame", "event_id", "x1", "y1", "x2", "y2", F.col("quality").alias("score"))
    return trackers.track(rows.join(v, "event_id", "left"), trackers.Appearance)


@query("trk07_duplicate_suppression")
def suppression(spark, sf):
    f = ob.frames(boxed(spark, sf), 6 * 3600)
    rows = F.sort_array(F.collect_list(F.struct("event_id", "x1", "y1", "x2", "y2", "quality")))
    per = f.groupBy("camera", "frame").agg(rows.alias("rows"))  # the boxes of one frame

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                r = row["rows"]
                keep = trackers.suppress([(x["x1"], x["y1"], x["x2"], x["y2"]) for x in r], [x["quality"] for x in r])
                out += [{"camera": row["camera"], "frame": row["frame"], "event_id": r[i]["event_id"]} for i in keep]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("camera", pa.string()), ("frame", pa.int64()), ("event_id", pa.int64())]))

    return per.mapInArrow(run, "camera string, frame bigint, event_id bigint")


@query("sem01_02_search_by_name", f"{_V} SELECT gid, camera, us_start FROM v WHERE name IS NOT NULL AND (contains(lower(name), lower('PERSON_1')) OR contains(lower('PERSON_1'), lower(name))) ORDER BY us_start DESC, gid, camera LIMIT 400")
def search_by_name(spark, sf):
    v = vi.visits(obs(spark, sf))
    n, q = F.lower("name"), F.lower(F.lit("PERSON_1"))
    return v.where(F.contains(n, q) | F.contains(q, n)).orderBy(F.desc("us_start"), "gid", "camera").limit(400).select("gid", "camera", "us_start")


@query("sem03_agg05_search_people", f"""{_V}, e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v FROM e WHERE vec_id = 0), hit AS (SELECT e.vec_id, list_dot_product(e.v, q.v) AS s FROM e, q WHERE e.vec_id <> 0 ORDER BY s DESC, vec_id LIMIT 96),
h AS (SELECT v.gid, max(hit.s) AS s, max(v.us_end) AS last, count(*) AS matched FROM hit JOIN v ON v.best_event = hit.vec_id GROUP BY v.gid) SELECT gid, round(s, 6) AS score, matched FROM h ORDER BY h.s DESC, last DESC LIMIT 8""")
def search_people(spark, sf):
    e = table(spark, sf, "embeddings")
    hits = ve.nearest(e.where("vec_id = 0"), e, 96).select("id", "sim")
    v = vi.visits(obs(spark, sf))
    h = hits.join(v, hits.id == v.best_event).groupBy("gid").agg(F.max("sim").alias("s"), F.max("us_end").alias("last"), F.count("*").alias("matched"))
    return h.orderBy(F.desc("s"), F.desc("last")).limit(8).select("gid", F.round("s", 6).alias("score"), "matched")


@query("sem05_text_index", f"WITH {OBS} SELECT camera, gid, first(event_id ORDER BY quality DESC, event_id) AS best FROM o WHERE y >= 0.2 GROUP BY 1, 2")
def text_index(spark, sf):
    return obs(spark, sf).where("y >= 0.2").groupBy("camera", "gid").agg(F.min_by("event_id", F.struct(-F.col("quality"), F.col("event_id"))).alias("best"))
