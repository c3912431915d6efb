"""Gallery matching, re-ranking, association and fusion queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions import vectors as ve
from trackloom.operators import galleries as ga
from trackloom.operators import observations as ob
from trackloom.operators import rerank as rr
from trackloom.operators import sequence as sq
from trackloom.operators.assignment import assign_groups
from trackloom.plans.catalog import BOXES, OBS, query, table
from trackloom.plans.q_geometry import boxed, obs
from trackloom.plans.q_metrics import _E, _Q, near, with_labels


def seen_vectors(spark, sf):
    """Embeddings as the appearances of observations with the same number."""
    o = obs(spark, sf).select("event_id", "us", "camera", "gid", "quality", "k")
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("event_id"), "label", ve.unit(F.col("embedding")).alias("v"))
    return o.join(e, "event_id")


@query("idn18_ema_matcher")
def ema(spark, sf):
    return ga.match(seen_vectors(spark, sf), ["camera"], limit=0.7, policy="ema")


@query("idn19_20_gallery_match")
def gallery(spark, sf):
    return ga.match(seen_vectors(spark, sf), ["camera"], limit=0.7, policy="camera_balanced")


@query("idn21_22_score_only", f"{_Q} SELECT query, id, round(1 - sim, 6) AS dist FROM n WHERE rank = 1 AND 1 - sim <= 0.7")
def score_only(spark, sf):
    return near(spark, sf, 1).where("1 - sim <= 0.7").select("query", "id", F.round(1 - F.col("sim"), 6).alias("dist"))


@query("idn28_rejoin", f"WITH {_E}, q AS (SELECT * FROM e WHERE vec_id % 20 = 0), n AS (SELECT q.vec_id AS query, e.vec_id AS id, list_dot_product(q.v[1:32], e.v[1:32]) AS a, list_dot_product(q.v[33:64], e.v[33:64]) AS b FROM q JOIN e ON q.vec_id <> e.vec_id), t AS (SELECT query, first(id ORDER BY a DESC, id) AS body, first(id ORDER BY b DESC, id) AS gait FROM n GROUP BY query) SELECT query, body, gait, body = gait AS agree FROM t")
def rejoin(spark, sf):
    e = table(spark, sf, "embeddings")
    half = lambda start: e.select("vec_id", F.slice("embedding", start, 32).alias("embedding"))
    best = lambda d, n: ve.nearest(d.where("vec_id % 20 = 0"), d, 1).select("query", F.col("id").alias(n))
    return best(half(1), "body").join(best(half(33), "gait"), "query").withColumn("agree", F.col("body") == F.col("gait"))


@query("idn36_37_reranked")
def reranked(spark, sf):
    """IDN-36 and IDN-37: the nearest row of each query by re-ranked distance, with plain lists and
    with at most ten rows of a camera in a list."""
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 3).alias("cam"), ve.unit(F.col("embedding")).alias("v"))
    q = e.where("vec_id % 20 = 0")
    one = lambda found, n: found.select("query", F.col("id").alias(n), F.round("dist", 6).alias(f"{n}_dist"))
    return one(rr.reranked(e, q), "plain").join(one(rr.reranked(e, q, camera_col="cam", quota=10), "by_camera"), "query")


@query("idn41_smoothed_hold")
def smoothed(spark, sf):
    rows = seen_vectors(spark, sf).withColumn("gid", F.col("k") % 2)
    return sq.fold(rows, ["camera"], ["us", "event_id"], lambda: ([], None, None, 0), ga.smooth_hold_step(), "event_id bigint, held bigint, v array<double>").select("event_id", "held", F.round(F.get("v", 0), 6).alias("first"))


@query("idn43_49_bond_checks", f"WITH {_E}, o AS (SELECT event_id, user_id FROM events), p AS (SELECT a.vec_id, a.label = b.label AS same, 1 - list_dot_product(a.v, b.v) AS d FROM e a JOIN e b ON b.vec_id = a.vec_id + 1) SELECT vec_id, d <= 0.95 AS bound, d <= 0.9 OR same AS reinforce FROM p")
def bond_checks(spark, sf):
    e = table(spark, sf, "embeddings")
    p = e.select("vec_id", F.col("label").alias("la"), F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("lb"), F.col("embedding").alias("b")), "vec_id")
    d = 1 - ve.dot(F.col("a"), F.col("b"))
    return p.select("vec_id", (d <= 0.95).alias("bound"), ((d <= 0.9) | (F.col("la") == F.col("lb"))).alias("reinforce"))


@query("idn52_name_state", "SELECT * FROM (VALUES (1::BIGINT, 'ann'), (2, 'ann'), (3, 'bob'), (4, NULL), (5, 'bob')) t(event_id, name)")
def name_state(spark, sf):
    rows = spark.createDataFrame([("c", 1, 1, "ann", None, False), ("c", 2, 2, None, 0.2, True), ("c", 3, 3, "bob", 0.1, False), ("c", 4, 4, None, 0.5, False), ("c", 5, 5, "bob", None, False)], "camera string, us bigint, event_id bigint, face string, body_dist double, unknown boolean")
    return sq.fold(rows, ["camera"], ["us"], lambda: (None, 0), ga.name_state_step(), "event_id bigint, name string")


@query("jn12_cross_camera_groups")
def cross_camera_groups(spark, sf):
    f = ob.frames(obs(spark, sf), 3600).where("x is not null and y is not null")
    tick = f.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("event_id", "camera", "x", "y"))).alias("p"))  # one tick's points

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                groups = ga.associate([(p["camera"], p["x"], p["y"]) for p in row["p"]], 0.2)
                out += [{"frame": row["frame"], "event_id": p["event_id"], "grp": k} for p, k in zip(row["p"], groups)]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("frame", pa.int64()), ("event_id", pa.int64()), ("grp", pa.int32())]))

    return tick.mapInArrow(run, "frame bigint, event_id bigint, grp int")


@query("jn23_optimal_assignment")
def optimal(spark, sf):
    f = ob.frames(obs(spark, sf), 86_400)
    a, b = f.where("camera = 'click'").alias("a"), f.where("camera = 'view'").alias("b")
    gain = F.floor(1000 / (1 + F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))))
    pairs = a.join(b, "frame").groupBy("frame", F.col("a.gid").alias("ga"), F.col("b.gid").alias("gb")).agg(F.max(gain).alias("gain"))
    return assign_groups(pairs, ["frame"], "ga", "gb", "gain")


@query("top12_live_camera", f"WITH {OBS}, m AS (SELECT max(us) AS now FROM o), l AS (SELECT gid, arg_max(camera, (us, event_id)) AS camera, max(us) AS us FROM o GROUP BY gid) SELECT gid, CASE WHEN (now - us) / 1e6 <= 86400 THEN camera END AS camera, CASE WHEN (now - us) / 1e6 <= 86400 THEN 'id' END AS how FROM l, m")
def live_camera(spark, sf):
    last = obs(spark, sf).groupBy("gid").agg(F.max(F.struct("us", "event_id", "camera")).alias("l"))
    now = last.agg(F.max("l.us").alias("now"))  # one row
    live = (F.col("now") - F.col("l.us")) / 1e6 <= 86_400
    return last.join(F.broadcast(now)).select("gid", F.when(live, F.col("l.camera")).alias("camera"), F.when(live, F.lit("id")).alias("how"))


@query("agg36_churn_audit", f"WITH {BOXES}, v AS (SELECT camera, gid, us // 86400000000 AS day, avg(quality) AS q FROM b GROUP BY 1, 2, 3), p AS (SELECT x.camera, x.day, x.gid AS ga, y.gid AS gb FROM v x JOIN v y ON x.camera = y.camera AND x.day = y.day AND x.gid < y.gid WHERE abs(x.q - y.q) <= 0.002) SELECT camera, day, count(*) AS pairs FROM p GROUP BY 1, 2 HAVING count(*) >= 2")
def churn(spark, sf):
    v = boxed(spark, sf).groupBy("camera", "gid", F.floor(F.col("us") / 86_400_000_000).alias("day")).agg(F.avg("quality").alias("q"))
    p = v.alias("x").join(v.alias("y"), ["camera", "day"]).where((F.col("x.gid") < F.col("y.gid")) & (F.abs(F.col("x.q") - F.col("y.q")) <= 0.002))
    return p.groupBy("camera", "day").agg(F.count("*").alias("pairs")).where("pairs >= 2")


@query("ml01_learned_fusion")
def learned_fusion(spark, sf):
    pairs = with_labels(spark, sf, near(spark, sf, 20)).select((F.col("label") == F.col("ql")).alias("same"), (1 - F.col("sim")).alias("d"), F.col("rank").cast("double").alias("r"))
    weights, bias = ga.fit_fusion(pairs, ["d", "r"])
    return spark.createDataFrame([(n, w) for n, w in zip(("d", "r", "bias"), (*weights, bias))], "feature string, weight double")


@query("top09_view_diverse_ema")
def policies(spark, sf):
    """The exemplars that each policy keeps of each identity."""
    rows = seen_vectors(spark, sf)

    def step(state, row):
        own = {"v": row["v"], "quality": row["quality"], "camera": row["camera"], "id": row["event_id"]}
        state = {p: ga.keep_exemplar(state.get(p, []), own, p, 4) for p in ("ema", "view_diverse", "camera_balanced")}
        return state, [{"event_id": row["event_id"], "kept": ";".join(f"{p}:{','.join(str(e['id']) for e in x)}" for p, x in state.items())}]

    return sq.fold(rows, ["gid"], ["us", "event_id"], dict, step, "event_id bigint, kept string")


@query("idn08_coherence_gate")
def coherence(spark, sf):
    def step(bucket, row):
        ok = ga.coherent(bucket, row["v"], 0.9)
        return ([*bucket, row["v"]][-10:] if ok else bucket), [{"event_id": row["event_id"], "accepted": ok}]

    return sq.fold(seen_vectors(spark, sf), ["label"], ["us", "event_id"], list, step, "event_id bigint, accepted boolean")


@query("idn47_first_face_upgrade", f"WITH {OBS}, f AS (SELECT camera, gid, min(us) AS first_us FROM o WHERE k < 20 GROUP BY 1, 2) SELECT o.event_id FROM o JOIN f USING (camera, gid) WHERE o.us = f.first_us AND o.k < 20")
def face_upgrade(spark, sf):
    """IDN-47: the first valid face of each track."""
    rows = obs(spark, sf).where("k < 20")
    n = F.row_number().over(Window.partitionBy("camera", "gid").orderBy("us", "event_id"))
    return rows.withColumn("n", n).where("n = 1").select("event_id")
