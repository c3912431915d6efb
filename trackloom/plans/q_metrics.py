"""Tracking-quality metrics, calibration and vector queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions import geometry as g
from trackloom.functions import vectors as ve
from trackloom.operators import assignment
from trackloom.operators import flicker as fl
from trackloom.operators import observations as ob
from trackloom.operators import vector_index as vx
from trackloom.plans.catalog import BOXES, OBS, query, table
from trackloom.plans.q_geometry import boxed, obs
from trackloom.plans.q_history import _MOVES, moves

HOUR = 3_600_000_000
#: Predicted and true ids of the shared events.
_D = f"WITH {OBS}, d AS (SELECT event_id, camera, us // {6 * HOUR} AS frame, (gid + k % 3) % 50 AS g, gid % 40 AS p FROM o)"


def detections(spark, sf):
    o = ob.frames(obs(spark, sf), 6 * 3600)
    return o.select("event_id", "camera", "frame", ((F.col("gid") + F.col("k") % 3) % 50).alias("g"), (F.col("gid") % 40).alias("p"))


@query("agg10_purity", f"{_D}, c AS (SELECT g, p, count(*) AS n FROM d GROUP BY g, p), m AS (SELECT max(n) AS n FROM c GROUP BY g) SELECT round(sum(n) / (SELECT count(*) FROM d), 6) AS purity FROM m")
def purity(spark, sf):
    per = detections(spark, sf).groupBy("g", "p").agg(F.count("*").alias("n")).groupBy("g").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return per.agg(F.round(F.sum("top") / F.sum("n"), 6).alias("purity"))


@query("agg11_id_switches", f"{_D} SELECT count(*) AS switches FROM (SELECT g, lag(g) OVER (PARTITION BY p, camera ORDER BY frame, g) AS b FROM d) WHERE g <> b")
def switches(spark, sf):
    before = F.lag("g").over(Window.partitionBy("p", "camera").orderBy("frame", "g"))
    return detections(spark, sf).withColumn("b", before).agg(F.count_if(F.col("g") != F.col("b")).alias("switches"))


@query("agg12_gid_inflation", f"{_D} SELECT round(count(DISTINCT g) / greatest(1, count(DISTINCT p)), 6) AS inflation FROM d")
def inflation(spark, sf):
    return detections(spark, sf).agg(F.round(F.count_distinct("g") / F.greatest(F.lit(1), F.count_distinct("p")), 6).alias("inflation"))


@query("agg13_cross_camera_links", f"{_D}, c AS (SELECT a.g = b.g AS sg, a.p = b.p AS sp FROM d a JOIN d b ON a.frame = b.frame AND a.camera < b.camera), n AS (SELECT count(*) FILTER (sg AND sp) AS tp, count(*) FILTER (sg AND NOT sp) AS fp, count(*) FILTER (NOT sg AND sp) AS fn FROM c) SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS prec, round(tp / nullif(tp + fn, 0), 6) AS recall FROM n")
def cross_links(spark, sf):
    """Pairs are only formed where an id or a person is shared; pairs that share neither count
    nowhere."""
    d = detections(spark, sf)
    pair = lambda key: d.alias("a").join(d.alias("b"), ["frame", key]).where("a.camera < b.camera")
    same_g = pair("g").agg(F.count_if(F.col("a.p") == F.col("b.p")).alias("tp"), F.count_if(F.col("a.p") != F.col("b.p")).alias("fp"))
    same_p = pair("p").agg(F.count_if(F.col("a.g") != F.col("b.g")).alias("fn"))
    n = same_g.join(F.broadcast(same_p))  # two single rows
    rate = lambda x: F.round(F.col("tp") / F.nullif(F.col("tp") + F.col(x), F.lit(0)), 6)
    return n.select("tp", "fp", "fn", rate("fp").alias("prec"), rate("fn").alias("recall"))


@query("agg14_idf1")
def idf1(spark, sf):
    d = detections(spark, sf)
    pairs = d.groupBy("camera", "g", "p").agg(F.count("*").alias("n"))
    got = assignment.assign_groups(pairs, ["camera"], "g", "p", "n").groupBy("camera").agg(F.sum("n").alias("matched"))
    return got.join(d.groupBy("camera").agg(F.count("*").alias("n")), "camera").select("camera", "matched", (F.col("matched") / F.col("n")).alias("idf1"))


@query("agg15_provable_merges", f"""WITH {BOXES}, f AS (SELECT *, us // {24 * HOUR} AS frame FROM b), p AS (SELECT DISTINCT a.camera, a.frame, a.gid FROM f a JOIN f c ON a.camera = c.camera AND a.frame = c.frame AND a.gid = c.gid AND a.event_id < c.event_id
WHERE greatest(0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0, least(a.y2, c.y2) - greatest(a.y1, c.y1)) < 0.5 * ((a.x2 - a.x1) * (a.y2 - a.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) - greatest(0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0, least(a.y2, c.y2) - greatest(a.y1, c.y1))))
SELECT (SELECT count(*) FROM p) AS merged, count(*) AS total FROM (SELECT DISTINCT camera, frame, gid FROM f)""")
def provable_merges(spark, sf):
    f = ob.frames(boxed(spark, sf), 86_400)
    box = lambda s: tuple(F.col(f"{s}.{c}") for c in ("x1", "y1", "x2", "y2"))
    both = f.alias("a").join(f.alias("b"), ["camera", "frame", "gid"]).where("a.event_id < b.event_id").where(g.iou(box("a"), box("b")) < 0.5)
    merged = both.select("camera", "frame", "gid").distinct().agg(F.count("*").alias("merged"))
    return merged.join(F.broadcast(f.agg(F.count_distinct("camera", "frame", "gid").alias("total"))))  # two single rows


@query("agg16_fragmentation", f"{_D}, t AS (SELECT camera, p, count(DISTINCT g) AS n FROM d GROUP BY 1, 2) SELECT round(count(*) FILTER (n = 1) / count(*), 6) AS clean, round(avg(n), 6) AS mean, max(n) AS most FROM t")
def fragmentation(spark, sf):
    t = detections(spark, sf).groupBy("camera", "p").agg(F.count_distinct("g").alias("n"))
    return t.agg(F.round(F.count_if(F.col("n") == 1) / F.count("*"), 6).alias("clean"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"))


@query("agg17_gid_noise", f"{_D}, t AS (SELECT g, count(DISTINCT (camera, frame)) AS n, count(DISTINCT camera) AS c FROM d GROUP BY 1) SELECT count(*) AS gids, count(*) FILTER (n < 15) AS short, count(*) FILTER (c > 1) AS multi FROM t")
def gid_noise(spark, sf):
    t = detections(spark, sf).groupBy("g").agg(F.count_distinct("camera", "frame").alias("n"), F.count_distinct("camera").alias("c"))
    return t.agg(F.count("*").alias("gids"), F.count_if(F.col("n") < 15).alias("short"), F.count_if(F.col("c") > 1).alias("multi"))


@query("agg18_flicker")
def flicker(spark, sf):
    """Labels are identities, or the track's own (T) where it has none yet."""
    g = (F.col("gid") + F.col("k") % 3) % 50
    label = F.when(F.col("k") % 7 == 0, F.concat(F.lit("T"), F.col("gid"))).otherwise(F.concat(F.lit("P"), g))
    rows = ob.frames(boxed(spark, sf)).select("camera", "frame", "event_id", F.floor(F.col("gid") / 3).alias("track"), label.alias("label"), "x1", "y1", "x2", "y2")
    return fl.report(fl.paths(rows))


_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, vec_id % 3 AS cam FROM embeddings)"


@query("agg19_face_oracle", f"""WITH {_E}, x AS (SELECT label, cam, unnest(v) AS x, unnest(range(len(v))) AS i FROM e), m AS (SELECT label, cam, i, avg(x) AS x FROM x GROUP BY ALL), v AS (SELECT label, cam, list(x ORDER BY i) AS v FROM m GROUP BY ALL),
p AS (SELECT a.label, max(1 - list_cosine_similarity(a.v, b.v)) AS d FROM v a JOIN v b ON a.label = b.label AND a.cam < b.cam GROUP BY 1) SELECT label, round(d, 6) AS dist, CASE WHEN d < 0.5 THEN 'confirmed' WHEN d > 0.7 THEN 'disproven' ELSE 'open' END AS verdict FROM p""")
def face_oracle(spark, sf):
    e = table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 3).alias("cam"), F.posexplode("embedding").alias("i", "x"))
    v = e.groupBy("label", "cam", "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("label", "cam").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    p = v.alias("a").join(v.alias("b"), "label").where("a.cam < b.cam").groupBy("label").agg(F.max(ve.cosine_distance(F.col("a.v"), F.col("b.v"))).alias("d"))
    return p.select("label", F.round("d", 6).alias("dist"), F.when(F.col("d") < 0.5, "confirmed").when(F.col("d") > 0.7, "disproven").otherwise("open").alias("verdict"))


@query("agg20_annotation_score", f"{_D}, c AS (SELECT camera, p, g, count(*) AS n FROM d GROUP BY ALL), m AS (SELECT camera, p, max(n) / sum(n) AS share, count(*) AS gids FROM c GROUP BY 1, 2) SELECT camera, round(avg(share), 6) AS majority, count(*) FILTER (gids > 1) AS split FROM m GROUP BY camera")
def annotation_score(spark, sf):
    m = detections(spark, sf).groupBy("camera", "p", "g").agg(F.count("*").alias("n")).groupBy("camera", "p").agg((F.max("n") / F.sum("n")).alias("share"), F.count("*").alias("gids"))
    return m.groupBy("camera").agg(F.round(F.avg("share"), 6).alias("majority"), F.count_if(F.col("gids") > 1).alias("split"))


@query("agg21_majority_vote", f"{_D}, c AS (SELECT camera, g, p, count(*) AS n FROM d GROUP BY ALL) SELECT camera, g, first(p ORDER BY n DESC, p) AS person FROM c GROUP BY 1, 2")
def majority(spark, sf):
    c = detections(spark, sf).groupBy("camera", "g", "p").agg(F.count("*").alias("n"))
    return c.groupBy("camera", "g").agg(F.min_by("p", F.struct(-F.col("n"), F.col("p"))).alias("person"))


@query("agg22_23_run_report", "SELECT * FROM (VALUES (1, 'b', 'tested'), (2, 'a', 'tested'), (3, 'c', 'not_tested')) t(place, model, status)")
def run_report(spark, sf):
    models = spark.createDataFrame([("a",), ("b",), ("c",)], "model string")
    runs = spark.createDataFrame([("a", 0.7, 1.2, 5.0), ("b", 0.9, None, 5.0)], "model string, idf1 double, inflation double, fps double")
    rows = models.join(runs, "model", "left").withColumn("status", F.when(F.col("idf1").isNull(), "not_tested").otherwise("tested"))
    w = Window.orderBy(F.desc(F.coalesce("idf1", F.lit(-1.0))), F.coalesce("inflation", F.lit(1e9)), F.desc(F.coalesce("fps", F.lit(0.0))), "model")  # a row for each model
    return rows.select(F.row_number().over(w).alias("place"), "model", "status")


@query("agg24_25_transition_windows", f"{_MOVES} SELECT least(cam_a, cam_b) AS ca, greatest(cam_a, cam_b) AS cb, round(greatest(5, quantile_cont(gap_s, 0.1)), 3) AS min_s, round(quantile_cont(gap_s, 0.9), 3) AS max_s, round(median(gap_s), 3) AS median_s, count(*) AS n FROM m WHERE cam_a <> cam_b AND gap_s >= 3 GROUP BY 1, 2")
def transition_windows(spark, sf):
    rows = moves(spark, sf).where("gap_s >= 3").groupBy(F.least("cam_a", "cam_b").alias("ca"), F.greatest("cam_a", "cam_b").alias("cb"))
    q = F.percentile("gap_s", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    got = rows.agg(q.alias("q"), F.count("*").alias("n"))
    return got.select("ca", "cb", F.round(F.greatest(F.lit(5.0), F.get("q", 0)), 3).alias("min_s"), F.round(F.get("q", 2), 3).alias("max_s"), F.round(F.get("q", 1), 3).alias("median_s"), "n")


_Q = f"WITH {_E}, q AS (SELECT * FROM e WHERE vec_id % 20 = 0), n AS (SELECT q.vec_id AS query, q.label AS ql, e.vec_id AS id, e.label, list_dot_product(q.v, e.v) AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, e.v) DESC, e.vec_id) AS rank FROM q JOIN e ON q.vec_id <> e.vec_id)"


def near(spark, sf, k):
    e = table(spark, sf, "embeddings")
    return ve.nearest(e.where("vec_id % 20 = 0"), e, k)


def with_labels(spark, sf, found):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return found.join(e.withColumnRenamed("vec_id", "id"), "id").join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("ql")), "query")


@query("agg26_calibration", f"WITH {_E}, q AS (SELECT * FROM e WHERE vec_id % 20 = 0), p AS (SELECT q.label = e.label AS same, list_dot_product(q.v, e.v) AS s FROM q JOIN e ON q.vec_id < e.vec_id), c AS (SELECT same, floor(s * 1000 + 0.5) AS bin, count(*) AS n, sum(s) AS total FROM p GROUP BY ALL), w AS (SELECT sum(x.n * y.n * CASE WHEN x.bin > y.bin THEN 1.0 WHEN x.bin = y.bin THEN 0.5 ELSE 0 END) AS u FROM c x JOIN c y ON x.same AND NOT y.same) SELECT round(1 - (sum(total) FILTER (same) / sum(n) FILTER (same) + sum(total) FILTER (NOT same) / sum(n) FILTER (NOT same)) / 2, 6) AS thr, round(any_value(u) / (sum(n) FILTER (same) * sum(n) FILTER (NOT same)), 4) AS auc FROM c, w")
def calibration(spark, sf):
    """The area under the curve of similarities rounded to thousandths, ties counting half."""
    e = table(spark, sf, "embeddings")
    c = ve.similarity_counts(e.where("vec_id % 20 = 0"), e, "label")
    of = lambda x, flag: F.sum(F.when(F.col("same") == flag, F.col(x)).otherwise(0))
    per = c.groupBy("bin").agg(of("n", True).alias("pos"), of("n", False).alias("neg"), of("total", True).alias("tp"), of("total", False).alias("tn"))
    below = F.coalesce(F.sum("neg").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # two thousand bins at most
    r = per.withColumn("u", F.col("pos") * (below + F.col("neg") / 2))
    return r.agg(F.round(1 - (F.sum("tp") / F.sum("pos") + F.sum("tn") / F.sum("neg")) / 2, 6).alias("thr"), F.round(F.sum("u") / (F.sum("pos") * F.sum("neg")), 4).alias("auc"))


@query("agg27_retrieval", f"{_Q}, h AS (SELECT query, bool_or(label = ql AND rank = 1) AS a, bool_or(label = ql AND rank <= 5) AS b FROM n GROUP BY query) SELECT round(avg(a::INT), 6) AS rank1, round(avg(b::INT), 6) AS rank5 FROM h")
def retrieval(spark, sf):
    hit = F.col("label") == F.col("ql")
    h = with_labels(spark, sf, near(spark, sf, 5)).groupBy("query").agg(F.max(hit & (F.col("rank") == 1)).alias("a"), F.max(hit).alias("b"))
    return h.agg(F.round(F.avg(F.col("a").cast("int")), 6).alias("rank1"), F.round(F.avg(F.col("b").cast("int")), 6).alias("rank5"))


@query("agg28_gallery_stats", f"WITH {_E}, c AS (SELECT label, count(*) AS n, count(DISTINCT cam) AS cams FROM e GROUP BY label) SELECT count(*) AS ids, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, count(*) FILTER (cams > 1) AS multi FROM c")
def gallery_stats(spark, sf):
    c = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_distinct(F.col("vec_id") % 3).alias("cams"))
    return c.agg(F.count("*").alias("ids"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.count_if(F.col("cams") > 1).alias("multi"))


@query("jn18_top04_nearest", f"{_Q} SELECT query, id, rank, round(sim, 6) AS sim FROM n WHERE rank <= 5")
def nearest5(spark, sf):
    return near(spark, sf, 5).select("query", "id", "rank", F.round("sim", 6).alias("sim"))


@query("jn18_indexed_recall")
def indexed_recall(spark, sf):
    """The index's recall of the ten nearest rows, at three quarters of its lists: these vectors are
    random, which is the worst case for lists."""
    e = table(spark, sf, "embeddings")
    q, centres = e.where("vec_id % 20 = 0"), vx.fit_centres(e, 16)
    return vx.recall(vx.search(q, vx.listed(e, centres), centres, 10, probes=12), ve.nearest(q, e, 10))


@query("jn05_filter_after_topk", f"{_Q} SELECT query, id FROM n WHERE rank <= 12 AND id % 3 = 1")
def filter_after(spark, sf):
    return near(spark, sf, 12).where("id % 3 = 1").select("query", "id")


@query("jn19_reciprocal_best", f"WITH {OBS}, {_E}, n AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id) AS r FROM e a JOIN e b ON a.vec_id <> b.vec_id), t AS (SELECT event_id, us AS s, us + (k + 1) * 60000000 AS e FROM o) SELECT x.a, x.b, round(1 - x.s, 6) AS dist, round(greatest(p.s - q.e, q.s - p.e) / 1e6, 3) AS gap_s FROM n x JOIN n y ON x.a = y.b AND x.b = y.a JOIN t p ON p.event_id = x.a JOIN t q ON q.event_id = x.b WHERE x.r = 1 AND y.r = 1 AND x.a % 20 = 0 AND 1 - x.s <= 0.85 * 0.75 AND (p.s >= q.e OR q.s >= p.e)")
def reciprocal(spark, sf):
    """Each other's best, near enough, and never at one time: the rows that transition times are
    learned from. A row's time is that of the observation of its number."""
    e = table(spark, sf, "embeddings")
    near = ve.reciprocal_best(e.where("vec_id % 20 = 0"), e).where(1 - F.col("sim") <= 0.85 * 0.75)
    t = obs(spark, sf).select("event_id", F.col("us").alias("s"), (F.col("us") + (F.col("k") + 1) * 60_000_000).alias("e"))
    p, q = (t.select(F.col("event_id").alias(i), F.col("s").alias(f"s{i}"), F.col("e").alias(f"e{i}")) for i in "ab")
    met = near.join(p, "a").join(q, "b").where("sa >= eb or sb >= ea")
    return met.select("a", "b", F.round(1 - F.col("sim"), 6).alias("dist"), F.round(F.greatest(F.col("sa") - F.col("eb"), F.col("sb") - F.col("ea")) / 1e6, 3).alias("gap_s"))


@query("top07_best_per_identity", f"{_Q}, m AS (SELECT query, label, max(sim) AS sim FROM n GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, label) AS rank FROM m) SELECT query, label, rank FROM r WHERE rank <= 3")
def best_per_identity(spark, sf):
    e = table(spark, sf, "embeddings")
    m = ve.best_per_group(e.where("vec_id % 20 = 0"), e, "label").withColumnRenamed("group", "label")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "label"))
    return m.select("query", "label", rank.alias("rank")).where("rank <= 3")


_NEXT = f"WITH {_E}, p AS (SELECT a.vec_id, a.v AS a, b.v AS b FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)"


def neighbours(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


@query("fn17_cosine_distance", f"{_NEXT} SELECT vec_id, round(1 - list_cosine_similarity(a, b), 6) AS dist FROM p")
def cosine(spark, sf):
    return neighbours(spark, sf).select("vec_id", F.round(ve.cosine_distance(F.col("a"), F.col("b")), 6).alias("dist"))


@query("fn18_l2_normalise", f"WITH {_E} SELECT vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, 1.0::DOUBLE AS norm FROM e")
def l2(spark, sf):
    u = ve.unit(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.get(u, 0), 6).alias("first"), F.round(ve.norm(u), 6).alias("norm"))


_SETS = f"WITH {_E}, p AS (SELECT a.label AS la, b.label AS lb, 1 - list_dot_product(a.v, b.v) AS d FROM e a JOIN e b ON a.label < b.label)"


@query("fn19_20_set_distance", f"{_SETS}, r AS (SELECT *, row_number() OVER (PARTITION BY la, lb ORDER BY d) AS r FROM p) SELECT la, lb, round(min(d), 6) AS least, round(avg(d), 6) AS mean, round(avg(d) FILTER (r <= 3), 6) AS top3 FROM r GROUP BY 1, 2")
def set_distance(spark, sf):
    d = ve.set_distances(table(spark, sf, "embeddings"), "label")
    return d.select("la", "lb", F.round("least", 6).alias("least"), F.round("mean", 6).alias("mean"), F.round("topk", 6).alias("top3"))


@query("fn21_bhattacharyya", f"{_NEXT}, h AS (SELECT vec_id, list_transform(a, lambda x: abs(x)) AS a, list_transform(b, lambda x: abs(x)) AS b FROM p) SELECT vec_id, round(sqrt(greatest(0, 1 - list_sum(list_transform(list_zip(a, b), lambda t: sqrt(t[1] * t[2]))) / sqrt(list_sum(a) * list_sum(b)))), 6) AS dist FROM h")
def bhatt(spark, sf):
    h = lambda c: F.transform(c, lambda x: F.abs(x.cast("double")))
    return neighbours(spark, sf).select("vec_id", F.round(ve.bhattacharyya(h(F.col("a")), h(F.col("b"))), 6).alias("dist"))


@query("fn22_23_fusion", f"{_NEXT}, d AS (SELECT vec_id, 1 - list_dot_product(a, b) AS d FROM p) SELECT vec_id, round(1 - 1 / (1 + exp(-(0.5 - 2 * d + d * d))), 6) AS learned, round(CASE WHEN vec_id % 2 = 0 THEN d / 0.4 * 0.45 + d / 0.5 * 0.55 ELSE d / 0.4 END, 6) AS fused FROM d")
def fusion(spark, sf):
    d = neighbours(spark, sf).select("vec_id", (1 - ve.dot(F.col("a"), F.col("b"))).alias("d"))
    face = F.when(F.col("vec_id") % 2 == 0, F.col("d"))
    return d.select("vec_id", F.round(ve.learned_distance([F.col("d"), F.col("d") * F.col("d")], [-2.0, 1.0], 0.5), 6).alias("learned"), F.round(ve.fused_distance(F.col("d"), face, F.lit(None).cast("double"), (0.4, 0.5, 0.6)), 6).alias("fused"))


@query("win22_embedding_smoothing", f"WITH {_E}, x AS (SELECT label, vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM e), m AS (SELECT label, vec_id, i, avg(x) OVER (PARTITION BY label, i ORDER BY vec_id ROWS 4 PRECEDING) AS x FROM x), n AS (SELECT vec_id, list(x ORDER BY i) AS v FROM m GROUP BY vec_id) SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(v[64] / sqrt(list_dot_product(v, v)), 6) AS last FROM n")
def smoothing(spark, sf):
    five = F.collect_list("embedding").over(Window.partitionBy("label").orderBy("vec_id").rowsBetween(-4, 0))
    rows = table(spark, sf, "embeddings").select("vec_id", five.alias("five")).select("vec_id", ve.unit(ve.mean_vector(F.col("five"))).alias("v"))
    return rows.select("vec_id", F.round(F.get("v", 0), 6).alias("first"), F.round(F.get("v", 63), 6).alias("last"))


@query("win26_rank_fusion", f"WITH {_E}, q AS (SELECT * FROM e WHERE vec_id % 20 = 0), n AS (SELECT q.vec_id AS query, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v[1:32], e.v[1:32]) DESC, e.vec_id) AS a, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v[33:64], e.v[33:64]) DESC, e.vec_id) AS b FROM q JOIN e ON q.vec_id <> e.vec_id), s AS (SELECT query, id, sum(s) AS s FROM (SELECT query, id, 1 / (60 + a) AS s FROM n WHERE a <= 50 UNION ALL SELECT query, id, 1 / (60 + b) FROM n WHERE b <= 50) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 12) DESC, id) AS rank FROM s) SELECT query, id, rank FROM r WHERE rank <= 5")
def rank_fusion(spark, sf):
    """Reciprocal ranks of two lists of fifty, by either half of the vector."""
    e = table(spark, sf, "embeddings")
    half = lambda start: e.select("vec_id", F.slice("embedding", start, 32).alias("embedding"))
    lists = [ve.nearest(d.where("vec_id % 20 = 0"), d, 50).select("query", "id", (1 / (60 + F.col("rank"))).alias("s")) for d in (half(1), half(33))]
    s = lists[0].union(lists[1]).groupBy("query", "id").agg(F.round(F.sum("s"), 12).alias("s"))
    return s.select("query", "id", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s"), "id")).alias("rank")).where("rank <= 5")


@query("idn30_name_vote", f"{_Q}, m AS (SELECT query, label AS name, min(1 - sim) AS d FROM n GROUP BY 1, 2) SELECT query, first(name ORDER BY d, name) AS name, round(min(d), 6) AS dist FROM m GROUP BY query HAVING min(d) <= 0.75")
def name_vote(spark, sf):
    m = with_labels(spark, sf, near(spark, sf, 40)).groupBy("query", F.col("label").alias("name")).agg(F.min(1 - F.col("sim")).alias("d"))
    best = m.groupBy("query").agg(F.min(F.struct("d", "name")).alias("m"))
    return best.where("m.d <= 0.75").select("query", "m.name", F.round("m.d", 6).alias("dist"))


@query("idn31_identify_margin", f"{_Q}, m AS (SELECT query, label, max(sim) AS s FROM n GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, label) AS r FROM m), t AS (SELECT query, max(label) FILTER (r = 1) AS who, max(s) FILTER (r = 1) AS a, max(s) FILTER (r = 2) AS b FROM r GROUP BY query) SELECT query, CASE WHEN a >= 0.3 AND (b IS NULL OR a - b >= 0.01) THEN who END AS who, CASE WHEN a < 0.3 THEN 'too far' WHEN b IS NOT NULL AND a - b < 0.01 THEN 'too close' ELSE 'ok' END AS reason FROM t")
def identify(spark, sf):
    e = table(spark, sf, "embeddings")
    m = ve.best_per_group(e.where("vec_id % 20 = 0"), e, "label").select("query", F.col("group").alias("label"), F.col("sim").alias("s"))
    r = m.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s"), "label")))
    at = lambda c, i: F.max(F.when(F.col("r") == i, F.col(c)))
    t = r.groupBy("query").agg(at("label", 1).alias("who"), at("s", 1).alias("a"), at("s", 2).alias("b"))
    close = F.col("b").isNotNull() & (F.col("a") - F.col("b") < 0.01)
    return t.select("query", F.when((F.col("a") >= 0.3) & ~close, F.col("who")).alias("who"), F.when(F.col("a") < 0.3, "too far").when(close, "too close").otherwise("ok").alias("reason"))


@query("idn38_query_expansion", f"{_Q}, t AS (SELECT query, id FROM n WHERE rank <= 3 UNION ALL SELECT vec_id, vec_id FROM q), x AS (SELECT query, unnest(v) AS x, unnest(range(len(v))) AS i FROM t JOIN e ON e.vec_id = t.id), m AS (SELECT query, i, avg(x) AS x FROM x GROUP BY 1, 2), w AS (SELECT query, list(x ORDER BY i) AS v FROM m GROUP BY 1) SELECT query, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first FROM w")
def expansion(spark, sf):
    e = table(spark, sf, "embeddings")
    members = near(spark, sf, 3).select("query", "id").union(e.where("vec_id % 20 = 0").select("vec_id", "vec_id"))
    w = members.join(e.select(F.col("vec_id").alias("id"), "embedding"), "id").groupBy("query").agg(F.collect_list("embedding").alias("vs"))
    return w.select("query", F.round(F.get(ve.unit(ve.mean_vector(F.col("vs"))), 0), 6).alias("first"))
