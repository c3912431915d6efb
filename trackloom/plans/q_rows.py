"""Rules of one row, over columns of the shared events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import geometry as g
from trackloom.functions import scalars as sc
from trackloom.operators import observations as ob
from trackloom.plans.catalog import BOXES, OBS, query
from trackloom.plans.q_geometry import boxed, obs
from trackloom.plans.q_streams import _READS, plate_reads

_PLATE = "'^(?:[A-Z]{2}[0-9]{1,2}[A-Z]{1,3}[0-9]{1,4}|[0-9]{2}BH[0-9]{4}[A-Z]{1,2})$'"


@query("prj05_shift", f"WITH {BOXES} SELECT event_id, round(x1 + k, 6) AS x1, round(y1 + 2 * k, 6) AS y1, CASE WHEN k % 3 = 0 THEN k ELSE gid END AS parent_id FROM b")
def shift(spark, sf):
    """Boxes of a region of interest that begins at (k, 2 k), with the parent that was given or theirs."""
    given = F.when(F.col("k") % 3 == 0, F.col("k"))
    return boxed(spark, sf).select("event_id", F.round(F.col("x1") + F.col("k"), 6).alias("x1"), F.round(F.col("y1") + 2 * F.col("k"), 6).alias("y1"), F.coalesce(given, "gid").alias("parent_id"))


@query("prj08_geometry_ref", f"WITH {OBS} SELECT event_id, CASE WHEN k % 2 = 0 THEN 'z' || k ELSE 'zone:[[' || k || ',' || gid || ']]' END AS ref, 'zone_' || (k + 1) AS label FROM o")
def geometry_ref(spark, sf):
    name = F.when(F.col("k") % 2 == 0, F.concat(F.lit("z"), F.col("k")))
    points = F.array(F.array(F.col("k"), F.col("gid")))
    return obs(spark, sf).select("event_id", F.coalesce(name, F.concat(F.lit("zone:"), F.to_json(points))).alias("ref"), F.concat(F.lit("zone_"), F.col("k") + 1).alias("label"))


@query("flt05_plate_roi", f"WITH {OBS} SELECT event_id, CASE k % 4 WHEN 0 THEN false WHEN 1 THEN true ELSE x BETWEEN 0.305 AND 0.605 AND y BETWEEN 0.305 AND 0.605 END AS kept FROM o")
def plate_roi(spark, sf):
    """Without zones a plate is dropped, with an empty list of them kept, else it has to lie in one or on its edge."""
    square = g.polygon([(0.305, 0.305), (0.605, 0.305), (0.605, 0.605), (0.305, 0.605)])
    zones = F.when(F.col("k") % 4 == 0, F.lit(None)).when(F.col("k") % 4 == 1, F.array().cast("array<array<struct<x:double,y:double>>>")).otherwise(F.array(square))
    kept = F.when(F.col("zones").isNull(), False).when(F.size("zones") == 0, True).otherwise(F.exists("zones", lambda p: g.in_polygon(F.col("x"), F.col("y"), p) | g.on_edge(F.col("x"), F.col("y"), p)))
    return obs(spark, sf).withColumn("zones", zones).select("event_id", kept.alias("kept"))


@query("flt06_face_gates", f"""WITH {OBS}, f AS (SELECT event_id, quality, CASE WHEN k % 7 > 0 THEN 0.5 + k / 100 END AS det, CASE WHEN k % 7 > 0 AND k % 11 > 0 THEN k + 10 END AS px FROM o)
SELECT event_id, coalesce(det >= 0.6 AND px >= 40, false) OR (det IS NULL AND px IS NULL) AS worth, coalesce(det >= 0.6 AND px >= 40 AND quality >= 0.3, false) AS fresh FROM f""")
def face_gates(spark, sf):
    rows = obs(spark, sf).withColumn("det", F.when(F.col("k") % 7 > 0, F.lit(0.5) + F.col("k") / 100)).withColumn("px", F.when((F.col("k") % 7 > 0) & (F.col("k") % 11 > 0), F.col("k") + 10))
    enough = (F.col("det") >= 0.6) & (F.col("px") >= 40)
    absent = F.col("det").isNull() & F.col("px").isNull()
    return rows.select("event_id", (F.coalesce(enough, F.lit(False)) | absent).alias("worth"), F.coalesce(enough & (F.col("quality") >= 0.3), F.lit(False)).alias("fresh"))


@query("flt10_full_body_index", f"WITH {OBS} SELECT event_id, k + 80 >= 120 AND (k + 80) / (40 + gid % 60) >= 1.8 AS indexable FROM o")
def full_body(spark, sf):
    h, w = F.col("k") + 80, F.col("gid") % 60 + 40
    return obs(spark, sf).select("event_id", ((h >= 120) & (h / w >= 1.8)).alias("indexable"))


@query("flt15_plate_format", f"WITH {OBS}, {_READS} SELECT text AS plate, count(*) AS n, bool_and(regexp_matches(text, {_PLATE})) AS ok FROM n GROUP BY text")
def plate_format(spark, sf):
    return plate_reads(obs(spark, sf)).groupBy(F.col("text").alias("plate")).agg(F.count("*").alias("n"), F.bool_and(F.col("text").rlike(sc.PLATE)).alias("ok"))


_RAW = "CASE k % 4 WHEN 0 THEN ' ' || camera || '/' || k || ':é. ' WHEN 1 THEN '...' WHEN 2 THEN camera || '.' || k END"


@query("fn02_safe_names", rf"""WITH {OBS}, r AS (SELECT event_id, coalesce({_RAW}, '') AS t FROM o)
SELECT event_id, coalesce(nullif(trim(trim(regexp_replace(t, '[^\p{{L}}\p{{N}} _.\-]', '_', 'g')), '.'), ''), 'unnamed') AS name, coalesce(nullif(trim(regexp_replace(t, '[^\p{{L}}\p{{N}}]', '_', 'g'), '_'), ''), 'item') AS item FROM r""")
def safe_names(spark, sf):
    raw = F.expr(_RAW)
    return obs(spark, sf).select("event_id", sc.safe_name(raw).alias("name"), sc.safe_item(raw).alias("item"))


@query("fn04_06_parsing", f"""WITH {OBS} SELECT event_id, coalesce(k % 5 IN (0, 1), false) AS flag, CASE k % 4 WHEN 0 THEN CASE WHEN k > 0 THEN k::DOUBLE END WHEN 3 THEN 0.5 END AS num, CASE WHEN k % 3 = 0 THEN 'x' END AS txt FROM o""")
def parsing(spark, sf):
    a = F.when(F.col("k") % 5 == 0, " YES ").when(F.col("k") % 5 == 1, "1").when(F.col("k") % 5 == 2, "no").when(F.col("k") % 5 == 3, "2")
    b = F.when(F.col("k") % 4 == 0, F.col("k").cast("string")).when(F.col("k") % 4 == 1, "-3").when(F.col("k") % 4 == 2, "abc").otherwise("0.5")
    c = F.when(F.col("k") % 3 == 0, "x").when(F.col("k") % 3 == 1, "")
    return obs(spark, sf).select("event_id", sc.truthy(a).alias("flag"), sc.positive(b).alias("num"), sc.optional(c).alias("txt"))


@query("fn09_time_bucket", f"WITH {OBS} SELECT event_id, CASE WHEN k % 9 = 0 THEN '' ELSE format('{{:.1f}}', us / 1e6) END AS bucket FROM o")
def time_bucket(spark, sf):
    t = F.when(F.col("k") % 9 > 0, F.col("us") / 1e6)
    return obs(spark, sf).select("event_id", sc.time_bucket(t).alias("bucket"))


@query("fn11_snapshot_refs", f"""WITH {OBS} SELECT event_id, CASE k % 3 WHEN 0 THEN 'crops/' || event_id || '.png' WHEN 1 THEN k || '.JPG' ELSE 'c/' || k END AS ref, CASE k % 3 WHEN 0 THEN 'image/png' ELSE 'image/jpeg' END AS kind FROM o""")
def snapshot_refs(spark, sf):
    p = F.when(F.col("k") % 3 == 0, F.concat(F.lit("/srv/state/p1/crops/"), "event_id", F.lit(".png"))).when(F.col("k") % 3 == 1, F.concat(F.lit("/tmp/x/"), F.col("k"), F.lit(".JPG"))).otherwise(F.concat(F.lit("c/"), F.col("k")))
    return obs(spark, sf).select("event_id", sc.relative_ref(p, "p1").alias("ref"), sc.image_type(p).alias("kind"))


@query("fn13_source_type", f"WITH {OBS} SELECT event_id, CASE k % 4 WHEN 0 THEN 'rtsp' WHEN 1 THEN 'rtsp' WHEN 2 THEN 'http' ELSE 'file' END AS kind FROM o")
def source_type(spark, sf):
    uri = F.concat(F.when(F.col("k") % 4 == 0, "rtsp://").when(F.col("k") % 4 == 1, "RTSPS://").when(F.col("k") % 4 == 2, "https://").otherwise("/srv/http://"), "camera", F.lit("/"), F.col("k"))
    return obs(spark, sf).select("event_id", sc.source_type(uri).alias("kind"))


@query("fn14_15_event_details", f"""WITH {OBS} SELECT event_id, CASE WHEN k % 3 > 0 THEN 'side_a' END AS origin, CASE WHEN k % 3 > 0 THEN 'side_b' END AS target,
CASE WHEN k % 3 > 0 THEN '{{"line":"' || camera || '","count":' || k || '}}' WHEN k % 2 = 0 THEN '{{"count":' || k || '}}' END AS details FROM o""")
def event_details(spark, sf):
    way = F.split(F.when(F.col("k") % 3 > 0, "side_a_to_side_b"), "_to_", 2)
    text = F.to_json(F.struct(F.when(F.col("k") % 3 > 0, F.col("camera")).alias("line"), F.when((F.col("k") % 3 > 0) | (F.col("k") % 2 == 0), F.col("k")).alias("count")))
    return obs(spark, sf).select("event_id", F.get(way, 0).alias("origin"), F.get(way, 1).alias("target"), F.when(text != "{}", text).alias("details"))


@query("fn16_tracked_objects", f"WITH {OBS}, {_READS}, r AS (SELECT camera, gid, min(text) AS plate FROM n WHERE k % 3 = 0 GROUP BY ALL) SELECT event_id, plate FROM o LEFT JOIN r ON r.camera = o.camera AND r.gid = o.gid")
def tracked_objects(spark, sf):
    o = obs(spark, sf)
    reads = plate_reads(o.where("k % 3 = 0")).groupBy("camera", F.col("track_id").alias("gid")).agg(F.min("text").alias("plate"))
    return o.join(reads, ["camera", "gid"], "left").select("event_id", "plate")


@query("fn24_25_fusion_rules", f"WITH {OBS} SELECT event_id, CASE WHEN k % 3 = 0 THEN 0.0 WHEN k % 2 = 0 THEN 0.55 ELSE 0.45 END::DOUBLE AS face_weight, CASE WHEN k * 10 > 600 THEN 0.3 WHEN k % 5 = 0 THEN 0.25 ELSE 0.2 END::DOUBLE AS thr FROM o")
def fusion_rules(spark, sf):
    weight = F.when(F.col("k") % 3 == 0, 0.0).when(F.col("k") % 2 == 0, 0.55).otherwise(0.45)
    return obs(spark, sf).select("event_id", weight.alias("face_weight"), F.when(F.col("k") * 10 > 600, 0.3).when(F.col("k") % 5 == 0, 0.25).otherwise(0.2).alias("thr"))


@query("fn26_display_score", f"""WITH {OBS}, s AS (SELECT event_id, quality, (100 + 3 * k)::DOUBLE AS h, (40 + gid % 100)::DOUBLE AS w FROM o)
SELECT event_id, round(0.45 * CASE WHEN h / w BETWEEN 2.0 AND 3.5 THEN 1.0 ELSE greatest(0.0, 1 - abs(h / w - 2.75) / 2.75) END + 0.35 * least(1.0, h / 300) + 0.2 * quality, 4) AS score FROM s""")
def display_score(spark, sf):
    return obs(spark, sf).select("event_id", sc.display_score((F.col("k") * 3 + 100).cast("double"), (F.col("gid") % 100 + 40).cast("double"), F.col("quality")).alias("score"))


@query("fn36_scope", f"WITH {OBS} SELECT gid, CASE WHEN count(DISTINCT camera) = (SELECT count(DISTINCT camera) FROM o) THEN 'all' ELSE string_agg(DISTINCT camera, ',' ORDER BY camera) END AS scope FROM o WHERE k < 30 GROUP BY gid")
def scope(spark, sf):
    o = obs(spark, sf)
    every = o.agg(F.count_distinct("camera").alias("every"))  # one row
    own = o.where("k < 30").groupBy("gid").agg(F.sort_array(F.collect_set("camera")).alias("cams"))
    return own.join(F.broadcast(every)).select("gid", F.when(F.size("cams") == F.col("every"), "all").otherwise(F.array_join("cams", ",")).alias("scope"))


@query("fn37_fresh_identity", f"WITH {OBS} SELECT event_id, abs((k - 50) / 100 + 0.001) <= 0.25 AS fresh, round(CAST(1 - quality AS DECIMAL(18, 6)), 3)::DOUBLE AS dist FROM o")
def fresh(spark, sf):
    verified = F.col("t") + (F.col("k") - 50) / 100 + 0.001
    return obs(spark, sf).select("event_id", (F.abs(verified - F.col("t")) <= 0.25).alias("fresh"), F.round((1 - F.col("quality")).cast("decimal(18,6)"), 3).cast("double").alias("dist"))


@query("snk13_snapshot_precedence", f"WITH {OBS} SELECT event_id, CASE k % 4 WHEN 0 THEN 'a' || k WHEN 1 THEN 'b' || k WHEN 2 THEN 'z' || k END AS ref FROM o")
def snapshot_precedence(spark, sf):
    crop = F.struct(F.concat(F.lit("b"), F.col("k")).alias("crop"))
    text = F.when(F.col("k") % 4 == 0, F.to_json(F.struct(F.concat(F.lit("a"), F.col("k")).alias("snapshot_ref"), crop.alias("payload")))).when(F.col("k") % 4 == 1, F.to_json(F.struct(crop.alias("payload"))))
    text = text.when(F.col("k") % 4 == 2, F.to_json(F.struct(F.lit("").alias("snapshot"), F.concat(F.lit("z"), F.col("k")).alias("frame")))).otherwise("not json")
    return obs(spark, sf).select("event_id", sc.snapshot_ref(text).alias("ref"))


@query("jn09_plate_parent", f"""WITH {BOXES}, f AS (SELECT *, us // 21600000000 AS frame FROM b), p AS (SELECT * FROM f WHERE camera = 'click'), v AS (SELECT * FROM f WHERE camera = 'view')
SELECT p.event_id AS plate, min(v.event_id) AS vehicle FROM p LEFT JOIN v ON v.frame = p.frame AND v.gid % 5 = p.gid % 5 AND (p.x1 + p.x2) / 2 BETWEEN v.x1 AND v.x2 AND (p.y1 + p.y2) / 2 BETWEEN v.y1 AND v.y2 GROUP BY p.event_id""")
def plate_parent(spark, sf):
    """Each plate's vehicle: of those in its frame and lane whose box holds its centre, the first."""
    f = ob.frames(boxed(spark, sf), 6 * 3600).withColumn("lane", F.col("gid") % 5)
    p, v = f.where("camera = 'click'").alias("p"), f.where("camera = 'view'").alias("v")
    x, y = (F.col("p.x1") + F.col("p.x2")) / 2, (F.col("p.y1") + F.col("p.y2")) / 2
    on = (F.col("p.frame") == F.col("v.frame")) & (F.col("p.lane") == F.col("v.lane")) & x.between(F.col("v.x1"), F.col("v.x2")) & y.between(F.col("v.y1"), F.col("v.y2"))
    return p.join(v, on, "left").groupBy(F.col("p.event_id").alias("plate")).agg(F.min("v.event_id").alias("vehicle"))


@query("jn25_latest_group", f"WITH {OBS}, g AS (SELECT name, arg_max('g' || k % 4, (us, event_id)) AS grp FROM o WHERE name IS NOT NULL AND k < 30 GROUP BY name) SELECT DISTINCT gid, grp FROM o LEFT JOIN g ON g.name = o.name")
def latest_group(spark, sf):
    o = obs(spark, sf)
    groups = o.where("name is not null and k < 30").groupBy("name").agg(F.max_by(F.concat(F.lit("g"), F.col("k") % 4), F.struct("us", "event_id")).alias("grp"))
    return o.select("gid", "name").distinct().join(groups, "name", "left").select("gid", "grp")


@query("agg09_use_case_state", f"""WITH {OBS}, d AS (SELECT camera, CASE WHEN k < 60 THEN 'side_a>side_b' ELSE 'side_b>side_a' END AS way, count(*) AS n FROM o GROUP BY ALL)
SELECT camera AS line, sum(n)::BIGINT AS total, string_agg(way || '=' || n, ';' ORDER BY way) AS directions FROM d GROUP BY camera""")
def use_case_state(spark, sf):
    hits = obs(spark, sf).select(F.col("camera").alias("line"), F.when(F.col("k") < 60, "side_a_to_side_b").otherwise("side_b_to_side_a").alias("direction"))
    per = hits.groupBy("line", "direction").agg(F.count("*").alias("n")).withColumn("d", F.split("direction", "_to_", 2))
    text = F.transform(F.sort_array(F.collect_list(F.struct("d", "n"))), lambda s: F.concat(F.array_join(s["d"], ">"), F.lit("="), s["n"]))
    return per.groupBy("line").agg(F.sum("n").alias("total"), F.array_join(text, ";").alias("directions"))


@query("set04_ordered_dedupe", f"WITH {OBS}, f AS (SELECT gid, camera, min((us, event_id)) AS first FROM o GROUP BY ALL) SELECT gid, string_agg(camera, ',' ORDER BY first) AS items FROM f GROUP BY gid")
def ordered_dedupe(spark, sf):
    """Each identity's cameras in the order in which it came to them."""
    first = obs(spark, sf).groupBy("gid", "camera").agg(F.min(F.struct("us", "event_id")).alias("first"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("first", "camera"))), lambda s: s["camera"])
    return first.groupBy("gid").agg(F.array_join(F.array_distinct(items), ",").alias("items"))


@query("set05_packs_to_stop", f"WITH {OBS} SELECT DISTINCT gid AS pack FROM o WHERE gid NOT IN (SELECT gid FROM o WHERE k = 7)")
def packs_to_stop(spark, sf):
    o = obs(spark, sf).select(F.col("gid").alias("pack"), "k")
    return o.select("pack").distinct().join(o.where("k = 7").select("pack"), "pack", "left_anti")


@query("win15_plate_events", f"WITH {OBS}, {_READS} SELECT DISTINCT camera, gid AS parent, text AS plate FROM n")
def plate_events(spark, sf):
    return plate_reads(obs(spark, sf)).select("camera", F.col("track_id").alias("parent"), F.col("text").alias("plate")).dropDuplicates(["camera", "parent", "plate"])


@query("idn06_link_reassign", f"WITH {OBS} SELECT gid AS person, first('n' || k % 4 ORDER BY quality DESC, event_id) AS name FROM o WHERE k % 3 > 0 GROUP BY gid")
def link_reassign(spark, sf):
    """A person's name: the surest one that wasn't revoked, the first on ties."""
    kept = obs(spark, sf).where("k % 3 > 0")
    return kept.groupBy(F.col("gid").alias("person")).agg(F.min_by(F.concat(F.lit("n"), F.col("k") % 4), F.struct(-F.col("quality"), F.col("event_id"))).alias("name"))
