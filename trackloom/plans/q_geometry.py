"""Projections, filters, zones and gates over observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import geometry as g
from trackloom.functions import scalars as sc
from trackloom.operators import observations as ob
from trackloom.operators import zones as zn
from trackloom.plans.catalog import BOXES, OBS, query, table

ZONE = [(0.1, 0.2), (0.5, 0.05), (0.9, 0.3), (0.7, 0.95), (0.2, 0.8)]
MASK = [(0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6)]
#: (camera or default, zone, corners); a camera with zones of its own has no default ones.
ZONES = [("default", "hall", ZONE), ("click", "door", [(0.05, 0.05), (0.95, 0.05), (0.95, 0.5), (0.05, 0.5)]), ("click", "desk", [(0.3, 0.3), (0.8, 0.3), (0.5, 0.9)])]
LINE = (0.5, 0.1, 0.5, 0.9)
LINES = [("click", "gate", 0.5, 0.1, 0.5, 0.9), ("view", "fence", 0.1, 0.5, 0.9, 0.6)]
H = [1.2, 0.1, 5.0, 0.05, 0.9, 3.0, 0.001, 0.002, 1.0]


def obs(spark: SparkSession, sf: str) -> DataFrame:
    return ob.from_events(table(spark, sf, "events"))


def boxed(spark: SparkSession, sf: str) -> DataFrame:
    return ob.boxes(obs(spark, sf))


def sql_edges(points: list) -> str:
    return ", ".join(f"({points[i][0]}::DOUBLE, {points[i][1]}::DOUBLE, {points[i - 1][0]}::DOUBLE, {points[i - 1][1]}::DOUBLE)" for i in range(len(points)))


def sql_inside(points: list, x: str = "x", y: str = "y") -> str:
    """The even-odd rule, edge by edge."""
    parts = []
    for i in range(len(points)):
        (a, b), (c, d) = points[i], points[i - 1]
        rise = d - b if d != b else 1e-9
        parts.append(f"(CASE WHEN ({b}::DOUBLE > {y}) <> ({d}::DOUBLE > {y}) AND {x} < ({c}::DOUBLE - {a}::DOUBLE) * ({y} - {b}::DOUBLE) / {'(' + str(d) + '::DOUBLE - ' + str(b) + '::DOUBLE)' if d != b else rise} + {a}::DOUBLE THEN 1 ELSE 0 END)")
    return f"(({' + '.join(parts)}) % 2 = 1)"


def inside(points: list = ZONE, x: str = "x", y: str = "y"):
    return g.in_fixed_polygon(F.col(x), F.col(y), points)


r6 = lambda c, n: F.round(c, 6).alias(n)


@query("prj01_foot_point", f"WITH {BOXES} SELECT event_id, round((x1 + x2) / 2, 6) AS fx, round(y2, 6) AS fy FROM b")
def foot_point(spark, sf):
    x, y = g.foot(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    return boxed(spark, sf).select("event_id", r6(x, "fx"), r6(y, "fy"))


@query("prj02_centre", f"WITH {BOXES} SELECT event_id, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy FROM b")
def centre(spark, sf):
    x, y = g.centre(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    return boxed(spark, sf).select("event_id", r6(x, "cx"), r6(y, "cy"))


@query("prj03_box_payload", f"""WITH {BOXES}, i AS (SELECT event_id, trunc(x1)::INT AS x1, trunc(y1)::INT AS y1, trunc(x2)::INT AS x2, trunc(y2)::INT AS y2 FROM b)
SELECT *, greatest(0, x2 - x1) AS width, greatest(0, y2 - y1) AS height FROM i""")
def box_payload(spark, sf):
    return boxed(spark, sf).select("event_id", g.box_payload(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]).alias("p")).select("event_id", "p.*")


@query("prj04_clip_box", f"""WITH {BOXES}, c AS (SELECT event_id, greatest(0, least(x1, 1920)) AS x1, greatest(0, least(y1, 1080)) AS y1, greatest(0, least(x2, 1920)) AS x2, greatest(0, least(y2, 1080)) AS y2 FROM b)
SELECT event_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM c WHERE x2 > x1 AND y2 > y1""")
def clip_box(spark, sf):
    c = boxed(spark, sf).select("event_id", g.clip_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], ob.FRAME_W, ob.FRAME_H).alias("c")).where("c is not null")
    return c.select("event_id", *[r6(F.col(f"c.{k}"), k) for k in ("x1", "y1", "x2", "y2")])


@query("prj06_normalise", f"""WITH {BOXES} SELECT event_id, CASE WHEN k % 10 <> 0 THEN round(x2 / 1920, 6) END AS nx, CASE WHEN k % 10 <> 0 THEN round(y2 / 1080, 6) END AS ny FROM b""")
def normalise(spark, sf):
    width = F.when(F.col("k") % 10 == 0, F.lit(0.0)).otherwise(F.lit(ob.FRAME_W))
    x, y = g.normalised(F.col("x2"), F.col("y2"), width, F.lit(ob.FRAME_H))
    return boxed(spark, sf).select("event_id", r6(x, "nx"), r6(y, "ny"))


@query("prj07_scale_geometry", "SELECT * FROM (VALUES (1, '[{\"x\":0.0,\"y\":0.0},{\"x\":200.0,\"y\":0.0},{\"x\":200.0,\"y\":50.0},{\"x\":0.0,\"y\":50.0}]'), (2, '[{\"x\":1.0,\"y\":2.0},{\"x\":3.0,\"y\":4.0},{\"x\":5.0,\"y\":6.0}]')) t(id, points)")
def scale_geometry(spark, sf):
    rows = spark.createDataFrame([(1, [(0.0, 0.0), (100.0, 25.0)], 1920.0, 1080.0, 960.0, 540.0), (2, [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)], 1920.0, 1080.0, None, None)], "id int, p array<struct<x:double,y:double>>, fw double, fh double, sw double, sh double")
    return rows.select("id", F.to_json(g.scaled_points(F.col("p"), F.col("fw"), F.col("fh"), F.col("sw"), F.col("sh"))).alias("points"))


@query("prj09_point_in_polygon", f"WITH {OBS} SELECT event_id, camera FROM o WHERE {sql_inside(ZONE)}")
def point_in_polygon(spark, sf):
    return obs(spark, sf).where(inside()).select("event_id", "camera")


@query("prj10_12_line_side", f"""WITH {OBS}, s AS (SELECT event_id, (0.9 - 0.1)::DOUBLE * (y - 0.5) - (0.6 - 0.5)::DOUBLE * (x - 0.1) AS s FROM o)
SELECT event_id, round(s, 6) + 0 AS side, CASE WHEN s < 0 THEN 'side_a' ELSE 'side_b' END AS label, round(s / sqrt((0.9 - 0.1)::DOUBLE * (0.9 - 0.1)::DOUBLE + (0.6 - 0.5)::DOUBLE * (0.6 - 0.5)::DOUBLE), 6) + 0 AS dist FROM s""")
def line_side(spark, sf):
    line = (0.1, 0.5, 0.9, 0.6)
    s = g.side(F.col("x"), F.col("y"), *line)
    return obs(spark, sf).select("event_id", (F.round(s, 6) + 0).alias("side"), g.side_label(s).alias("label"), (F.round(g.line_distance(F.col("x"), F.col("y"), *line), 6) + 0).alias("dist"))


_PREV = f"WITH {OBS}, p AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM o WINDOW w AS (PARTITION BY camera, gid ORDER BY us, event_id))"


@query("prj13_crossed_line", f"{_PREV} SELECT event_id FROM p WHERE ((px - 0.5) * (x - 0.5)) < 0")
def crossed_line(spark, sf):
    s = g.side(F.col("x"), F.col("y"), *LINE)
    rows = obs(spark, sf).withColumn("s", s).withColumn("p", ob.before("s"))
    return rows.where(g.crossed(F.col("p"), F.col("s"))).select("event_id")


_SEG = [(1, 0, 0, 10, 10, 0, 10, 10, 0), (2, 0, 0, 10, 0, 10, 0, 20, 0), (3, 0, 0, 10, 0, 5, 0, 5, 5), (4, 0, 0, 1, 1, 5, 5, 6, 7), (5, 0, 0, 10, 0, 0, 1, 10, 1)]


@query("prj14_15_segments", "SELECT * FROM (VALUES (1, true, true), (2, true, false), (3, true, true), (4, false, false), (5, false, false)) t(id, meet, strict)")
def segments(spark, sf):
    rows = spark.createDataFrame([(i, *map(float, r)) for i, *r in _SEG], "id int, ax double, ay double, bx double, by double, cx double, cy double, dx double, dy double")
    p = [(F.col(f"{k}x"), F.col(f"{k}y")) for k in "abcd"]
    return rows.select("id", g.segments_meet(*p).alias("meet"), g.segments_cross(*p).alias("strict"))


@query("prj16_line_touches_zone", "SELECT * FROM (VALUES (1, true), (2, true), (3, false), (4, false)) t(id, touches)")
def touches(spark, sf):
    kind = "array<struct<x:double,y:double>>"
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    rows = spark.createDataFrame([(1, [(-1.0, 2.0), (5.0, 2.5)], square), (2, [(1.0, 1.0), (9.0, 9.0)], square), (3, [(5.0, 5.0), (9.0, 5.0)], square), (4, [(1.0, 1.0)], square)], f"id int, line {kind}, zone {kind}")
    return rows.select("id", g.line_touches_zone(F.col("line"), F.col("zone")).alias("touches"))


@query("prj17_19_directions", f"""{_PREV}, d AS (SELECT event_id, x - px AS dx, y - py AS dy, px - 0.5 AS a, x - 0.5 AS b FROM p WHERE px IS NOT NULL)
SELECT event_id, ['east', 'south_east', 'south', 'south_west', 'west', 'north_west', 'north', 'north_east'][(floor((((degrees(atan2(dy, dx)) + 360) % 360) + 22.5) / 45) % 8)::INT + 1] AS compass,
  CASE WHEN dy * 0.8::DOUBLE >= 0 THEN 'a_to_b' ELSE 'b_to_a' END AS along,
  CASE WHEN -a < 0 THEN 'side_a' ELSE 'side_b' END || '_to_' || CASE WHEN -b < 0 THEN 'side_a' ELSE 'side_b' END AS sides FROM d""")
def directions(spark, sf):
    s = g.side(F.col("x"), F.col("y"), *LINE)
    rows = obs(spark, sf).withColumn("s", s).withColumns({"px": ob.before("x"), "py": ob.before("y"), "ps": ob.before("s")}).where("px is not null")
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    return rows.select("event_id", g.compass(dx, dy).alias("compass"), g.endpoint_direction(dx, dy, *LINE).alias("along"), g.crossing_sides(F.col("ps"), F.col("s")).alias("sides"))


@query("prj20_iou_pairs", f"""WITH {BOXES}, f AS (SELECT *, us // 3600000000 AS frame FROM b)
, p AS (SELECT a.event_id AS a, c.event_id AS b, greatest(0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0, least(a.y2, c.y2) - greatest(a.y1, c.y1)) AS i,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) AS s FROM f a JOIN f c ON a.camera = c.camera AND a.frame = c.frame AND a.event_id < c.event_id)
SELECT a, b, CASE WHEN s - i > 0 THEN round(i / (s - i), 6) ELSE 0 END AS iou FROM p""")
def iou_pairs(spark, sf):
    f = ob.frames(boxed(spark, sf)).select("camera", "frame", "event_id", "x1", "y1", "x2", "y2")
    a, b = f.alias("a"), f.alias("b")
    box = lambda s: tuple(F.col(f"{s}.{c}") for c in ("x1", "y1", "x2", "y2"))
    on = (F.col("a.camera") == F.col("b.camera")) & (F.col("a.frame") == F.col("b.frame")) & (F.col("a.event_id") < F.col("b.event_id"))
    return a.join(b, on).select(F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b"), r6(g.iou(box("a"), box("b")), "iou"))


_MAP = f"WITH {OBS}, q AS (SELECT *, 0.001 * x + 0.002 * y + 1.0 AS w FROM o), m AS (SELECT event_id, camera, gid, us, (1.2 * x + 0.1 * y + 5.0) / w AS mx, (0.05 * x + 0.9 * y + 3.0) / w AS my FROM q)"


@query("prj21_homography", f"{_MAP} SELECT event_id, round(mx, 1) AS mx, round(my, 1) AS my FROM m WHERE abs(mx * 10 - floor(mx * 10) - 0.5) > 1e-6 AND abs(my * 10 - floor(my * 10) - 0.5) > 1e-6")
def homography(spark, sf):
    x, y = g.project(F.col("x"), F.col("y"), H)
    rows = obs(spark, sf).select("event_id", x.alias("mx"), y.alias("my"))
    tie = lambda c: F.abs(F.col(c) * 10 - F.floor(F.col(c) * 10) - 0.5) > 1e-6
    return rows.where(tie("mx") & tie("my")).select("event_id", F.round("mx", 1).alias("mx"), F.round("my", 1).alias("my"))


@query("prj22_homography_fit", "SELECT * FROM (VALUES (1, 6.3::DOUBLE, 3.95::DOUBLE), (2, 5.0, 3.0)) t(id, mx, my)")
def homography_fit(spark, sf):
    image = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.5, 0.25)]
    plane = [(1.2 * x + 0.1 * y + 5.0, 0.05 * x + 0.9 * y + 3.0) for x, y in image]
    rows = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.0, 0.0)], "id int, x double, y double")
    x, y = g.project(F.col("x"), F.col("y"), g.fit_homography(image, plane))
    return rows.select("id", r6(x, "mx"), r6(y, "my"))


@query("prj23_map_bounds", f"{_MAP} SELECT event_id FROM m WHERE mx BETWEEN 5.5 - 0.15 * 0.6 AND 6.1 + 0.15 * 0.6 AND my BETWEEN 3.2 - 0.15 * 0.5 AND 3.7 + 0.15 * 0.5")
def map_bounds(spark, sf):
    x, y = g.project(F.col("x"), F.col("y"), H)
    m = 0.15
    return obs(spark, sf).select("event_id", x.alias("mx"), y.alias("my")).where(F.col("mx").between(5.5 - m * 0.6, 6.1 + m * 0.6) & F.col("my").between(3.2 - m * 0.5, 3.7 + m * 0.5)).select("event_id")


@query("flt01_class_filter", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')")
def class_filter(spark, sf):
    return table(spark, sf, "events").where(F.col("event_type").isin("click", "view")).select("event_id", "event_type")


@query("flt02_mask_roi", f"WITH {OBS} SELECT event_id FROM o WHERE camera = 'view' AND NOT {sql_inside(MASK)} AND {sql_inside(ZONE)}")
def mask_roi(spark, sf):
    return obs(spark, sf).where((F.col("camera") == "view") & ~inside(MASK) & inside(ZONE)).select("event_id")


def _sql_zones(what: str) -> str:
    parts = [f"SELECT {what}, '{z}' AS zone FROM o WHERE {'camera = ' + repr(c) if c != 'default' else 'camera <> ' + repr('click')} AND {sql_inside(p)}" for c, z, p in ZONES]
    return f"WITH {OBS}, z AS ({' UNION ALL '.join(parts)})"


@query("flt03_in_any_zone", f"{_sql_zones('event_id')} SELECT DISTINCT event_id FROM z")
def in_any_zone(spark, sf):
    return obs(spark, sf).where(zn.in_any_zone(ZONES, F.col("camera"), F.col("x"), F.col("y"))).select("event_id")


@query("flt04_zone_tags", f"{_sql_zones('event_id')} SELECT event_id, string_agg(zone, ',' ORDER BY zone) AS zones FROM z GROUP BY event_id")
def zone_tags(spark, sf):
    tags = zn.zone_tags(ZONES, F.col("camera"), F.col("x"), F.col("y"))
    return obs(spark, sf).select("event_id", F.array_join(tags, ",").alias("zones")).where("zones <> ''")


@query("flt07_body_seed_gate", f"WITH {BOXES} SELECT event_id FROM b WHERE y2 - y1 >= 120 AND (y2 - y1) / (x2 - x1) BETWEEN 1.0 AND 3.5 AND x1 >= 10 AND x2 <= 1910 AND y1 >= 10 AND y2 <= 1070 AND quality >= 0.2")
def body_seed(spark, sf):
    h, w = F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")
    return boxed(spark, sf).where((h >= 120) & (h / w).between(1.0, 3.5) & (F.col("x1") >= 10) & (F.col("x2") <= 1910) & (F.col("y1") >= 10) & (F.col("y2") <= 1070) & (F.col("quality") >= 0.2)).select("event_id")


@query("flt08_body_continue_gate", f"WITH {BOXES} SELECT event_id FROM b WHERE y2 - y1 >= 80 AND (y2 - y1) / (x2 - x1) BETWEEN 0.8 AND 4.5 AND quality >= 0.05")
def body_continue(spark, sf):
    h, w = F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")
    return boxed(spark, sf).where((h >= 80) & (h / w).between(0.8, 4.5) & (F.col("quality") >= 0.05)).select("event_id")


@query("flt11_alert_strength", "SELECT event_id FROM events WHERE event_type <> 'click' OR coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) <= 45, true)")
def alert_strength(spark, sf):
    dist = F.get_json_object("props", "$.k").try_cast("double")
    return table(spark, sf, "events").where((F.col("event_type") != "click") | F.coalesce(dist <= 45, F.lit(True))).select("event_id")


@query("flt12_event_type_exclusion", "SELECT event_id FROM events WHERE event_type NOT IN ('click', 'error')")
def type_exclusion(spark, sf):
    return table(spark, sf, "events").where(~F.col("event_type").isin("click", "error")).select("event_id")


@query("flt13_live_cameras", f"WITH {OBS} SELECT event_id FROM o WHERE camera IN ('view', 'click')")
def live_cameras(spark, sf):
    live = ["view", "click"]
    camera = F.col("camera")
    return obs(spark, sf).where(camera.isNull() | F.lit(not live) | camera.isin(live)).select("event_id")


@query("jn10_observation_zone", f"{_sql_zones('event_id')} SELECT event_id, zone FROM z")
def observation_zone(spark, sf):
    return obs(spark, sf).select("event_id", F.explode(zn.zone_tags(ZONES, F.col("camera"), F.col("x"), F.col("y"))).alias("zone"))


@query("jn11_observation_line", f"""WITH {OBS}, l(camera, line, ax, ay, bx, by_) AS (VALUES ('click', 'gate', 0.5::DOUBLE, 0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE), ('view', 'fence', 0.1, 0.5, 0.9, 0.6))
SELECT event_id, line, sign((bx - ax) * (y - ay) - (by_ - ay) * (x - ax))::INT AS side FROM o JOIN l USING (camera)""")
def observation_line(spark, sf):
    lines = spark.createDataFrame(LINES, "camera string, line string, ax double, ay double, bx double, by double")
    s = g.side(F.col("x"), F.col("y"), *[F.col(c) for c in ("ax", "ay", "bx", "by")])
    return obs(spark, sf).join(lines, "camera").select("event_id", "line", F.signum(s).cast("int").alias("side"))
