"""Queries over the order of observations: visits, crossings, dwell, absence, cooldowns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions import geometry as g
from trackloom.operators import joins as jn
from trackloom.operators import observations as ob
from trackloom.operators import sequence as sq
from trackloom.operators import visits as vi
from trackloom.plans.catalog import BOXES, OBS, VISITS, query
from trackloom.plans.q_geometry import LINE, ZONE, boxed, inside, obs, sql_inside

DAY = 86_400.0
_IN = f"WITH {OBS}, z AS (SELECT *, {sql_inside(ZONE)} AS inz FROM o)"
_TRACK = "(PARTITION BY camera, gid ORDER BY us, event_id)"


@query("visits", f"WITH {VISITS} SELECT gid, camera, us_start, us_end, n_obs, quality, best_event, name, map_x, map_y FROM v")
def visits(spark, sf):
    """AGG-1 and WIN-27."""
    return vi.visits(obs(spark, sf))


@query("flt09_visit_gate", f"WITH {VISITS} SELECT gid, camera, us_start, n_obs FROM v WHERE n_obs >= 3 AND (us_end - us_start) / 1e6 >= 0.5")
def visit_gate(spark, sf):
    return vi.gated(vi.visits(obs(spark, sf))).select("gid", "camera", "us_start", "n_obs")


@query("win01_previous_point", f"WITH {OBS} SELECT event_id, lag(x) OVER w AS px, lag(y) OVER w AS py FROM o WINDOW w AS {_TRACK}")
def previous_point(spark, sf):
    return obs(spark, sf).select("event_id", ob.before("x").alias("px"), ob.before("y").alias("py"))


_CROSS = f"""WITH {OBS}, s AS (SELECT *, -(0.9 - 0.1)::DOUBLE * (x - 0.5) AS s FROM o), p AS (SELECT *, lag(s) OVER w AS p FROM s WINDOW w AS {_TRACK}),
c AS (SELECT event_id, camera, gid, us, CASE WHEN s < 0 THEN 'in' ELSE 'out' END AS direction FROM p WHERE p IS NOT NULL AND (p > 0) <> (s > 0) AND s <> 0)"""


@query("win02_03_line_crossing", f"""{_CROSS} SELECT event_id, camera, gid, us, direction, count(*) FILTER (direction = 'in') OVER w AS n_in, count(*) FILTER (direction = 'out') OVER w AS n_out
FROM c WINDOW w AS (PARTITION BY camera ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)""")
def line_crossing(spark, sf):
    return sq.line_crossings(obs(spark, sf), LINE)


@query("agg08_line_counters", f"{_CROSS} SELECT camera, count(*) FILTER (direction = 'in') AS n_in, count(*) FILTER (direction = 'out') AS n_out, count(*) AS total FROM c GROUP BY camera")
def line_counters(spark, sf):
    n = lambda d: F.count_if(F.col("direction") == d).alias(f"n_{d}")
    return sq.line_crossings(obs(spark, sf), LINE).groupBy("camera").agg(n("in"), n("out"), F.count("*").alias("total"))


@query("win04_intrusion", f"{_IN}, i AS (SELECT *, row_number() OVER {_TRACK} AS i FROM z), p AS (SELECT *, lag(i) OVER {_TRACK} AS p FROM i WHERE inz) SELECT event_id, camera, gid FROM p WHERE p IS NULL OR i - p - 1 >= 2")
def intrusion(spark, sf):
    return sq.entries(obs(spark, sf), inside()).select("event_id", "camera", "gid")


@query("win05_loitering", f"""{_IN}, c AS (SELECT *, CASE WHEN inz = lag(inz) OVER {_TRACK} THEN 0 ELSE 1 END AS c FROM z), r AS (SELECT *, sum(c) OVER {_TRACK} AS run FROM c),
d AS (SELECT *, (us - min(us) OVER (PARTITION BY camera, gid, run)) / 1e6 AS d FROM r WHERE inz), f AS (SELECT *, row_number() OVER (PARTITION BY camera, gid, run ORDER BY us, event_id) AS n FROM d WHERE d >= 86400)
SELECT event_id, camera, gid, round(d, 1) AS dwell_s FROM f WHERE n = 1""")
def loitering(spark, sf):
    return sq.dwells(obs(spark, sf), inside(), DAY).select("event_id", "camera", "gid", "dwell_s")


@query("win06_absence", f"""{_IN}, l AS (SELECT camera, us, coalesce(max(us) FILTER (inz) OVER w, min(us) OVER w) AS last FROM z WINDOW w AS (PARTITION BY camera ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))
SELECT camera, min(us) AS us, (min(us) - last) / 1e6 AS empty_s FROM l WHERE (us - last) / 1e6 > 7200 GROUP BY camera, last""")
def absence(spark, sf):
    return sq.absences(obs(spark, sf), inside(), 7200)


@query("win07_stopped", f"""{_IN}, r AS (SELECT *, x * 1920 AS px, y * 1080 AS py FROM z WHERE inz), m AS (SELECT *, CASE WHEN sqrt((px - lag(px) OVER {_TRACK}) ** 2 + (py - lag(py) OVER {_TRACK}) ** 2) <= 300 THEN 0 ELSE 1 END AS m FROM r),
s AS (SELECT *, sum(m) OVER {_TRACK} AS stop FROM m), d AS (SELECT *, (us - min(us) OVER (PARTITION BY camera, gid, stop)) / 1e6 AS d FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY camera, gid, stop ORDER BY us, event_id) AS n FROM d WHERE d >= 3600) SELECT event_id, camera, gid, us, d AS duration_s FROM f WHERE n = 1""")
def stopped(spark, sf):
    return sq.stopped(obs(spark, sf), inside(), F.col("x") * 1920, F.col("y") * 1080, 300.0, 3600.0)


@query("win08_parking", f"""{_IN}, d AS (SELECT *, (us - min(us) OVER (PARTITION BY camera, gid)) // 100000 AS tenths FROM z WHERE inz),
f AS (SELECT *, row_number() OVER (PARTITION BY camera, gid ORDER BY us, event_id) AS n FROM d WHERE tenths >= 150) SELECT event_id, camera, gid, us, tenths FROM f WHERE n = 1""")
def parking(spark, sf):
    return sq.parked(obs(spark, sf), inside())


@query("win09_stable_crossing")
def stable_crossing(spark, sf):
    rows = boxed(spark, sf).withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2, "px": F.col("x") * 1920, "py": F.col("y2")})
    return sq.stable_crossings(rows, (960.0, 108.0, 960.0, 972.0))


@query("win10_direct_crossing", f"""WITH {BOXES}, p AS (SELECT event_id, (x1 + x2) / 2 AS cx, y2 AS cy, lag((x1 + x2) / 2) OVER w AS px, lag(y2) OVER w AS py FROM b WINDOW w AS {_TRACK})
SELECT event_id FROM p WHERE sqrt((cx - px) ** 2 + (cy - py) ** 2) >= 8 AND (px - 960) * (cx - 960) < 0 AND (py + (cy - py) * (960 - px) / (cx - px)) BETWEEN 108 AND 972""")
def direct_crossing(spark, sf):
    rows = boxed(spark, sf).withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": F.col("y2")})
    rows = rows.withColumns({"px": ob.before("cx"), "py": ob.before("cy")})
    return rows.where(sq.direct_crossing((F.col("px"), F.col("py")), (F.col("cx"), F.col("cy")), (960.0, 108.0, 960.0, 972.0))).select("event_id")


def _greedy(seconds: int, where: str = "true") -> str:
    """Next row at least so long after the last that fired, by recursion."""
    return f"""WITH RECURSIVE {OBS}, q AS (SELECT * FROM o WHERE {where}), f AS (SELECT camera, gid, min(us) AS us FROM q GROUP BY camera, gid
UNION ALL SELECT f.camera, f.gid, (SELECT min(us) FROM q WHERE q.camera = f.camera AND q.gid = f.gid AND q.us >= f.us + {seconds}000000) FROM f WHERE f.us IS NOT NULL)
SELECT camera, gid, us FROM f WHERE us IS NOT NULL"""


@query("win11_first_time_ttl", _greedy(604_800))
def first_time_ttl(spark, sf):
    return sq.cooldown(obs(spark, sf).select("camera", "gid", "us", "event_id"), ["camera", "gid"], 604_800).select("camera", "gid", "us")


@query("win12_wrong_way", f"""WITH {OBS}, p AS (SELECT *, x * 1920 AS px, y * 1080 AS py FROM o), d AS (SELECT *, px - lag(px) OVER {_TRACK} AS dx, py - lag(py) OVER {_TRACK} AS dy FROM p)
SELECT event_id FROM d WHERE sqrt(dx * dx + dy * dy) >= 3 AND {sql_inside(ZONE)} AND dx * 1.0 + dy * 0.25 > 0""")
def wrong_way(spark, sf):
    rows = obs(spark, sf).withColumns({"px": F.col("x") * 1920, "py": F.col("y") * 1080})
    return sq.wrong_way(rows, (1.0, 0.25), inside()).select("event_id")


@query("win13_zone_alert_once", f"{_IN} SELECT camera, gid, min(us) AS us FROM z WHERE inz GROUP BY camera, gid")
def zone_alert(spark, sf):
    return obs(spark, sf).where(inside()).groupBy("camera", "gid").agg(F.min("us").alias("us"))


_P = f"{_IN}, p AS (SELECT *, lag(x) OVER {_TRACK} AS px, lag(inz) OVER {_TRACK} AS pin FROM z)"


@query("win14_counting", f"""{_P}, c AS (SELECT *, CASE WHEN px < 0.5 THEN 'right' ELSE 'left' END AS direction, row_number() OVER {_TRACK} AS n FROM p WHERE (px - 0.5) * (x - 0.5) < 0 AND (inz OR pin))
SELECT event_id, camera, direction, count(*) OVER w AS total, count(*) OVER d AS direction_count FROM c WHERE n = 1
WINDOW w AS (PARTITION BY camera ORDER BY us, event_id ROWS UNBOUNDED PRECEDING), d AS (PARTITION BY camera, direction ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)""")
def counting(spark, sf):
    rows = obs(spark, sf).withColumn("inz", inside()).withColumns({"px": ob.before("x"), "pin": ob.before("inz")})
    rows = rows.where(((F.col("px") - 0.5) * (F.col("x") - 0.5) < 0) & (F.col("inz") | F.col("pin"))).withColumn("n", F.row_number().over(ob.per_track())).where("n = 1")
    rows = rows.withColumn("direction", F.when(F.col("px") < 0.5, "right").otherwise("left"))
    so_far = lambda *k: F.count("*").over(Window.partitionBy(*k).orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("event_id", "camera", "direction", so_far("camera").alias("total"), so_far("camera", "direction").alias("direction_count"))


@query("win17_arrivals", f"{VISITS.replace('o AS', 'WITH o AS', 1)}, n AS (SELECT *, lag(us) OVER (PARTITION BY name, camera ORDER BY us, event_id) AS p FROM o WHERE name IS NOT NULL) SELECT event_id, name, camera FROM n WHERE p IS NULL OR (us - p) / 1e6 > 86400")
def arrivals(spark, sf):
    return sq.arrivals(obs(spark, sf).where("name is not null"), ["name", "camera"], DAY).select("event_id", "name", "camera")


@query("win18_watch_realert", _greedy(432_000, "name IS NOT NULL"))
def watch(spark, sf):
    rows = obs(spark, sf).where("name is not null").select("camera", "gid", "us", "event_id")
    return sq.cooldown(rows, ["camera", "gid"], 432_000).select("camera", "gid", "us")


@query("win19_call_cooldown", _greedy(259_200))
def call_cooldown(spark, sf):
    return sq.cooldown(obs(spark, sf).select("camera", "gid", "us", "event_id"), ["camera", "gid"], 259_200).select("camera", "gid", "us")


@query("win20_name_hold", f"""WITH {OBS}, q AS (SELECT *, CASE WHEN k % 3 = 0 THEN name END AS nm FROM o), h AS (SELECT event_id, us, last_value(nm IGNORE NULLS) OVER w AS nm, max(us) FILTER (nm IS NOT NULL) OVER w AS seen
FROM q WINDOW w AS (PARTITION BY camera, gid ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)) SELECT event_id, CASE WHEN (us - seen) / 1e6 <= 86400 THEN nm END AS shown FROM h""")
def name_hold(spark, sf):
    rows = obs(spark, sf).withColumn("name", F.when(F.col("k") % 3 == 0, F.col("name")))
    return sq.held_names(rows, DAY).select("event_id", "shown")


@query("win21_alert_window", f"WITH {OBS}, m AS (SELECT max(us) AS now FROM o) SELECT event_id FROM o, m WHERE (now - us) / 1e6 <= 86400")
def alert_window(spark, sf):
    rows = obs(spark, sf)
    now = rows.agg(F.max("us").alias("now"))  # one row
    return rows.join(F.broadcast(now)).where((F.col("now") - F.col("us")) / 1e6 <= DAY).select("event_id")


_BY_ONE = "q AS (SELECT event_id, camera, gid, k % {m} AS v, row_number() OVER (PARTITION BY camera, gid ORDER BY us, event_id) AS n FROM o)"


@query("win23_id_hysteresis", f"""WITH RECURSIVE {OBS}, {_BY_ONE.format(m=3)}, w AS (SELECT camera, gid, n, event_id, v, v AS held, NULL::BIGINT AS rival, 0 AS c FROM q WHERE n = 1
UNION ALL SELECT q.camera, q.gid, q.n, q.event_id, q.v, CASE WHEN q.v <> w.held AND q.v = w.rival AND w.c + 1 >= 2 THEN q.v ELSE w.held END, CASE WHEN q.v = w.held OR q.v = w.rival AND w.c + 1 >= 2 THEN NULL ELSE q.v END,
CASE WHEN q.v = w.held THEN 0 WHEN q.v = w.rival THEN CASE WHEN w.c + 1 >= 2 THEN 0 ELSE w.c + 1 END ELSE 1 END FROM w JOIN q ON q.camera = w.camera AND q.gid = w.gid AND q.n = w.n + 1) SELECT event_id, v AS value, held FROM w""")
def id_hysteresis(spark, sf):
    rows = obs(spark, sf).select("camera", "gid", "us", "event_id", (F.col("k") % 3).alias("value"))
    return sq.hysteresis(rows, ["camera", "gid"], "value", 2).select("event_id", "value", "held")


@query("win24_confirm_colocation", f"""WITH {OBS}, f AS (SELECT us // 86400000000 AS tick, gid, x, y FROM o), p AS (SELECT DISTINCT a.gid AS a, b.gid AS b, tick FROM f a JOIN f b USING (tick) WHERE a.gid < b.gid AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.1 * 0.1),
r AS (SELECT *, tick - row_number() OVER (PARTITION BY a, b ORDER BY tick) AS run FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY a, b, run ORDER BY tick) AS k FROM r) SELECT a, b, tick FROM k WHERE k = 3""")
def confirm(spark, sf):
    rows = ob.frames(obs(spark, sf), 86_400).withColumnRenamed("frame", "tick")
    return sq.confirmed_near(rows, "tick", "gid", 0.1, 3)


@query("win25_camera_history", f"""WITH {OBS}, c AS (SELECT *, lag(camera) OVER (PARTITION BY gid ORDER BY us, event_id) AS p FROM o)
SELECT gid, string_agg(camera, '>' ORDER BY us, event_id) AS path, count(*) AS n FROM c WHERE p IS NULL OR p <> camera GROUP BY gid""")
def camera_history(spark, sf):
    p = F.lag("camera").over(Window.partitionBy("gid").orderBy("us", "event_id"))
    rows = obs(spark, sf).withColumn("p", p).where("p is null or p <> camera")
    steps = F.sort_array(F.collect_list(F.struct("us", "event_id", "camera")))
    return rows.groupBy("gid").agg(F.array_join(F.transform(steps, lambda s: s["camera"]), ">").alias("path"), F.count("*").alias("n"))


@query("win25_trajectory_tail", f"WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY us DESC, event_id DESC) AS n FROM o) SELECT gid, event_id, n FROM r WHERE n <= 12")
def trajectory(spark, sf):
    n = F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("us"), F.desc("event_id")))
    return obs(spark, sf).select("gid", "event_id", n.alias("n")).where("n <= 12")


@query("idn46_confirm_counter", f"""WITH RECURSIVE {OBS}, {_BY_ONE.format(m=2)}, w AS (SELECT camera, gid, n, event_id, NULL::BIGINT AS held, v AS candidate, 1 AS c FROM q WHERE n = 1
UNION ALL SELECT s.camera, s.gid, s.n, s.event_id, CASE WHEN same THEN held WHEN c2 >= 3 THEN who ELSE held END, CASE WHEN same THEN candidate WHEN c2 >= 3 OR c2 <= 0 THEN NULL ELSE who END, CASE WHEN same THEN c WHEN c2 >= 3 OR c2 <= 0 THEN 0 ELSE c2 END
FROM (SELECT q.camera, q.gid, q.n, q.event_id, w.held, w.candidate, w.c, coalesce(q.v = w.held, false) AS same, coalesce(w.candidate, q.v) AS who, CASE WHEN w.candidate IS NULL THEN 1 WHEN q.v = w.candidate THEN w.c + 1 ELSE w.c - 1 END AS c2
FROM w JOIN q ON q.camera = w.camera AND q.gid = w.gid AND q.n = w.n + 1) s) SELECT event_id, held FROM w""")
def confirm_counter(spark, sf):
    rows = obs(spark, sf).select("camera", "gid", "us", "event_id", (F.col("k") % 2).alias("value"))
    return sq.confirmed_counter(rows, ["camera", "gid"], "value").select("event_id", "held")


@query("str02_batch_clock", f"WITH {OBS} SELECT us // 86400000000 AS batch, max(us) AS tick FROM o GROUP BY 1")
def batch_clock(spark, sf):
    return ob.frames(obs(spark, sf), 86_400).groupBy(F.col("frame").alias("batch")).agg(F.max("us").alias("tick"))


@query("str09_frame_skipping", f"WITH {OBS}, n AS (SELECT event_id, row_number() OVER (PARTITION BY camera ORDER BY us, event_id) AS n FROM o) SELECT event_id FROM n WHERE (n - 1) % 3 = 0")
def frame_skipping(spark, sf):
    n = F.row_number().over(Window.partitionBy("camera").orderBy("us", "event_id"))
    return obs(spark, sf).withColumn("n", n).where((F.col("n") - 1) % 3 == 0).select("event_id")


@query("str07_future_rejected", f"WITH {OBS}, p AS (SELECT event_id, us - lag(us) OVER (PARTITION BY gid ORDER BY event_id) AS gap FROM o) SELECT event_id FROM p WHERE gap >= 0 AND gap <= 3600000000")
def future_rejected(spark, sf):
    gap = F.col("us") - F.lag("us").over(Window.partitionBy("gid").orderBy("event_id"))
    return obs(spark, sf).withColumn("gap", gap).where((F.col("gap") >= 0) & (F.col("gap") <= 3_600_000_000)).select("event_id")
