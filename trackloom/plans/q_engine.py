"""The query surface as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.engine import Engine
from trackloom.operators import growing_index as gi
from trackloom.operators import indexing as ix
from trackloom.plans.catalog import OBS, VISITS, query, table
from trackloom.plans.q_geometry import obs
from trackloom.storage import fresh_path

_V = f"WITH {VISITS}"
_NAMES = "coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '')"
_CAMERAS = "string_agg(DISTINCT camera, ',' ORDER BY camera)"


def engine(spark, sf) -> Engine:
    o = obs(spark, sf)
    alerts = o.where("k < 30").select("event_id", "gid", "us", F.col("camera").alias("type"), F.when(F.col("k") > 5, F.col("quality")).alias("dist"))
    return Engine(o, table(spark, sf, "embeddings"), alerts)


def flat(df):
    """Arrays of texts joined."""
    kinds = dict(df.dtypes)
    return df.select(*[F.array_join(c, ",").alias(c) if kinds[c] == "array<string>" else F.col(c) for c in df.columns])


@query("api_persons", f"{_V} SELECT gid, {_NAMES} AS names, {_CAMERAS} AS cameras, count(*) AS visits, min(us_start) AS first_us, max(us_end) AS last_us FROM v GROUP BY gid ORDER BY last_us DESC, gid LIMIT 100")
def persons(spark, sf):
    return flat(engine(spark, sf).persons())


@query("api_person", f"{_V} SELECT camera, count(*) AS visits, sum(n_obs)::BIGINT AS observations, min(us_start) AS first_us, max(us_end) AS last_us, {_NAMES} AS names FROM v WHERE gid = 7 GROUP BY camera")
def person(spark, sf):
    return flat(engine(spark, sf).person(7))


@query("api_summary", f"{_V} SELECT camera, count(DISTINCT gid) AS people, count(DISTINCT gid) FILTER (name IS NOT NULL) AS named, sum(n_obs)::BIGINT AS observations, max(us_end) AS last_us FROM v GROUP BY camera")
def summary(spark, sf):
    return engine(spark, sf).summary()


@query("api_events", f"WITH {OBS} SELECT event_id, camera, gid, us FROM o WHERE camera = 'view' ORDER BY us DESC, event_id DESC LIMIT 100")
def events(spark, sf):
    return engine(spark, sf).events(camera="view").select("event_id", "camera", "gid", "us")


@query("api_alerts_by_kind", f"WITH {OBS} SELECT camera AS type, count(*) AS n, count(DISTINCT gid) AS people, max(us) AS last_us FROM o WHERE k < 30 GROUP BY camera")
def alerts_by_kind(spark, sf):
    return engine(spark, sf).alerts_by_kind()


@query("api_churn", f"{_V} SELECT a.camera, a.gid AS before, b.gid AS after, count(*) AS n FROM v a JOIN v b ON a.camera = b.camera AND a.gid <> b.gid AND b.us_start > a.us_end AND b.us_start <= a.us_end + 600000000 GROUP BY ALL")
def churn(spark, sf):
    return engine(spark, sf).churn(600)


@query("api_history", f"{_V} SELECT count(*) AS visits, count(DISTINCT gid) AS people, min(us_start) AS first_us, max(us_end) AS last_us, count(name) AS named FROM v")
def history(spark, sf):
    return engine(spark, sf).history()


@query("api_audit", f"WITH {OBS}, c AS (SELECT gid, camera, count(*) AS n FROM o GROUP BY 1, 2) SELECT gid, string_agg(camera || '=' || n, ',' ORDER BY camera) AS cameras, sum(n)::BIGINT AS n_obs FROM c GROUP BY gid HAVING count(*) >= 2")
def audit(spark, sf):
    text = F.array_join(F.transform(F.map_entries("cameras"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return engine(spark, sf).audit().withColumn("cameras", text)


@query("api_path", f"{_V} SELECT camera, us_start, us_end, n_obs FROM v WHERE gid = 7 ORDER BY us_start, camera LIMIT 200")
def path(spark, sf):
    return engine(spark, sf).path(7).select("camera", "us_start", "us_end", "n_obs")


@query("api_alert_history", f"""{_V}, c AS (SELECT gid, us_start, min(best_event) AS id FROM v GROUP BY gid, us_start), l AS (SELECT event_id, gid, us, CASE WHEN k > 5 THEN quality END AS dist FROM o WHERE k < 30 ORDER BY us DESC, event_id DESC LIMIT 250)
SELECT event_id, (SELECT first(c.id ORDER BY abs(c.us_start - l.us), c.us_start, c.id) FROM c WHERE c.gid = l.gid) AS crop FROM l WHERE coalesce(dist <= 0.6, true) ORDER BY us DESC, event_id DESC LIMIT 50""")
def alert_history(spark, sf):
    return engine(spark, sf).alert_history(50, 0.6).select("event_id", "crop")


@query("agg35_overall", f"{_V}, c AS (SELECT camera, count(*) AS n, min(us) AS a, max(us) AS b FROM o GROUP BY camera) SELECT count(*) AS cameras, sum(n)::BIGINT AS observations, round(sum(CASE WHEN b > a THEN 1e6 * n / (b - a) ELSE 0 END), 6) AS fps, (SELECT count(DISTINCT gid) FROM v) AS people, (SELECT count(*) FROM v) AS visits FROM c")
def overall(spark, sf):
    return engine(spark, sf).overall()


@query("sem04_pending_index", f"{_V} SELECT best_event, us_end FROM v WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = v.best_event) ORDER BY us_end DESC, best_event LIMIT 32")
def pending_index(spark, sf):
    return ix.pending(engine(spark, sf).visits, table(spark, sf, "embeddings")).select("best_event", "us_end")


@query("sem04_filled_index")
def filled_index(spark, sf):
    """The embeddings indexed in four steps, and the ten nearest rows that the index gives."""
    e = table(spark, sf, "embeddings")
    root = fresh_path(spark, "index")
    for step in range(4):
        gi.add(e.where(F.pmod(F.xxhash64("vec_id"), F.lit(4)) == step), root)
    return gi.search(e.where("vec_id % 20 = 0"), root, 10).select("query", "id", "rank", F.round("sim", 6).alias("sim"))


@query("sem06_live_search", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 20 = 0), n AS (SELECT q.vec_id AS query, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, e.v) DESC, e.vec_id) AS rank FROM q, e) SELECT query, id, rank FROM n WHERE rank <= 12")
def live_search(spark, sf):
    e = table(spark, sf, "embeddings")
    return ix.search(e.where("vec_id % 20 = 0"), e).select("query", "id", "rank")


@query("fn38_age_stamp", f"WITH {OBS} SELECT event_id, round((max(us) OVER (PARTITION BY camera) - us) / 1e6, 6) AS age_s FROM o")
def age(spark, sf):
    return ix.age_stamp(obs(spark, sf)).select("event_id", F.round("age_s", 6).alias("age_s"))
