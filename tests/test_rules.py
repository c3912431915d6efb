"""Rules that change while rows come in, against the switches one after another."""

import random

import duckdb
import pytest

from trackloom.operators import rules as ru
from trackloom.plans import registry
from trackloom.plans.catalog import OBS
from trackloom.streaming import processors as st

CHANGES = "us long, seq long, rule string, action string, camera string, zones long"


def plain(rows, changes, first):
    """{(row, rule, zones)} by going through changes and rows in order of time."""
    names = sorted({c[2] for c in changes if c[2] is not None})
    scope, zones, built, out = {r: set() for r in names}, None, dict.fromkeys(names), []
    queue = sorted([(c[0], 0, c[1], c) for c in changes] + [(us, 1, i, (i, cam)) for i, cam, us in rows], key=lambda x: x[:3])
    for us, kind, _, x in queue:
        if kind == 1:
            out += [(x[0], r, built[r]) for r in names if scope[r] is None or x[1] in scope[r]]
            continue
        _, _, rule, action, camera, version = x
        if action == "zones":
            zones = version
            for r in names:
                if scope[r]:  # a set with something in it
                    built[r] = zones
            continue
        known = {c for c, t in first.items() if t <= us}
        if camera is None:
            scope[rule] = None if action == "enable" else set()
        elif action == "enable":
            scope[rule] = None if scope[rule] is None else scope[rule] | {camera}
        else:
            scope[rule] = (known if scope[rule] is None else scope[rule]) - {camera}
        built[rule] = zones
    return sorted(out, key=str)


def frames(spark, rows, changes, first):
    return (
        spark.createDataFrame(rows, "event_id long, camera string, us long"), spark.createDataFrame(changes, CHANGES),
        spark.createDataFrame(list(first.items()), "camera string, first_us long"),
    )


H = 3_600_000_000


def test_edges_of_scopes(spark):
    changes = [
        (10 * H, 1, "a", "enable", None, None), (10 * H, 2, "b", "enable", "x", None), (20 * H, 3, None, "zones", None, 1),  # b is a set and takes them, a is all and doesn't
        (30 * H, 4, "a", "disable", "x", None), (31 * H, 5, "a", "enable", "x", None), (32 * H, 6, "b", "disable", "x", None), (33 * H, 7, None, "zones", None, 2),
        (60 * H, 8, "b", "enable", "y", None), (61 * H, 9, "a", "enable", None, None), (61 * H, 10, "a", "disable", None, None), (62 * H, 11, "c", "disable", "x", None),
    ]
    first = {"x": 0, "y": 5 * H, "late": 40 * H}
    rows = [(i, cam, us * H) for i, (cam, us) in enumerate((c, t) for c in ("x", "y", "late", "other") for t in (0, 10, 15, 25, 30, 31, 32, 34, 45, 60, 61, 62, 99))]
    r, c, f = frames(spark, rows, changes, first)
    got = sorted(((x["event_id"], x["rule"], x["zones"]) for x in ru.ruled(r, ru.versions(c, f)).collect()), key=str)
    assert got == plain(rows, changes, first)
    at = lambda cam, us, rule: [z for i, q, z in got if q == rule and rows[i][1:] == (cam, us * H)]
    assert at("x", 25, "a") == [None] and at("x", 25, "b") == [1]
    assert at("late", 45, "a") == [] and at("y", 45, "a") == [2] and at("x", 30, "a") == [] and at("x", 31, "a") == [1]


@pytest.mark.parametrize("seed", range(4))
def test_any_order_of_switches(spark, seed):
    rng = random.Random(seed)
    changes = [(rng.randrange(0, 200) * H, i, *rng.choice([(rng.choice("abc"), rng.choice(["enable", "disable"]), rng.choice([None, "x", "y", "z"]), None), (None, "zones", None, i)])) for i in range(40)]
    first = {"x": 3 * H, "y": 50 * H, "w": 120 * H}
    rows = [(i, rng.choice("xywz"), rng.randrange(0, 220) * H + rng.randrange(2)) for i in range(300)]
    r, c, f = frames(spark, rows, changes, first)
    got = sorted(((x["event_id"], x["rule"], x["zones"]) for x in ru.ruled(r, ru.versions(c, f)).collect()), key=str)
    assert got == plain(rows, changes, first)


def test_query_equals_a_loop(spark):
    for sf in ("sf0.001", "sf0.01"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('/root/testdata/{sf}/events.parquet')")
        rows = con.execute(f"WITH {OBS} SELECT event_id, camera, us FROM o").fetchall()
        first = dict(con.execute(f"WITH {OBS} SELECT camera, min(us) FROM o GROUP BY 1").fetchall())
        names = ["click", "error", "purchase", "signup", "view"]
        changes = [
            (us, e, None if k % 10 == 0 else f"r{k % 3}", "zones" if k % 10 == 0 else "enable" if gid % 2 else "disable", None if k % 10 == 0 or k % 7 == 0 else names[e % 5], e if k % 10 == 0 else None)
            for e, us, k, gid in con.execute(f"WITH {OBS} SELECT event_id, us, k, gid FROM o WHERE camera = 'error' AND quality < 0.1").fetchall()
        ]
        want = {}
        for _, rule, zones in plain(rows, changes, first):
            n, z = want.get(rule, (0, 0))
            want[rule] = (n + 1, z + (zones or 0))
        got = {r["rule"]: (r["n"], r["zones"]) for r in registry.queries()["str13_rules_by_version"](spark, f"/root/testdata/{sf}").collect()}
        assert got == want and want


def test_a_stream_follows_its_rules(spark, tmp_path):
    """Changes that are appended while a stream runs hold for the rows after them."""
    rows = [(i, "xy"[i % 2], i * H) for i in range(60)]
    log, folder = str(tmp_path / "changes"), str(tmp_path / "in")
    spark.createDataFrame([(5 * H, 1, "a", "enable", "x", None)], CHANGES).write.parquet(log)
    first = spark.createDataFrame([("x", 0), ("y", 0)], "camera string, first_us long")
    got = []

    def meet(batch, _):
        held = ru.versions(spark.read.schema(CHANGES).parquet(log), first)
        got.extend((r["event_id"], r["rule"]) for r in ru.ruled(batch, held).collect())

    for part, change in ((rows[:30], (30 * H, 2, "a", "enable", None, None)), (rows[30:], None)):
        spark.createDataFrame(part, "event_id long, camera string, us long").write.mode("append").parquet(folder)
        q = st.start(spark.readStream.schema("event_id long, camera string, us long").parquet(folder), meet, str(tmp_path / "cp"), None)
        q.awaitTermination(120)
        if change:
            spark.createDataFrame([change], CHANGES).write.mode("append").parquet(log)
    assert sorted(got) == [(i, "a") for i, cam, us in rows if (us >= 5 * H and cam == "x") or us >= 30 * H]
