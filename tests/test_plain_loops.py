"""Queries that SQL doesn't express against plain loops over the same rows."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trackloom.operators import galleries as ga
from trackloom.operators import sequence as sq
from trackloom.operators import trackers
from trackloom.operators.assignment import hungarian
from trackloom.plans import registry
from trackloom.plans.q_geometry import boxed, obs

SF = "/root/testdata/sf0.001"
FOLDS = ["idn32_enrollment", "idn03_42_reassociation", "idn50_named_canonical", "idn18_ema_matcher", "idn19_20_gallery_match", "idn41_smoothed_hold", "top09_view_diverse_ema", "idn08_coherence_gate"]


def plain_fold(df, keys, order, start, step, schema, finish=None):
    """:func:`sequence.fold` on the driver, key after key."""
    by = defaultdict(list)
    for r in df.collect():
        by[tuple(r[k] for k in keys)].append(r.asDict(recursive=True))
    out = []
    for rows in by.values():
        state = start()
        for row in sorted(rows, key=lambda r: [r[c] for c in order]):
            state, made = step(state, row)
            out += made
        out += finish(state) if finish else []
    names = [f.split()[0].split(":")[0] for f in schema.split(",")]
    return df.sparkSession.createDataFrame([tuple(r.get(n) for n in names) for r in out], schema.replace(":", " "))


@pytest.mark.parametrize("name", FOLDS)
def test_folds_equal_a_plain_loop(spark, monkeypatch, name):
    text = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
    sf = SF.replace("0.001", "0.01") if name.startswith("idn50") else SF  # fifteen people have no name in common
    got = text(registry.queries()[name](spark, sf))
    for module in (sq, ga):
        if hasattr(module, "fold"):
            monkeypatch.setattr(module, "fold", plain_fold)
    assert got == text(registry.queries()[name](spark, sf)) and got


def frames_of(df, seconds, key=lambda r: (r["camera"], r["frame"])):
    by = defaultdict(list)
    for r in df.withColumn("frame", F.floor(F.col("us") / (seconds * 1_000_000))).collect():
        by[key(r)].append(r)
    return by


def test_groups_across_cameras(spark):
    got = {r["event_id"]: (r["frame"], r["grp"]) for r in registry.queries()["jn12_cross_camera_groups"](spark, SF).collect()}
    n = 0
    for frame, rows in frames_of(obs(spark, SF), 3600, lambda r: r["frame"]).items():
        rows = sorted((r for r in rows if r["x"] is not None and r["y"] is not None), key=lambda r: r["event_id"])
        groups = []
        for r in rows:
            at = next((i for i, g in enumerate(groups) if all(m["camera"] != r["camera"] for m in g) and math.dist((g[0]["x"], g[0]["y"]), (r["x"], r["y"])) <= 0.2), None)
            if at is None:
                at = len(groups)
                groups.append([])
            groups[at].append(r)
            assert got[r["event_id"]] == (frame, at)
            n += 1
    assert n == len(got)


def test_suppression_in_frames(spark):
    got = {r["event_id"] for r in registry.queries()["trk07_duplicate_suppression"](spark, SF).collect()}
    want = set()
    for rows in frames_of(boxed(spark, SF), 6 * 3600).values():
        kept = []
        for r in sorted(rows, key=lambda r: (-r["quality"], r["event_id"])):
            box = (r["x1"], r["y1"], r["x2"], r["y2"])
            if all(trackers.iou(box, k) < 0.45 for k in kept):
                kept.append(box)
                want.add(r["event_id"])
    assert got == want


def test_trackers_frame_by_frame(spark):
    for name, make in (("trk03_iou_tracker", trackers.Greedy), ("trk04_sort_tracker", trackers.Kalman)):
        got = {r["event_id"]: r["track"] for r in registry.queries()[name](spark, SF).collect()}
        live = {}
        for (camera, n), rows in sorted(frames_of(boxed(spark, SF), 6 * 3600).items()):
            rows = sorted(rows, key=lambda r: r["event_id"])
            ids = live.setdefault(camera, make()).frame(n, [(r["x1"], r["y1"], r["x2"], r["y2"]) for r in rows])
            assert [got[r["event_id"]] for r in rows] == ids


def test_assignments_are_the_best(spark):
    """Totals against the best of each day or camera, from a matrix of its own."""
    gains = defaultdict(dict)
    for frame, rows in frames_of(obs(spark, SF), 86_400, lambda r: r["frame"]).items():
        for a in rows:
            for b in rows:
                if a["camera"] == "click" and b["camera"] == "view" and None not in (a["x"], a["y"], b["x"], b["y"]):
                    gain = math.floor(1000 / (1 + math.dist((a["x"], a["y"]), (b["x"], b["y"]))))
                    gains[frame][a["gid"], b["gid"]] = max(gain, gains[frame].get((a["gid"], b["gid"]), 0))
    got = defaultdict(list)
    for r in registry.queries()["jn23_optimal_assignment"](spark, SF).collect():
        got[r["frame"]].append((r["ga"], r["gb"], r["gain"]))
    for frame, g in gains.items():
        left, right = sorted({a for a, _ in g}), sorted({b for _, b in g})
        best = sum(g.get((left[i], right[j]), 0) for i, j in hungarian([[-g.get((a, b), 0) for b in right] for a in left]))
        rows = got[frame]
        assert sum(x for *_, x in rows) == best and len({a for a, *_ in rows}) == len({b for _, b, _ in rows}) == len(rows)
        assert all(g[a, b] == x for a, b, x in rows)
    counts, total = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for r in obs(spark, SF).collect():
        counts[r["camera"]][(r["gid"] + r["k"] % 3) % 50, r["gid"] % 40] += 1
        total[r["camera"]] += 1
    for r in registry.queries()["agg14_idf1"](spark, SF).collect():
        c = counts[r["camera"]]
        left, right = sorted({a for a, _ in c}), sorted({b for _, b in c})
        best = sum(c.get((left[i], right[j]), 0) for i, j in hungarian([[-c.get((a, b), 0) for b in right] for a in left]))
        assert r["matched"] == best and math.isclose(r["idf1"], best / total[r["camera"]])


def test_stable_crossings(spark):
    got = {r["event_id"]: r["by"] for r in registry.queries()["win09_stable_crossing"](spark, SF).collect()}
    by = defaultdict(list)
    for r in boxed(spark, SF).collect():
        by[r["camera"], r["gid"]].append(r)
    want = {}
    for rows in by.values():
        side, before = None, None
        for n, r in enumerate(sorted(rows, key=lambda r: (r["us"], r["event_id"]))):
            now = {"centre": ((r["x1"] + r["x2"]) / 2, (r["y1"] + r["y2"]) / 2), "foot": (r["x"] * 1920, r["y2"])}
            d = 960 - now["centre"][0]
            own = None if abs(d) <= 6 else math.copysign(1, d)

            def direct(kind):
                (a, b), (c, e) = before[kind], now[kind]  # noqa: B023
                if math.dist((a, b), (c, e)) < 8 or (960 - a) * (960 - c) >= 0:
                    return False
                return 108 <= b + (e - b) * (960 - a) / (c - a) <= 972

            if n >= 1:
                how = "centre" if direct("centre") else "foot" if direct("foot") else "memory" if side is not None and own is not None and own != side else None
                if how:
                    want[r["event_id"]] = how
            side, before = own if own is not None else side, now
    assert got == want


def test_fitted_fusion_separates_pairs(spark):
    w = {r["feature"]: r["weight"] for r in registry.queries()["ml01_learned_fusion"](spark, SF).collect()}
    assert set(w) == {"d", "r", "bias"} and all(map(math.isfinite, w.values()))
    rows = [(True, 0.1 * i, 1.0) for i in range(5)] + [(False, 0.5 + 0.1 * i, 1.0) for i in range(5)]
    weights, bias = ga.fit_fusion(spark.createDataFrame(rows, "same boolean, d double, r double"), ["d", "r"])
    assert all((weights[0] * d + weights[1] * r + bias > 0) == same for same, d, r in rows)
