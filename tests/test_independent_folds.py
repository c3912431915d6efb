"""The gallery rules written once more, over rows from DuckDB and with NumPy; nothing of the
library but its registered queries is used here."""

import itertools
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
OBS = """SELECT event_id AS e, event_type AS camera, user_id AS gid, epoch_us(ts) AS us, least(value / 100, 1.0) AS quality, (value % 100) / 100 AS x,
  CAST(json_extract_string(props, '$.k') AS BIGINT) / 100.0 AS y, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"""


def table(text, sf=SF):
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    found = con.execute(f"WITH o AS ({OBS}) {text}")
    names = [d[0] for d in found.description]
    return [dict(zip(names, r)) for r in found.fetchall()]


@pytest.fixture(scope="module")
def seen():
    rows = table("SELECT o.*, label, embedding::DOUBLE[] AS v FROM o JOIN embeddings ON vec_id = e ORDER BY us, e")
    for r in rows:
        r["v"] = np.array(r["v"]) / np.linalg.norm(r["v"])
    return rows


def query(spark, name, sf=SF):
    return [r.asDict() for r in __spark_entry__.queries()[name](spark, sf).collect()]


def by(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[key(r)].append(r)
    return out


def balanced(have, cap):
    """The places to keep: one of the fullest camera's goes, the worst and earliest of it."""
    if len(have) <= cap:
        return have
    cams = [x[2] for x in have]
    full = max(dict.fromkeys(cams), key=cams.count)
    drop = min((x[1], i) for i, x in enumerate(have) if x[2] == full)[1]
    return have[:drop] + have[drop + 1 :]


@pytest.mark.parametrize(("name", "ema"), [("idn18_ema_matcher", True), ("idn19_20_gallery_match", False)])
def test_matchers(spark, seen, name, ema):
    want = {}
    for rows in by(seen, lambda r: r["camera"]).values():
        people = []  # of each its (vector, quality, camera)s
        for r in rows:
            far = [1 - max(float(r["v"] @ x[0]) for x in p) for p in people]
            at = int(np.argmin(far)) if far else -1
            if at < 0 or far[at] > 0.7:
                people.append([])
                at, d = len(people) - 1, None
            else:
                d = far[at]
            own = (r["v"], r["quality"], r["camera"])
            if ema and people[at]:
                mix = 0.85 * people[at][0][0] + 0.15 * r["v"]
                people[at] = [(mix / np.linalg.norm(mix), 0, "")]
            else:
                people[at] = balanced([*people[at], own], 10)
            want[r["e"]] = (at + 1, d)
    got = {r["event_id"]: (r["gid"], r["dist"]) for r in query(spark, name)}
    assert got.keys() == want.keys()
    for e, (gid, d) in want.items():
        assert got[e][0] == gid and (d is None) == (got[e][1] is None) and (d is None or math.isclose(d, got[e][1], abs_tol=1e-9))


def test_coherence(spark, seen):
    want = {}
    for rows in by(seen, lambda r: r["label"]).values():
        held = []
        for r in rows:
            want[r["e"]] = ok = len(held) < 3 or 1 - max(float(r["v"] @ x) for x in held) <= 0.9
            held = (held + [r["v"]])[-10:] if ok else held
    got = {r["event_id"]: r["accepted"] for r in query(spark, "idn08_coherence_gate")}
    assert got == want and not all(want.values())


def test_policies(spark, seen):
    want = {}
    for rows in by(seen, lambda r: r["gid"]).values():
        diverse, even, last = [], [], None
        for r in rows:
            own = (r["v"], r["quality"], r["camera"], r["e"])
            diverse.append(own)
            if len(diverse) > 4:
                like = max(((float(diverse[i][0] @ diverse[j][0]), i, j) for i in range(5) for j in range(i)))
                i, j = like[1:]
                del diverse[min((diverse[i][1], i), (diverse[j][1], j))[1]]
            even = balanced([*even, own], 4)
            last = r["e"]
            ids = lambda x: ",".join(str(y[3]) for y in x)
            want[r["e"]] = f"ema:{last};view_diverse:{ids(diverse)};camera_balanced:{ids(even)}"
    assert {r["event_id"]: r["kept"] for r in query(spark, "top09_view_diverse_ema")} == want


def test_enrollment(spark, seen):
    people = defaultdict(list)  # person: [pose, mode, vector, quality]
    want = {}
    for r in seen:
        k, v, who, q = r["k"], r["v"], r["label"], r["quality"]
        pose = "frontal" if k < 60 else "left" if k < 90 else None
        why = "pose" if pose is None else "detection" if 0.5 + k / 100 < 0.6 else "blurry" if k * 2.0 < 30 else None
        if why is None and any(float(x[2] @ v) >= 0.55 for other, xs in people.items() if other != who for x in xs):
            why = "impostor"
        if why is None:
            mine = people[who]
            modes = by([x for x in mine if x[0] == pose], lambda x: x[1])
            like = {}
            for m, xs in modes.items():
                mean = sum(x[2] for x in xs) / len(xs)
                like[m] = float(mean @ v) / np.linalg.norm(mean) if np.linalg.norm(mean) else 0.0
            best = min(like, key=lambda m: (-like[m], m)) if like else None
            known = best is not None and like[best] >= 0.5
            mode = best if known else max(modes, default=-1) + 1
            frontal = [x for x in mine if x[0] == "frontal"]
            if len(mine) >= 40:
                weak = min(mine, key=lambda x: x[3])
                if q <= weak[3] or (len(frontal) == 1 and frontal[0] is weak):
                    why = "full"
                else:
                    mine[:] = [x for x in mine if x is not weak] + [[pose, mode, v, q]]
                    why = "replaced"
            elif not known:
                why = "no mode left" if len(modes) >= 3 else "new mode"
                if why == "new mode":
                    mine.append([pose, mode, v, q])
            elif len(modes[mode]) < 4:
                why = "redundant" if max(float(x[2] @ v) for x in modes[mode]) >= 0.95 else "stored"
                if why == "stored":
                    mine.append([pose, mode, v, q])
            else:
                weak = min(modes[mode], key=lambda x: x[3])
                if q <= 1.15 * weak[3] or (len(frontal) == 1 and frontal[0] is weak):
                    why = "mode full"
                else:
                    mine[:] = [x for x in mine if x is not weak] + [[pose, mode, v, q]]
                    why = "replaced"
        want[r["e"]] = why
    got = {r["event_id"]: r["outcome"] for r in query(spark, "idn32_enrollment")}
    assert got == want and len(set(want.values())) > 3


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    return w * h / (area(a) + area(b) - w * h)


def test_reassociation(spark):
    want = {}
    for rows in by(table("SELECT * FROM o"), lambda r: r["camera"]).values():
        tracks = {}  # track: [gid, box, frame, whether it gave its gid away], in the order of their rows
        for r in sorted(rows, key=lambda r: (r["us"] // 21_600_000_000, r["e"])):
            frame, box = r["us"] // 21_600_000_000, ((r["x"] - 0.05) * 1920, (r["y"] - 0.2) * 1080, (r["x"] + 0.05) * 1920, r["y"] * 1080)
            if r["gid"] in tracks:
                gid = tracks[r["gid"]][0]
            else:
                gid, best, heir = r["gid"] % 50, 0.8, None
                for t in tracks.values():
                    if 1 <= frame - t[2] <= 30 and not t[3]:
                        b = t[1]
                        d = math.hypot((box[0] + box[2]) / 2 - (b[0] + b[2]) / 2, (box[1] + box[3]) / 2 - (b[1] + b[3]) / 2)
                        score = max(overlap(b, box), 1 - d / max(1e-9, b[3] - b[1]))
                        if score > best:
                            best, heir = score, t
                if heir:
                    gid, heir[3] = heir[0], True
            tracks = {k: t for k, t in tracks.items() if frame - t[2] <= 30}
            tracks[r["gid"]] = [gid, box, frame, False]
            want[r["e"]] = (r["gid"], gid)
    assert {r["event_id"]: (r["track"], r["gid"]) for r in query(spark, "idn03_42_reassociation")} == want


def test_named_anchors(spark):
    sf = SF.replace("0.001", "0.01")
    want = []
    for name, rows in by(table("SELECT * FROM o WHERE gid % 7 = 0 ORDER BY us, e", sf), lambda r: f"n{r['gid'] % 4}").items():
        near = [r for r in rows if r["k"] / 100 <= 0.45]
        want += [(r["gid"], near[0]["gid"], name, r["us"]) for r in near if r["gid"] != near[0]["gid"]]
    got = sorted((r["gid"], r["anchor"], r["name"], r["us"]) for r in query(spark, "idn50_named_canonical", sf))
    assert got == sorted(want) and want


def test_assignments_of_small_groups():
    """The assignment step against all permutations."""
    from trackloom.operators.assignment import hungarian

    rng = random.Random(6)
    for _ in range(200):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        cost = [[rng.choice([0, -1, -5, -7, 3, rng.randint(-9, 9)]) for _ in range(m)] for _ in range(n)]
        pairs = list(hungarian(cost))
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs) == min(n, m)
        if n <= m:
            best = min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        else:
            best = min(sum(cost[p[j]][j] for j in range(m)) for p in itertools.permutations(range(n), m))
        assert sum(cost[i][j] for i, j in pairs) == best


def test_smoothed_hold(spark, seen):
    want = {}
    for rows in by(seen, lambda r: r["camera"]).values():
        held, rivals, last = None, [], []
        for r in rows:
            now = r["k"] % 2
            rivals = [] if held is None or now == held else [*rivals, now] if not rivals or rivals[-1] == now else [now]
            if held is None or now == held:
                held, last = now, [*last, r["v"]][-5:]
            elif len(rivals) >= 4:
                held, rivals, last = now, [], [r["v"]]
            mean = sum(last)
            want[r["e"]] = (held, round(float(mean[0] / np.linalg.norm(mean)), 6))
    got = {r["event_id"]: (r["held"], r["first"]) for r in query(spark, "idn41_smoothed_hold")}
    assert got.keys() == want.keys() and all(got[e][0] == w[0] and abs(got[e][1] - w[1]) <= 1e-6 for e, w in want.items())


def test_greedy_tracker(spark):
    want = {}
    for rows in by(table("SELECT * FROM o"), lambda r: r["camera"]).values():
        tracks, born = [], 0  # [number, box, frame]
        for frame, now in sorted(by(rows, lambda r: r["us"] // 21_600_000_000).items()):
            now = sorted(now, key=lambda r: r["e"])
            boxes = {r["e"]: ((r["x"] - 0.05) * 1920, (r["y"] - 0.2) * 1080, (r["x"] + 0.05) * 1920, r["y"] * 1080) for r in now}
            free = [r["e"] for r in now]
            for t in tracks:
                best = max(free, key=lambda e: (overlap(t[1], boxes[e]), -free.index(e)), default=None)  # noqa: B023
                if best is not None and overlap(t[1], boxes[best]) >= 0.25:
                    want[best], t[1], t[2] = t[0], boxes[best], frame
                    free.remove(best)
            for e in free:
                born += 1
                tracks.append([born, boxes[e], frame])
                want[e] = born
            tracks = [t for t in tracks if frame - t[2] <= 40]
    assert {r["event_id"]: r["track"] for r in query(spark, "trk03_iou_tracker")} == want
