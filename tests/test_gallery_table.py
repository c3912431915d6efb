"""Gallery tables and fusions against plain loops."""

import random
from collections import defaultdict

import numpy as np
import pytest

from trackloom.operators import gallery_table as gt


def test_any_grouping_of_merges_gives_one_gallery(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(12), rng.randrange(1000), rng.choice("xyz")) for _ in range(200)]
    frame = lambda part: gt.entries_of(spark.createDataFrame(part, "gid long, us long, camera string"))
    whole = sorted(map(tuple, frame(rows).collect()))
    for cut in (1, 77, 150):
        parts = [frame(rows[:cut]), frame(rows[cut:160]) if cut < 160 else frame(rows[:0]), frame(rows[max(cut, 160) :])]
        rng.shuffle(parts)
        assert sorted(map(tuple, gt.together(gt.together(parts[0].union(parts[1])).union(parts[2])).collect())) == whole
    shots = [(g, rng.choice(["body", "face"]), rng.random(), us, i) for i, (g, us, _) in enumerate(rows)]
    merges = [(1, 2), (2, 3), (5, 99), (98, 6), (7, 7), (8, 3)]
    entries, best = gt.merged(frame(rows), spark.createDataFrame(shots, "gid long, modality string, quality double, us long, id long"), spark.createDataFrame(merges, "source long, target long"), cap=4)
    to = {1: 3, 2: 3, 8: 3}
    want = defaultdict(list)
    for g, us, cam in rows:
        want[to.get(g, g)].append((us, cam))
    assert sorted(map(tuple, entries.collect())) == sorted((g, min(v)[0], max(v)[0], len(v), sorted({c for _, c in v})) for g, v in want.items())
    held = defaultdict(list)
    for g, m, q, us, i in shots:
        held[to.get(g, g), m].append((-q, -us, i))
    assert sorted((r["gid"], r["modality"], r["id"]) for r in best.collect()) == sorted((g, m, x[2]) for (g, m), v in held.items() for x in sorted(v)[:4])


@pytest.mark.parametrize("how", ["mean", "weighted", "geff"])
@pytest.mark.parametrize("block", [3, 2048])
def test_fusions_of_missing_vectors(spark, monkeypatch, how, block):
    monkeypatch.setattr(gt, "BLOCK", block)
    rng = np.random.default_rng(7)
    pick = random.Random(7)
    some = lambda n, p: rng.normal(size=n).tolist() if pick.random() < p else None
    rows = [(i, some(5, 0.7), some(3, 0.5), pick.choice([0.0, 0.5, 1.0]), pick.choice([-1.0, 0.0, 2.0]), pick.random()) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a array<double>, b array<double>, wa double, wb double, reliability double").repartition(3)
    got = {r["query"]: (r["id"], round(r["d"], 9)) for r in gt.fused_best(df, df, ["a", "b"], how, ["wa", "wb"]).collect()}
    far = lambda x, y: None if x is None or y is None else 1 - float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
    want = {}
    for i, a, b, wa, wb, _ in rows:
        every = []
        for j, x, y, _, _, r in rows:
            da, db = far(a, x), far(b, y)
            if how == "geff":
                d = None if da is None else da if db is None else (1 - 0.45 * r) * da + 0.45 * r * db
            else:
                parts = [(w if how == "weighted" else 1.0, v) for w, v in ((wa, da), (wb, db)) if v is not None and (how == "mean" or w > 0)]
                d = sum(w * v for w, v in parts) / sum(w for w, _ in parts) if parts else None
            if d is not None and i != j:
                every.append((d, j))
        if every:
            d, j = min(every)
            want[i] = (j, round(d, 9))
    assert got == want
    with pytest.raises(ValueError):
        gt.fused_best(df, df, ["a"], "sum")
