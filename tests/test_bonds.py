"""Bonds against a loop over the rows of each track."""

import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from trackloom.operators import bonds as bo
from trackloom.plans import registry
from trackloom.plans.catalog import OBS

S = 1_000_000


def far(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return 1 - float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def plain(rows, break_bar, app_bar, face_bar, memory_s):
    tracks = defaultdict(list)
    for r in rows:
        tracks[r[0]].append(r)
    out = []
    for own in tracks.values():
        bond, apps, faces = None, [], []
        for _, us, e, v, f, body, match in sorted(own, key=lambda r: (r[1], r[2])):
            near = lambda kept, x: min((far(y, x) for t, y in kept if us - t <= memory_s * S), default=None)  # noqa: B023, E731
            da = near(apps, v) if v is not None else None
            df = near(faces, f) if f is not None else None
            begins = bond is None or bool(body and da is not None and da > break_bar)
            agrees = bool(match and da is not None and da <= app_bar) or (df is not None and df <= face_bar)
            if begins:
                bond, apps, faces = e, [], []
            keeps_app, keeps_face = bool(body and v is not None), bool(f is not None and (body or agrees))
            if keeps_app:
                apps.append((us, v))
            if keeps_face:
                faces.append((us, f))
            out.append((e, bond, begins, keeps_app, keeps_face))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_bonds_equal_a_loop(spark, seed):
    rng = np.random.default_rng(seed)
    pick = random.Random(seed)
    middle = rng.normal(size=(5, 8))
    rows = []
    for e in range(260):
        who = pick.randrange(5)
        v = (middle[who] + rng.normal(0, 0.35, 8)).tolist() if pick.random() < 0.9 else None
        f = (middle[who][:4] + rng.normal(0, 0.3, 4)).tolist() if pick.random() < 0.5 else None
        rows.append((pick.randrange(3), pick.randrange(900) * S, e, v, f, pick.random() < 0.5, pick.random() < 0.7))
    df = spark.createDataFrame(rows, "track long, us long, event_id long, v array<double>, f array<double>, body_ok boolean, match_ok boolean")
    got = sorted(tuple(r) for r in bo.bonds(df, 0.5, 0.35, 0.3, 120).collect())
    want = plain(rows, 0.5, 0.35, 0.3, 120)
    assert got == want
    assert sum(w[2] for w in want) > 10 and any(w[4] and not w[3] for w in want)
    assert bo.bonds(df.limit(0)).count() == 0


def test_query_equals_a_loop(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    v = {i: x for i, x in con.execute("SELECT vec_id, embedding::DOUBLE[] FROM embeddings").fetchall()}
    rows = []
    for e, cam, gid, us, k, q in con.execute(f"WITH {OBS} SELECT event_id, camera, gid, us, k, quality FROM o").fetchall():
        x = v[(gid * 7 + (e if k % 10 == 0 else 0)) % len(v)]
        rows.append(((cam, gid), us, e, x, x[32:] if k % 2 == 0 else None, q >= 0.2, q >= 0.05))
    got = sorted(tuple(r) for r in registry.queries()["idn43_49_bonds"](spark, sf).collect())
    assert got == plain(rows, 0.5, 0.35, 0.3, 432_000)
