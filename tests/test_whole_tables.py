"""Queries without SQL, and the operators beneath them, against brute force over whole tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import vectors as ve
from trackloom.operators import identity as idn
from trackloom.operators import joins as jn
from trackloom.operators import rerank as rr
from trackloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def matrix(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    m = np.array([r["embedding"] for r in rows], float)
    return [r["vec_id"] for r in rows], m / np.linalg.norm(m, axis=1, keepdims=True), [r["label"] for r in rows]


def nearest_ids(ids, s, i, k):
    return [j for j in np.lexsort((ids, -s[i])) if j != i][:k]


def plain_rerank(ids, v, k1=20, k2=6, mix=0.3, camera=None, quota=None):
    """Re-ranked distances with whole matrices."""
    s = v @ v.T
    d = np.clip(1 - s, 0, None)
    lists = []
    for i in range(len(ids)):
        own = [i]
        for j in nearest_ids(ids, s, i, len(ids)):
            if camera is None or sum(camera[x] == camera[j] for x in own[1:]) < quota:
                own.append(j)
            if len(own) == k1 + 1:
                break
        lists.append(own)
    mutual = lambda i, k: {j for j in lists[i][: k + 1] if i in lists[j][: k + 1]}
    w = np.zeros_like(d)
    for i in range(len(ids)):
        first = mutual(i, k1)
        grown = set(first)
        for j in first:
            half = mutual(j, k1 // 2)
            if 3 * len(half & first) > 2 * len(half):
                grown |= half
        at = sorted(grown)
        w[i, at] = np.exp(-d[i, at]) / np.exp(-d[i, at]).sum()
    w = np.array([w[own[:k2]].mean(axis=0) for own in lists])
    both = np.array([np.minimum(w[i], w).sum(axis=1) for i in range(len(ids))])
    return (1 - mix) * (1 - both / (2 - both)) + mix * d


@pytest.mark.parametrize("by_camera", [False, True])
def test_re_ranked_neighbours(spark, matrix, by_camera):
    ids, v, _ = matrix
    ids, v = ids[:200], v[:200]
    df = spark.createDataFrame([(i, i % 3, x.tolist()) for i, x in zip(ids, v)], "vec_id long, cam int, v array<double>")
    got = rr.reranked(df, df.where("vec_id % 5 = 0"), k=3, **({"camera_col": "cam", "quota": 4} if by_camera else {})).collect()
    d = plain_rerank(ids, v, camera=[i % 3 for i in ids] if by_camera else None, quota=4)
    np.fill_diagonal(d, np.inf)
    want = {(ids[i], r + 1): d[i, j] for i in range(len(ids)) if ids[i] % 5 == 0 for r, j in enumerate(np.argsort(d[i], kind="stable")[:3])}
    assert {(r["query"], r["rank"]) for r in got} == set(want)
    assert all(math.isclose(r["dist"], want[r["query"], r["rank"]], abs_tol=1e-9) for r in got)


def test_linked_clusters_equal_the_plain_ones(spark, matrix):
    rng = random.Random(4)
    edges = {}
    for _ in range(400):  # dense groups and links between them
        a, b = rng.sample(range(60), 2)
        if a // 6 == b // 6 or rng.random() < 0.1:
            edges[min(a, b), max(a, b)] = round(rng.random(), 3)
    rows = [(d, a, b) for (a, b), d in edges.items()]
    for most in (3, 8):
        found = idn.linked_clusters(spark.createDataFrame([(a, b, d) for d, a, b in rows], "a long, b long, d double"), most)
        got = {}
        for r in found.collect():
            got.setdefault(r["survivor"], []).append(r["member"])
        assert sorted(map(sorted, got.values())) == idn.complete_linkage(rows, most)
        assert all(k == min(v) for k, v in got.items())
    ids, v, _ = matrix
    s = v @ v.T
    near = {tuple(sorted((ids[i], ids[j]))): round(float(1 - s[i, j]), 9) for i in range(len(ids)) for j in nearest_ids(ids, s, i, 3)}
    got = {}
    for r in registry.queries()["idn13_16_linked_clusters"](spark, SF).collect():
        got.setdefault(r["survivor"], []).append(r["member"])
    assert sorted(map(sorted, got.values())) == idn.complete_linkage([(d, a, b) for (a, b), d in near.items()])


def test_near_pairs(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), rng.randrange(40), rng.random() * 2 - 1, rng.random()) for _ in range(300)] + [(0, 1, None, 0.1), (1, 2, 0.3, 0.3), (1, 3, 0.5, 0.3)]
    got = jn.near_pairs(spark.createDataFrame(rows, "tick int, gid int, x double, y double"), ["tick"], "gid", 0.2).collect()
    want = {(t, min(a, b), max(a, b)) for t, a, x, y in rows for u, b, z, w in rows if t == u and a != b and x is not None and z is not None and (x - z) ** 2 + (y - w) ** 2 <= 0.2**2}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_set_distances_across_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(90, 8))
    label = rng.integers(0, 4, 90)
    df = spark.createDataFrame([(i, int(k), x.tolist()) for i, (k, x) in enumerate(zip(label, v))], "vec_id long, label int, embedding array<double>")
    monkeypatch.setattr(ve, "BLOCK", 16)
    got = {(r["la"], r["lb"]): r for r in ve.set_distances(df.repartition(3), "label").collect()}
    for a in range(4):
        for b in range(a + 1, 4):
            d = np.sort((1 - v[label == a] @ v[label == b].T).ravel())
            assert np.allclose([got[a, b][c] for c in ("least", "mean", "topk")], [d[0], d.mean(), d[:3].mean()])
    assert len(got) == 6


def test_reciprocal_best(spark, matrix):
    ids, v, _ = matrix
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<double>")
    s = v @ v.T
    best = {ids[i]: ids[nearest_ids(ids, s, i, 1)[0]] for i in range(len(ids))}
    want = {(a, b) for a, b in best.items() if a % 20 == 0 and best[b] == a}
    assert {(r["a"], r["b"]) for r in ve.reciprocal_best(df.where("vec_id % 20 = 0"), df).collect()} == want


def test_components_of_a_long_chain(spark):
    df = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = idn.connected(df.union(spark.createDataFrame([(1000, 1001), (5, 5)], "a long, b long")))
    assert {r["id"]: r["root"] for r in got.collect()} == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_starts_after_ends(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(2), i, s, s + rng.choice([0, 3, 1_000_000])) for i, s in enumerate(rng.randrange(500) for _ in range(200))] + [(0, -1, None, None)]
    df = spark.createDataFrame(rows, "camera int, gid long, us_start long, us_end long")
    for us in (0, 1, 7):
        got = sorted((r["a"]["gid"], r["b"]["gid"]) for r in jn.begun_within(df, df, ["camera"], us).collect())
        assert got == sorted((a, b) for c, a, _, e in rows for d, b, s, _ in rows if c == d and e is not None and s is not None and 0 < s - e <= us)
    # buckets are of the length asked for, however long the rows are: a day of them would be 10^12 / 600 for each row
    long = spark.range(3000).select(F.lit(1).alias("camera"), F.col("id").alias("gid"), F.col("id").alias("us_start"), (F.col("id") + 10**12).alias("us_end"))
    assert jn.begun_within(long, long, ["camera"], 600).count() == 0
