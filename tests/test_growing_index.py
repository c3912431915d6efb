"""An index filled in steps against brute force in NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import growing_index as gi
from trackloom.plans import registry


def brute(v, asked, k):
    m = np.array([v[i] for i in sorted(v)], float)
    ids = sorted(v)
    out = set()
    for q in asked:
        s = m @ np.array(v[q], float)
        best = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-s[i], ids[i]))[:k]
        out |= {(q, ids[i]) for i in best}
    return out


def test_steps_of_32(spark, tmp_path):
    rng = np.random.default_rng(2)
    v = np.repeat(rng.normal(size=(12, 16)), 16, axis=0) + rng.normal(0, 0.4, (192, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v = {i: x.tolist() for i, x in enumerate(v)}
    root, seen, kinds = f"file://{tmp_path}/index", [], ["double", "float"]
    for step in range(6):
        part = [(i, v[i]) for i in range(32 * step, 32 * step + 32)] + [(9000 + step, None)]
        df = spark.createDataFrame(part, "vec_id long, embedding array<double>").withColumn("embedding", F.col("embedding").cast(f"array<{kinds[step % 2]}>"))
        assert gi.add(df, root, lists=8, k=5) == 32 and gi.add(df, root, lists=8, k=5) == 0
        held = gi.version(spark, root)
        seen.append((len(held["parts"]), held["n_centred"]))
        assert held["n"] == 32 * (step + 1) and held["recall"] >= 0.9
    assert seen == [(1, 32), (1, 64), (2, 64), (1, 128), (2, 128), (3, 128)]  # fitted anew beyond half as many more
    index = gi.rows(spark, held)
    assert index.schema.simpleString() == "struct<list:int,id:bigint,v:array<double>>"
    assert sorted(r["id"] for r in index.collect()) == list(range(192))
    centres = np.array(held["centres"])
    for r in index.collect():  # as a full build with these centres lists them
        assert r["list"] == int(np.argsort(-(centres @ np.array(r["v"])), kind="stable")[0])
    asked = [i for i in range(192) if i % 7 == 0]
    df = spark.createDataFrame([(i, v[i]) for i in asked], "vec_id long, embedding array<double>")
    found = {(r["query"], r["id"]) for r in gi.search(df, root, 5).collect()}
    rounded = {i: np.array(x, np.float32).tolist() if (i // 32) % 2 else x for i, x in v.items()}
    assert len(found & brute(rounded, asked, 5)) >= 0.85 * len(asked) * 5
    assert gi.vacuum(spark, root) == 3 and gi.vacuum(spark, root) == 0
    assert {(r["query"], r["id"]) for r in gi.search(df, root, 5).collect()} == found


def test_before_the_first_step(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert gi.version(spark, root) is None and gi.search(none, root, 3).count() == 0 and gi.add(none, root) == 0
    one = spark.createDataFrame([(5, [1.0, 0.0]), (5, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert gi.add(one, root) == 1 and gi.search(one.limit(1), root, 3).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_fills_the_index(spark, sf):
    folder = f"/root/testdata/{sf}"
    v = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    got = {(r["query"], r["id"]) for r in registry.queries()["sem04_filled_index"](spark, folder).collect()}
    asked = [i for i in v if i % 20 == 0]
    want = brute(v, asked, 10)
    assert {q for q, _ in got} == set(asked) and len(got & want) >= 0.88 * len(want)
