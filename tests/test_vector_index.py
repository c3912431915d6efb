"""The vector index: every row indexed, recall against brute force."""

import numpy as np
import pytest

from trackloom.functions import vectors as ve
from trackloom.operators import vector_index as vx


@pytest.mark.parametrize("block", [16, 2048])
def test_recall_on_grouped_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(ve, "BLOCK", block)
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(40, 16))
    v = np.repeat(middles, 20, axis=0) + rng.normal(0, 0.3, (800, 16))
    v = np.concatenate((v, middles[:1] + rng.normal(0, 0.3, (400, 16))))  # a third in one group
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(9999, None)], "vec_id long, embedding array<float>")
    centres = vx.fit_centres(df, 32, sample=600)
    index = vx.listed(df, centres)
    assert index.select("id").distinct().count() == index.count() == 1200
    q = df.where("vec_id % 20 = 0")
    found, exact = vx.search(q, index, centres, 5, probes=8), ve.nearest(q, df, 5)
    r = vx.recall(found, exact).first()
    assert r["queries"] == 60 and r["recall"] >= 0.9
    every = {(x["query"], x["rank"]): x["id"] for x in vx.search(q, index, centres, 5, probes=32).collect()}
    assert every == {(x["query"], x["rank"]): x["id"] for x in exact.collect()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    centres = vx.fit_centres(one, 4)
    assert vx.search(one, vx.listed(none, centres), centres, 3).count() == 0 and vx.search(none, vx.listed(one, centres), centres, 3).count() == 0
    assert len(vx.fit_centres(none)) == 0
