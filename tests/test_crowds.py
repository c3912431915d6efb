"""Pairs of identities block by block against loops over all pairs."""

import random

import pytest

from trackloom.operators import crowds
from trackloom.plans import registry


@pytest.mark.parametrize(("crowd", "at_once"), [(7, 16), (1024, 1 << 20)])
def test_pairs_equal_those_of_a_loop(spark, monkeypatch, crowd, at_once):
    monkeypatch.setattr(crowds, "CROWD", crowd)
    monkeypatch.setattr(crowds, "AT_ONCE", at_once)
    rng = random.Random(crowd)
    rows = [(rng.randrange(50), rng.choice("abc"), s := rng.randrange(300), s + rng.randrange(9)) for _ in range(250)]
    df = spark.createDataFrame([*rows, (None, "a", 1, 9), (51, None, 1, 9), (52, "a", None, 9)], "gid long, camera string, s long, e long")
    pairs = [(x, y) for x in rows for y in rows if x[0] < y[0]]
    got = [tuple(r) for r in crowds.sharing(df.select("gid", "camera", "s"), "gid", "camera", "s").collect()]
    want = {(x[0], y[0]) for x, y in pairs if x[1:3] == y[1:3]}
    assert sorted(got) == sorted(want) and len(want) > 20
    for where in (lambda a, b: a == b, lambda a, b: a != b and {a, b} != {"a", "b"}):
        got = [tuple(r) for r in crowds.together(df, "gid", "camera", "s", "e", 3, where).collect()]
        want = {(x[0], y[0]) for x, y in pairs if where(x[1], y[1]) and min(x[3], y[3]) - max(x[2], y[2]) >= 3}
        assert sorted(got) == sorted(want) and len(want) > 20
    assert crowds.sharing(df.where("false"), "gid", "camera", "s").collect() == []


@pytest.mark.parametrize("name", ["idn17_cannot_link", "jn15_covisible_margin", "jn16_concurrent_conflict"])
def test_pairs_are_not_shuffled(spark, name):
    """What goes through an exchange are rows of identities, not pairs of them."""
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(ga" not in plan and "HashAggregate" not in plan.split("MapInArrow")[0]
