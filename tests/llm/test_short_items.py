"""Benchmark items of fewer than 12 words."""

from itertools import combinations
from math import ceil

import pytest

from trackloom.llm import decontaminate


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_BYTES, 0])
def test_short_items_are_found_with_all_allowed_substitutions(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
    items = {n: [f"q{n}x{k}" for k in range(n)] for n in (1, 3, 7, 8, 9, 10, 11, 12)}
    docs, want = [], set()
    for n, words in items.items():
        allowed = 0 if n < 8 else n - ceil(0.8 * n)
        for wrong in range(min(n, allowed + 1) + 1):
            for bad in combinations(range(n), wrong):
                d = len(docs)
                docs.append((d, " ".join(["lead"] * 3 + [f"w{k}" if k in bad else x for k, x in enumerate(words)] + ["tail"] * 3)))
                if wrong <= allowed:
                    want.add((d, n, n - wrong))
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string"))
    assert {(r["id"], r["item"], r["n_equal"]) for r in found.collect()} == want
