"""Lexical search against a loop over all documents and items."""

import math
import random
import re
from collections import Counter

import pytest

from trackloom.llm import lexical_search as ls

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LETTERS))


def plain(docs, items, k=10, once=True):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    found = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 100 - 90 + (90 * c.total() * n_docs) // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, x in Counter(terms(text)).items() for q in [1 if once else x] if t in c)
            if s > 0:
                scores.append((-s, 10**18 if i is None else i))
        found += [(item, r + 1, None if i == 10**18 else i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return Counter(found)


def made(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Éa", "日本", "ÀB", "a1b", "x_y", "Ä", "­", "\U0001f600z", "x\x1cy", "K", "K"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 3, 20, 60]))) for i in range(400)]
    docs += [(None, docs[7][1]), (1000, None), (1001, " .,"), (7, docs[7][1]), (3, "other w1 w2")] + [(2000 + i, "w1 w2 w3 copies") for i in range(60)]
    items = [(i, text(rng.choice([1, 4, 30]))) for i in range(30)] + [(0, "w1 w1 w1 w2"), (None, "w5 copies"), (50, None), (51, "--"), (52, "nowhere"), (53, "copies")]
    return docs, items


@pytest.mark.parametrize("once", [True, False])
@pytest.mark.parametrize("block_bytes", [ls.BLOCK_BYTES, 200])
def test_search_equals_a_loop(spark, monkeypatch, once, block_bytes):
    monkeypatch.setattr(ls, "BLOCK_DOCS", 64)
    docs, items = made(block_bytes)
    d = spark.createDataFrame([(*x, "t", 3) for x in docs], "doc_id long, text string, terms string, n int").repartition(5)
    i = spark.createDataFrame([(*x, "t", 3) for x in items], "item_id long, text string, terms string, rank int")
    found = ls.search(d, i, once=once, block_bytes=block_bytes)
    assert found.columns == ["item_id", "rank", "id", "score"]
    assert Counter(map(tuple, found.collect())) == plain(docs, items, once=once)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(ls, "PIECE", 100)
    rng = random.Random(5)
    text = "".join(rng.choice(["Word", "é" * 90, "x" * 300, "n0", "K"]) + rng.choice([" ", ".", "\n\n"]) for _ in range(500))
    assert ls.counted(text.encode()) == {t.encode(): n for t, n in Counter(terms(text)).items()}
    assert ls.counted(None) == {} and ls.counted(b"") == {}


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "one")], "item_id int, text string")
    assert ls.search(d.limit(0), i).count() == 0 and ls.search(d, i.limit(0)).count() == 0
    assert ls.search(d, i).schema.simpleString() == ls.search(d, i.limit(0)).schema.simpleString()
    assert [tuple(r) for r in ls.search(d, i).collect()] == [tuple(r) for r in plain([(1, "one two")], [(1, "one")])]
