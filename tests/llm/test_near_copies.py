"""Near copies against brute force over all pairs."""

import random

import pytest

import corpus_pipeline
from trackloom.llm import near_copies, simhash_dedup


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def expected(texts):
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            both = len(sets[a] | sets[b])
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * both:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


@pytest.mark.parametrize("few, block", [(12, 1024), (2, 5), (0, 1)])
def test_every_pair_of_four_fifths_is_linked(spark, monkeypatch, few, block):
    monkeypatch.setattr(near_copies, "FEW", few)
    monkeypatch.setattr(near_copies, "BLOCK_LONGS", 1 << 20 if few else 16)
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "DEAL", 40 if few else 400)  # the first two deal keys out
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    line, texts = " ".join(word() for _ in range(30)), ["", "  ", "one two", "ONE two", "one two three"]
    for k in range(12):
        w = [word() for _ in range(60 + 5 * k)]
        for _ in range(12):
            v = list(w)
            for at in rng.sample(range(len(v)), rng.randrange(5)):
                v[at] = word()
            texts.append(" ".join(v) + (f" {line}" if rng.random() < 0.5 else ""))
    chain = [word() for _ in range(100)]
    for _ in range(20):  # neighbours are alike, the ends are not
        chain[rng.randrange(100)] = word()
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    texts = dict(enumerate(texts))
    got = near_copies.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r["id"]: r["component"] for r in got.collect()} == expected(texts)


def test_stage_keeps_one_of_near_copies(spark):
    rng = random.Random(9)
    w = [str(rng.randrange(10**6)) for _ in range(200)]
    other = list(w)
    other[50] = other[120] = "changed"
    far = w[:100] + [str(rng.randrange(10**6)) for _ in range(100)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate((w, other, far))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2]


def test_bitmaps_never_differ_more_than_sets(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rng, rows = np.random.default_rng(3), []
    for n in (0, 1, 31, 32, 40, 300, 2000):
        x = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        y = np.unique(np.concatenate((x[n // 5 :], rng.integers(0, 1 << 64, n // 3, dtype=np.uint64))))
        rows.append((near_copies.parity(x).tolist(), near_copies.parity(y).tolist(), len(np.setxor1d(x, y))))
    df = spark.createDataFrame(rows, "x array<long>, y array<long>, most int")
    length = F.least(F.size("x"), F.size("y"))
    folded = df.select("most", near_copies._folded(F.col("x"), length).alias("x"), near_copies._folded(F.col("y"), length).alias("y"))
    for r in folded.collect():
        flips = sum(((a ^ b) % (1 << 64)).bit_count() for a, b in zip(r["x"], r["y"], strict=True))
        assert flips <= r["most"] and (r["most"] - flips) % 2 == 0


@pytest.mark.parametrize("find", [near_copies.near_copies, simhash_dedup.near_duplicates])
def test_other_texts_of_an_id_stay(spark, find):
    rng = random.Random(4)
    text = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(80))
    one, two, three = text(), text(), text()
    rows = [(1, one), (1, two), (1, one), (2, one + " more"), (2, three), (3, two), (None, one), (None, one)]
    got = simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), find=near_copies.near_copies if find is near_copies.near_copies else find).collect()
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in got)
    assert kept[:2] == [(0, one), (0, one)]
    texts = {t for _, t in kept}
    assert {one, two, three} <= texts and (1, one) in kept and (1, two) in kept and (2, three) in kept and (3, two) not in kept
    if find is near_copies.near_copies:
        assert len(kept) == 5


def test_stage_links_fingerprints_by_the_ring(spark, monkeypatch):
    """Sets whose fingerprints are within two bits are compared as the ring finds them, and what they
    link isn't compared again by keys."""
    rng = random.Random(12)
    word = lambda: str(rng.randrange(10**6))
    texts = []
    for _ in range(6):
        w = [word() for _ in range(400)]
        texts += [" ".join([*w[: k + 1], word(), *w[k + 2 :]]) for k in (0, 0, 397, 397)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = {}
    for t in texts:
        h = near_copies.shingles(t)
        prints[near_copies.node_of(h)] = simhash_dedup.bits_of(h)
    nodes = spark.createDataFrame([(n, near_copies._signed(f)) for n, f in prints.items()], "node long, fp long")
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2
    want = {(min(a for a in prints if near(a, b)), b) for b in prints} - {(b, b) for b in prints}
    got = {tuple(r) for r in near_copies._within_reach(nodes).collect()}
    assert len(want) > 5 and {b for _, b in got} == {b for _, b in want} and all(near(a, b) and a < b for a, b in got)

    asked = []
    ring, closed = near_copies.links, near_copies.components
    monkeypatch.setattr(near_copies, "links", lambda fps: asked.append(fps.count()) or ring(fps))
    monkeypatch.setattr(near_copies, "components", lambda edges: asked.append({tuple(r) for r in edges.select("a", "b").collect()}) or closed(edges))
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(expected(dict(enumerate(texts))).values()))
    assert asked[0] == len(set(prints.values())) and asked[1] == got


@pytest.mark.parametrize("few", [12, 0])
def test_sets_of_very_different_sizes_are_linked_at_low_shares(spark, monkeypatch, few):
    """At two fifths a text is linked to one of two and a half times its shingles, whose bitmap is four
    times as long."""
    monkeypatch.setattr(near_copies, "FEW", few)
    rng = random.Random(13)
    texts = {}
    for k in range(8):
        w = [str(rng.randrange(10**6)) for _ in range(2000)]
        n = 34 + 31 * k
        texts[3 * k], texts[3 * k + 1], texts[3 * k + 2] = " ".join(w[:n]), " ".join(w[: int((n - 4) * 2.5) + 4]), " ".join(w[: n * 3])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["id"]: r["component"] for r in near_copies.near_copies(docs, share=(2, 5)).collect()}
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for _ in range(3):
        for a in texts:
            for b in texts:
                if 5 * len(sets[a] & sets[b]) >= 2 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert got == root and sum(root[3 * k + 1] == 3 * k for k in range(8)) == 8
