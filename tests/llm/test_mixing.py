"""Mixing of sources against a loop over their documents in order."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trackloom.llm import mixing


def plain(docs):
    """Counter of (id, size, source_size, target, taken), and targets found by sharing again and again."""
    by = defaultdict(list)
    for i, text, source in docs:
        by["1" if source is None else "0" + source].append((len(re.findall(r"[^\x20\x09-\x0D]+", text or "")), -1 if i is None else i))
    names = sorted(by)
    size = {k: sum(n for n, _ in by[k]) for k in names}
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(size.values())
    while free:
        level = left / sum(weight[k] for k in free)
        over = {k for k in free if level * weight[k] >= 2 * size[k]}
        for k in over or free:
            target[k] = 2.0 * size[k] if over else level * weight[k]
        left -= sum(target[k] for k in over)
        free -= over or free
    out = Counter()
    for k in names:
        at = int(hashlib.md5(f"11:{k}".encode()).hexdigest()[:13], 16) / 16**13
        for n, i in sorted(by[k]):
            step = target[k] / size[k] if size[k] else 0
            out[i, n, size[k], round(target[k], 6), (math.floor(at + step) - math.floor(at)) * n] += 1
            at += step
    return out, size, target


def made(seed, n=900):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.4 else rng.choice(["a", "é", "Z", None, "empty", "日", "", "one big"])
        text = None if source == "empty" else " ".join(rng.choices("one two\tthree\x0bfour".split(" "), k=rng.choice([0, 1, 5, 5, 5, 40]))) + rng.choice(["", " \n", "\x1c"])
        rows.append((None if rng.random() < 0.02 else i, text, source))
    return rows + [(n, "word " * 5000, "one big"), (0, "same same", "hot"), (0, "same same", "hot"), (0, "else else", "hot")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_copies_equal_a_loop(spark, seed):
    docs = made(seed)
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, source string, key string, part int").repartition(7)
    got = mixing.copies(df).collect()
    want, size, target = plain(docs)
    found = Counter((-1 if r["id"] is None else r["id"], r["size"], r["source_size"], round(r["target"], 6), r["copies"] * r["size"]) for r in got)
    assert found == want
    taken, largest = Counter(), Counter()
    for r in got:
        taken[r["key"]] += r["copies"] * r["size"]
        largest[r["key"]] = max(largest[r["key"]], r["size"])
        assert r["copies"] <= 2
    assert all(abs(taken[k] - target[k]) <= largest[k] for k in size)
    assert math.isclose(sum(target.values()), 1.5 * sum(size.values()))


def test_the_mix_has_its_rows_as_often_as_they_are_taken(spark):
    docs = [(*d, "x", 1) for d in made(4, 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, key string, __rank int")
    got = mixing.mixed(df)
    assert got.columns == df.columns
    counts = Counter(tuple(r) for r in got.collect())
    want = Counter()
    for r in mixing.copies(df).collect():
        want[r["id"], r["size"], r["key"]] += r["copies"]
    key = lambda d: (d[0], len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")), "1" if d[2] is None else "0" + d[2])
    have = Counter()
    for d, n in counts.items():
        have[key(d)] += n
    assert +want == have and set(counts) <= set(docs)


def test_empty_tables_and_one_source(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (2, None, "s"), (3, "", "t")], "doc_id long, text string, source string")
    assert mixing.copies(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0
    assert {(r["id"], r["target"]) for r in mixing.copies(df).collect()} == {(1, 3.0), (2, 3.0), (3, 0.0)}
    ids = df.select("doc_id", F.col("doc_id").cast("string").alias("text"), "source")
    assert {r["size"] for r in mixing.copies(ids).collect()} == {1}
