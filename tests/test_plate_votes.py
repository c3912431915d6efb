"""Votes on plates: any order and any split of the reads give the same, as a plain count does."""

import random
import re
from collections import Counter

from trackloom.functions.scalars import PLATE
from trackloom.operators import plates

SCHEMA = "camera string, track_id long, text string, confidence double, plate_width double"


def plain(reads):
    """A count of the reads of one track: (plate, reads)."""
    votes = [(t, round(max(0.05, c) * 1000) * max(1, int(w or 0))) for t, c, w in reads if c >= 0.4 and re.match(PLATE, t)]
    if len(votes) < 4:
        return None, len(votes)
    total, lengths = sum(w for _, w in votes), Counter()
    for t, w in votes:
        lengths[len(t)] += w
    n = min(lengths, key=lambda x: (-lengths[x], x))
    text = ""
    for i in range(n):
        letters = Counter()
        for t, w in votes:
            if len(t) == n:
                letters[t[i]] += w
        best = min(letters, key=lambda x: (-letters[x], x))
        if 5 * letters[best] < 3 * lengths[n]:
            return None, len(votes)
        text += best
    return (text if 2 * lengths[n] >= total and re.match(PLATE, text) else None), len(votes)


def made():
    rng = random.Random(4)
    rows = []
    for track in range(60):
        truth = f"KA{rng.randrange(100):02d}AB{rng.randrange(10000):04d}"
        for _ in range(rng.choice([1, 3, 4, 6, 20])):
            t = list(truth)
            if rng.random() < 0.4:
                t[rng.randrange(10)] = rng.choice("ABC0123")
            if rng.random() < 0.2:
                t = t[:-1]
            rows.append(("c", track, "".join(t), rng.choice([0.3, 0.4, 0.5, 0.9]), rng.choice([None, 0.0, 3.7, 40.0])))
    return rows + [("c", 99, x, 0.5, 10.0) for x in ["KA01AB1234", "KA01AB1235"] * 3]


def test_any_order_and_any_split(spark):
    rows = made()
    want = {}
    for track in {r[1] for r in rows}:
        plate, n = plain([r[2:] for r in rows if r[1] == track])
        if n:
            want[track] = (plate, n, plate is None and n < 12)
    assert want[99][0] is None and sum(v[0] is not None for v in want.values()) > 15
    for seed in range(3):
        rng = random.Random(seed)
        mixed = rng.sample(rows, len(rows))
        cuts = sorted(rng.sample(range(len(rows)), 4))
        parts = [plates.tally(spark.createDataFrame(mixed[a:b] or mixed[:0], SCHEMA)) for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        rng.shuffle(parts)
        left = plates.merged(parts[0].union(parts[1]))
        whole = plates.merged(left.union(plates.merged(parts[2].union(parts[3]).union(parts[4]))))
        got = {r["track_id"]: (r["plate"], r["reads"], r["goes_on"]) for r in plates.agreed(whole).collect()}
        assert got == want
