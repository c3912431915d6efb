"""Quality classifier on supervised subword embeddings.

A word's vector is the mean of learned vectors of its hashed features: the word itself and its
character n-grams of 3 to 5. A word that repeats the one before it is the word AGAIN. A
document is the mean of its words' vectors; a softmax over it gives the classes. Everything is
trained by stochastic gradient descent in numpy on TRAIN_DOCS labelled rows at most, those of
the least id hash with TRAIN_CHARS characters at most (see language_id), and every row is scored
by its whole text. As the model is linear above the vectors, scoring
needs one number for each distinct word.

Defined cases: a null or blank text has no words and gets the bias alone; labels outside 0 and
1, or null, are not learned from; with nothing to learn from, all scores are 0.5; equal rows
give equal rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_DOCS = 2000
BUCKETS = 1 << 16
DIMENSIONS = 8
AGAIN = "\x00again"


def words(text: str | None) -> list[str]:
    found = (text or "").split()
    return [AGAIN if i and w == found[i - 1] else w for i, w in enumerate(found)]


def features(word: str) -> list[int]:
    """Hashed features of a word: itself, and its n-grams with the ends marked."""
    import zlib

    if word == AGAIN:
        return [zlib.crc32(b"\x00again") & BUCKETS - 1]
    w = f"<{word}>".encode("utf-8", "surrogatepass")
    crc = zlib.crc32
    parts = [w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)]
    return [h & BUCKETS - 1 for h in (crc(w), *map(crc, parts))]


@dataclass
class Model:
    margin: object  # of each feature: its vector times the difference of the classes' outputs
    bias: float

    def word_rows(self, found: list[str]):
        """For each word: its margin, and one."""
        import numpy as np

        if not found:
            return np.zeros((0, 2))
        flat: list[int] = []
        sizes = []
        for w in found:
            own = features(w)
            flat += own
            sizes.append(len(own))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        return np.column_stack([np.add.reduceat(self.margin[flat], starts) / sizes, np.ones(len(found))])

    def score(self, sums) -> float:
        import math

        x = float(sums[0] / max(sums[1], 1.0) + self.bias)
        return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def fit(rows: list[tuple[str, int]], epochs: int = 12, rate: float = 0.3, seed: int = 11) -> Model:
    """Vectors and outputs of (text, label) rows, classes weighted alike."""
    import numpy as np

    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    u, b = rng.normal(0, 0.5, (DIMENSIONS, 2)), np.zeros(2)
    if not rows:
        return Model(np.zeros(BUCKETS), 0.0)
    cache: dict[str, list[int]] = {}
    data = []
    for text, label in rows:
        found = Counter(words(text))
        n = sum(found.values())
        mass: dict[int, float] = {}
        for w, c in found.items():
            own = cache.get(w) or cache.setdefault(w, features(w))
            for f in own:
                mass[f] = mass.get(f, 0.0) + c / (n * len(own))
        data.append((np.fromiter(mass.keys(), np.int64, len(mass)), np.fromiter(mass.values(), float, len(mass)), label))
    counts = np.bincount([y for _, y in rows], minlength=2)
    weight = len(rows) / (2 * np.maximum(counts, 1))
    steps, total = 0, epochs * len(data)
    for _ in range(epochs):
        for j in rng.permutation(len(data)):
            idx, val, y = data[j]
            h = val @ e[idx] if len(idx) else np.zeros(DIMENSIONS)
            s = h @ u + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            lr = rate * (1 - steps / total)
            p *= weight[y]
            steps += 1
            pull = u @ p
            u -= lr * np.outer(h, p)
            b -= 0.1 * lr * p
            if len(idx):
                e[idx] -= (lr / max(val @ val, 1e-3)) * val[:, None] * pull
    return Model(e @ (u[:, 1] - u[:, 0]), float(b[1] - b[0]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: the probability of label 1."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from trackloom.llm.word_scores import WordSums

        table = WordSums(model.word_rows, 2)
        for batch in batches:
            found = [model.score(s) for s in table.sums(words(t) for t in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["id", "score"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, score double")


def fit_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", n: int = TRAIN_DOCS, folds: int = 5, fold: int = 0) -> Model:
    """Fit on up to ``n`` labelled rows outside the held-out fold, without those of very long
    texts. Only the chosen labels, at most ``n``, are broadcast to fetch their texts."""
    from trackloom.llm.language_id import TRAIN_CHARS, held_out

    known = labels.where(~held_out(id_col, folds, fold) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    few = known.groupBy("id").agg(F.max("y").alias("y")).where("id is not null").orderBy(F.xxhash64("id"), "id").limit(n)
    got = texts.where(F.length("t") <= TRAIN_CHARS).join(F.broadcast(few), "id").groupBy("id").agg(F.min(F.struct("t", "y")).alias("r")).select("id", "r.*").collect()
    return fit([(r["t"], int(r["y"])) for r in sorted(got, key=lambda r: r["id"])])
