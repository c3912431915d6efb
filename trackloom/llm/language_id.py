"""Language identification: sparse multinomial logistic regression over TF-IDF of character
n-grams, trained by follow-the-regularised-leader with elastic-net penalties, then calibrated
by a temperature.

N-grams of 1 to 4 characters are taken within lower-case words with a space at either side.
Term frequency is an n-gram's share of a text's n-grams, so a text's scores are sums over its
words. The model is fitted on TRAIN_DOCS labelled rows at most, those of the least id hash with
TRAIN_CHARS characters at most, and predicts every row from its whole text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows without a
language are not learned from; with no row to learn from, everything is ``und``; of languages
with equal probabilities the first by name is taken; texts of any length are read whole; equal
rows give equal rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_DOCS = 1500
#: Longer texts aren't learned from; with TRAIN_DOCS it bounds what the driver collects.
TRAIN_CHARS = 100_000
ORDERS = (1, 2, 3, 4)
MIN_DOCS = 3
SCALE = 20.0
#: The share of a label that may be anything when the temperature is fitted, so that texts that are all
#: told apart don't drive it to nought, and the temperatures that are tried.
DOUBT = 0.01
TEMPERATURES = tuple(0.05 * 1.12**i for i in range(60))


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether the crc32 of the id as text falls into a fold; a null id does not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample(rows: DataFrame, id_col: str, n: int, text_col: str = "t") -> DataFrame:
    """One row of up to ``n`` ids of the least id hash, with a text of TRAIN_CHARS characters at
    most; of an id with several, the least text and label. Only ids are sorted, and the chosen
    ones are broadcast to fetch the rest of their rows."""
    fit = rows.where(F.length(text_col) <= TRAIN_CHARS)
    few = fit.select(F.col(id_col).alias("__id")).where("__id is not null").distinct().orderBy(F.xxhash64("__id"), "__id").limit(n)
    rest = [c for c in rows.columns if c not in (id_col, text_col)]
    met = fit.join(F.broadcast(few), F.col(id_col) == F.col("__id"))
    return met.groupBy(id_col).agg(F.min(F.struct(text_col, *rest)).alias("r")).select(id_col, "r.*")


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in ORDERS for i in range(len(w) - n + 1)]


@dataclass
class Model:
    languages: list[str]
    index: dict[str, int] = field(default_factory=dict)
    weights: object = None  # n-grams x languages, IDF applied
    bias: object = None
    temperature: float = 1.0

    def word_rows(self, words: list[str]):
        """For each word: the sums of its n-grams' weights, and their number."""
        import numpy as np

        from trackloom.llm.word_scores import segment_sums

        if not words:
            return np.zeros((0, len(self.languages) + 1))
        flat: list[int] = []
        sizes, totals = [], []
        look = self.index.get
        for w in words:
            rows = [r for r in map(look, grams(w)) if r is not None]
            flat += rows
            sizes.append(len(rows))
            totals.append(sum(max(0, len(w) + 3 - n) for n in ORDERS))
        weights = self.weights[flat] if flat else np.zeros((0, len(self.languages)))
        return np.column_stack([segment_sums(weights, sizes), totals])

    def probabilities(self, sums):
        import numpy as np

        z = (SCALE * sums[:-1] / max(sums[-1], 1.0) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def fit(rows: list[tuple[str, str]], alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-4, epochs: int = 3, seed: int = 3) -> Model:
    """A model of (text, language) rows; every fifth row only calibrates."""
    import numpy as np

    languages = sorted({y for _, y in rows})
    model = Model(languages)
    if not languages:
        return model
    tuned = rows[::5] if len(rows) >= 50 else rows
    learned = [r for i, r in enumerate(rows) if i % 5] if len(rows) >= 50 else rows
    per_word: dict[str, list[str]] = {}

    def counts(text: str) -> Counter:
        found: Counter = Counter()
        for w, n in Counter(text.lower().split()).items():
            if w not in per_word:
                per_word[w] = grams(w)
            for g in per_word[w]:
                found[g] += n
        return found

    bags = [counts(t) for t, _ in learned]
    df: Counter = Counter()
    for b in bags:
        df.update(b.keys())
    kept = sorted(g for g, n in df.items() if n >= min(MIN_DOCS, len(learned)))
    model.index = {g: i for i, g in enumerate(kept)}
    idf = np.array([np.log((1 + len(learned)) / (1 + df[g])) + 1 for g in kept])
    k = len(languages)
    z, n, w = np.zeros((len(kept) + 1, k)), np.zeros((len(kept) + 1, k)), np.zeros((len(kept) + 1, k))
    data = []
    for b, (_, y) in zip(bags, learned):
        total = sum(b.values())
        idx = np.array([model.index[g] for g in b if g in model.index], np.int64)
        val = np.array([c for g, c in b.items() if g in model.index]) * (SCALE / max(total, 1))
        data.append((np.append(idx, len(kept)), np.append(val * idf[idx], 1.0), languages.index(y)))
    rng = np.random.default_rng(seed)
    penalty = np.full((len(kept) + 1, 1), l1)
    penalty[-1] = 0  # the bias is free
    for _ in range(epochs):
        for j in rng.permutation(len(data)):
            idx, val, y = data[j]
            zi, ni, p = z[idx], n[idx], penalty[idx]
            wi = np.where(np.abs(zi) <= p, 0.0, -(zi - np.sign(zi) * p) / ((beta + np.sqrt(ni)) / alpha + l2))
            s = val @ wi
            e = np.exp(s - s.max())
            q = e / e.sum()
            q[y] -= 1
            g = val[:, None] * q
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[idx] += g - sigma * wi
            n[idx] += g * g
    w = np.where(np.abs(z) <= penalty, 0.0, -(z - np.sign(z) * penalty) / ((beta + np.sqrt(n)) / alpha + l2))
    model.weights, model.bias = w[:-1] * idf[:, None], w[-1]
    used = np.flatnonzero(np.any(model.weights != 0, axis=1))
    model.index = {kept[i]: j for j, i in enumerate(used)}
    model.weights = model.weights[used]
    logits = []
    for t, y in tuned:
        s = model.word_rows(t.lower().split()).sum(axis=0)
        logits.append((SCALE * s[:-1] / max(s[-1], 1.0) + model.bias, languages.index(y)))
    x, y = np.array([a for a, _ in logits]), np.array([b for _, b in logits])

    def loss(t: float) -> float:
        v = x / t
        v = v - v.max(axis=1, keepdims=True)
        right = (1 - DOUBT) * v[np.arange(len(y)), y] + DOUBT * v.mean(axis=1)
        return float(np.mean(np.log(np.exp(v).sum(axis=1)) - right))

    model.temperature = float(min(TEMPERATURES, key=loss))
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from trackloom.llm.word_scores import WordSums

        table = WordSums(model.word_rows, len(model.languages) + 1)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            names, scores = [], []
            for t, s in zip(texts, table.sums(t.lower().split() for t in texts)):
                if not model.languages or not any(c.isalpha() for c in t):
                    names.append("und")
                    scores.append(0.0)
                else:
                    p = model.probabilities(s)
                    names.append(model.languages[int(np.argmax(p))])
                    scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def fit_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", n: int = TRAIN_DOCS, folds: int = 4, fold: int = 2) -> Model:
    """Fit on up to ``n`` labelled rows outside the held-out fold."""
    rows = docs.where(~held_out(id_col, folds, fold) & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(label_col).alias("y"))
    got = sample(rows, "id", n).select("id", "t", "y").collect()
    return fit([(r["t"], r["y"]) for r in sorted(got, key=lambda r: (r["id"], r["t"]))])
