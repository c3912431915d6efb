"""Ranked lexical search as a blocked product of sparse matrices: items by terms (how often an
item holds a term) times terms by documents (a term's impact in a document, whole numbers of 64
bits). Rows of the second matrix are merged into one row of the product for each item (Gustavson's
order) within a block of documents, and each block's best k join the task's best k of the item.

Terms are runs of ASCII letters and digits and of any characters beyond ASCII, with A-Z in lower
case. A first pass over the documents counts the items' terms in each (narrow rows, written); from
these come the numbers of documents with a term, all documents and all terms, and a second pass
over the narrow rows makes impacts and products. Items are taken in blocks of BLOCK_BYTES of terms,
so what the driver collects and executors get of them is bounded; each block of items passes over
the documents once.

Defined cases: a null or empty text has no terms, is no document to the counts and is never found;
items without terms, or whose terms occur nowhere, have no rows; repeated documents each count and
are each found, repeated items each have their ranks; equal scores go by id (null last), then by
the text's hash; ids of documents are whole numbers; texts of any length are counted whole, in
pieces of PIECE bytes; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import forget, written

#: Bytes of distinct terms in a block of items, about.
BLOCK_BYTES = 8_000_000
#: Documents in a block of the product.
BLOCK_DOCS = 4096
PIECE = 1 << 20
#: What stands for a null id among equal scores.
LAST = (1 << 63) - 1

_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, piece by piece."""
    flat, at = text.translate(_FOLD), 0
    while len(flat) - at > PIECE:
        end = flat.find(b" ", at + PIECE)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end
    yield flat[at:].split()


def counted(text: bytes | None) -> Counter:
    found: Counter = Counter()
    for piece in terms(text or b""):
        found.update(piece)
    return found


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, terms, times, bytes) of each row: its distinct terms and how often it holds them."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [sorted(counted(t).items()) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([[t for t, _ in x] for x in found], pa.list_(pa.binary())), pa.array([[c for _, c in x] for x in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([sum(len(t) + 1 for t, _ in x) for x in found], pa.int64())], ["id", "terms", "times", "bytes"])

    given = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, terms array<binary>, times array<bigint>, bytes bigint").where("bytes > 0")


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, hash, n, terms, tfs) of the documents with a term: all terms, and how often each of the
    vocabulary occurs."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        look = known.value
        for batch in batches:
            n, numbers, tfs, ends = [], [], [], [0]
            for t in batch.column(2):
                found = counted(t.as_py())
                n.append(found.total())
                met = [(look[x], found[x]) for x in (found if len(found) < len(look) else look) if x in look and x in found]
                numbers += [x for x, _ in met]
                tfs += [c for _, c in met]
                ends.append(len(numbers))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(v, "i4"))) for v in (numbers, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), *lists], ["id", "hash", "n", "terms", "tfs"])

    given = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return given.mapInArrow(run, "id bigint, hash bigint, n bigint, terms array<int>, tfs array<int>").where("n > 0")


def _best(scores, ids, hashes, k: int):
    import numpy as np

    first = np.lexsort((hashes, ids, -scores))[:k]
    return scores[first], ids[first], hashes[first]


def products(counts: DataFrame, rows: list[tuple[list[int], list[int]]], weights: list[int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, id, hash, score): each task's best k documents for each row of the item-term matrix,
    given as (term numbers, multiplicities)."""
    shared = counts.sparkSession.sparkContext.broadcast((rows, weights))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        items, weight = shared.value
        weight = np.array(weight, "i8")
        empty = np.zeros(0, "i8")
        best = [(empty, empty, empty)] * len(items)
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK_DOCS):
                block = whole.slice(begin, BLOCK_DOCS)
                size = block.num_rows
                ids = block.column(0).fill_null(LAST).to_numpy()
                hashes, n = block.column(1).to_numpy(), block.column(2).to_numpy()
                lists, tf = block.column(3), block.column(4).flatten().to_numpy().astype("i8")
                doc = np.repeat(np.arange(size), lists.value_lengths().to_numpy())
                term = lists.flatten().to_numpy()
                length = 100 - 90 + (90 * n * n_docs) // n_terms
                impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * length[doc]))
                order = np.argsort(term, kind="stable")  # the block, term by term
                doc, impact = doc[order], impact[order]
                ends = np.searchsorted(term[order], np.arange(len(weight) + 1))
                full = {}
                for t in np.flatnonzero(np.diff(ends) * 2 > size).tolist():
                    full[t] = np.zeros(size, "i8")
                    full[t][doc[ends[t] : ends[t + 1]]] = impact[ends[t] : ends[t + 1]]
                ends = ends.tolist()
                for i, (numbers, times) in enumerate(items):
                    row = np.zeros(size, "i8")
                    for t, m in zip(numbers, times):
                        a, b = ends[t], ends[t + 1]
                        if t in full:
                            row += full[t] if m == 1 else m * full[t]
                        elif a < b:
                            row[doc[a:b]] += impact[a:b] if m == 1 else m * impact[a:b]
                    scores, known, _ = best[i]
                    if len(scores) < k:
                        new = np.flatnonzero(row > 0)
                    else:
                        new = np.flatnonzero(row >= scores[-1])
                        new = new[(row[new] > scores[-1]) | (ids[new] <= known[-1])]
                    if len(new):
                        best[i] = _best(*(np.concatenate((x, y[new])) for x, y in zip(best[i], (row, ids, hashes))), k)
        item = np.repeat(np.arange(len(items)), [len(x[0]) for x in best])
        columns = [np.concatenate([x[c] for x in best] or [empty]) for c in range(3)]
        found = pa.array(columns[1], mask=columns[1] == LAST)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), found, pa.array(columns[2]), pa.array(columns[0])], ["item", "id", "hash", "score"])

    return counts.mapInArrow(run, "item bigint, id bigint, hash bigint, score bigint")


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, once: bool = True, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(item_id, rank, id, score): the ``k`` documents of the highest scores above 0 for each row of
    ``items``. With ``once`` a term counts once in an item, otherwise as often as it is there."""
    spark = docs.sparkSession
    asked = written(item_terms(items, item_col, item_text).withColumn("row", F.monotonically_increasing_id()), "item-terms")
    kind = asked.schema["id"].dataType.simpleString()
    total = asked.agg(F.sum("bytes")).first()[0] or 0
    blocks = -(-total // block_bytes)
    found = None
    for b in range(blocks):
        held = sorted(asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).collect(), key=lambda r: r["row"])
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in held for t in r["terms"]}))}
        rows = [([vocabulary[bytes(t)] for t in r["terms"]], [1] * len(r["times"]) if once else r["times"]) for r in held]
        counts = written(term_counts(docs, vocabulary, id_col, text_col), "term-counts")
        n_docs, n_terms = counts.agg(F.count("*"), F.sum("n")).first()
        df = dict(counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))]
        part = products(counts, rows, weights, n_docs, n_terms or 1, k)
        ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "hash"))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(held)], f"item bigint, item_id {kind}")
        one = written(ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "id", "score"), "ranked")
        forget(counts)
        found = one if found is None else found.unionAll(one)
    forget(asked)
    return spark.createDataFrame([], f"item_id {kind}, rank int, id bigint, score bigint") if found is None else found
