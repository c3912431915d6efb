"""Packing token ids into sequences, shortest pack first over the length histogram.

A document is cut into pieces of the sequence length and one rest. Only the histogram of
piece lengths goes to the driver; its size is the sequence length whatever the corpus.
There, lengths are placed longest first, each into the shortest packs that it fits, which
changes counts of packing patterns and never touches single documents. A pattern's places are
then intervals of ranks among the pieces of one length, and pieces find their sequence by rank.

Ranks need no sort: tasks number the pieces of each length as they write them, and the counts
of earlier tasks are added.

Defined cases: a null or empty text is the end id alone; equal rows are packed each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import written

LENGTH = 2048
END_ID = 1
PIECES = "piece bigint, part int, rank bigint, id {id}, start bigint, length int, doc_tokens bigint, ids_crc32 bigint, ids binary"


def pack_histogram(counts: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, number of sequences) for numbers of pieces by length.

    Longest first; each length goes to the packs with the most room. Every step uses up a
    length or a group of equal packs, so patterns stay as few as lengths, and counts of any
    size cost the same.
    """
    groups: dict[int, list[list]] = defaultdict(list)  # room left -> [pattern, count]
    for size in sorted(counts, reverse=True):
        left = counts[size]
        rooms = sorted((r for r in groups if r >= size and groups[r]), reverse=True)
        for room in rooms:
            while left and groups[room]:
                pattern, n = groups[room].pop()
                take = min(n, left)
                if n > take:
                    groups[room].append([pattern, n - take])
                groups[room - size].append([(*pattern, size), take])
                left -= take
            if not left:
                break
        # packs that this length itself has just left may take it again
        while left:
            again = max((r for r in groups if r >= size and groups[r]), default=None)
            if again is None:
                fits = length // size
                whole, rest = divmod(left, fits)
                if whole:
                    groups[length - fits * size].append([(size,) * fits, whole])
                if rest:
                    groups[length - rest * size].append([(size,) * rest, 1])
                left = 0
                break
            pattern, n = groups[again].pop()
            take = min(n, left)
            if n > take:
                groups[again].append([pattern, n - take])
            groups[again - size].append([(*pattern, size), take])
            left -= take
    total: Counter = Counter()
    for packs in groups.values():
        for pattern, n in packs:
            total[pattern] += n
    return sorted(total.items(), reverse=True)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int]]]:
    """For each length, (first rank, first sequence, offset) of its places, by rank."""
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: Counter = Counter()
    base = 0
    for pattern, n in patterns:
        offset = 0
        for size in pattern:
            found[size].append((used[size], base, offset))
            used[size] += n
            offset += size
        base += n
    return dict(found)


def pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All pieces with their ids (little-endian, 16 bits wide where the vocabulary allows)."""

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from trackloom.llm.tokens import encoder

        enc = encoder(tokenizer, end_id)
        width = np.dtype("<u2") if enc.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        part, n, rank = TaskContext.get().partitionId(), 0, Counter()
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for row, ids in enumerate(enc.encode(batch.column(1).to_pylist())):
                total = len(ids) // 4
                for start in range(0, total, length):
                    own = ids[4 * start : 4 * (start + length)]
                    size = len(own) // 4
                    rows.append(((part << 40) + n, part, rank[size], row, start, size, total, zlib.crc32(own), np.frombuffer(own, "<u4").astype(width).tobytes()))
                    rank[size] += 1
                    n += 1
                    held += size
                if held > 4_000_000:
                    yield _piece_batch(pa, rows, batch)
                    rows, held = [], 0
            yield _piece_batch(pa, rows, batch)

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, PIECES.format(id=given.schema["id"].dataType.simpleString()))


def _piece_batch(pa, rows: list[tuple], batch):
    cols = list(zip(*rows)) or [()] * 9
    kinds = [pa.int64(), pa.int32(), pa.int64(), None, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    arrays = [batch.column(0).take(pa.array(c, pa.int64())) if k is None else pa.array(c, k) for c, k in zip(cols, kinds)]
    return pa.RecordBatch.from_arrays(arrays, ["piece", "part", "rank", "id", "start", "length", "doc_tokens", "ids_crc32", "ids"])


def place(made: DataFrame, length: int = LENGTH) -> DataFrame:
    """Where each of the written ``pieces`` goes: its columns but the ids, sequence_id, offset."""
    narrow = made.drop("ids")
    counts = narrow.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `length` rows
    table = slots(pack_histogram(histogram, length))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        where = {size: np.array(v, np.int64).reshape(-1, 3) for size, v in table.items()}
        for batch in batches:
            sizes, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            seq, off = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            order = np.argsort(sizes, kind="stable")
            for idx in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(sizes) else ():
                t = where[int(sizes[idx[0]])]
                at = np.searchsorted(t[:, 0], ranks[idx], side="right") - 1
                seq[idx], off[idx] = t[at, 1] + ranks[idx] - t[at, 0], t[at, 2]
            kept = batch.select(["piece", "id", "start", "length", "doc_tokens", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(seq), pa.array(off)], [*kept.schema.names, "sequence_id", "offset"])

    kind = made.schema["id"].dataType.simpleString()
    out = f"piece bigint, id {kind}, start bigint, length int, doc_tokens bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return narrow.join(before, ["part", "length"]).mapInArrow(run, out)


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pieces, placements) of a table of documents; the pieces are written once."""
    made = written(pieces(docs, tokenizer, end_id, length, id_col, text_col), "pieces")
    return made, place(made, length)


def padded_length(tokens, length: int = LENGTH):
    """A sequence is padded to ``length`` unless its tokens are a power of two in number."""
    return F.when(F.bit_count(tokens.cast("long")) == 1, tokens).otherwise(F.lit(length))


def sequences(made: DataFrame, placed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(sequence_id, n_tokens, padded, ids, ends): the ids of whole sequences in order, without
    the padding, and where each piece ends. A sequence gathers ``length`` ids at most."""
    rows = placed.select("piece", "sequence_id", "offset", "length").join(made.select("piece", "ids"), "piece")
    kept = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    n = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return kept.select(
        "sequence_id", n.alias("n_tokens"), padded_length(n, length).alias("padded"),
        F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias("ids"), F.transform("p", lambda x: x["offset"] + x["length"]).alias("ends"),
    )
