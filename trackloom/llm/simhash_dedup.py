"""SimHash near-duplicates with pigeonring filtering.

A fingerprint bit is set where over half of a document's 3-word shingle hashes have it.
Fingerprints that differ in at most two bits are linked, and links are closed to components.

Candidates: the 64 bits form a ring of five segments. If two fingerprints differ in at most
two bits, then some segment starts a chain whose cumulative differences never exceed length
times 2/5, so the first two segments of that chain are equal (some 26 bits), the first four
differ in one bit at most. Equal pairs of segments are the join key, the rest of the chain is
checked, and the full Hamming distance comes last.

A key that more than ``bucket`` fingerprints share isn't paired within: there, each
fingerprint is sent to itself and to its one-bit neighbours outside the key. Two fingerprints
of the bucket are at most two bits apart exactly if they meet in such a point, where at most
40 can meet, so its links to the least of them keep every connection at a linear count.

Defined cases: a null or blank text has fingerprint zero and links like any other; equal rows
share a component; a row without id takes the least id of its component (null if there is
none); an empty table gives no rows; other columns are ignored, or passed through by
:func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import components, free_name, written

DISTANCE = 2
#: (first bit from the top, bits) of the ring's segments.
RING = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
BUCKET = 64


def fingerprint_of(text: str | None, size: int = 3) -> int:
    """The fingerprint of one text as an unsigned integer."""
    import re

    import numpy as np
    import xxhash

    lower = (text or "").translate(_LOWER)
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not found:
        return 0
    one = " ".join(found).encode("utf-8", "surrogatepass")
    if len(found) <= size:
        return xxhash.xxh64_intdigest(one, 42)
    gaps = np.flatnonzero(np.frombuffer(one, np.uint8) == 32)
    begin = np.concatenate(([0], gaps + 1))[: len(found) - size + 1].tolist()
    end = np.concatenate((gaps, [len(one)]))[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(one[a:b], 42) for a, b in zip(begin, end)), np.uint64, len(begin))
    return bits_of(hashes)


def bits_of(hashes) -> int:
    """The fingerprint of an array of unsigned shingle hashes; zero of none."""
    import numpy as np

    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounds the bit matrix of a very long text
        counts += np.unpackbits(hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


_LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as a signed long) for every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [fingerprint_of(t) for t in batch.column(1).to_pylist()]
            signed = [x - (1 << 64) if x >> 63 else x for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed, pa.int64())], ["id", "fp"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, fp bigint")


def _segment(fp, i: int):
    first, bits = RING[i % len(RING)]
    return F.shiftrightunsigned(fp, 64 - first - bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _mask(i: int) -> int:
    first, bits = RING[i % len(RING)]
    return ((1 << bits) - 1) << (64 - first - bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _chain(diff, start: int):
    """Whether the chain of segments from ``start`` stays within its proportional budgets."""
    m, ok, seen = len(RING), F.lit(True), 0
    for length in range(1, m + 1):
        seen |= _mask(start + length - 1)
        ok = ok & (F.bit_count(diff.bitwiseAND(F.lit(_signed(seen)).cast("long"))) <= length * DISTANCE // m)
    return ok


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) links between distinct fingerprints ``fps(fp)``: every pair at most DISTANCE
    bits apart is connected by links, directly or through other fingerprints within reach."""
    m = len(RING)
    keys = F.array(
        *[
            F.struct(F.lit(i).alias("start"), F.shiftleft(_segment(F.col("fp"), i), RING[(i + 1) % m][1]).bitwiseOR(_segment(F.col("fp"), i + 1)).alias("key"))
            for i in range(m)
        ]
    )
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.start", "k.key")
    sizes = keyed.groupBy("start", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(keyed.join(sizes, ["start", "key"]), "buckets")
    small = shared.where(F.col("n") <= bucket)
    x, y = small.select("start", "key", F.col("fp").alias("a")), small.select("start", "key", F.col("fp").alias("b"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    kept = F.lit(False)
    for i in range(m):
        kept = kept | ((F.col("start") == i) & _chain(diff, i))
    pairs = x.join(y, ["start", "key"]).where(F.col("a") < F.col("b")).where(kept).where(F.bit_count(diff) <= DISTANCE)

    points = F.lit(None).cast("array<bigint>")
    for i in range(m):
        outside = [b for b in range(64) if not (_mask(i) | _mask(i + 1)) >> b & 1]
        flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b)).cast("long")) for b in outside])
        points = F.when(F.col("start") == i, flips).otherwise(points)
    hot = shared.where(F.col("n") > bucket).select("start", "key", "fp", F.explode(points).alias("point"))
    met = hot.groupBy("point", "start", "key").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return pairs.select("a", "b").union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(id, fp, component): the component is the least id reachable over links."""
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    found = components(links(distinct.select("fp"), bucket))
    of = distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = found.select("component").distinct()
    best = of.join(roots, of.root == roots.component, "semi").groupBy("root").agg(F.min("least").alias("best"))
    label = of.join(best, "root", "left").select("fp", F.coalesce("best", "least").alias("component"))
    return prints.join(label, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """One row of each component that ``find`` gives, that of the least id, with its columns as
    they were. A row is known by its id and its text, so other texts of an id that are no copies
    stay; rows that repeat both count as copies; rows without an id belong to no group and stay."""
    key, kept_key, rank = free_name(docs, "key", "kept_key", "rank")
    named, rest = docs.where(F.col(id_col).isNotNull()), docs.where(F.col(id_col).isNull())
    if named.groupBy(id_col).count().where("count > 1").isEmpty():  # an id is a row: nothing else to tell apart
        kept = find(named, id_col, text_col).where("id = component").select(F.col("id").alias(kept_key))
        return named.join(kept, F.col(id_col) == F.col(kept_key), "semi").unionByName(rest)
    named = named.withColumn(key, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text")))
    kept = find(named, key, text_col).where("id = component").select(F.col("id").alias(kept_key)).distinct()
    found = named.join(kept, F.col(key) == F.col(kept_key), "semi")
    first = found.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(1)))).where(F.col(rank) == 1).drop(rank, key)
    return first.unionByName(rest)
