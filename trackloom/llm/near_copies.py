"""Near copies by SimHash fingerprints, pigeonring filtering and the exact Jaccard similarity.

A text is the set of its five-word shingles (the whole text if it has fewer words). Texts whose
sets have a Jaccard similarity of four fifths at least are linked, and links are closed to
components. No link is estimated, and none is lost:

* Each set has a SimHash fingerprint. Those within two bits of each other are found by the ring
  of :mod:`simhash_dedup`, their sets are compared, and the links make the first components.
* Similar sets may be 18 bits apart, which no ring selects. The rest is found by keys: two such sets share one of the first n - ceil(0.8 n) + 1 shingles of each in any common order.
  Those shingles are the join key. The order only saves work: shingles that a sample of the
  texts has often come last.
* Each set has a parity bitmap of two bits a shingle or more, in which each shingle flips one bit.
  Bitmaps differ in no more bits than sets in shingles, so candidates with more different bits
  than the similarity allows go without a look at their sets. The larger of two bitmaps is folded.
* The sets of the candidates that are left are compared.

Texts with equal sets are one node. A node is compared with the least node whose fingerprint is
its own, and a fingerprint's least node with the least within reach. In the first round of keys
every node is compared with the least node of each of its keys that is in another component,
which links a large group of copies at a linear count. Keys that the
sample has in many texts are dealt out over several tasks, whose least nodes are compared in
turn. The second round compares nodes that have the same least node in some key and are still
in different components: where that are few, as pairs; else as blocks of nodes, whose bitmaps
are compared in memory, so that only pairs that may be similar become rows.

Defined cases: a null or blank text has the empty set and links to the like alone; texts of any
length are read whole; equal rows share a component; a row without id takes the least id of its
component (null if there is none); an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import components, forget, written
from trackloom.llm.simhash_dedup import _LOWER, _signed, bits_of, links

SIZE = 5
#: The least similarity as a fraction of whole numbers.
SHARE = (4, 5)
#: Texts of the sample that finds common shingles, and the most of those that are kept.
SAMPLE, COMMON = 20_000, 200_000
#: A key that the sample has in a share x of its texts is dealt out over x * DEAL tasks.
DEAL = 400
#: Nodes under one least node that are paired one by one, about as many that make a block, and the most
#: longs of bitmaps in one, about.
FEW, BLOCK, BLOCK_LONGS = 12, 1024, 1 << 20


def shingles(text: str | None, size: int = SIZE):
    """The sorted distinct shingle hashes of a text."""
    import numpy as np
    import xxhash

    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    if not found:
        return np.empty(0, np.uint64)
    one = " ".join(found).encode("utf-8", "surrogatepass")
    gaps = np.flatnonzero(np.frombuffer(one, np.uint8) == 32)
    n = max(1, len(found) - size + 1)
    begin = np.concatenate(([0], gaps + 1))[:n].tolist()
    end = np.concatenate((gaps, [len(one)]))[min(size, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(one[a:b], 42) for a, b in zip(begin, end)), np.uint64, n))


def node_of(hashes) -> int:
    """One signed long for a set of shingles."""
    import xxhash

    x = xxhash.xxh64_intdigest(hashes.tobytes(), 7)
    return x - (1 << 64) if x >> 63 else x


def parity(hashes):
    """The parity bitmap of a set of shingles, as a power of two of longs."""
    import numpy as np

    bits = 64 << (len(hashes) // 32).bit_length()
    flips = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def _folded(bits: Column, length: Column, times: int = 1) -> Column:
    """A bitmap of ``length`` longs, or up to 2 ** ``times`` times as many, as one of ``length``."""
    for t in reversed(range(times)):
        n = F.shiftleft(length, t)
        halves = F.zip_with(F.slice(bits, F.lit(1), n), F.slice(bits, n + 1, n), lambda x, y: x.bitwiseXOR(y))
        bits = F.when(F.size(bits) > n, halves).otherwise(bits)
    return bits


def _folds(share: tuple[int, int]) -> int:
    """How often the bitmap of the larger of two similar sets is folded at most."""
    return max(1, (-(-share[1] // share[0]) - 1).bit_length())


def _common(docs: DataFrame, size: int):
    """(hashes, shares of texts) of shingles that a sample of the texts has often, sorted by hash."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text, size).view(np.int64))], ["h"])

    n = docs.count()
    some = docs.select("text").sample(fraction=SAMPLE / n, seed=1) if n > SAMPLE else docs.select("text")
    rows = some.mapInArrow(run, "h bigint").groupBy("h").agg(F.count("*").alias("n")).where("n > 3").orderBy(F.desc("n"), "h").limit(COMMON).collect()
    pairs = sorted((r["h"] % (1 << 64), r["n"]) for r in rows)
    return np.array([h for h, _ in pairs], np.uint64), np.array([c for _, c in pairs], float) / max(1, min(n, SAMPLE))


def _nodes(docs: DataFrame, size: int, share: tuple[int, int]) -> DataFrame:
    """(id, node, fp, size, bits, prefix, deal) of every row of ``docs(id, text)``."""
    known, shares = _common(docs, size)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            nodes, fps, sizes, bits, prefixes, deals = [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                h = shingles(text, size)
                n, node = len(h), node_of(h)
                nodes.append(node)
                fps.append(_signed(bits_of(h)))
                sizes.append(n)
                bits.append(parity(h))
                often = np.zeros(n)
                if n and len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    often = np.where(known[at] == h, shares[at], 0.0)
                    order = np.lexsort((h, often))
                    h, often = h[order], often[order]
                first = n - -(-n * share[0] // share[1]) + 1
                tasks = (often[:first] * DEAL).astype(np.int64)
                prefixes.append(h[:first].view(np.int64))
                deals.append(np.where(tasks > 1, 1 + np.int64(node) % np.maximum(tasks, 1), 0).astype(np.int32))
            longs = pa.list_(pa.int64())
            columns = [batch.column(0), pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bits, longs), pa.array(prefixes, longs), pa.array(deals, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "node", "fp", "size", "bits", "prefix", "deal"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, node bigint, fp bigint, size int, bits array<bigint>, prefix array<bigint>, deal array<int>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = [shingles(t, size) for t in batch.column(1).to_pylist()]
            columns = [pa.array([node_of(h) for h in found], pa.int64()), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "shingles"])

    return docs.select("id", "text").mapInArrow(run, "node bigint, shingles array<bigint>")


def _block_pairs(groups: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b) of ``groups(head, n, longs, node, at, size, bits)``: the nodes of one head in different
    components whose sizes and bitmaps allow the similarity. Nodes are put into blocks of
    about BLOCK nodes or BLOCK_LONGS of bitmaps, whichever is less, by their hash, and blocks meet in
    pairs."""
    p, q = share
    folds = _folds(share)
    block = F.pmod(F.xxhash64("node"), F.ceil(F.greatest(F.col("n") / BLOCK, F.col("longs") / BLOCK_LONGS))).alias("block")
    blocks = groups.groupBy("head", block).agg(F.collect_list(F.struct("node", "at", "size", "bits")).alias("x"))
    y = blocks.select("head", F.col("block").alias("other"), F.col("x").alias("y"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def by_length(column):
            """(nodes, components, sizes, bitmaps) of a block by bitmap length."""
            node, at, size, bits = column.flatten().flatten()
            lengths = np.diff(bits.offsets.to_numpy())
            first, longs = bits.offsets.to_numpy()[:-1], bits.values.to_numpy().view(np.uint64)  # bits of signed numbers aren't counted as they are
            for m in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == m)
                yield m, node.to_numpy()[rows], at.to_numpy()[rows], size.to_numpy().astype(np.int64)[rows], longs[first[rows][:, None] + np.arange(m)]

        for batch in batches:
            for i in range(batch.num_rows):
                one = list(by_length(batch.column(0).slice(i, 1)))
                two = list(by_length(batch.column(1).slice(i, 1)))
                for l, na, ia, sa, xa in one:
                    for m, nb, ib, sb, xb in two:
                        if max(l, m) > min(l, m) << folds:
                            continue  # the sizes of the sets differ too much
                        k = min(l, m)
                        x, y = (v if v.shape[1] == k else np.bitwise_xor.reduce(v.reshape(len(v), -1, k), axis=1) for v in (xa, xb))
                        step = max(1, (1 << 20) // max(1, len(y) * k))
                        for c in range(0, len(x), step):
                            part = slice(c, c + step)
                            both = sa[part, None] + sb[None]
                            most = both - 2 * -(-p * both // (p + q))
                            ok = (ia[part, None] != ib[None]) & (q * sa[part, None] >= p * sb[None]) & (q * sb[None] >= p * sa[part, None])
                            ok &= np.bitwise_count(x[part, None] ^ y[None]).sum(axis=2, dtype=np.int64) <= most
                            r, s = np.nonzero(ok)
                            lo, hi = np.minimum(na[part][r], nb[s]), np.maximum(na[part][r], nb[s])
                            yield pa.RecordBatch.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["a", "b"])

    return blocks.join(y, "head").where("block <= other").select("x", "y").mapInArrow(run, "a bigint, b bigint")


def _within_reach(nodes: DataFrame) -> DataFrame:
    """(a, b) of ``nodes(node, fp)``: the least node of a fingerprint with the others that have it, and
    with the least node among the fingerprints that the ring links to it."""
    least = written(nodes.groupBy("fp").agg(F.min("node").alias("a")), "fingerprints")
    same = nodes.select("node", "fp").join(least, "fp").where("a < node").select("a", F.col("node").alias("b"))
    found = links(least.select("fp"))
    ends = found.join(least.select(F.col("fp").alias("a"), F.col("a").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("a").alias("y")), "b")
    across = ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).groupBy("b").agg(F.min("a").alias("a"))
    return same.union(across.select("a", "b"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, share: tuple[int, int] = SHARE) -> DataFrame:
    """(id, node, component): the component is the least id reachable over links."""
    p, q = share
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = written(_nodes(given, size, share), "nodes")
    first = F.row_number().over(Window.partitionBy("node").orderBy(F.col("id").asc_nulls_last()))
    one_each = lambda *columns: prints.select("id", "node", *columns).withColumn("nth", first).where("nth = 1").drop("nth")
    nodes = written(one_each("fp", "size", "bits").withColumnRenamed("id", "least"), "distinct")
    keyed = one_each("prefix", "deal").select("node", F.explode(F.arrays_zip("prefix", "deal")).alias("k")).select(F.col("k.prefix").alias("key"), F.col("k.deal").alias("deal"), "node")
    group = Window.partitionBy("key", "deal")
    ends = keyed.withColumns({"head": F.min("node").over(group), "last": F.max("node").over(group)})
    shared = written(ends.where("head < last or deal > 0").drop("last"), "shared")
    heads = shared.where("deal > 0").select("key", "head").distinct()
    tops = heads.groupBy("key").agg(F.min("head").alias("a"))

    def near(pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """The pairs (a, b) whose sets are similar enough, but for those in one of the ``known`` components."""
        spots = nodes.withColumn("at", F.col("node")) if known is None else nodes.join(known, "node", "left").withColumn("at", F.coalesce("component", "node"))
        side = lambda c, *names: spots.select(F.col("node").alias(c), *[F.col(x).alias(y) for x, y in zip(("size", "bits", "least", "at"), names)])
        both = pairs.where("a < b").distinct().join(side("a", "m", "x", "ida", "i"), "a").join(side("b", "n", "y", "idb", "j"), "b").where("i <> j")
        fits = (q * F.col("m") >= p * F.col("n")) & (q * F.col("n") >= p * F.col("m"))
        length = F.least(F.size("x"), F.size("y"))
        flips = F.aggregate(F.zip_with(_folded(F.col("x"), length, _folds(share)), _folded(F.col("y"), length, _folds(share)), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        most = F.col("m") + F.col("n") - 2 * F.ceil(p * (F.col("m") + F.col("n")) / (p + q))
        pairs = written(both.where(fits).where(flips <= most).select("a", "b", "ida", "idb"), "candidates")
        ids = pairs.select(F.col("ida").alias("wanted")).union(pairs.select("idb")).distinct()
        sets = written(_sets(given.join(ids, F.col("id").eqNullSafe(F.col("wanted")), "semi"), size).dropDuplicates(["node"]), "sets")
        with_sets = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        found = written(with_sets.where((p + q) * common >= p * (F.size("x") + F.size("y"))).select("a", "b").distinct(), "links")
        forget(sets)
        forget(pairs)
        return found

    zero = near(_within_reach(nodes))
    by_key = shared.select(F.col("head").alias("a"), F.col("node").alias("b")).union(heads.join(tops, "key").select("a", F.col("head").alias("b")))
    one = zero.union(near(by_key, components(zero)))
    known = components(one)
    # dealt keys get one head again; their number is bounded by COMMON
    under = shared.join(F.broadcast(tops), "key", "left").select(F.coalesce("a", "head").alias("head"), "node").distinct()
    placed = under.join(known, "node", "left").select("head", "node", F.coalesce("component", "node").alias("at"))
    # bitmaps are counted by length here, where rows are narrow: a head may have very many nodes
    placed = written(placed.join(nodes.select("node", F.size("bits").alias("long")), "node"), "placed")
    counts = placed.groupBy("head").agg(F.count("*").alias("n"), F.sum("long").alias("longs"), F.min("at").alias("lo"), F.max("at").alias("hi")).where("lo < hi").select("head", "n", "longs")
    still = placed.join(counts, "head").drop("long")
    few = still.where(F.col("n") <= FEW)
    x, y = few.select("head", F.col("node").alias("a"), F.col("at").alias("i")), few.select("head", F.col("node").alias("b"), F.col("at").alias("j"))
    many = still.where(F.col("n") > FEW).join(nodes.select("node", "size", "bits"), "node")
    two = near(x.join(y, "head").where("a < b and i <> j").select("a", "b").union(_block_pairs(many, share)))
    forget(shared)
    forget(placed)
    found = components(one.union(two))
    of = nodes.join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("root"))
    best = of.groupBy("root").agg(F.min("least").alias("best"))
    return prints.join(of.join(best, "root").select("node", F.col("best").alias("component")), "node").select("id", "node", "component")
