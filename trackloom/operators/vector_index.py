"""An inverted-list index for vectors: every row in the list of its nearest centre, searches in
the lists nearest to the query.

Centres come from at most ``sample`` rows (spherical k-means on the driver); every row is
indexed. A search is not exact: :func:`recall` measures it against the block product over all
rows. Lists are cut into blocks by the hash of the ids, so a list that holds a third of all rows
is many blocks, and no list is gathered in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import vectors as ve

#: Rows that the centres are fitted on.
SAMPLE = 20_000


def fit_centres(vectors: DataFrame, lists: int = 64, sample: int = SAMPLE, rounds: int = 10, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding"):
    """Unit centres as an array, from the rows of the least id hash. Empty without rows."""
    import numpy as np

    rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(vec_col).alias("v"), F.xxhash64(id_col).alias("h")).orderBy("h").limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    m = unit(np.array([r["v"] for r in rows], float))
    centres = m[np.random.default_rng(seed).permutation(len(m))[:lists]]
    for _ in range(rounds):
        of = (m @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, m)
        have = np.bincount(of, minlength=len(centres)) > 0
        centres = np.where(have[:, None], unit(sums), centres)
    return centres


def listed(vectors: DataFrame, centres, lists: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(list, id, v): each row in its ``lists`` nearest lists; rows without a vector are left out."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n = min(lists, len(centres)) if batch.num_rows else 0
            best = np.argsort(-(np.array(batch.column(1).to_pylist(), float) @ centres.T), axis=1, kind="stable")[:, :n] if n else np.zeros((0, 0), int)
            at = pa.array(np.repeat(np.arange(batch.num_rows), n))
            yield pa.RecordBatch.from_arrays([pa.array(best.ravel(), pa.int32()), batch.column(0).take(at), batch.column(1).take(at)], ["list", "id", "v"])

    given = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return given.mapInArrow(run, "list int, id bigint, v array<double>")


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    counts = F.broadcast(rows.groupBy("list").agg(F.count("*").alias("n")))  # a row for each list
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / ve.BLOCK)).alias("block")
    return rows.join(counts, "list").groupBy("list", block).agg(F.collect_list(F.struct("id", "v")).alias(name)).select("list", name)


def search(queries: DataFrame, index: DataFrame, centres, k: int, probes: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query, id, sim, rank): the nearest rows of ``index`` (made by :func:`listed`) in the ``probes``
    lists nearest to each query, itself left out."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def side(column, i):
            ids, v = column.slice(i, 1).flatten().flatten()
            return ids.to_numpy(), v.flatten().to_numpy().reshape(len(ids), -1)

        for batch in batches:
            for i in range(batch.num_rows):
                (qi, q), (gi, g) = side(batch.column(0), i), side(batch.column(1), i)
                s = q @ g.T
                s[qi[:, None] == gi[None]] = -np.inf
                order = np.lexsort((np.broadcast_to(gi, s.shape), -s), axis=1)[:, :k]
                best = np.take_along_axis(s, order, 1)
                keep = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, keep.sum(1))), pa.array(gi[order][keep]), pa.array(best[keep])], ["query", "id", "sim"])

    met = _blocks(listed(queries, centres, probes, id_col, vec_col), "q").join(_blocks(index, "g"), "list").select("q", "g").mapInArrow(run, "query bigint, id bigint, sim double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): the share of the exact nearest rows that were found."""
    hit = exact.select("query", "id").join(found.select("query", "id").withColumn("hit", F.lit(1)), ["query", "id"], "left")
    return hit.agg(F.count_distinct("query").alias("queries"), F.round(F.count("hit") / F.nullif(F.count("*"), F.lit(0)), 4).alias("recall"))
