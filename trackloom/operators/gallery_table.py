"""A gallery as two tables, entries and exemplars, that are merged by key; and matches against it by
several vectors at once, of which any may be missing."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.vectors import BLOCK
from trackloom.operators.identity import resolve

#: Exemplars of one identity and modality that stay: the best by quality, then the newest.
CAP = 10


def entries_of(rows: DataFrame) -> DataFrame:
    """(gid, created, last_seen, seen, cameras) of assigned ``rows(gid, us, camera, ...)``: forced
    assignments are rows like others, under the gid that they were given."""
    return rows.groupBy("gid").agg(F.min("us").alias("created"), F.max("us").alias("last_seen"), F.count("*").alias("seen"), F.sort_array(F.collect_set("camera")).alias("cameras"))


def together(entries: DataFrame) -> DataFrame:
    """Entries of several galleries, or of rows and a gallery, as one: the least time of creation, the
    latest seen, all counts and cameras. Merging is the same in any order and grouping."""
    cameras = F.array_sort(F.array_distinct(F.flatten(F.collect_set("cameras"))))
    return entries.groupBy("gid").agg(F.min("created").alias("created"), F.max("last_seen").alias("last_seen"), F.sum("seen").alias("seen"), cameras.alias("cameras"))


def kept(exemplars: DataFrame, cap: int = CAP) -> DataFrame:
    """The ``exemplars(gid, modality, quality, us, id)`` that stay."""
    w = Window.partitionBy("gid", "modality").orderBy(F.desc("quality"), F.desc("us"), "id")
    return exemplars.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= cap).drop("nth")


def merged(entries: DataFrame, exemplars: DataFrame, merges: DataFrame, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """Both tables after ``merges(source, target)`` of entries that are there; chains are followed.
    A source without an entry, or whose target has none, stays as it is."""
    ids = entries.select("gid")
    there = merges.where("source <> target").join(ids.withColumnRenamed("gid", "source"), "source", "semi").join(ids.withColumnRenamed("gid", "target"), "target", "semi")
    final = resolve(there.select(F.col("source").alias("id"), "target"))
    final = final.withColumnRenamed("id", "__id")

    def moved(df: DataFrame) -> DataFrame:
        return df.join(final, df.gid == F.col("__id"), "left").withColumn("gid", F.coalesce("final", "gid")).select(*df.columns)

    return together(moved(entries)), kept(moved(exemplars), cap)


def _blocks(rows: DataFrame, vectors: list[str], numbers: list[str], side: str) -> DataFrame:
    """Rows of up to BLOCK: ids, and for each vector a matrix with rows of zeros where it is missing."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                columns = [pa.array([part.column(0).to_pylist()], pa.list_(pa.int64()))]
                for i in range(len(vectors)):
                    lists = part.column(1 + i).to_pylist()
                    size = max((len(v) for v in lists if v), default=0)
                    m = np.array([v or [0.0] * size for v in lists], float).reshape(len(lists), size)
                    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                    columns.append(pa.array([m.tobytes()], pa.binary()))
                for i in range(len(numbers)):
                    columns.append(pa.array([[x or 0.0 for x in part.column(1 + len(vectors) + i).to_pylist()]], pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays(columns, [f"{side}{i}" for i in range(len(columns))])

    given = rows.select("id", *[F.col(v).cast("array<double>").alias(v) for v in vectors], *[F.col(n).cast("double").alias(n) for n in numbers])
    kinds = [f"{side}0 array<bigint>", *[f"{side}{1 + i} binary" for i in range(len(vectors))], *[f"{side}{1 + len(vectors) + i} array<double>" for i in range(len(numbers))]]
    return given.mapInArrow(run, ", ".join(kinds))


def fused_best(queries: DataFrame, gallery: DataFrame, vectors: list[str], how: str = "mean", weights: list[str] | None = None, face_weight: float = 0.45, reliability: str = "reliability") -> DataFrame:
    """(query, id, d): the nearest gallery row of each query by a distance over several ``vectors``, the
    smaller id on ties; queries without a vector in common with any row are left out.

    ``mean``: of the distances of the vectors that both have. ``weighted``: by the query's ``weights``
    columns, one for each vector, those above zero. ``geff``: of the first vector, which both have to
    have, and the second with a weight of ``face_weight`` times the gallery row's ``reliability``, where
    both have it. One product for each vector and pair of blocks.
    """
    if how not in ("mean", "weighted", "geff"):
        raise ValueError(f"no fusion {how}")
    numbers = weights or [] if how == "weighted" else []
    q, g = _blocks(queries, vectors, numbers, "q"), _blocks(gallery, vectors, [reliability] if how == "geff" else [], "g")
    n = len(vectors)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                qi, gi = np.array(r["q0"], np.int64), np.array(r["g0"], np.int64)
                d, has = [], []
                for i in range(1, n + 1):
                    a, b = (np.frombuffer(r[f"{s}{i}"]).reshape(len(ids), -1) for s, ids in (("q", qi), ("g", gi)))
                    if a.shape[1] and b.shape[1]:
                        d.append(1 - a @ b.T)
                        has.append(a.any(axis=1)[:, None] & b.any(axis=1)[None])
                    else:  # a block in which nobody has it
                        d.append(np.zeros((len(qi), len(gi))))
                        has.append(np.zeros((len(qi), len(gi)), bool))
                if how == "geff":
                    w = np.where(has[1], face_weight * np.array(r[f"g{n + 1}"])[None], 0.0)
                    out = np.where(has[0], (1 - w) * d[0] + w * d[1], np.inf)
                else:
                    w = [h * (np.maximum(np.array(r[f"q{n + 1 + i}"]), 0.0)[:, None] if how == "weighted" else 1.0) for i, h in enumerate(has)]
                    total = sum(w)
                    out = np.where(total > 0, sum(x * y for x, y in zip(w, d)) / np.where(total > 0, total, 1.0), np.inf)
                out[qi[:, None] == gi[None]] = np.inf
                best = np.lexsort((np.broadcast_to(gi, out.shape), out), axis=1)[:, 0]
                at = np.arange(len(qi))
                keep = np.isfinite(out[at, best])
                yield pa.RecordBatch.from_arrays([pa.array(qi[keep]), pa.array(gi[best][keep]), pa.array(out[at, best][keep])], ["query", "id", "d"])

    met = q.crossJoin(g).mapInArrow(run, "query bigint, id bigint, d double")  # of blocks, not of rows
    return met.groupBy("query").agg(F.min(F.struct("d", "id")).alias("best")).select("query", F.col("best.id").alias("id"), F.col("best.d").alias("d"))
