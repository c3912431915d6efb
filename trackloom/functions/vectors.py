"""Embedding vectors: column expressions for single pairs, Arrow blocks for searches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The vector over its length; unchanged if that is next to nothing."""
    return F.element_at(F.transform(F.array(norm(a)), lambda n: F.when(n < 1e-12, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))), 1)


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine; 999 if a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(999.0)).otherwise(1 - dot(a, b) / n)


def mean_vector(vectors: Column) -> Column:
    """The mean of an array of equal-length vectors."""
    n = F.size(vectors)
    zero = F.transform(F.element_at(vectors, 1), lambda x: F.lit(0.0))
    return F.transform(F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double"))), lambda x: x / n)


def bhattacharyya(p: Column, q: Column) -> Column:
    """Distance of two histograms; 1 if one is empty, 999 if one is missing."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    n = total(p) * total(q)
    both = F.aggregate(F.zip_with(p, q, lambda x, y: F.sqrt(x.cast("double") * y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.sqrt(n)
    return F.when(p.isNull() | q.isNull(), F.lit(999.0)).when(n == 0, F.lit(1.0)).otherwise(F.sqrt(F.greatest(F.lit(0.0), 1 - both)))


def link_distance(distances: Column, how: str = "min", k: int = 3) -> Column:
    """Of all distances between two sets: the least, the mean, or the mean of the k least."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    if how == "min":
        return F.array_min(distances)
    return mean(distances) if how == "avg" else mean(F.slice(F.sort_array(distances), 1, k))


def learned_distance(features: list[Column], weights: list[float], bias: float) -> Column:
    """One minus the logistic of a linear form."""
    z = F.lit(bias)
    for f, w in zip(features, weights):
        z = z + f * w
    return 1 - 1 / (1 + F.exp(-z))


def fused_distance(app: Column, face: Column, gait: Column, limits: tuple[float, float, float], face_weight: float = 0.55, gait_weight: float = 0.2) -> Column:
    """Distances over their limits, weighted; the weight of gait comes out of appearance's, and
    what is missing gives its weight to appearance."""
    f = F.when(face.isNotNull(), F.lit(face_weight)).otherwise(F.lit(0.0))
    w = F.when(gait.isNotNull(), F.least(F.lit(gait_weight), 1 - f)).otherwise(F.lit(0.0))
    part = lambda d, limit, weight: F.coalesce(d / limit, F.lit(0.0)) * weight
    return part(app, limits[0], 1 - f - w) + part(face, limits[1], f) + part(gait, limits[2], w)


def to_blob(v: Column) -> Column:
    """Vectors as the bytes of their 32-bit floats, least byte first."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def run(v: pd.Series) -> pd.Series:
        import numpy as np

        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return run(v)


def from_blob(b: Column) -> Column:
    """The vectors of such bytes; null if they aren't a whole number of floats."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<float>")
    def run(b: pd.Series) -> pd.Series:
        import numpy as np

        return b.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, "<f4"))

    return run(b)


def _blocks(df: DataFrame, id_col: str, vec_col: str, side: str) -> DataFrame:
    """Rows of up to BLOCK vectors, each partition by itself."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                rows = part.filter(pa.compute.is_valid(part.column(1)))
                if not rows.num_rows:
                    continue
                matrix = np.array(rows.column(1).to_pylist(), np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([rows.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([matrix.tobytes()], pa.binary())], [f"{side}_ids", f"{side}_m"])

    return df.select(F.col(id_col).cast("bigint"), F.col(vec_col)).mapInArrow(run, f"{side}_ids array<bigint>, {side}_m binary")


def nearest(queries: DataFrame, gallery: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", itself: bool = False) -> DataFrame:
    """(query, id, sim, rank): the k gallery rows of greatest dot product, smaller id first on
    ties. Blocks of queries meet blocks of the gallery in one matrix product each, and only
    each block's best k go on to the merge."""
    q, g = _blocks(queries, id_col, vec_col, "q"), _blocks(gallery, id_col, vec_col, "g")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                qi, gi = np.array(row["q_ids"], np.int64), np.array(row["g_ids"], np.int64)
                s = np.frombuffer(row["q_m"]).reshape(len(qi), -1) @ np.frombuffer(row["g_m"]).reshape(len(gi), -1).T
                if not itself:
                    s[qi[:, None] == gi[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(gi, s.shape), -s), axis=1)[:, :k]
                best = np.take_along_axis(s, order, 1)
                keep = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, keep.sum(1))), pa.array(gi[order][keep]), pa.array(best[keep])], ["query", "id", "sim"])

    met = q.crossJoin(g).mapInArrow(run, "query bigint, id bigint, sim double")  # of blocks, not of rows
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def best_per_group(queries: DataFrame, gallery: DataFrame, group_col: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query, group, sim): the greatest dot product of each query with each group, its own row
    left out. A block gives one row for each query and group in it."""
    q = _blocks(queries, id_col, vec_col, "q")
    tagged = gallery.withColumn("__v", F.array_append(F.col(vec_col).cast("array<double>"), F.col(group_col).cast("double")))
    g = _blocks(tagged, id_col, "__v", "g")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                qi, gi = np.array(row["q_ids"], np.int64), np.array(row["g_ids"], np.int64)
                m = np.frombuffer(row["g_m"]).reshape(len(gi), -1)
                groups, of = np.unique(m[:, -1].astype(np.int64), return_inverse=True)
                s = np.frombuffer(row["q_m"]).reshape(len(qi), -1) @ m[:, :-1].T
                s[qi[:, None] == gi[None, :]] = -np.inf
                best = np.full((len(groups), len(qi)), -np.inf)
                np.maximum.at(best, of, s.T)
                keep = np.isfinite(best.T)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, keep.sum(1))), pa.array(np.broadcast_to(groups, keep.shape)[keep]), pa.array(best.T[keep])], ["query", "group", "sim"])

    met = q.crossJoin(g).mapInArrow(run, "query bigint, group bigint, sim double")  # of blocks, not of rows
    return met.groupBy("query", "group").agg(F.max("sim").alias("sim"))


def _tagged(df: DataFrame, tag_col: str, id_col: str, vec_col: str, side: str) -> DataFrame:
    """Blocks whose vectors carry a whole number behind them."""
    rows = df.withColumn("__v", F.array_append(F.col(vec_col).cast("array<double>"), F.col(tag_col).cast("double")))
    return _blocks(rows, id_col, "__v", side)


def _products(queries: DataFrame, gallery: DataFrame, tag_col: str, id_col: str, vec_col: str, make: Callable, schema: str) -> DataFrame:
    """What ``make(query ids, query tags, gallery ids, gallery tags, products)`` gives, as columns,
    for each pair of blocks."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            for row in batch.to_pylist():
                qi, gi = np.array(row["q_ids"], np.int64), np.array(row["g_ids"], np.int64)
                q, g = np.frombuffer(row["q_m"]).reshape(len(qi), -1), np.frombuffer(row["g_m"]).reshape(len(gi), -1)
                made = make(qi, q[:, -1].astype(np.int64), gi, g[:, -1].astype(np.int64), q[:, :-1] @ g[:, :-1].T)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, target)], schema=target)

    met = _tagged(queries, tag_col, id_col, vec_col, "q").crossJoin(_tagged(gallery, tag_col, id_col, vec_col, "g"))  # of blocks, not of rows
    return met.mapInArrow(run, schema)


def set_distances(vectors: DataFrame, set_col: str, k: int = 3, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(la, lb, least, mean, topk): of all distances between the vectors of two sets, la < lb, the
    least, the mean, and the mean of the ``k`` least. A pair of blocks gives k rows for each pair
    of sets in it at most."""

    def make(qi, qt, gi, gt, s):
        import numpy as np

        out = [[] for _ in range(5)]
        for a in np.unique(qt):
            for b in np.unique(gt[gt > a]):
                d = 1 - s[np.ix_(qt == a, gt == b)].ravel()
                few = np.sort(np.partition(d, min(k, len(d)) - 1)[:k])
                for i, x in enumerate(few):
                    for column, value in zip(out, (a, b, x, d.sum() if i == 0 else 0.0, len(d) if i == 0 else 0)):
                        column.append(value)
        return out

    rows = _products(vectors, vectors, set_col, id_col, vec_col, make, "la bigint, lb bigint, d double, total double, n bigint")
    nth = F.row_number().over(Window.partitionBy("la", "lb").orderBy("d"))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("la", "lb").agg(F.min("d").alias("least"), F.avg("d").alias("topk"))
    mean = rows.groupBy("la", "lb").agg((F.sum("total") / F.sum("n")).alias("mean"))
    return few.join(mean, ["la", "lb"]).select("la", "lb", "least", "mean", "topk")


def pairs_within(vectors: DataFrame, bar: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(a, b, d): pairs of ids, a < b, of which some vectors are at a cosine distance of ``bar`` at
    most, with the least. An id may have several vectors; a pair of blocks gives one row for each
    pair of ids."""
    q, g = _blocks(vectors, id_col, vec_col, "q"), _blocks(vectors, id_col, vec_col, "g")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def unit(ids, raw):
            m = np.frombuffer(raw).reshape(len(ids), -1)
            return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

        for batch in batches:
            for row in batch.to_pylist():
                qi, gi = np.array(row["q_ids"], np.int64), np.array(row["g_ids"], np.int64)
                d = 1 - unit(qi, row["q_m"]) @ unit(gi, row["g_m"]).T
                at = np.nonzero((d <= bar) & (qi[:, None] < gi[None, :]))
                a, b, d = qi[at[0]], gi[at[1]], d[at]
                order = np.lexsort((d, b, a))
                a, b, d = a[order], b[order], d[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(d[new])], ["a", "b", "d"])

    met = q.crossJoin(g).mapInArrow(run, "a bigint, b bigint, d double")  # of blocks, not of rows
    return met.groupBy("a", "b").agg(F.min("d").alias("d"))


def similarity_counts(queries: DataFrame, gallery: DataFrame, set_col: str, bins: int = 1000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(same, bin, n, total): for the pairs of a query and a gallery row of a greater id, how many of
    equal and of different sets have a similarity of bin / bins, rounded, and its sum."""

    def make(qi, qt, gi, gt, s):
        import numpy as np

        out = [[] for _ in range(4)]
        later, same = qi[:, None] < gi[None, :], qt[:, None] == gt[None, :]
        for flag in (True, False):
            x = s[later & (same == flag)]
            at, where = np.unique(np.floor(x * bins + 0.5).astype(np.int64), return_inverse=True)
            for column, values in zip(out, ([flag] * len(at), at, np.bincount(where, minlength=len(at)), np.bincount(where, x, len(at)))):
                column.extend(values)
        return out

    rows = _products(queries, gallery, set_col, id_col, vec_col, make, "same boolean, bin bigint, n bigint, total double")
    return rows.groupBy("same", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def reciprocal_best(queries: DataFrame, gallery: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(a, b, sim): queries, which are rows of the gallery too, and their best rows, if each is
    the other's best."""
    there = nearest(queries, gallery, 1, id_col, vec_col).select(F.col("query").alias("a"), F.col("id").alias("b"), "sim")
    found = gallery.join(there.select(F.col("b").alias(id_col)).distinct(), id_col, "semi")
    back = nearest(found, gallery, 1, id_col, vec_col).select(F.col("query").alias("b"), F.col("id").alias("a"))
    return there.join(back, ["a", "b"]).select("a", "b", "sim")
