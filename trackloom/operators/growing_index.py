"""A vector index that grows: steps append rows to the lists of the centres that are there; after a
stated growth the centres are fitted anew and all rows listed again. A version is published only
with a number of lists to search by which the measured recall reaches the gate.

A version is one small row (centres, part folders, counts, lists to search) behind a pointer that
changes in one step, so a reader sees the last version or the new one, whole. Parts are never
changed; :func:`vacuum` deletes those that the current version doesn't name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from trackloom.functions import vectors as ve
from trackloom.operators import vector_index as vx
from trackloom.sources import sinks
from trackloom.storage import Scope

#: Rows whose recall is measured, at most: those of the least id hash.
ASKED = 500
_ROWS = "list int, id bigint, v array<double>"
_VERSION = "centres array<array<double>>, parts array<string>, n bigint, n_centred bigint, probes int, recall double"


def version(spark: SparkSession, root: str):
    """The published version, None before the first."""
    try:
        return sinks.load_version(spark, root).select(*[f.split()[0] for f in _VERSION.split(", ")]).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def rows(spark: SparkSession, held) -> DataFrame:
    """(list, id, v) of a version."""
    return spark.read.schema(_ROWS).parquet(*held["parts"])


def add(vectors: DataFrame, root: str, lists: int = 16, growth: float = 0.5, k: int = 10, gate: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> int:
    """Index the rows of ``vectors`` that aren't yet, and publish a version with them; how many there
    were. Vectors of any numeric type become doubles; rows without a vector are left out; repeating a
    step adds nothing; of rows with one id the least vector is taken."""
    import numpy as np

    spark, scope = vectors.sparkSession, Scope()
    held = version(spark, root)
    new = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    new = new.groupBy("id").agg(F.min("v").alias("v"))
    if held is not None:
        new = new.join(rows(spark, held).select("id"), "id", "left_anti")
    new = scope.written(new, "index-rows")
    n = new.count()
    if not n:
        scope.close()
        return 0
    total = n + (held["n"] if held is not None else 0)
    if held is None or total > held["n_centred"] * (1 + growth):
        whole = new if held is None else new.unionByName(rows(spark, held).select("id", "v"))
        centres, centred, parts = vx.fit_centres(whole, lists, id_col="id", vec_col="v"), total, []
    else:
        whole, centres, centred, parts = new, np.array(held["centres"]), held["n_centred"], list(held["parts"])
    part = f"{root}/part-{uuid.uuid4().hex}"
    vx.listed(whole, centres, id_col="id", vec_col="v").write.parquet(part)
    index = spark.read.schema(_ROWS).parquet(*parts, part)
    asked = scope.written(index.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(ASKED), "asked")
    exact = scope.written(ve.nearest(asked, index, k, "id", "v"), "exact")
    probes, recall = max(1, min(held["probes"] if held is not None else len(centres) // 4, len(centres))), 0.0
    while True:
        recall = vx.recall(vx.search(asked, index, centres, k, probes, "id", "v"), exact).first()["recall"]
        if recall is None or recall >= gate or probes >= len(centres):
            break
        probes = min(len(centres), probes + max(1, len(centres) // 8))
    scope.close()
    one = [([c.tolist() for c in centres], [*parts, part], total, centred, probes, 1.0 if recall is None else float(recall))]
    sinks.save_version(spark.createDataFrame(one, _VERSION), root)
    return n


def search(asked: DataFrame, root: str, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query, id, sim, rank) in the published version."""
    import numpy as np

    held = version(asked.sparkSession, root)
    if held is None:
        return asked.sparkSession.createDataFrame([], "query bigint, id bigint, sim double, rank int")
    return vx.search(asked, rows(asked.sparkSession, held), np.array(held["centres"]), k, held["probes"], id_col, vec_col)


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete the parts that the published version doesn't name; how many there were. For times
    without readers of older versions."""
    held = version(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    keep = {p.rsplit("/", 1)[1] for p in (held["parts"] if held is not None else [])}
    old = [s.getPath() for s in fs.listStatus(path(root)) if s.getPath().getName().startswith("part-") and s.getPath().getName() not in keep]
    for p in old:
        fs.delete(p, True)
    return len(old)
