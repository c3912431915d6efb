"""A history by days that grows by batches and loses what is past its time.

What is in it is a published list of day folders behind a pointer that changes in one step. A batch
adds folders, pruning takes whole days off the list and writes the day at the edge anew, so only that
day's rows are touched, repeating either changes nothing, and a reader keeps the list it began with.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from trackloom.sources import sinks

DAY = 86_400_000_000
_LIST = "batch string, day bigint, folder string"


def listed(spark: SparkSession, root: str) -> list[tuple[str, int, str]]:
    """(batch, day, folder) of the published list; a folder may be null for a batch without rows."""
    try:
        return [tuple(r) for r in sinks.load_version(spark, f"{root}/list").select("batch", "day", "folder").collect()]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise


def _publish(spark: SparkSession, root: str, entries: list[tuple]) -> None:
    sinks.save_version(spark.createDataFrame(entries, _LIST).coalesce(1), f"{root}/list")


def _write(rows: DataFrame, root: str, batch: str) -> list[tuple[str, int, str]]:
    folder = f"{root}/days/{uuid.uuid4().hex}"
    dated = rows.withColumn("day", F.floor(F.col("us") / DAY))
    dated.write.partitionBy("day").parquet(folder)
    days = [r["day"] for r in rows.sparkSession.read.parquet(folder).select("day").distinct().collect()] if not rows.isEmpty() else []
    return [(batch, int(d), f"{folder}/day={d}") for d in days] or [(batch, None, None)]


def append(rows: DataFrame, root: str, batch: str) -> bool:
    """Add a batch of rows with ``us`` under its own name; False if it is there already."""
    spark = rows.sparkSession
    known = listed(spark, root)
    if any(b == batch for b, _, _ in known):
        return False
    _publish(spark, root, known + _write(rows, root, batch))
    return True


def history(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The rows of the published list."""
    folders = [f for _, _, f in listed(spark, root) if f]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def prune(spark: SparkSession, root: str, schema: str, now_us: int, keep_days: float) -> int:
    """Take rows older than ``keep_days`` before ``now_us`` off the list; how many day folders were
    dropped or written anew. Nothing is kept for ever only by a count: 0 days or less keep all."""
    if keep_days <= 0:
        return 0
    edge = now_us - round(keep_days * DAY)
    known = listed(spark, root)
    old = [e for e in known if e[2] and e[1] < edge // DAY]
    border = [e for e in known if e[2] and e[1] == edge // DAY]
    changed = []
    for batch, day, folder in border:
        rows = spark.read.schema(schema).parquet(folder)
        if rows.where(F.col("us") < edge).isEmpty():
            continue
        changed.append(((batch, day, folder), _write(rows.where(F.col("us") >= edge), root, batch)))
    gone = {*old, *(e for e, _ in changed)}
    if gone:
        left = [e for e in known if e not in gone] + [e for _, new in changed for e in new]
        left += [(b, None, None) for b in {e[0] for e in old} - {e[0] for e in left}]  # the batch stays known
        _publish(spark, root, left)
    return len(gone)


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete day folders that the list doesn't name; how many. For times without older readers."""
    keep = {f.split("/days/")[1] for _, _, f in listed(spark, root) if f}
    path = spark._jvm.org.apache.hadoop.fs.Path
    top = path(f"{root}/days")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    days = [d.getPath() for b in (fs.listStatus(top) if fs.exists(top) else []) for d in fs.listStatus(b.getPath()) if d.isDirectory()]
    old = [d for d in days if f"{d.getParent().getName()}/{d.getName()}" not in keep]
    for d in old:
        fs.delete(d, True)
    return len(old)


def with_history(vectors: DataFrame, rows: DataFrame, id_col: str, row_id: str = "event_id") -> DataFrame:
    """The vectors whose row is still in the history."""
    return vectors.join(rows.select(F.col(row_id).alias(id_col)).distinct(), id_col, "left_semi")
