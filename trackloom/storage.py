"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Without one, a local session (tests) gets a folder
    of its own; on a cluster that would be out of reach of other machines, so it is an error."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        known = found.get() if found.isDefined() else None
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="trackloom-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/trackloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost
    executors, and what made the rows runs once."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/trackloom/" in path:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


class Scope:
    """Tables that are only needed for a while: made by :meth:`written`, deleted by :meth:`close`."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.made.append(written(df, name))
        return self.made[-1]

    def close(self) -> None:
        while self.made:
            forget(self.made.pop())
