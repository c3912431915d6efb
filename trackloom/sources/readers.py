"""Scans: observation logs, track CSVs, annotations, configuration, plans, galleries."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Observation log rows.
OBSERVATION = (
    "camera string, local_id bigint, stable_id bigint, frame bigint, t double, bbox array<double>, quality double, gid bigint, "
    "app_emb array<float>, face_emb array<float>, gait_emb array<float>, frame_wh array<int>, display_wh array<int>, body_ok boolean, color array<float>, crop string"
)
#: fixed values: header names that mean the same column
ALIASES = {
    "camera": ("camera", "cam"), "frame": ("frame", "frame_idx", "f"), "gid": ("global_id", "gid", "global_id_stab"), "track": ("track_id", "track", "local_id", "tid"),
    "x1": ("x1", "left", "xmin"), "y1": ("y1", "top", "ymin"), "x2": ("x2", "right", "xmax"), "y2": ("y2", "bottom", "ymax"), "label": ("label", "person_id"),
}


#: CSV files whose names don't begin with ``face_``; globs have no plain way to say that.
NOT_FACES = "{[!f]*,f[!a]*,fa[!c]*,fac[!e]*,face[!_]*,f,fa,fac,face}.csv"


def observations_of(raw: DataFrame) -> DataFrame:
    """Log rows as observations: bound by stable_id where there is one; quality defaults to 1;
    a missing gid stays null; the raw id is kept."""
    return raw.select(
        "camera", F.coalesce("stable_id", "local_id").alias("track"), F.col("local_id").alias("raw_id"), "frame", "t", "bbox", F.coalesce("quality", F.lit(1.0)).alias("quality"), "gid", "app_emb", "face_emb", "gait_emb"
    ).where("camera is not null")


def observation_log(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line; blank and malformed lines are skipped."""
    return observations_of(spark.read.schema(OBSERVATION).option("mode", "DROPMALFORMED").json(path))


def observation_stream(spark: SparkSession, folder: str, files: int = 64, since: str | None = None) -> DataFrame:
    """New files of a folder of logs; the checkpoint keeps what was read. With ``since`` (a time as
    ``2026-01-31T12:00:00``), files last changed before it count as read, so a stream can start
    at the present end of a folder."""
    raw = spark.readStream.schema(OBSERVATION).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files)
    return observations_of((raw.option("modifiedAfter", since) if since else raw).json(folder))


def is_below(path: str, root: str) -> bool:
    """Whether a path, links followed, stays under a root."""
    real, top = os.path.realpath(path), os.path.realpath(root)
    return real == top or real.startswith(top.rstrip(os.sep) + os.sep)


def aliased(df: DataFrame, wanted: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """Columns under their own names, whichever alias the header has; absent ones are null."""
    have = {c.lower(): c for c in df.columns}
    pick = lambda names: next((F.col(f"`{have[n]}`") for n in names if n in have), F.lit(None).cast("string"))
    return df.select(*[pick(names).alias(name) for name, names in wanted.items()])


def track_events(spark: SparkSession, path: str) -> DataFrame:
    """Track CSVs of a file or folder (files named ``face_*`` are left out). Rows whose gid is
    not a number go; the label is that of the file, else ``P<gid>``, or ``T`` without one."""
    raw = spark.read.option("header", True).option("pathGlobFilter", NOT_FACES if os.path.splitext(path)[1] != ".csv" else "*.csv").csv(path)
    rows = aliased(raw)
    number = lambda c, k: F.col(c).try_cast(k).alias(c)
    rows = rows.select("camera", number("frame", "bigint"), number("gid", "bigint"), number("track", "bigint"), *[number(c, "double") for c in ("x1", "y1", "x2", "y2")], "label").where("gid is not null")
    return rows.withColumn("label", F.coalesce("label", F.when(F.col("gid") < 0, "T").otherwise(F.concat(F.lit("P"), "gid"))))


def vector_of(text: Column) -> Column:
    """A vector written as numbers between semicolons."""
    return F.transform(F.split(text, ";"), lambda x: x.cast("float"))


def faces(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    return raw.select("camera", F.col("gid").try_cast("bigint").alias("gid"), vector_of(F.col("face")).alias("face")).where("gid is not null")


def annotations(rows: DataFrame, model: str, scenario: str) -> DataFrame:
    """(camera, global_id, person_id) of one model and scenario; blank persons go, and the last
    row (by ``n``) of a key wins."""
    known = rows.where((F.col("model") == model) & (F.col("scenario") == scenario) & ~F.lower(F.trim(F.coalesce("person_id", F.lit("")))).isin("", "nan", "none"))
    last = F.row_number().over(Window.partitionBy("camera", "global_id").orderBy(F.desc("n")))
    return known.withColumn("r", last).where("r = 1").select("camera", F.col("global_id").cast("bigint").alias("global_id"), "person_id")


CAMERAS = "cameras array<struct<camera_id:string,name:string,enabled:boolean,source:struct<type:string,uri:string,fps:double>,processing:struct<fps:double>>>"


def camera_sources(config: DataFrame) -> DataFrame:
    """Enabled cameras with a source; the processing rate goes before the source's."""
    c = config.select(F.posexplode("cameras").alias("i", "c"))
    kept = c.where(F.coalesce("c.enabled", F.lit(True)) & (F.coalesce("c.source.uri", F.lit("")) != ""))
    rate = lambda x: F.when(F.col(x) > 0, F.col(x))
    return kept.select("i", "c.camera_id", F.col("c.source.uri").alias("uri"), F.coalesce(rate("c.processing.fps"), rate("c.source.fps")).alias("fps"), (F.coalesce("c.source.type", F.lit("")) != "file").alias("live"))


DESIRED = "edge_id string, revision int, management_url string, cameras array<struct<camera_id:string,source:string,solution_pack:string,fps:double,apps:array<string>>>, model_bundles map<string,struct<version:string,url:string,sha256:string>>"


def desired_state(rows: DataFrame) -> DataFrame:
    """A row for each camera of a desired state, with the defaults filled in."""
    c = rows.select(F.coalesce("edge_id", F.lit("edge-unknown")).alias("edge_id"), F.coalesce("revision", F.lit(1)).alias("revision"), F.explode("cameras").alias("c"))
    return c.select("edge_id", "revision", "c.camera_id", "c.source", "c.solution_pack", F.coalesce("c.fps", F.lit(10.0)).alias("fps"), "c.apps")


def resolve_source(text: str) -> str:
    """``env:NAME``, ``file:PATH`` and ``secret:NAME`` are looked up on the driver; the rest is
    itself. What is not set or empty is an error, whose text has no value in it."""
    kind, _, name = text.partition(":")
    if kind == "env" or kind == "secret":
        value = os.environ.get(name if kind == "env" else f"SECRET_{name.upper()}", "")
    elif kind == "file" and not name.startswith("//"):
        with open(name, encoding="utf-8") as f:
            value = f.read().strip()
    else:
        value = text
    if not value:
        raise ValueError(f"the {kind} source {name!r} is empty")
    return value


def table_with(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table in which columns of ``schema`` that older files lack are null."""
    return spark.read.schema(schema).option("mergeSchema", True).parquet(path)


class Refreshing:
    """A small table that is read again when its files change, for use in foreachBatch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.mark, self.frame = None, None

    def get(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        mark = sorted((str(s.getPath()), s.getModificationTime(), s.getLen()) for s in fs.listStatus(path))
        if mark != self.mark:
            self.mark, self.frame = mark, self.spark.read.parquet(self.path)
        return self.frame


MANIFEST = "solution_pack string, app_id string, version string, required_data array<string>, required_services array<string>, models array<string>, state array<string>, preferred_hardware map<string,string>"


def app_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each manifest of a folder, JSON or (where PyYAML is installed) YAML. Two
    manifests of one app are an error. Configuration-sized: files are parsed on the driver."""
    import json

    rows, seen = [], set()
    for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content").collect():
        text = bytes(r["content"]).decode("utf-8")
        if r["path"].endswith(".json"):
            doc = json.loads(text)
        elif r["path"].endswith((".yaml", ".yml")):
            import yaml  # optional

            doc = yaml.safe_load(text)
        else:
            continue
        key = (doc["solution_pack"], doc["app_id"])
        if key in seen:
            raise ValueError(f"two manifests of {key}")
        seen.add(key)
        needs = doc.get("requires", {})
        rows.append((*key, str(doc.get("version", "")), needs.get("data", []), needs.get("services", []), doc.get("models", []), doc.get("state", []), {k: str(v) for k, v in doc.get("hardware", {}).items()}))
    return spark.createDataFrame(rows, MANIFEST)


def runtime_plan(spark: SparkSession, path: str) -> DataFrame:
    """Cameras and their nodes of a compiled plan in JSON."""
    plan = spark.read.option("multiLine", True).json(path)
    c = plan.select("solution_pack", F.explode("cameras").alias("c"))
    return c.select("solution_pack", "c.camera_id", F.posexplode("c.nodes").alias("pos", "node"))
