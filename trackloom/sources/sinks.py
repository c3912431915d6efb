"""Sinks: envelopes, local logs, versioned folders, and fan-out to brokers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Writer = Callable[[DataFrame, int], None]


def envelope(rows: DataFrame, body: list[str], message_type: str = "camera_analytics", version: str = "5.0") -> DataFrame:
    """(key, value) with a JSON message for each row; ``camera`` and ``seq`` name the message."""
    message = F.struct(F.lit(version).alias("schema_version"), F.lit(message_type).alias("message_type"), F.concat_ws(":", "camera", "seq").alias("message_id"), "camera", *body)
    return rows.select(F.col("camera").alias("key"), F.to_json(message).alias("value"))


def json_log(path: str) -> Writer:
    """JSON lines in a folder for each batch, so a batch that is repeated doesn't double its rows."""
    return lambda df, batch: df.write.mode("overwrite").json(f"{path}/batch={batch}")


def event_log(rows: DataFrame, pack: str) -> DataFrame:
    """Events with the defaults of the local log and the name of their picture."""
    stamp = F.date_format(F.timestamp_micros("us"), "yyyyMMdd'T'HHmmss")
    return rows.withColumns({"solution_pack": F.lit(pack), "timestamp_utc": F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "snapshot": F.concat_ws("_", "camera", stamp, "event_id")})


def kafka(servers: str, topic: str, **options: str) -> Writer:
    """Also for services that speak the Kafka protocol; needs the connector on the class path."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).options(**options).save()

    return write


def per_partition(connect: Callable[[], tuple[Callable[[dict], None], Callable[[], None]]]) -> Writer:
    """For brokers without a Spark connector. ``connect`` runs on the executors, once for each
    partition that has rows, and gives what sends a row and what closes the connection."""

    def write(df: DataFrame, batch: int) -> None:
        def run(batches):
            import pyarrow as pa

            sent, put, close = 0, None, None
            try:
                for b in batches:
                    for row in b.to_pylist():
                        if put is None:
                            put, close = connect()
                        put(row)
                        sent += 1
            finally:
                if close is not None:
                    close()
            yield pa.RecordBatch.from_arrays([pa.array([sent], pa.int64())], ["sent"])

        df.mapInArrow(run, "sent bigint").write.format("noop").mode("overwrite").save()

    return write


def fan_out(writers: dict[str, Writer]) -> Writer:
    """All sinks get every batch; failures are gathered and raised once at the end."""

    def write(df: DataFrame, batch: int) -> None:
        kept = df.persist()
        failed = {}
        try:
            for name, w in writers.items():
                try:
                    w(kept, batch)
                except Exception as e:  # the others still get their rows
                    failed[name] = e
        finally:
            kept.unpersist()
        if failed:
            raise RuntimeError("; ".join(f"{n}: {e}" for n, e in failed.items()))

    return write


def redis_stream(host: str, port: int, stream: str, maxlen: int = 10_000) -> Writer:
    def connect():
        import redis  # optional client

        client = redis.Redis(host, port)
        return lambda r: client.xadd(stream, {"payload": r["value"]}, maxlen=maxlen, approximate=True), client.close

    return per_partition(connect)


def mqtt(host: str, port: int, topic: str, qos: int = 0, retain: bool = False) -> Writer:
    def connect():
        from paho.mqtt import client as paho  # optional client

        client = paho.Client()
        client.connect(host, port)
        client.loop_start()

        def close() -> None:
            client.loop_stop()
            client.disconnect()

        return lambda r: client.publish(topic, r["value"], qos, retain).wait_for_publish(), close

    return per_partition(connect)


def rabbit(url: str, exchange: str, routing_key: str) -> Writer:
    def connect():
        import pika  # optional client

        connection = pika.BlockingConnection(pika.URLParameters(url))
        channel = connection.channel()
        return lambda r: channel.basic_publish(exchange, routing_key, r["value"]), connection.close

    return per_partition(connect)


MAKERS = {"json": lambda c: json_log(c["path"]), "kafka": lambda c: kafka(c["servers"], c["topic"]), "eventhub": lambda c: kafka(c["servers"], c["topic"], **c.get("options", {})), "redis": lambda c: redis_stream(c["host"], int(c.get("port", 6379)), c["stream"]), "mqtt": lambda c: mqtt(c["host"], int(c.get("port", 1883)), c["topic"]), "rabbitmq": lambda c: rabbit(c["url"], c["exchange"], c.get("routing_key", ""))}


def from_config(outputs: list[dict]) -> Writer:
    """Writers of all enabled outputs. One that can't be made is left out, unless none is left."""
    made, failed = {}, []
    for i, c in enumerate(outputs):
        if not c.get("enabled", True):
            continue
        try:
            made[f"{c['type']}-{i}"] = MAKERS[c["type"]](c)
        except Exception as e:
            failed.append(f"{c.get('type')}: {e}")
    if failed and not made:
        raise ValueError("no output can be made: " + "; ".join(failed))
    return fan_out(made)


def save_version(df: DataFrame, root: str) -> str:
    """Write a whole new version and then point to it in one step, so readers see the old version
    or the new one."""
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path(f"{root}/.current.tmp"), True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(path(f"{root}/.current.tmp"), path(f"{root}/current"), how)
    return version


def load_version(spark, root: str) -> DataFrame:
    version = spark.read.text(f"{root}/current").first()[0]
    return spark.read.parquet(f"{root}/{version}")


def gallery_export(vectors: DataFrame, path: str, id_col: str = "vec_id", gid_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Unit vectors with their gid, as Parquet, and the counts of each gid."""
    from trackloom.functions.vectors import unit

    vectors.select(F.col(id_col).alias("row"), F.col(gid_col).alias("gid"), unit(F.col(vec_col)).alias("emb")).write.mode("overwrite").parquet(path)
    return vectors.sparkSession.read.parquet(path).groupBy("gid").agg(F.count("*").alias("n"))


def plans(rows: DataFrame, path: str) -> None:
    """One folder of JSON for each solution pack."""
    rows.write.mode("overwrite").partitionBy("solution_pack").json(path)
