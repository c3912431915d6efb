"""Corpus preparation over the documents table: quality rules, near-duplicates, benchmark
decontamination, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last keep the columns
of documents. ``run`` writes each stage to the shared folder and reads it again for the next,
so a lost executor costs one stage's tasks at most; a stage's table is deleted when the next one
is written. An empty documents table gives no rows.

Pseudonyms need a secret key, ``trackloom.pii.secret`` of the session (Spark redacts settings of
such names in its logs). Without one a run makes its own, which it forgets: its pseudonyms link
within the run and nobody can take them back.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import decontaminate, near_copies, packing, pii, quality_rules, simhash_dedup
from trackloom.llm.common import forget, written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the strict policy rejects go."""
    return quality_rules.quality_filter(docs, quality_rules.STRICT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the least id. Five-word shingles
    agree in four fifths at least."""
    return simhash_dedup.keep_one(docs, find=near_copies.near_copies)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark leak go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private values become pseudonyms; the count of code points follows the text."""
    out = pii.pseudonymised(docs, spark.conf.get("trackloom.pii.secret", None) or secrets.token_hex(32))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    import public_tokenizers

    _, placed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return placed.select(F.col("id").alias("doc_id"), "start", F.col("length").cast("long"), "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("pseudonyms", private_values),
    ("packing", packed),
]
#: Token ids can't be had from SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        made.append(docs)
        for old in made[-2:-1]:
            forget(old)
    packed_ = STAGES[-1][1](spark, docs, sf_dir)  # its pieces are written by now
    for old in made[-1:]:
        forget(old)
    return packed_
