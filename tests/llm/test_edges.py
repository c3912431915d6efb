"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trackloom.llm import decontaminate, html_extract, language_id, packing, pii, quality_classifier, quality_rules, secret_scan, simhash_dedup, token_output
from trackloom.llm.common import fresh_path

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, m string, __kept_id string, component string, spans string, length int, start int, n_words int"
LONG = "alpha beta gamma delta " * 40_000
TEXTS = ["one two three four five six seven eight nine", "", None, "   \n\t ", LONG, "x" * 200_000, "one two three four five six seven eight nine", "dup\x0bwords\x0cand é 日本 😀"]


def rows(n=None):
    ids = [None if i == 2 else i for i in range(len(TEXTS))]
    return [(i, t, "en" if k % 2 else None, None, None, "i", "f", "m", "k", "c", "s", 1, 2, 3) for k, (i, t) in enumerate(zip(ids, TEXTS))][:n] + [(0, TEXTS[0], "en", "s", 1, "i", "f", "m", "k", "c", "s", 1, 2, 3)] * (n is None)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def items(spark, given=("one two three FOUR, five six seven eight nine", None, "", "too short")):
    return spark.createDataFrame(list(enumerate(given)), "item_id long, text string")


def build(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(8)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"), "length", "id")
    return {
        "1": secret_scan.scan(docs), "2": html_extract.main_text(pages), "3": quality_classifier.score(docs, quality_classifier.fit_labels(docs, labels)),
        "4": token_output.read_documents(token_output.write_sequences(docs, fresh_path(spark, "t"), BPE)), "5": quality_rules.ledger(docs),
        "7": simhash_dedup.near_duplicates(docs), "8": packing.pack(docs, BPE)[1], "9": pii.pseudonyms(docs, "k"), "10": language_id.predict(docs, language_id.fit_documents(docs)),
    }


def test_every_row_gets_a_result(spark, docs):
    n = len(TEXTS) + 1
    got = {k: v.collect() for k, v in build(spark, docs).items()}
    for k, found in got.items():
        if k != "8":
            assert len(found) == n, k
    assert {r["id"] for r in got["8"]} == {None, *range(8)} - {2}
    by = lambda k, c="id": {r[c]: r for r in got[k]}
    assert by("1")[1]["base"] == [] and by("2")[1]["text"] == "" and by("2")[None]["text"] == ""
    assert by("2")[4]["text"] == LONG.strip()
    assert by("5", "doc_id")[4]["n_words"] == 160_000 and by("5", "doc_id")[4]["n_repeat_words"] == 160_000
    assert by("5", "doc_id")[None]["n_words"] == by("5", "doc_id")[3]["n_words"] == 0 and by("5", "doc_id")[5]["word_chars"] == 200_000
    assert by("4")[None]["n_tokens"] == 1 and by("4")[1]["n_tokens"] == 1 and by("4")[None]["start"] == 0
    assert by("7")[1]["fp"] == by("7")[None]["fp"] == by("7")[3]["fp"] == 0 and {by("7")[k]["component"] for k in (1, None, 3)} == {1}
    assert by("7")[0]["component"] == by("7")[6]["component"] == 0
    assert by("9", "doc_id")[None]["text"] is None and by("9", "doc_id")[4]["text"] == LONG
    assert by("10")[None]["lang_pred"] == by("10")[1]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for k in ("3", "10") for r in got[k])


def test_empty_tables(spark, none, docs):
    assert all(v.count() == 0 for v in build(spark, none).values())
    assert decontaminate.leaks(none, items(spark)).count() == 0
    assert decontaminate.leaks(docs, items(spark, ())).count() == 0
    assert quality_rules.ablations(quality_rules.ledger(none), quality_rules.STRICT).count() == 0


def test_leaks(spark, docs):
    assert {tuple(r) for r in decontaminate.leaks(docs, items(spark)).collect()} == {(0, 0, 9, 9), (6, 0, 9, 9)}
    kept = decontaminate.clean(docs, items(spark))
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 4, 5, 7]


def test_stages_keep_columns(spark, docs, none, tmp_path):
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    for given in (docs, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, given, str(tmp_path))
            assert found.columns == given.columns
            found.collect()
        corpus_pipeline.STAGES[-1][1](spark, given, str(tmp_path)).collect()
    kept = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in simhash_dedup.keep_one(docs).collect())
    assert kept == [-1, 0, 1, 4, 5, 7]
