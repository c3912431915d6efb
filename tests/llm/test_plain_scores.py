"""The classifiers' scores against plain ones, and what they learn from."""

import math

import pytest
from pyspark.sql import functions as F

from trackloom.llm import language_id, quality_classifier

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_quality_scores(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_classifier.fit_labels(docs, labels)
    got = {r["id"]: r["score"] for r in quality_classifier.score(docs, model).collect()}
    for r in docs.collect():
        words = quality_classifier.words(r["text"])
        each = [sum(model.margin[f] for f in quality_classifier.features(w)) / len(quality_classifier.features(w)) for w in words]
        x = (sum(each) / len(each) if each else 0.0) + model.bias
        assert math.isclose(got[r["doc_id"]], 1 / (1 + math.exp(-x)), abs_tol=1e-9)


def test_languages(spark, docs):
    model = language_id.fit_documents(docs)
    got = {r["id"]: r for r in language_id.predict(docs, model).collect()}
    for r in docs.collect():
        text = (r["text"] or "").lower()
        found = [g for w in text.split() for g in language_id.grams(w)]
        if not any(c.isalpha() for c in text):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        z = [sum(float(model.weights[model.index[g]][k]) for g in found if g in model.index) * language_id.SCALE / len(found) + float(model.bias[k]) for k in range(len(model.languages))]
        e = [math.exp((x - max(z)) / model.temperature) for x in z]
        best = max(range(len(z)), key=lambda k: z[k])
        assert got[r["doc_id"]]["lang_pred"] == model.languages[best]
        assert math.isclose(got[r["doc_id"]]["score"], e[best] / sum(e), rel_tol=1e-6)


def test_the_temperature_lies_within_what_is_tried(spark, docs):
    """Also where all texts are told apart, which without any doubt would drive it to nought."""
    model = language_id.fit_documents(docs)
    assert language_id.TEMPERATURES[0] < model.temperature < language_id.TEMPERATURES[-1]
    apart = [("aaa aaa aaa aa" * (1 + i % 3), "x") for i in range(40)] + [("bbb bb bbb bbb" * (1 + i % 3), "y") for i in range(40)]
    model = language_id.fit(apart)
    assert language_id.TEMPERATURES[0] < model.temperature < language_id.TEMPERATURES[-1]
    sure = model.probabilities(model.word_rows(["aaa"]).sum(axis=0))
    assert 0.9 < float(sure.max()) < 1


def test_one_bounded_text_of_each_id(spark, monkeypatch):
    monkeypatch.setattr(language_id, "TRAIN_CHARS", 10)
    rows = spark.createDataFrame([(1, "b", "y"), (1, "a", "z"), (1, "a", "x"), (2, "x" * 11, "x"), (3, "c", "x"), (None, "d", "x")], "id long, t string, y string")
    got = sorted((r["id"], r["t"], r["y"]) for r in language_id.sample(rows, "id", 5).collect())
    assert got == [(1, "a", "x"), (3, "c", "x")]
    assert language_id.sample(rows, "id", 1).count() == 1
