"""The stages together against plain versions of each."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import plain
from tests.llm.test_near_copies import expected
from trackloom.llm import pii, queries

SF = "/root/testdata/sf0.001"


def test_pseudonyms_equal_the_plain_version(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op9_pii(spark, SF).collect()}
    assert sum(r["n_private"] for r in got.values()) > 10
    assert {i: r["text"] for i, r in got.items()} == {i: plain.pseudonym(t, pii.DEMO_KEY) for i, t in texts.items()}


def test_pipeline_equals_the_plain_version(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {i: t for i, t in docs.items() if plain.keeps(t)}
    first = expected(docs)
    docs = {i: t for i, t in docs.items() if first[i] == i and not plain.leaks(t, items)}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for i, t in docs.items():
        ids = np.array([*tokenizer.encode(plain.pseudonym(t, pii.DEMO_KEY), add_special_tokens=False).ids, 1], "<u4")
        want |= {(i, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048)}
    spark.conf.set("trackloom.pii.secret", pii.DEMO_KEY)
    rows = corpus_pipeline.run(spark, SF).collect()
    spark.conf.unset("trackloom.pii.secret")
    assert {(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows} == want and len(rows) == len(want)
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in seqs.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 2048
