"""Queries of text operators against their SQL, over the smallest tables and over made-up ones with
benchmark items of any length."""

import random

import duckdb
import pytest

from trackloom.llm import queries

SF = "/root/testdata/sf0.001"


def compare(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')" if folder != SF else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    df = queries.QUERIES[name](spark, str(folder))
    assert sorted(df.columns) == sorted(names)
    key = lambda r: str(r)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=key)
    assert got == sorted(found.fetchall(), key=key)
    return got


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, name, SF)


def test_leaks_of_items_of_any_length(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: rng.choice("the of and to in a is it as on".split()) if rng.random() < 0.3 else "".join(rng.choices("abcdefgh", k=5))
    items = [[word() for _ in range(n)] for n in [*range(3, 20)] * 2 + [30, 45]]
    docs = []
    for item in items:
        for wrong in range(5):
            part = list(item[: rng.randint(min(len(item), 13), len(item))])
            for k in rng.sample(range(len(part)), min(wrong, len(part))):
                part[k] = word()
            docs.append(" ".join([word() for _ in range(rng.randrange(20))] + part + [word() for _ in range(rng.randrange(20))]))
    docs += ["", None, " ".join(items[20]) + " " + " ".join(items[20])]
    spark.createDataFrame([(i, t) for i, t in enumerate(docs)] + [(0, docs[0])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(t).title()) for i, t in enumerate(items)] + [(99, None), (98, " ".join(items[3]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert len(compare(spark, "op6_decontaminate", tmp_path)) > 60
