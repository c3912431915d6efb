"""Every registered query of the library against its SQL on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from trackloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


#: Queries without SQL, and where plain code stands against them.
PLAIN = {
    "test_plain_loops": "idn32_enrollment idn03_42_reassociation idn50_named_canonical idn18_ema_matcher idn19_20_gallery_match idn41_smoothed_hold top09_view_diverse_ema idn08_coherence_gate jn12_cross_camera_groups "
    "jn23_optimal_assignment agg14_idf1 ml01_learned_fusion trk03_iou_tracker trk04_sort_tracker trk07_duplicate_suppression win09_stable_crossing",
    "test_merging": "idn10_merge_log idn11_canonical_view idn15_mapper_pass idn16_churn_repair idn35_named_requests",
    "test_growing_index": "sem04_filled_index",
    "test_bonds": "idn43_49_bonds",
    "test_rules": "str13_rules_by_version",
    "test_trackers": "agg18_flicker trk01_centroid_tracker trk02_tracker_stage trk05_two_stage_tracker trk06_appearance_tracker",
    "test_vector_index": "jn18_indexed_recall",
    "test_whole_tables": "idn13_16_linked_clusters idn36_37_reranked",
}


def test_every_query_has_sql_or_plain_code():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {n for names in PLAIN.values() for n in names.split()}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sql, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    text = registry.oracle_sql().get(name)
    if text is None:
        return
    found = sql.execute(text)
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
