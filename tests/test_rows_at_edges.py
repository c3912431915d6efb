"""Rows that random tables seldom hold, put through registered queries and their SQL."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from trackloom.functions import scalars as sc
from trackloom.plans import registry

BEGIN = datetime.datetime(2024, 1, 1)


def both(spark, folder, name, rows):
    """The rows of a query and of its SQL over events of (us after the begin, user, type, value, k)."""
    columns = list(zip(*[(i, BEGIN + datetime.timedelta(microseconds=us), user, kind, value, f'{{"k": {k}}}') for i, (us, user, kind, value, k) in enumerate(rows)]))
    types = {"event_id": pa.int64(), "ts": pa.timestamp("us"), "user_id": pa.int64(), "event_type": pa.string(), "value": pa.float64(), "props": pa.string()}
    pq.write_table(pa.table({n: pa.array(c, t) for (n, t), c in zip(types.items(), columns)}), folder / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    got = [tuple(r[n] for n in names) for r in registry.queries()[name](spark, str(folder)).collect()]
    return sorted(got, key=str), sorted(found.fetchall(), key=str)


def test_a_plate_on_the_edge_of_its_region_is_kept(spark, tmp_path):
    values = (30.49, 30.5, 30.51, 60.49, 60.5, 60.51, 160.5)
    got, want = both(spark, tmp_path, "flt05_plate_roi", [(i, i, "view", v, k) for i, (v, k) in enumerate((v, k) for v in values for k in (30, 31, 58, 62))])
    assert got == want and sum(r[1] for r in want) == 10


def test_time_buckets_round_the_binary_number(spark, tmp_path):
    got, want = both(spark, tmp_path, "fn09_time_bucket", [(i * 1_234_567_800_000 + t, i, "view", 1.0, 1) for i in range(2) for t in range(0, 2_000_000, 50_000)])
    assert got == want
    seconds = [n / 20 for n in range(-45, 60)] + [1.7e9 + n / 20 for n in range(40)] + [0.15 + 1e-16, 9.95, 9.999, 1e15 + 0.25]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate([*seconds, None])], "i int, s double").select("i", sc.time_bucket(F.col("s")).alias("b"))
    assert [r["b"] for r in rows.orderBy("i").collect()] == [*(f"{s:.1f}" for s in seconds), ""]


def test_points_on_a_slanted_line(spark, tmp_path):
    on = [(round(10 + 8 * (k - 50), 2), k) for k in range(50, 61)]
    got, want = both(spark, tmp_path, "prj10_12_line_side", [(i, i, "view", v + d, k) for i, (v, k, d) in enumerate((v, k, d) for v, k in on for d in (-0.01, 0, 0.01, 100) if v + d >= 0)])
    assert got == want and sum(r[1] == 0 for r in want) >= 11


def test_paths_that_meet_the_end_of_a_line(spark, tmp_path):
    pairs = [(55.46, 1, 35.44, 34), (65.66, 37, 46.52, 4), (111.76, 2, 54.78, 11), (40.0, 10, 60.0, 10), (40.0, 90, 60.0, 90), (40.0, 9, 60.0, 9), (40.0, 5, 60.0, 15)]
    got, want = both(spark, tmp_path, "win10_direct_crossing", [(2 * i + j, i, "view", v, k) for i, (v, k, w, m) in enumerate(pairs) for j, (v, k) in enumerate(((v, k), (w, m)))])
    assert got == want and 0 < len(want) < 4


def test_labels_of_very_many_tracks(spark, tmp_path):
    s, users = 1_000_000, 4200
    rows = [(i * s, i, "view", 1.0, 10) for i in range(users)] + [((users + i) * s, i, "view", 1.0, 50) for i in range(0, users, 7)]
    rows += [(432_000 * s + 3 * s + j, 3 + j, "view", 1.0, 60) for j in (-1, 0, 1)] + [(14 * 86_400 * s, 0, "view", 1.0, 50)]
    try:
        got, want = both(spark, tmp_path, "str05_track_labels", rows)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == want and sum(r[3] is not None for r in want) > 600


def test_pairs_at_the_very_radius(spark, tmp_path):
    day = 86_400_000_000
    places = [(x, k) for x in range(0, 100, 7) for k in (10, 20)] + [(x + 10, k) for x in range(0, 90, 7) for k in (10, 16, 28)] + [(x + 6, k) for x in range(0, 90, 11) for k in (18, 2)]
    rows = [(d * day + i, i, "view", float(x), k) for d in range(4) for i, (x, k) in enumerate(places)]
    got, want = both(spark, tmp_path, "win24_confirm_colocation", rows)
    assert got == want and len(want) > 20
