"""Retention by days: repeats change nothing, readers keep their version."""

from trackloom.operators import retention as rt

SCHEMA = "event_id bigint, us bigint"
D = rt.DAY


def ids(df):
    return sorted(r["event_id"] for r in df.collect())


def test_prune_drops_days_and_cuts_the_edge(spark, tmp_path):
    root = f"file://{tmp_path}/h"
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert ids(rt.history(spark, root, SCHEMA)) == [] and rt.prune(spark, root, SCHEMA, 9 * D, 1) == 0
    one = [(i, i * D // 4) for i in range(20)]
    two = [(100 + i, i * D // 2 + 7) for i in range(16)]
    assert rt.append(frame(one), root, "one") and rt.append(frame(two), root, "two") and not rt.append(frame(two), root, "two")
    assert rt.append(frame([]), root, "none") and not rt.append(frame([]), root, "none")
    before = rt.history(spark, root, SCHEMA)
    assert ids(before) == sorted(i for i, _ in one + two)
    now, keep = 7 * D + D // 3, 4.0
    want = sorted(i for i, us in one + two if us >= now - keep * D)
    assert rt.prune(spark, root, SCHEMA, now, keep) == 8
    assert ids(rt.history(spark, root, SCHEMA)) == want
    assert ids(before) == sorted(i for i, _ in one + two)  # a reader that began before
    assert rt.prune(spark, root, SCHEMA, now, keep) == 0 and ids(rt.history(spark, root, SCHEMA)) == want
    assert not rt.append(frame(one), root, "one")
    assert rt.vacuum(spark, root) == 8 and rt.vacuum(spark, root) == 0
    assert ids(rt.history(spark, root, SCHEMA)) == want and rt.prune(spark, root, SCHEMA, now, 0) == 0
    assert rt.prune(spark, root, SCHEMA, 99 * D, 1) > 0 and ids(rt.history(spark, root, SCHEMA)) == []
    assert not rt.append(frame(one), root, "one") and not rt.append(frame(two), root, "two")
    kept = rt.with_history(spark.createDataFrame([(1, "a"), (2, "b")], "vec_id long, v string"), frame([(2, 0), (2, 1)]), "vec_id")
    assert [r["vec_id"] for r in kept.collect()] == [2]
