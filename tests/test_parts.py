"""Geometry, joins, assignment, trackers, plates, identity, sources and sinks."""

import itertools
import json
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trackloom.functions import geometry as g
from trackloom.functions import scalars as sc
from trackloom.functions import vectors as ve
from trackloom.operators import identity as idn
from trackloom.operators import joins as jn
from trackloom.operators import indexing as ix
from trackloom.operators import plates, trackers
from trackloom.operators import zones as zn
from trackloom.operators.assignment import hungarian
from trackloom.sources import readers as rd
from trackloom.sources import sinks as sk


def test_compass(spark):
    moves = [(1, 0), (0, 1), (-1, 0), (0, -1), (1, 1)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in moves], "x double, y double")
    assert [r[0] for r in df.select(g.compass(F.col("x"), F.col("y"))).collect()] == ["east", "south", "west", "north", "south_east"]


def test_polygon_edges_are_half_open(spark):
    square = g.polygon([(0, 0), (1, 0), (1, 1), (0, 1)])
    df = spark.createDataFrame([(0.5, 0.5), (0.0, 0.5), (1.0, 0.5), (0.5, 0.0), (0.5, 1.0), (2.0, 0.5)], "x double, y double")
    assert [r[0] for r in df.select(g.in_polygon(F.col("x"), F.col("y"), square)).collect()] == [True, True, False, True, False, False]
    assert not df.select(g.in_polygon(F.col("x"), F.col("y"), g.polygon([(0, 0), (1, 1)]))).first()[0]
    odd = [(0.1, 0.2), (0.5, 0.05), (0.9, 0.3), (0.7, 0.95), (0.2, 0.8)]
    grid = spark.range(441).select((F.col("id") % 21 / 20).alias("x"), (F.floor(F.col("id") / 21) / 20).alias("y"))
    assert grid.where(g.in_polygon(F.col("x"), F.col("y"), g.polygon(odd)) != g.in_fixed_polygon(F.col("x"), F.col("y"), odd)).count() == 0


def test_homography_fit():
    image = [(0, 0), (4, 1), (5, 5), (-1, 4), (2, 2)]
    h = np.array([[1.1, 0.2, 3], [0.1, 0.9, -2], [0.01, 0.02, 1]])
    plane = [tuple((p := h @ [x, y, 1])[:2] / p[2]) for x, y in image]
    assert np.allclose(g.fit_homography(image, plane), h.ravel())


def test_hungarian_finds_the_least_cost():
    rng = random.Random(1)
    for n, m in [(1, 1), (3, 3), (2, 4), (5, 3), (0, 2)]:
        a = np.array([[rng.random() for _ in range(m)] for _ in range(n)]).reshape(n, m)
        got = hungarian(a)
        k = min(n, m)
        best = min((sum(a[r, c] for r, c in zip(rows, cols)) for rows in itertools.permutations(range(n), k) for cols in itertools.combinations(range(m), k)), default=0)
        assert len(got) == k and sum(a[r, c] for r, c in got) == pytest.approx(best)


@pytest.mark.parametrize("make", [trackers.Greedy, trackers.Centroid, trackers.Kalman, trackers.TwoStage])
def test_trackers_follow_two_objects(make):
    t = make()
    seen = []
    for n in range(12):
        boxes = [(10 + 3 * n, 10, 60 + 3 * n, 110), (300 - 2 * n, 50, 360 - 2 * n, 180)]
        order = boxes if n % 2 else boxes[::-1]
        ids = t.frame(n, order, [0.9, 0.9])
        seen.append(tuple(ids if n % 2 else ids[::-1]))
    assert len(set(seen)) == 1 and len(set(seen[0])) == 2


def test_suppression_keeps_the_best_in_input_order():
    assert trackers.suppress([(0, 0, 10, 10), (1, 0, 11, 10), (50, 0, 60, 10)], [0.5, 0.9, 0.1]) == [1, 2]


def test_plate_vote():
    reads = [("KA01AB1234", 1.0), ("KA01AB1284", 1.0), ("KA01AB1234", 1.0), ("KA01AB1234", 1.0)]
    assert plates.vote(reads) == "KA01AB1234" and plates.vote(reads[:3]) is None
    assert plates.vote([("KA01AB1234", 1.0), ("KA01AB1284", 1.0)] * 2) is None


def test_plate_hold_and_forget():
    step, state, out = plates.confirm_step(), ([], None, None), []
    for i in [*range(5), 400, 401, 402, 403]:
        state, made = step(state, {"camera": "c", "track_id": 1, "frame_idx": i, "text": "KA01AB1234" if i < 300 else "MH02CD5678", "weight": 1.0})
        out += [(m["plate"], m["frame_idx"]) for m in made]
    assert out == [("KA01AB1234", 3), ("MH02CD5678", 403)]


def test_complete_linkage_needs_every_cross_pair():
    assert idn.complete_linkage([(0.1, 1, 2), (0.2, 2, 3)]) == [[1, 2]]
    assert idn.complete_linkage([(0.1, 1, 2), (0.2, 2, 3), (0.3, 1, 3)]) == [[1, 2, 3]]


def test_resolve_follows_chains(spark):
    got = {r["id"]: r["final"] for r in idn.resolve(spark.createDataFrame([(i, i - 1) for i in range(1, 15)], "id long, target long")).collect()}
    assert got == {i: 0 for i in range(1, 15)}


def test_connected(spark):
    got = {r["id"]: r["root"] for r in idn.connected(spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 7)], "a long, b long")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 8: 8, 9: 8}


def test_asof_ties_take_the_earlier(spark):
    left = spark.createDataFrame([(1, 10), (1, 5), (2, 1)], "key int, us long")
    right = spark.createDataFrame([(1, 0, 7), (1, 20, 8), (1, 0, 6)], "key int, us long, id int")
    assert {(r["key"], r["us"]): r["nearest"] for r in jn.asof_nearest(left, right, "key", "us", "id").collect()} == {(1, 10): 6, (1, 5): 6, (2, 1): None}


def test_overlaps_equal_the_plain_join(spark):
    rng = random.Random(2)
    data = [(i, rng.choice("ab"), s := rng.randrange(500), s + rng.randrange(120)) for i in range(60)]
    df = spark.createDataFrame(data, "id int, cam string, s long, e long")
    got = {(r["a"]["id"], r["b"]["id"]) for r in jn.overlaps(df, df, ["cam"], "s", "e", 37).collect()}
    assert got == {(a[0], b[0]) for a in data for b in data if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]}


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(50, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None)], "vec_id long, embedding array<float>").repartition(3)
    got = {(r["query"], r["rank"]): r["id"] for r in ve.nearest(df.where("vec_id % 20 = 0"), df, 4).collect()}
    w = v.astype(np.float32).astype(float)
    for q in (0, 20, 40):
        s = w @ w[q]
        s[q] = -9
        assert [got[q, k + 1] for k in range(4)] == np.argsort(-s)[:4].tolist()


def test_json_log_and_csv_scans(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"camera":"c","local_id":1,"stable_id":5}\n\nnot json\n{"camera":"c","local_id":2}\n')
    assert sorted((r["track"], r["quality"]) for r in rd.observation_log(spark, str(tmp_path / "a.jsonl")).collect()) == [(2, 1.0), (5, 1.0)]
    (tmp_path / "e.csv").write_text("cam,f,gid,tid,x1,y1,x2,y2\nc,1,7,3,0,0,1,1\nc,2,-1,3,0,0,1,1\nc,3,oops,3,0,0,1,1\n")
    assert [(r["frame"], r["label"]) for r in rd.track_events(spark, str(tmp_path / "e.csv")).orderBy("frame").collect()] == [(1, "P7"), (2, "T")]
    with pytest.raises(ValueError):
        rd.resolve_source("env:NOT_SET_ANYWHERE_1")


def test_fan_out_feeds_all_sinks_and_raises_once(spark, tmp_path):
    df = spark.range(3).withColumn("camera", F.lit("c")).withColumn("seq", F.col("id"))
    seen = []

    def broken(d, b):
        raise OSError("down")

    with pytest.raises(RuntimeError, match="down"):
        sk.fan_out({"bad": broken, "ok": lambda d, b: seen.append(d.count())})(df, 0)
    assert seen == [3]
    sk.from_config([{"type": "json", "path": str(tmp_path / "out")}, {"type": "nonsense"}, {"type": "mqtt", "enabled": False}])(sk.envelope(df, ["id"]), 0)
    lines = [json.loads(json.loads(x)["value"]) for p in (tmp_path / "out").rglob("*.json") for x in p.read_text().splitlines()]
    assert sorted(x["message_id"] for x in lines) == ["c:0", "c:1", "c:2"] and {x["schema_version"] for x in lines} == {"5.0"}
    sk.json_log(str(tmp_path / "out"))(sk.envelope(df, ["id"]), 0)  # a batch that comes again
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_brokers_get_one_connection_for_a_partition(spark, tmp_path):
    folder = str(tmp_path)

    def connect():
        import uuid

        f = open(f"{folder}/{uuid.uuid4().hex}", "w")
        return lambda r: f.write(f"{r['id']}\n"), f.close

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        sk.per_partition(connect)(spark.range(0, 20, 1, 2).union(spark.range(0)), 0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    files = list(tmp_path.iterdir())
    assert len(files) == 2 and sorted(int(x) for f in files for x in f.read_text().split()) == list(range(20))


def test_track_events_leave_out_face_files_alone(spark, tmp_path):
    for name in ("front_gate", "f", "face", "facade", "face_a", "cam1"):
        (tmp_path / f"{name}.csv").write_text(f"cam,f,gid,tid,x1,y1,x2,y2\n{name},1,7,3,0,0,1,1\n")
    assert {r["camera"] for r in rd.track_events(spark, str(tmp_path)).collect()} == {"front_gate", "f", "face", "facade", "cam1"}


def test_paths_stay_below_their_root(tmp_path):
    (tmp_path / "root/sub").mkdir(parents=True)
    (tmp_path / "rooted").mkdir()
    (tmp_path / "root/link").symlink_to(tmp_path / "rooted")
    root = str(tmp_path / "root")
    assert rd.is_below(f"{root}/sub/x", root) and rd.is_below(root, root)
    assert not rd.is_below(f"{root}/../rooted", root) and not rd.is_below(f"{root}/link/x", root) and not rd.is_below("/", root)


def test_vectors_as_bytes(spark):
    df = spark.createDataFrame([(1, [1.0, -2.5]), (2, None), (3, [])], "id int, v array<float>")
    got = {r["id"]: r for r in df.select("id", "v", ve.to_blob(F.col("v")).alias("b")).select("id", "b", ve.from_blob(F.col("b")).alias("w")).collect()}
    assert bytes(got[1]["b"]) == np.array([1.0, -2.5], "<f4").tobytes() and got[1]["w"] == [1.0, -2.5]
    assert got[2]["b"] is None and got[2]["w"] is None and got[3]["w"] == []
    assert df.limit(1).select(ve.from_blob(F.unhex(F.lit("0102"))).alias("w")).first()["w"] is None


def test_index_steps_take_the_latest_rows_and_end(spark, tmp_path):
    visits = spark.createDataFrame([(i, 100 - i) for i in range(5)] + [(None, 999)], "best_event long, us_end long")
    path = str(tmp_path / "index")
    spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<float>").write.parquet(path)

    def embed(todo):  # the picture of visit 2 is gone
        return todo.where("best_event <> 2").select(F.col("best_event").alias("vec_id"), F.array(F.lit(0.0), F.lit(1.0)).alias("embedding"))

    assert [ix.index_step(visits, path, embed, 2, limit=2) for _ in range(4)] == [2, 2, 0, 0]
    types = {str(pq.read_schema(f).field("embedding").type.value_type) + str(pq.read_schema(f).field("vec_id").type) for f in (tmp_path / "index").glob("*.parquet")}
    assert types == {"floatint64"}
    index = spark.read.parquet(path)
    assert {r["vec_id"]: r["embedding"] for r in index.collect()} == {0: [1.0, 0.0], 1: [0.0, 1.0], 2: [0.0, 0.0], 3: [0.0, 1.0], 4: [0.0, 1.0]}
    asked = spark.createDataFrame([(-1, [-1.0, -1.0])], "vec_id long, embedding array<float>")
    assert {r["id"] for r in ix.search(asked, index).collect()} == {0, 1, 3, 4}


@pytest.mark.parametrize("kind", ["float", "double", "int"])
def test_index_takes_vectors_of_any_number_type(spark, kind):
    todo = spark.createDataFrame([(1, 5), (2, 6)], "best_event int, us_end long")
    made = todo.where("best_event = 1").select(F.col("best_event").alias("vec_id"), F.array(F.lit(0), F.lit(1)).cast(f"array<{kind}>").alias("embedding"))
    got = ix.indexed(todo, lambda _: made, 2)
    assert got.schema.simpleString() == "struct<vec_id:bigint,embedding:array<float>>"
    assert {r["vec_id"]: r["embedding"] for r in got.collect()} == {1: [0.0, 1.0], 2: [0.0, 0.0]}
    with pytest.raises(Exception, match="3 numbers"):
        ix.indexed(todo, lambda _: made, 3).collect()


def test_ages_by_either_clock(spark):
    rows = spark.createDataFrame([("a", 1_000_000), ("a", 5_000_000), ("b", 2_000_000)], "camera string, us long")
    assert sorted((r["camera"], r["age_s"]) for r in ix.age_stamp(rows).collect()) == [("a", 0.0), ("a", 4.0), ("b", 0.0)]
    assert all(r["age_s"] > 1e9 for r in ix.age_stamp(rows, "wall").collect())


def test_versions(spark, tmp_path):
    for n in (2, 5):
        sk.save_version(spark.range(n), f"file://{tmp_path}")
        assert sk.load_version(spark, f"file://{tmp_path}").count() == n


def test_names(spark):
    df = spark.createDataFrame([("a..b c!",), (None,)], "t string")
    assert [r[0] for r in df.select(sc.safe_name(F.col("t"))).collect()] == ["a..b c_", "unnamed"]


def test_manifests_and_plans(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.json").write_text(json.dumps({"solution_pack": "traffic", "app_id": "anpr", "requires": {"data": ["plates"]}, "hardware": {"ocr": "GPU"}}))
    (tmp_path / "m/readme.txt").write_text("no manifest")
    found = rd.app_manifests(spark, str(tmp_path / "m")).collect()
    assert [(r["app_id"], r["required_data"], r["preferred_hardware"]) for r in found] == [("anpr", ["plates"], {"ocr": "GPU"})]
    (tmp_path / "m/b.json").write_text((tmp_path / "m/a.json").read_text())
    with pytest.raises(ValueError):
        rd.app_manifests(spark, str(tmp_path / "m"))
    (tmp_path / "p.json").write_text(json.dumps({"solution_pack": "traffic", "cameras": [{"camera_id": "c", "nodes": ["decode", "detect"]}]}))
    assert [(r["camera_id"], r["pos"], r["node"]) for r in rd.runtime_plan(spark, str(tmp_path / "p.json")).collect()] == [("c", 0, "decode"), ("c", 1, "detect")]


def test_refreshing_table_follows_its_files(spark, tmp_path):
    spark.range(2).write.parquet(f"{tmp_path}/t")
    table = rd.Refreshing(spark, f"file://{tmp_path}/t")
    assert table.get().count() == 2 and table.get() is table.get()
    spark.range(3).write.mode("append").parquet(f"{tmp_path}/t")
    assert table.get().count() == 5


def test_zone_tags_equal_polygons(spark):
    rng = random.Random(8)
    zones = [("a", "z2", [(0.1, 0.1), (0.9, 0.2), (0.5, 0.8)]), ("a", "z1", [(0, 0), (0.5, 0), (0.5, 0.5), (0, 0.5)]), ("default", "all", [(0.2, 0.2), (0.8, 0.2), (0.8, 0.8), (0.2, 0.8)]), ("b", "line", [(0, 0), (1, 1)])]
    rows = [(rng.choice(["a", "b", "c", None]), round(rng.random(), 1), round(rng.random(), 1)) for _ in range(300)] + [("a", None, 0.2)]
    df = spark.createDataFrame(rows, "camera string, x double, y double")
    tags = zn.zone_tags(zones, F.col("camera"), F.col("x"), F.col("y"))
    every = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(z).alias("z"), g.in_polygon(F.col("x"), F.col("y"), g.polygon(p)).alias("i")) for c, z, p in zones])
    got = df.select("camera", tags.alias("tags"), zn.in_any_zone(zones, F.col("camera"), F.col("x"), F.col("y")).alias("any"), every.alias("every")).collect()
    for r in got:
        own = r["camera"] if r["camera"] in ("a", "b") else "default"
        want = sorted(e["z"] for e in r["every"] if e["c"] == own and e["i"])
        assert r["tags"] == want and r["any"] == bool(want)
