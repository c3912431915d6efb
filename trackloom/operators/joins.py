"""Joins over time: nearest rows, overlapping intervals, transition windows, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_nearest(left: DataFrame, right: DataFrame, key: str, at: str, right_id: str, name: str = "nearest") -> DataFrame:
    """``left`` with the id of the right row of the same key that is nearest in time, either
    way; the earlier one, then the smaller id, where two are equally near. Null without any.

    Both sides are sorted together once per key; the neighbours come from two running
    windows, so a key with many rows on both sides costs no product.
    """
    have = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, at).agg(F.min(right_id).alias("__rid"))
    both = left.withColumns({"__rid": F.lit(None).cast(right.schema[right_id].dataType), "__left": F.lit(1)}).unionByName(have.withColumn("__left", F.lit(0)), allowMissingColumns=True)
    hit = F.when(F.col("__left") == 0, F.struct(F.col(at).alias("at"), F.col("__rid").alias("id")))
    w = Window.partitionBy(key).orderBy(at, "__left")
    seen = both.withColumns({"__p": F.last(hit, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__n": F.first(hit, True).over(w.rowsBetween(0, Window.unboundedFollowing))}).where("__left = 1")
    nearer = F.col("__n.at") - F.col(at) < F.col(at) - F.col("__p.at")
    found = F.when(F.col("__p").isNull() | F.coalesce(nearer, F.lit(False)), F.col("__n.id")).otherwise(F.col("__p.id"))
    return seen.withColumn(name, found).drop("__rid", "__left", "__p", "__n")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], start: str, end: str, bucket: int, least: Column | int = 0) -> DataFrame:
    """Pairs of rows with equal keys whose closed intervals overlap, as structs ``a`` and ``b``.

    Each interval is put into the buckets of time that it touches; a pair meets in several, and
    counts in the bucket of the later start alone. So the join is an equi-join whose groups
    are as small as the bucket, and not one group for each key.
    """
    cut = lambda df: df.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    x, y = cut(a).alias("x"), cut(b).alias("y")
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in [*keys, "__b"]]
    met = x.join(y, on).where(F.col("x.__b") == F.greatest(F.floor(F.col(f"x.{start}") / bucket), F.floor(F.col(f"y.{start}") / bucket)))
    shared = F.least(f"x.{end}", f"y.{end}") - F.greatest(f"x.{start}", f"y.{start}")
    pick = lambda s, df: F.struct(*[F.col(f"{s}.{c}").alias(c) for c in df.columns]).alias("a" if s == "x" else "b")
    return met.where(shared >= least).select(pick("x", a), pick("y", b))


def begun_within(a: DataFrame, b: DataFrame, keys: list[str], us: int, start: str = "us_start", end: str = "us_end") -> DataFrame:
    """Pairs of rows with equal keys, as structs ``a`` and ``b``, of which b begins after a's end, by
    ``us`` microseconds at most. Time is cut into buckets of that length, of which an end asks two,
    so how long the rows last doesn't count."""
    size = max(1, us)
    bucket = lambda c: F.floor(c / F.lit(size)).cast("bigint")
    x = a.select(F.struct("*").alias("a"), *keys, F.explode(F.sequence(bucket(F.col(end)), bucket(F.col(end) + us))).alias("__b"))
    y = b.select(F.struct("*").alias("b"), *keys, bucket(F.col(start)).alias("__b"))
    gap = F.col(f"b.{start}") - F.col(f"a.{end}")
    return x.join(y, [*keys, "__b"]).where((gap > 0) & (gap <= us)).select("a", "b")


def near_pairs(rows: DataFrame, keys: list[str], id_col: str, radius: float) -> DataFrame:
    """(keys, a, b): pairs of different ids, a < b, that stand within ``radius`` of each other
    under equal keys. ``rows(keys, id, x, y)``; rows without a place are ignored.

    The plane is cut into squares of that side; a row meets those of its own square and of half
    of the squares around it, so no pair of far rows is made, and none is made twice.
    """
    at = rows.where("x is not null and y is not null").select(*keys, F.col(id_col).alias("i"), "x", "y").withColumns({"cx": F.floor(F.col("x") / radius), "cy": F.floor(F.col("y") / radius)})
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))])
    out = at.withColumn("s", F.explode(steps)).select(*keys, F.col("i").alias("p"), F.col("x").alias("px"), F.col("y").alias("py"), (F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy"), ((F.col("s.dx") == 0) & (F.col("s.dy") == 0)).alias("own"))
    met = out.join(at, [*keys, "cx", "cy"]).where("p <> i and (not own or p < i)")
    met = met.where((F.col("px") - F.col("x")) ** 2 + (F.col("py") - F.col("y")) ** 2 <= radius**2)
    return met.select(*keys, F.least("p", "i").alias("a"), F.greatest("p", "i").alias("b")).distinct()


def camera_pair(a: Column, b: Column) -> tuple[Column, Column]:
    """A pair of cameras in one order, for symmetric lookups."""
    return F.least(a, b), F.greatest(a, b)


def transitions(moves: DataFrame, topology: DataFrame, unknown: tuple[float, float] | None, slack: float = 0.0) -> DataFrame:
    """``moves(cam_a, cam_b, gap_s)`` with ``ok``: the gap lies in the pair's window widened by
    ``slack``. Pairs without a window take ``unknown``, or are blocked if that is None. A
    negative gap is blocked. The topology is looked up in either order."""
    lo, hi = camera_pair(F.col("cam_a"), F.col("cam_b"))
    windows = topology.select(*[c.alias(n) for c, n in zip(camera_pair(F.col("cam_a"), F.col("cam_b")), ("__lo", "__hi"))], "min_s", "max_s")
    both = moves.withColumns({"__a": lo, "__b": hi}).join(windows, (F.col("__a") == F.col("__lo")) & (F.col("__b") == F.col("__hi")), "left")
    least = F.coalesce("min_s", F.lit(unknown[0] if unknown else None).cast("double")) - slack
    most = F.coalesce("max_s", F.lit(unknown[1] if unknown else None).cast("double")) + slack
    ok = F.coalesce((F.col("gap_s") >= 0) & (F.col("gap_s") >= least) & (F.col("gap_s") <= most), F.lit(False))
    return both.withColumn("ok", ok).drop("__a", "__b", "__lo", "__hi", "min_s", "max_s")


def best_match(target: DataFrame, reference: DataFrame, keys: list[str], target_id: str, score: Column, least: float, ref_id: str) -> DataFrame:
    """For each target row the reference row of the same keys with the best score of at least
    ``least``; the first by id on ties. ``score`` is over aliases t and r."""
    both = target.alias("t").join(reference.alias("r"), [F.col(f"t.{k}") == F.col(f"r.{k}") for k in keys])
    scored = both.select(F.col(f"t.{target_id}").alias(target_id), F.col(f"r.{ref_id}").alias("match"), score.alias("score"))
    best = scored.groupBy(target_id).agg(F.max(F.struct(F.col("score"), -F.col("match"))).alias("m"))
    return best.where(F.col("m.score") >= least).select(target_id, (-F.col("m.col2")).alias("match"), F.col("m.score").alias("score"))
