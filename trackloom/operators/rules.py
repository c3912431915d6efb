"""Rules that change while rows come in: a log of changes, read as versions and met by time.

A rule's scope is nothing, a set of cameras, or every camera. A change of one camera adds to or takes
from the set; taking one out of every camera leaves those that were known by then, without it. A
change of zones reaches at once the rules whose scope is a set with something in it; others take the
latest zones when they are next switched. Changes and cameras are configuration: versions are made of
their combinations, and rows meet the versions of their day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000
ENABLE, DISABLE, ZONES = "enable", "disable", "zones"


def versions(changes: DataFrame, cameras: DataFrame) -> DataFrame:
    """(rule, camera, us_from, us_until, active, zones): what holds from one change of a rule to the next
    (``us_until`` is null for the last), from ``changes(us, seq, rule, action, camera, zones)`` in order
    of (us, seq) and ``cameras(camera, first_us)`` with the time of their first row. Changes without a
    camera are for every camera; changes of zones have no rule and hold for all. The null camera stands
    for those that are neither known nor named."""
    rules = changes.where("rule is not null").select("rule").distinct()
    zoned = changes.where(F.col("action") == ZONES).drop("rule").join(rules)  # rules are few
    switched = changes.where(F.col("action") != ZONES)
    order = Window.partitionBy("rule").orderBy("us", "seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    c = switched.unionByName(zoned).withColumn("n", F.row_number().over(order))
    whole = (F.col("action") != ZONES) & F.col("camera").isNull()
    c = c.withColumn("epoch", F.sum(whole.cast("int")).over(so_far)).withColumn("all", F.coalesce(F.last(F.when(whole, F.col("action") == ENABLE), ignorenulls=True).over(so_far), F.lit(False)))
    cut = F.when(F.col("all") & (F.col("action") == DISABLE) & F.col("camera").isNotNull(), F.struct("n", "us", "camera"))
    c = c.withColumn("cut", F.min(cut).over(Window.partitionBy("rule", "epoch").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumn("until", F.lead("us").over(order)).withColumn("latest", F.last(F.when(F.col("action") == ZONES, F.col("zones")), ignorenulls=True).over(so_far))

    every = cameras.select("camera", "first_us").union(changes.where("camera is not null").select("camera", F.lit(None).cast("bigint")))
    every = every.groupBy(F.col("camera").alias("cam")).agg(F.min("first_us").alias("first_us"))
    every = every.union(changes.sparkSession.range(1).select(F.lit(None).cast("string"), F.lit(None).cast("bigint")))  # any other
    each = c.join(every)  # configuration by configuration
    own = F.when((F.col("camera") == F.col("cam")) & (F.col("action") != ZONES), F.struct("n", "epoch", (F.col("action") == ENABLE).alias("on")))
    each = each.withColumn("own", F.last(own, ignorenulls=True).over(Window.partitionBy("rule", "cam").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    in_epoch = F.coalesce(F.col("own.epoch") == F.col("epoch"), F.lit(False))
    known = F.coalesce((F.col("first_us") <= F.col("cut.us")) & (F.col("cam") != F.col("cut.camera")), F.lit(False))
    after_cut = F.when(in_epoch & (F.col("own.n") >= F.col("cut.n")), F.col("own.on")).otherwise(known)
    active = F.when(~F.col("all"), in_epoch & F.coalesce("own.on", F.lit(False))).when(F.col("cut").isNull(), True).otherwise(after_cut)
    each = each.withColumn("active", active)
    is_set = (~F.col("all") | F.col("cut").isNotNull()) & F.max("active").over(Window.partitionBy("rule", "n"))
    applied = (F.col("action") != ZONES) | is_set
    per_camera = Window.partitionBy("rule", "cam").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    used = F.last(F.when(applied, F.struct(F.col("latest").alias("z"))), ignorenulls=True).over(per_camera)["z"]
    found = each.withColumn("used", used).where("until is null or us < until")  # the last of changes at one time holds
    return found.select("rule", F.col("cam").alias("camera"), F.col("us").alias("us_from"), F.col("until").alias("us_until"), "active", F.col("used").alias("zones"))


def ruled(rows: DataFrame, held: DataFrame) -> DataFrame:
    """``rows(camera, us, ...)`` once for each rule that is active for their camera at their time, with
    ``rule`` and ``zones``. A change holds for rows at its own time. Versions are cut into days, so that
    the join has equal keys."""
    end = rows.agg(F.max("us").alias("end"))  # one row
    live = held.where("active").join(F.broadcast(end)).withColumn("last", F.coalesce(F.col("us_until") - 1, F.greatest("us_from", "end"))).where(F.col("us_from") <= F.col("end"))
    live = live.withColumn("day", F.explode(F.sequence(F.floor(F.col("us_from") / DAY), F.floor(F.least("last", "end") / DAY)))).select(F.col("camera").alias("cam"), "day", "us_from", "us_until", "rule", "zones")
    named = held.where("camera is not null").select(F.col("camera").alias("named")).distinct()
    given = rows.join(named, F.col("camera") == F.col("named"), "left").withColumn("__day", F.floor(F.col("us") / DAY))
    met = given.join(live, (F.coalesce("named", F.lit("")) == F.coalesce("cam", F.lit(""))) & (F.col("__day") == F.col("day")))
    inside = (F.col("us") >= F.col("us_from")) & (F.col("us_until").isNull() | (F.col("us") < F.col("us_until")))
    return met.where(inside).select(*rows.columns, "rule", "zones")
