"""Plate texts from many noisy reads of a track: weighted vote, then confirm and hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.scalars import PLATE, normalise_plate
from trackloom.operators.sequence import fold


def vote(reads: list[tuple[str, float]], least: int = 4, length_share: float = 0.5, char_share: float = 0.6) -> str | None:
    """The agreed text of (text, weight) reads: the heaviest length, then the heaviest
    character of each place; the first seen wins ties. None without agreement."""
    import re

    if len(reads) < least:
        return None

    def heaviest(pairs) -> tuple:
        sums: dict = {}
        for value, weight in pairs:
            sums[value] = sums.get(value, 0.0) + weight
        return max(sums.items(), key=lambda x: x[1])  # dicts keep order and max the first

    total = sum(w for _, w in reads)
    length, weight = heaviest((len(t), w) for t, w in reads)
    if weight < length_share * total:
        return None
    same = [(t, w) for t, w in reads if len(t) == length]
    mass = sum(w for _, w in same)
    text = ""
    for i in range(length):
        char, weight = heaviest((t[i], w) for t, w in same)
        if weight < char_share * mass:
            return None
        text += char
    return text if re.match(PLATE, text) else None


def gated(reads: DataFrame, min_confidence: float = 0.4, min_width: float = 0.0) -> DataFrame:
    """Reads that may vote, with their weight: confidence times plate width."""
    rows = reads.withColumn("text", normalise_plate(F.col("text"))).withColumn("width", F.coalesce("plate_width", F.lit(0.0)))
    small = (F.lit(min_width) > 0) & (F.col("width") > 0) & (F.col("width") < min_width)
    kept = rows.where((F.col("confidence") >= min_confidence) & ~small & F.col("text").rlike(PLATE))
    return kept.withColumn("weight", F.greatest(F.lit(0.05), "confidence") * F.greatest(F.lit(1.0), "width"))


def confirm_step(attempts: int = 12, forget: int = 150):
    """Gives a row when a track's plate is first agreed; it never changes afterwards. A track
    without a read for ``forget`` frames starts anew."""

    def step(state, row: dict):
        reads, held, last = state
        if last is not None and row["frame_idx"] - last > forget:
            reads, held = [], None
        if held or len(reads) >= attempts:
            return (reads, held, row["frame_idx"]), []
        reads = [*reads, (row["text"], row["weight"])]
        held = vote(reads)
        out = [{"camera": row["camera"], "track_id": row["track_id"], "plate": held, "frame_idx": row["frame_idx"], "reads": len(reads)}] if held else []
        return (reads, held, row["frame_idx"]), out

    return step


CONFIRMED = "camera string, track_id bigint, plate string, frame_idx bigint, reads int"


def confirmed(reads: DataFrame, min_confidence: float = 0.4, min_width: float = 0.0) -> DataFrame:
    rows = gated(reads, min_confidence, min_width).select("camera", "track_id", "frame_idx", "text", "weight")
    return fold(rows, ["camera", "track_id"], ["frame_idx", "text"], lambda: ([], None, None), confirm_step(), CONFIRMED)


#: Weights are whole numbers, so sums don't depend on the order of reads: confidence in thousandths
#: times plate width in whole pixels.
TALLY = ["length", "place", "letter"]


def tally(reads: DataFrame, keys: tuple[str, ...] = ("camera", "track_id"), min_confidence: float = 0.4, min_width: float = 0.0) -> DataFrame:
    """(keys, length, place, letter, weight, reads): for each track the weights of its gated reads by
    length (place 0) and by letter of each place. Tallies of parts of the reads merge by summing
    up (:func:`merged`), in any order and any grouping."""
    rows = gated(reads, min_confidence, min_width)
    weight = F.round(F.greatest(F.lit(0.05), "confidence") * 1000).cast("bigint") * F.greatest(F.lit(1), F.floor("width")).cast("bigint")
    places = F.sequence(F.lit(0), F.length("text"))
    each = rows.select(*keys, F.length("text").alias("length"), "text", weight.alias("weight"), F.explode(places).alias("place"))
    letter = F.when(F.col("place") == 0, "").otherwise(F.substring("text", F.col("place"), F.lit(1)))
    return each.groupBy(*keys, "length", "place", letter.alias("letter")).agg(F.sum("weight").alias("weight"), F.count("*").alias("reads"))


def merged(tallies: DataFrame, keys: tuple[str, ...] = ("camera", "track_id")) -> DataFrame:
    """One tally of many."""
    return tallies.groupBy(*keys, *TALLY).agg(F.sum("weight").alias("weight"), F.sum("reads").alias("reads"))


def agreed(votes: DataFrame, keys: tuple[str, ...] = ("camera", "track_id"), least: int = 4, attempts: int = 12) -> DataFrame:
    """(keys, plate, reads, goes_on) of each track in a tally: its plate, if there are ``least`` reads,
    the heaviest length has half of all weight, the heaviest letter of each of its places has three
    fifths of that, and the text is a plate; whether it should be read on. The shorter length and
    the first letter win ties."""
    heads = votes.where("place = 0").groupBy(*keys).agg(
        F.sum("reads").alias("reads"), F.sum("weight").alias("total"), F.max(F.struct("weight", (-F.col("length")).alias("n"))).alias("best"),
    )
    heads = heads.withColumn("best_length", -F.col("best.n")).withColumn("mass", F.col("best.weight"))
    right = votes.where("place > 0").join(heads.select(*keys, F.col("best_length").alias("length")), [*keys, "length"])
    letters = right.groupBy(*keys, "place").agg(F.max_by("letter", F.struct("weight", -F.ascii("letter"))).alias("letter"), F.max("weight").alias("weight"))
    texts = letters.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "letter"))), lambda s: s["letter"]), "").alias("text"), F.min("weight").alias("weakest"))
    rows = heads.join(texts, list(keys), "left")
    sure = (F.col("reads") >= least) & (2 * F.col("mass") >= F.col("total")) & (5 * F.col("weakest") >= 3 * F.col("mass")) & F.col("text").rlike(PLATE)
    plate = F.when(sure, F.col("text"))
    return rows.select(*keys, plate.alias("plate"), "reads", (plate.isNull() & (F.col("reads") < attempts)).alias("goes_on"))
