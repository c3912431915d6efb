"""Scalar functions on strings, numbers, maps and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed value: the registration formats that count as plates
PLATE = r"^(?:[A-Z]{2}\d{1,2}[A-Z]{1,3}\d{1,4}|\d{2}BH\d{4}[A-Z]{1,2})$"


def normalise_plate(text: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9]", "")


def safe_name(text: Column, fallback: str = "unnamed") -> Column:
    """Letters, digits, space and ``-_.`` stay; the rest becomes ``_``; outer dots go."""
    kept = F.btrim(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N} _.\-]", "_")), F.lit("."))
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(fallback))


def safe_item(text: Column, fallback: str = "item") -> Column:
    kept = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", "_"), F.lit("_"))
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(fallback))


def source_name(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"[^A-Za-z0-9_.\-]+", "_"), F.lit("_.-"))


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes", "on"), F.lit(False))


def positive(text: Column, kind: str = "double") -> Column:
    n = text.try_cast(kind)
    return F.when(n > 0, n)


def optional(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def time_bucket(seconds: Column) -> Column:
    """Seconds with one decimal, rounded as the binary number that they are; empty for null. Halves that it
    holds exactly, .25 and .75, go to the even tenth."""
    whole = F.floor(F.abs(seconds))
    rest = F.abs(seconds) - whole
    tenth = F.least(F.floor(rest * 10), F.lit(9))
    half = (2 * tenth + 1) / 20
    # the doubles next to .05, .45, .55 and .65 lie above them, those next to the other halves below
    up = (rest > half) | ((rest == half) & tenth.isin(0, 4, 5, 6, 7))
    tenths = whole * 10 + tenth + up.cast("int")
    sign = F.when(seconds < 0, "-").otherwise("")
    return F.coalesce(F.concat(sign, F.floor(tenths / 10).cast("bigint"), F.lit("."), (tenths % 10).cast("bigint")), F.lit(""))


def source_type(uri: Column) -> Column:
    return F.when(F.lower(uri).rlike("^rtsps?://"), "rtsp").when(F.lower(uri).rlike("^https?://"), "http").otherwise("file")


def relative_ref(path: Column, pack: str) -> Column:
    """What follows ``state/<pack>/`` of an absolute path, else its last part."""
    after = F.regexp_extract(path, rf"state/{pack}/(.+)$", 1)
    return F.when(~F.startswith(path, F.lit("/")), path).when(after != "", after).otherwise(F.element_at(F.split(path, "/"), -1))


def image_type(path: Column) -> Column:
    kind = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(kind == "png", "image/png").when(kind == "webp", "image/webp").otherwise("image/jpeg")


def display_score(h: Column, w: Column, quality: Column) -> Column:
    """Shape, size and quality of a person crop; shape is full between 2.0 and 3.5 heights a
    width and falls off around 2.75."""
    ratio = h / w
    shape = F.when(ratio.between(2.0, 3.5), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(ratio - 2.75) / 2.75))
    return F.round(0.45 * shape + 0.35 * F.least(F.lit(1.0), h / 300) + 0.2 * quality, 4)


def face_quality(sharpness: Column, px: Column, det: Column) -> Column:
    return F.least(sharpness / 200, F.lit(1.5)) * F.least(px / 60, F.lit(1.5)) * det


def pose_bin(yaw: Column, frontal: float = 15.0, most: float = 60.0) -> Column:
    return F.when(F.abs(yaw) <= frontal, "frontal").when((yaw < 0) & (yaw >= -most), "left").when((yaw > 0) & (yaw <= most), "right")


def topic(*parts: Column) -> Column:
    """Parts joined by dots; null or empty ones are left out."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), ".")


def snapshot_ref(event: Column) -> Column:
    """The first reference to a picture in a JSON event: its own keys, then its payload's."""
    keys = ("snapshot_ref", "snapshot", "crop", "image", "thumbnail", "frame")
    return F.coalesce(*[F.nullif(F.get_json_object(event, f"$.{at}{k}"), F.lit("")) for at in ("", "payload.") for k in keys])
