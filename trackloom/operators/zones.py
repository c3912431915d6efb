"""Zones of cameras: which ones a point lies in.

Zones are configuration: ``(camera, zone, points)`` rows on the driver, where the camera
``default`` stands for all cameras without zones of their own. Each camera's zones become plain
comparisons inside generated code, behind a test of the zone's bounding box; no row is
multiplied by the zones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.functions import geometry as g

Zones = list[tuple[str, str, list[tuple[float, float]]]]


def boxed_polygon(x: Column, y: Column, points: list[tuple[float, float]]) -> Column:
    """:func:`geometry.in_fixed_polygon`, asked only within the bounding box."""
    if len(points) < 3:
        return F.lit(False)
    xs, ys = [float(p[0]) for p in points], [float(p[1]) for p in points]
    return F.when(x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)), g.in_fixed_polygon(x, y, points)).otherwise(False)


def _by_camera(zones: Zones, camera: Column, of: dict, none: Column) -> Column:
    own = F.when(F.lit(False), none)
    for c in of:
        if c != "default":
            own = own.when(camera == c, of[c])
    return own.otherwise(of.get("default", none))


def zone_tags(zones: Zones, camera: Column, x: Column, y: Column) -> Column:
    """The names of the zones that hold a point, in order of names; none for a null point."""
    of: dict[str, Column] = {}
    for c in dict.fromkeys(z[0] for z in zones):
        each = sorted((name, points) for cam, name, points in zones if cam == c)
        of[c] = F.array_compact(F.array(*[F.when(boxed_polygon(x, y, points), F.lit(name)) for name, points in each]))
    return _by_camera(zones, camera, of, F.array().cast("array<string>"))


def in_any_zone(zones: Zones, camera: Column, x: Column, y: Column) -> Column:
    """Whether some zone of the camera holds a point; no for a null point."""
    of: dict[str, Column] = {}
    for cam, _, points in zones:
        held = boxed_polygon(x, y, points)
        of[cam] = of[cam] | held if cam in of else held
    return _by_camera(zones, camera, of, F.lit(False))
