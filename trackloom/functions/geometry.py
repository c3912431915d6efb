"""Plane geometry on columns: points, boxes, lines, polygons, homographies. No UDF.

Points are pairs of columns; a polygon is an array of struct(x, y); a line is a pair of points
given as numbers or columns.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float

#: Eight sectors of 45 degrees, clockwise from east because y points down.
COMPASS = ("east", "south_east", "south", "south_west", "west", "north_west", "north", "north_east")


def _c(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _less(b: Number, a: Number) -> Column:
    """The difference; of two numbers, that of the decimals as they are written (0.6 - 0.5 is 0.1)."""
    return _c(b) - _c(a) if isinstance(a, Column) or isinstance(b, Column) else F.lit(float(Decimal(repr(float(b))) - Decimal(repr(float(a)))))


def foot(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, y2


def centre(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, (y1 + y2) / 2


def box_payload(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whole numbers toward zero; sides are never negative; null if a value is missing."""
    i = [c.cast("int") for c in (x1, y1, x2, y2)]
    made = F.struct(i[0].alias("x1"), i[1].alias("y1"), i[2].alias("x2"), i[3].alias("y2"), F.greatest(F.lit(0), i[2] - i[0]).alias("width"), F.greatest(F.lit(0), i[3] - i[1]).alias("height"))
    return F.when(x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull(), made)


def clip_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Number, height: Number) -> Column:
    """The box inside the frame; null if nothing is left."""
    w, h = _c(width), _c(height)
    cut = lambda v, top: F.greatest(F.lit(0.0), F.least(v, top))
    a, b, c, d = cut(x1, w), cut(y1, h), cut(x2, w), cut(y2, h)
    return F.when((c > a) & (d > b), F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2")))


def normalised(x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """By the frame's size; null where that is unknown or zero."""
    known = (width > 0) & (height > 0)
    return F.when(known, x / width), F.when(known, y / height)


def polygon(points: list[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def scaled_points(points: Column, frame_w: Column, frame_h: Column, source_w: Column, source_h: Column) -> Column:
    """Two points become the four corners of their rectangle; points are scaled only if both
    sizes are known and differ."""
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    a, b = F.element_at(points, 1), F.element_at(points, 2)
    full = F.when(F.size(points) == 2, F.array(corner(a["x"], a["y"]), corner(b["x"], a["y"]), corner(b["x"], b["y"]), corner(a["x"], b["y"]))).otherwise(points)
    differ = (frame_w > 0) & (frame_h > 0) & (source_w > 0) & (source_h > 0) & ((frame_w != source_w) | (frame_h != source_h))
    return F.transform(full, lambda p: corner(F.when(differ, p["x"] * frame_w / source_w).otherwise(p["x"]), F.when(differ, p["y"] * frame_h / source_h).otherwise(p["y"])))


def in_polygon(x: Column, y: Column, poly: Column) -> Column:
    """Even-odd rule with half-open edges; fewer than three points hold nothing."""
    n = F.size(poly)

    def crossed(i: Column) -> Column:
        p, q = F.get(poly, i), F.get(poly, F.when(i == 0, n - 1).otherwise(i - 1))
        rise = q["y"] - p["y"]
        return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(rise == 0, F.lit(1e-9)).otherwise(rise) + p["x"])

    return F.when(n < 3, F.lit(False)).otherwise(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), lambda inside, i: inside != crossed(i)))


def on_edge(x: Column, y: Column, poly: Column) -> Column:
    """Whether a point lies on an edge or corner, of which :func:`in_polygon` counts some in and some out."""
    n = F.size(poly)

    def met(i: Column) -> Column:
        p, q = F.get(poly, i), F.get(poly, F.when(i == 0, n - 1).otherwise(i - 1))
        within = x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))
        return within & ((q["x"] - p["x"]) * (y - p["y"]) == (q["y"] - p["y"]) * (x - p["x"]))

    return F.when(n < 3, F.lit(False)).otherwise(F.exists(F.sequence(F.lit(0), n - 1), met))


def in_fixed_polygon(x: Column, y: Column, points: list[tuple[float, float]]) -> Column:
    """:func:`in_polygon` for corners known beforehand: one test for each edge, which stays
    inside generated code."""
    inside = F.lit(False)
    for i in range(len(points) if len(points) > 2 else 0):
        (ax, ay), (bx, by) = [(float(u), float(v)) for u, v in (points[i], points[i - 1])]
        met = (F.lit(ay) > y) != (F.lit(by) > y)
        inside = inside != (met & (x < F.lit(bx - ax) * (y - ay) / F.lit((by - ay) or 1e-9) + ax))
    return inside


def side(x: Column, y: Column, ax: Number, ay: Number, bx: Number, by: Number) -> Column:
    """Cross product of the line's direction and the point: which side, times the length."""
    return _less(bx, ax) * (y - _c(ay)) - _less(by, ay) * (x - _c(ax))


def side_label(value: Column) -> Column:
    return F.when(value < 0, "side_a").otherwise("side_b")


def line_distance(x: Column, y: Column, ax: Number, ay: Number, bx: Number, by: Number) -> Column:
    """Signed distance; a line of no length counts as of length one."""
    length = F.hypot(_less(bx, ax), _less(by, ay))
    return side(x, y, ax, ay, bx, by) / F.when(length == 0, F.lit(1.0)).otherwise(length)


def crossed(before: Column, now: Column) -> Column:
    """Both sides are off the line and differ."""
    return (before != 0) & (now != 0) & (before * now < 0)


def segments_meet(a: tuple, b: tuple, c: tuple, d: tuple, tolerance: float = 1e-6) -> Column:
    """A proper crossing, or an end that lies on the other segment within the tolerance."""
    turn = lambda p, q, r: (q[1] - p[1]) * (r[0] - q[0]) - (q[0] - p[0]) * (r[1] - q[1])
    on = lambda p, q, r: (
        (q[0] <= F.greatest(p[0], r[0]) + tolerance) & (q[0] >= F.least(p[0], r[0]) - tolerance) & (q[1] <= F.greatest(p[1], r[1]) + tolerance) & (q[1] >= F.least(p[1], r[1]) - tolerance)
    )
    a, b, c, d = [tuple(map(_c, p)) for p in (a, b, c, d)]
    o = [turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)]
    proper = (o[0] * o[1] < 0) & (o[2] * o[3] < 0)
    flat = lambda v: F.abs(v) <= tolerance
    return proper | (flat(o[0]) & on(a, c, b)) | (flat(o[1]) & on(a, d, b)) | (flat(o[2]) & on(c, a, d)) | (flat(o[3]) & on(c, b, d))


def segments_cross(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """Strict orientation test: touching ends may differ from :func:`segments_meet`."""
    turns = lambda p, q, r: (r[1] - p[1]) * (q[0] - p[0]) > (q[1] - p[1]) * (r[0] - p[0])
    a, b, c, d = [tuple(map(_c, p)) for p in (a, b, c, d)]
    return (turns(a, c, d) != turns(b, c, d)) & (turns(a, b, c) != turns(a, b, d))


def line_touches_zone(line: Column, zone: Column) -> Column:
    """An end of the line lies in the zone, or a part of it crosses an edge."""
    n, m = F.size(zone), F.size(line)
    p = lambda arr, i: (F.get(arr, i)["x"], F.get(arr, i)["y"])
    inside = F.exists(line, lambda q: in_polygon(q["x"], q["y"], zone))
    meets = F.exists(F.sequence(F.lit(0), m - 2), lambda i: F.exists(F.sequence(F.lit(0), n - 1), lambda k: segments_cross(p(line, i), p(line, i + 1), p(zone, k), p(zone, (k + 1) % n))))
    return F.when((m < 2) | (n < 3), F.lit(False)).otherwise(inside | meets)


def compass(dx: Column, dy: Column) -> Column:
    angle = F.pmod(F.degrees(F.atan2(dy, dx)) + 360, F.lit(360.0))
    return F.element_at(F.array(*map(F.lit, COMPASS)), (F.floor((angle + 22.5) / 45) % 8 + 1).cast("int"))


def endpoint_direction(dx: Column, dy: Column, ax: Number, ay: Number, bx: Number, by: Number) -> Column:
    dot = dx * (_c(bx) - _c(ax)) + dy * (_c(by) - _c(ay))
    return F.when(dot >= 0, "a_to_b").otherwise("b_to_a")


def crossing_sides(before: Column, now: Column) -> Column:
    return F.concat(side_label(before), F.lit("_to_"), side_label(now))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes; 0 where the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = w * h
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def project(x: Column, y: Column, h: list[Number]) -> tuple[Column, Column]:
    """A point through a 3 by 3 homography in row order; null where the scale is zero."""
    h = [_c(v) for v in h]
    scale = h[6] * x + h[7] * y + h[8]
    scale = F.when(scale != 0, scale)
    return (h[0] * x + h[1] * y + h[2]) / scale, (h[3] * x + h[4] * y + h[5]) / scale


def fit_homography(image: list[tuple[float, float]], plane: list[tuple[float, float]]) -> list[float]:
    """Least-squares homography from four or more point pairs, by the direct linear transform
    on normalised points. A configuration-sized driver computation."""
    import numpy as np

    if len(image) < 4 or len(image) != len(plane):
        raise ValueError("four or more point pairs are needed")

    def unit(p):
        p = np.asarray(p, float)
        c, s = p.mean(axis=0), np.sqrt(2) / max(np.linalg.norm(p - p.mean(axis=0), axis=1).mean(), 1e-12)
        t = np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])
        return (p - c) * s, t

    (a, ta), (b, tb) = unit(image), unit(plane)
    rows = []
    for (x, y), (u, v) in zip(a, b):
        rows += [[-x, -y, -1, 0, 0, 0, u * x, u * y, u], [0, 0, 0, -x, -y, -1, v * x, v * y, v]]
    h = np.linalg.inv(tb) @ np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3) @ ta
    return (h / h[2, 2]).ravel().tolist()
