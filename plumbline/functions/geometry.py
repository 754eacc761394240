"""Geometry of boxes and polygons as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point_in_polygon(x: str, y: str, polygon: str) -> Column:
    """Ray casting over an array of (x, y) structs; fewer than three corners hold nothing."""
    n = f"size({polygon})"
    a, b = f"{polygon}[i]", f"{polygon}[(i + {n} - 1) % {n}]"
    slope = f"({b}.x - {a}.x) * ({y} - {a}.y) / (({b}.y - {a}.y) + 1e-12) + {a}.x"
    cross = f"(({a}.y > {y}) <> ({b}.y > {y})) AND {x} < {slope}"
    return F.expr(f"{n} >= 3 AND aggregate(sequence(0, greatest({n} - 1, 0)), false, (odd, i) -> odd <> ({cross}))")


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes [x1, y1, x2, y2]."""
    side = lambda i, j: f"greatest(0D, least({a}[{j}], {b}[{j}]) - greatest({a}[{i}], {b}[{i}]))"
    area = lambda v: f"greatest(0D, {v}[2] - {v}[0]) * greatest(0D, {v}[3] - {v}[1])"
    inter = f"{side(0, 2)} * {side(1, 3)}"
    return F.expr(f"coalesce(try_divide({inter}, {area(a)} + {area(b)} - {inter}), 0D)")


def foot(box: str) -> Column:
    """Where a person of that box stands: the middle of the lower edge."""
    return F.struct(((F.col(box)[0] + F.col(box)[2]) / 2).alias("x"), F.col(box)[3].alias("y"))


def centre(box: str) -> Column:
    return F.struct(((F.col(box)[0] + F.col(box)[2]) / 2).alias("x"), ((F.col(box)[1] + F.col(box)[3]) / 2).alias("y"))


def distance(x1: str, y1: str, x2: str, y2: str) -> Column:
    return F.hypot(F.col(x1) - F.col(x2), F.col(y1) - F.col(y2))
