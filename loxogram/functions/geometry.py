"""Boxes, points and distances as column expressions. The plane is Euclidean; boxes are closed."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerance of the box predicates (fixed value).
EPSILON = 1.192092896e-07


class Box(NamedTuple):
    xlo: Column
    ylo: Column
    xhi: Column
    yhi: Column


class Point(NamedTuple):
    x: Column
    y: Column


def box(prefix: str = "") -> Box:
    return Box(*(F.col(f"{prefix}{c}") for c in ("xlo", "ylo", "xhi", "yhi")))


def fixed_box(xlo: float, ylo: float, xhi: float, yhi: float) -> Box:
    return Box(*(F.lit(float(v)) for v in (xlo, ylo, xhi, yhi)))


def point(prefix: str = "") -> Point:
    return Point(F.col(f"{prefix}x"), F.col(f"{prefix}y"))


def point_box(p: Point) -> Box:
    return Box(p.x, p.y, p.x, p.y)


def intersects(a: Box, b: Box, eps: float = EPSILON) -> Column:
    return (a.xlo <= b.xhi + eps) & (a.xhi >= b.xlo - eps) & (a.ylo <= b.yhi + eps) & (a.yhi >= b.ylo - eps)


def contains(a: Box, b: Box, eps: float = EPSILON) -> Column:
    return (a.xlo <= b.xlo + eps) & (a.xhi >= b.xhi - eps) & (a.ylo <= b.ylo + eps) & (a.yhi >= b.yhi - eps)


def contains_point(a: Box, p: Point) -> Column:
    """Without tolerance, unlike box in box."""
    return p.x.between(a.xlo, a.xhi) & p.y.between(a.ylo, a.yhi)


def point_contains(p: Point, q: Point) -> Column:
    """A point has no inside: never."""
    return F.lit(False)


def touches(a: Box, b: Box, eps: float = EPSILON) -> Column:
    """Some axis has lower edges, or upper edges, that coincide; this is no topological touch."""
    return (F.abs(a.xlo - b.xlo) < eps) | (F.abs(a.xhi - b.xhi) < eps) | (F.abs(a.ylo - b.ylo) < eps) | (F.abs(a.yhi - b.yhi) < eps)


def touches_point(a: Box, p: Point, eps: float = EPSILON) -> Column:
    """Some edge of the box has the point's coordinate."""
    return touches(a, point_box(p), eps)


def same_point(p: Point, q: Point, eps: float = EPSILON) -> Column:
    return (F.abs(p.x - q.x) <= eps) & (F.abs(p.y - q.y) <= eps)


def same_box(a: Box, b: Box, eps: float = EPSILON) -> Column:
    out = F.lit(True)
    for u, v in zip(a, b, strict=True):
        out = out & (F.abs(u - v) <= eps)
    return out


def _hypot(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def distance(p: Point, q: Point) -> Column:
    return _hypot(p.x - q.x, p.y - q.y)


def min_distance(a: Box, b: Box) -> Column:
    gap = lambda lo, hi, lo2, hi2: F.greatest(lo2 - hi, lo - hi2, F.lit(0.0))
    return _hypot(gap(a.xlo, a.xhi, b.xlo, b.xhi), gap(a.ylo, a.yhi, b.ylo, b.yhi))


def max_distance(a: Box, b: Box) -> Column:
    far = lambda lo, hi, lo2, hi2: F.greatest(F.abs(hi2 - lo), F.abs(hi - lo2))
    return _hypot(far(a.xlo, a.xhi, b.xlo, b.xhi), far(a.ylo, a.yhi, b.ylo, b.yhi))


def area(a: Box) -> Column:
    return (a.xhi - a.xlo) * (a.yhi - a.ylo)


def margin(a: Box) -> Column:
    """Sum of the sides times 2^(dimensions - 1): in the plane, the perimeter."""
    return 2 * ((a.xhi - a.xlo) + (a.yhi - a.ylo))


def diagonal(a: Box) -> Column:
    return _hypot(a.xhi - a.xlo, a.yhi - a.ylo)


def longest_side(a: Box) -> Column:
    return F.greatest(a.xhi - a.xlo, a.yhi - a.ylo)


def center(a: Box) -> Point:
    return Point((a.xlo + a.xhi) / 2, (a.ylo + a.yhi) / 2)


def intersection(a: Box, b: Box) -> Box:
    """The common box; all null where there is none."""
    meet = Box(F.greatest(a.xlo, b.xlo), F.greatest(a.ylo, b.ylo), F.least(a.xhi, b.xhi), F.least(a.yhi, b.yhi))
    some = (meet.xlo <= meet.xhi) & (meet.ylo <= meet.yhi)
    return Box(*(F.when(some, c) for c in meet))


def intersection_area(a: Box, b: Box) -> Column:
    return F.coalesce(area(intersection(a, b)), F.lit(0.0))


def union(a: Box, b: Box) -> Box:
    return Box(F.least(a.xlo, b.xlo), F.least(a.ylo, b.ylo), F.greatest(a.xhi, b.xhi), F.greatest(a.yhi, b.yhi))


def bounding_box(a: Box) -> list[Column]:
    """Aggregates: the least box around all."""
    return [F.min(a.xlo).alias("xlo"), F.min(a.ylo).alias("ylo"), F.max(a.xhi).alias("xhi"), F.max(a.yhi).alias("yhi")]


def expand(a: Box, by: Column | float) -> Box:
    return Box(a.xlo - by, a.ylo - by, a.xhi + by, a.yhi + by)
