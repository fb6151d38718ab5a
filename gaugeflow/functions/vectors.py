"""Vectors as tuples of scalar columns: a component a column, so nothing is boxed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, ...]


def columns(prefix: str, names: str = "xyz") -> Vector:
    return tuple(F.col(prefix + n) for n in names)


def numbers(*values: float) -> Vector:
    return tuple(F.lit(float(v)) for v in values)


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b))


def dot(a: Vector, b: Vector) -> Column:
    return reduce(lambda s, t: s + t, (x * y for x, y in zip(a, b)))


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vector, b: Vector) -> Column:
    return norm(minus(a, b))


def clip(x: Column, low: float, high: float) -> Column:
    """x held to low..high; null stays null, which ``least`` and ``greatest`` alone would pass over."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def angle_degrees(a: Vector, b: Vector) -> Column:
    """Angle between two vectors; the cosine is clipped first, as acos is NaN beyond 1. Null where one has no length."""
    return F.degrees(F.acos(clip(F.try_divide(dot(a, b), norm(a) * norm(b)), -1, 1)))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def unit(a: Vector) -> Vector:
    """Of length 1; null where a vector has no length."""
    return tuple(F.try_divide(x, norm(a)) for x in a)


def view_direction(q: Vector) -> Vector:
    """A camera's -Z axis in the world, of length 1, from its quaternion (x, y, z, w) of any length; squared lengths below 1e-12 count as 1."""
    x, y, z, w = q
    s = F.lit(2.0) / F.when(dot(q, q) < 1e-12, 1.0).otherwise(dot(q, q))
    return unit((-(s * (x * z + y * w)), -(s * (y * z - x * w)), -(F.lit(1.0) - s * (x * x + y * y))))


def smootherstep(x: Column) -> Column:
    """6t^5 - 15t^4 + 10t^3 of x clipped to 0..1."""
    t = clip(x, 0, 1)
    return t * t * t * (t * (t * 6 - 15) + 10)


def affine(p: Vector, rows: list[list[float]]) -> Vector:
    """A 3x4 or 4x4 matrix applied to points."""
    return tuple(dot(p, numbers(*r[:3])) + r[3] for r in rows[:3])
