"""Points, regions of interest, camera transforms and landmark measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.scratch import written


def in_sphere(p: V.Vector, center: V.Vector, radius: float) -> Column:
    """Within the radius, the surface included."""
    return V.distance(p, center) <= radius


def in_segment_tube(p: V.Vector, a: V.Vector, b: V.Vector, radius: float, low: float = 0.0, high: float = 1.0) -> Column:
    """Within the radius of the segment's nearest point, at a share low..high along it; nowhere if the segment has no length."""
    axis = V.minus(b, a)
    length2 = V.dot(axis, axis)
    share = F.try_divide(V.dot(V.minus(p, a), axis), length2)
    near = tuple(x + d * V.clip(share, 0, 1) for x, d in zip(a, axis))
    return F.coalesce((length2 > 1e-24) & share.between(low, high) & (V.distance(p, near) <= radius), F.lit(False))


def near_any(points: DataFrame, p: tuple[str, str, str], anchors: list[tuple[float, float, float]], radius: float, least: int = 0) -> DataFrame:
    """Points whose nearest of a few anchors is within the radius, with that distance; fewer than ``least`` of them are an error. Anchors are constants, so this is an expression."""
    d = F.least(*[V.distance(tuple(F.col(c) for c in p), V.numbers(*a)) for a in anchors], F.lit(float("inf")))
    near = points.withColumn("anchor_distance", d).where(F.col("anchor_distance") <= radius)
    if least and (found := near.count()) < least:
        raise ValueError(f"{found} points are near an anchor, fewer than {least}")
    return near


def central_or_all(points: DataFrame, by: str, p: tuple[str, str, str], center: tuple[float, float, float], radius: float, least: int) -> DataFrame:
    """Points within the radius of a center; all points of a cloud of which fewer than ``least`` are."""
    inside = in_sphere(tuple(F.col(c) for c in p), V.numbers(*center), radius)
    n = points.groupBy(by).agg(F.count_if(inside).alias("_n"))
    return points.join(n, by).where((F.col("_n") < least) | inside).drop("_n")


def basis_coordinates(p: V.Vector, origin: V.Vector, axes: tuple[V.Vector, V.Vector, V.Vector]) -> tuple[Column, Column, Column]:
    return tuple(V.dot(V.minus(p, origin), a) for a in axes)


def max_pairwise_angle(rows: DataFrame, by: list[str], row_id: str, direction: tuple[str, str, str], cuts: int = 8) -> DataFrame:
    """The widest angle between two of a case's directions, in degrees; cases with one direction are left out, vectors without length don't count.

    Directions fall into the cells of a grid of ``cuts`` by ``cuts`` on each side of a cube around them. Of each cell, the bounds of its
    directions say how wide the angle to another cell's can be, and one of them how wide one surely is. Only pairs of cells that can beat
    the widest sure angle of their case are compared row by row, so rows are not paired with all others, and cells are of a fixed number.
    """
    v = V.unit(tuple(F.col(c) for c in direction))
    unit = rows.select(*by, F.col(row_id).alias("_i"), *[x.alias(f"_{c}") for x, c in zip(v, "xyz")]).where("_x IS NOT NULL")
    x, y, z = (F.col(f"_{c}") for c in "xyz")
    longest = F.greatest(F.abs(x), F.abs(y), F.abs(z))
    side = F.when(F.abs(x) == longest, F.when(x > 0, 0).otherwise(1)).when(F.abs(y) == longest, F.when(y > 0, 2).otherwise(3)).otherwise(F.when(z > 0, 4).otherwise(5))
    at = lambda c: F.least(F.floor((c / longest + 1) / 2 * cuts), F.lit(cuts - 1)).cast("int")
    unit = unit.withColumn("_cell", side * cuts * cuts + F.when(side < 2, at(y) * cuts + at(z)).when(side < 4, at(x) * cuts + at(z)).otherwise(at(x) * cuts + at(y)))
    unit = written(unit, "directions")
    box = [f(f"_{c}").alias(f"_{n}{c}") for c in "xyz" for n, f in (("l", F.min), ("h", F.max))]
    cells = unit.groupBy(*by, "_cell").agg(*box, F.min(F.struct("_i", "_x", "_y", "_z")).alias("_p"), F.count(F.lit(1)).alias("_n"))
    cells = written(cells, "cells")
    other = cells.select(*by, *[F.col(c).alias(f"{c}2") for c in cells.columns if c not in by])
    pairs = cells.join(other, by).where("_cell < _cell2 OR (_cell = _cell2 AND _n > 1)")  # cells: a fixed number a case
    least = sum((F.least(*[F.col(f"_{a}{c}") * F.col(f"_{b}{c}2") for a in "lh" for b in "lh"]) for c in "xyz"), F.lit(0.0))  # of any dot product
    sure = F.when(F.col("_cell") < F.col("_cell2"), V.dot(tuple(F.col(f"_p._{c}") for c in "xyz"), tuple(F.col(f"_p2._{c}") for c in "xyz"))).otherwise(1.0)
    pairs = pairs.select(*by, "_cell", "_cell2", least.alias("_least"), sure.alias("_sure"))
    bound = pairs.groupBy(*by).agg(F.min("_sure").alias("_bound"))
    hopeful = pairs.join(bound, by).where(F.col("_least") <= F.col("_bound") + 1e-12).select(*by, "_cell", "_cell2")
    second = unit.select(*by, F.col("_cell").alias("_cell2"), F.col("_i").alias("_j"), *[F.col(f"_{c}").alias(f"_{c}2") for c in "xyz"])
    met = unit.join(hopeful, [*by, "_cell"]).join(second, [*by, "_cell2"]).where("_cell < _cell2 OR _i < _j")
    cosine = V.dot((x, y, z), tuple(F.col(f"_{c}2") for c in "xyz"))
    return met.groupBy(*by).agg(F.degrees(F.acos(V.clip(F.min(cosine), -1, 1))).alias("max_angle"))


def bounding_box(points: DataFrame, by: list[str], scale: float = 1.0) -> DataFrame:
    """points, nonfinite, and minimum, maximum and scaled extent of each axis over finite points."""
    ok = V.is_finite(F.col("x")) & V.is_finite(F.col("y")) & V.is_finite(F.col("z"))
    out = [F.count(F.lit(1)).alias("points"), F.count_if(~ok).alias("nonfinite")]
    for c in "xyz":
        v = F.when(ok, F.col(c))
        out += [F.min(v).alias(f"min_{c}"), F.max(v).alias(f"max_{c}"), ((F.max(v) - F.min(v)) * scale).alias(f"extent_{c}")]
    return points.groupBy(*by).agg(*out)


def rotated_intrinsics(fx: Column, fy: Column, cx: Column, cy: Column, width: Column, height: Column, rotation: Column, scale: Column) -> tuple[Column, ...]:
    """(fx, fy, cx, cy, width, height) after turning an image and scaling it; an unknown rotation is an error.

    A quarter turn clockwise sends pixel (u, v) to (height - 1 - v, u), one counter-clockwise to (v, width - 1 - u).
    """
    bad = F.raise_error(F.concat(F.lit("unknown rotation: "), F.coalesce(rotation, F.lit("null"))))

    def pick(none, clockwise, counter, half):
        return F.when(rotation == "none", none * scale).when(rotation == "clockwise", clockwise * scale).when(rotation == "counterclockwise", counter * scale).when(rotation == "half", half * scale).otherwise(bad.cast("double"))

    return (pick(fx, fy, fy, fx), pick(fy, fx, fx, fy), pick(cx, height - 1 - cy, cy, width - 1 - cx), pick(cy, cx, width - 1 - cx, height - 1 - cy), pick(width, height, height, width), pick(height, width, width, height))


#: The ten landmarks that the measurements need.
LANDMARKS = ("glabella", "nasion", "pronasale", "subnasale", "columella", "labiale_superius", "left_alare", "right_alare", "left_endocanthion", "right_endocanthion")


def pivot_landmarks(rows: DataFrame, by: str, names: tuple[str, ...] = LANDMARKS) -> DataFrame:
    """Rows (by, landmark, x, y, z) to a row a case with struct columns; a landmark that is missing is null."""
    return rows.groupBy(by).agg(*[F.max(F.when(F.col("landmark") == n, F.struct("x", "y", "z"))).alias(n) for n in names])


def _angle_at(a: V.Vector, vertex: V.Vector, b: V.Vector) -> Column:
    u, v = V.minus(a, vertex), V.minus(b, vertex)
    together = V.norm(u) * V.norm(v) < 1e-9
    return F.when(together, F.raise_error(F.lit("an angle of landmarks that are one point")).cast("double")).otherwise(V.angle_degrees(u, v))


def measurements(wide: DataFrame, by: str) -> DataFrame:
    """Six measurements of pivoted landmarks in millimetres: two angles, a ratio, two lengths and a deviation, rounded as reports show them. A case that lacks a landmark is an error.

    The Goode ratio is the distance of the pronasale from the middle between both alaria over the length from nasion to pronasale. The
    deviation is how far the pronasale is, along the axis through both endocanthia, from their middle.
    """
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in sorted(LANDMARKS)]))
    checked = wide.withColumn("nasion", F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("missing landmarks: "), F.array_join(missing, ", "))).cast("struct<x:double,y:double,z:double>")).otherwise(F.col("nasion")))
    at = lambda n: tuple(F.col(f"{n}.{c}") for c in "xyz")
    middle = lambda a, b: tuple((x + y) / 2 for x, y in zip(at(a), at(b)))
    eyes = V.unit(V.minus(at("right_endocanthion"), at("left_endocanthion")))
    length, tip = V.distance(at("pronasale"), at("nasion")), at("pronasale")
    return checked.select(
        by, F.bround(_angle_at(at("glabella"), at("nasion"), tip), 1).alias("nasofrontal_angle_deg"), F.bround(_angle_at(at("columella"), at("subnasale"), at("labiale_superius")), 1).alias("nasolabial_angle_deg"),
        F.bround(V.distance(tip, middle("left_alare", "right_alare")) / length, 3).alias("goode_ratio"), F.bround(length, 2).alias("nose_length_mm"), F.bround(V.distance(at("left_alare"), at("right_alare")), 2).alias("nose_width_mm"),
        F.bround(F.abs(V.dot(V.minus(tip, middle("left_endocanthion", "right_endocanthion")), eyes)), 2).alias("midline_deviation_mm"),
    )


def anatomical_frame(wide: DataFrame, by: str) -> DataFrame:
    """A case's axes and region from its pivoted landmarks in millimetres: vertical, anterior, lateral (structs), tip_longitudinal_mm, roi_end_mm, half_width_mm, alar_width_mm, usable.

    Vertical runs from nasion to subnasale; anterior is what the way to the pronasale has across it; lateral is across both, from
    the left alare to the right unless anterior would then point away from the tip. ``usable`` is false where the tip is nearer than 15 mm along the vertical, the alaria are nearer than
    10 mm, or the region would end before 12 mm.
    """
    at = lambda n: tuple(F.col(f"{n}.{c}") for c in "xyz")
    pack = lambda v: F.struct(*[x.alias(c) for x, c in zip(v, "xyz")])
    vertical = V.unit(V.minus(at("subnasale"), at("nasion")))
    rows = wide.select(by, *LANDMARKS, pack(vertical).alias("vertical"))
    up = at("vertical")
    to_tip = V.minus(at("pronasale"), at("nasion"))
    along = V.dot(to_tip, up)
    rows = rows.withColumns({"tip_longitudinal_mm": along, "across": pack(tuple(t - along * u for t, u in zip(to_tip, up)))})
    rows = rows.withColumn("lateral", pack(V.unit(V.cross(up, V.unit(at("across"))))))
    flip = F.when(V.dot(at("lateral"), V.minus(at("right_alare"), at("left_alare"))) < 0, -1.0).otherwise(1.0)
    rows = rows.withColumn("lateral", pack(tuple(x * flip for x in at("lateral"))))
    rows = rows.withColumn("anterior", pack(V.unit(V.cross(at("lateral"), up))))
    back = F.when(V.dot(at("anterior"), at("across")) < 0, -1.0).otherwise(1.0)
    rows = rows.withColumns({"anterior": pack(tuple(x * back for x in at("anterior"))), "lateral": pack(tuple(x * back for x in at("lateral")))})
    rows = rows.withColumn("alar_width_mm", V.distance(at("right_alare"), at("left_alare"))).withColumn("roi_end_mm", F.least(0.82 * F.col("tip_longitudinal_mm"), F.col("tip_longitudinal_mm") - 6))
    usable = (F.col("tip_longitudinal_mm") >= 15) & V.is_finite(F.col("alar_width_mm")) & (F.col("alar_width_mm") >= 10) & (F.col("roi_end_mm") >= 12)
    return rows.select(by, "vertical", "anterior", "lateral", "tip_longitudinal_mm", "roi_end_mm", V.clip(0.28 * F.col("alar_width_mm"), 6, 12).alias("half_width_mm"), "alar_width_mm", F.coalesce(usable, F.lit(False)).alias("usable"))
