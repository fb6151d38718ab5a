"""Points against triangle surfaces: closest points, bindings, distances both ways, agreement of normals."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.scratch import forget, written
from . import tiles
from .quantiles import exact_percentiles

POINTS_A_TILE = 2048


def with_closest(rows: DataFrame) -> DataFrame:
    """``rows`` with points x, y, z and triangles a*, b*, c* get the triangle's closest point: u, v, w (its weights of the corners, which sum to 1), sx, sy, sz and distance."""
    p, a, b, c = V.columns(""), V.columns("a"), V.columns("b"), V.columns("c")
    ab, ac = V.minus(b, a), V.minus(c, a)
    names = {"_1": (ab, a), "_2": (ac, a), "_3": (ab, b), "_4": (ac, b), "_5": (ab, c), "_6": (ac, c)}
    rows = rows.withColumns({n: V.dot(side, V.minus(p, corner)) for n, (side, corner) in names.items()})
    d1, d2, d3, d4, d5, d6 = (F.col(n) for n in names)
    rows = rows.withColumns({"_vc": d1 * d4 - d3 * d2, "_vb": d5 * d2 - d1 * d6, "_va": d3 * d6 - d5 * d4})
    va, vb, vc = F.col("_va"), F.col("_vb"), F.col("_vc")
    zero, one = F.lit(0.0), F.lit(1.0)

    def weights(v: Column, w: Column) -> Column:
        return F.struct(v.alias("v"), w.alias("w"))

    along_bc = F.try_divide(d4 - d3, (d4 - d3) + (d5 - d6))
    at = (
        F.when((d1 <= 0) & (d2 <= 0), weights(zero, zero))
        .when((d3 >= 0) & (d4 <= d3), weights(one, zero))
        .when((vc <= 0) & (d1 >= 0) & (d3 <= 0), weights(F.coalesce(F.try_divide(d1, d1 - d3), zero), zero))
        .when((d6 >= 0) & (d5 <= d6), weights(zero, one))
        .when((vb <= 0) & (d2 >= 0) & (d6 <= 0), weights(zero, F.coalesce(F.try_divide(d2, d2 - d6), zero)))
        .when((va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0), weights(one - F.coalesce(along_bc, zero), F.coalesce(along_bc, zero)))
        .otherwise(weights(F.coalesce(F.try_divide(vb, va + vb + vc), zero), F.coalesce(F.try_divide(vc, va + vb + vc), zero)))
    )
    rows = rows.withColumn("_at", at).withColumns({"u": one - F.col("_at.v") - F.col("_at.w"), "v": F.col("_at.v"), "w": F.col("_at.w")})
    s = tuple(F.col("u") * x + F.col("v") * y + F.col("w") * z for x, y, z in zip(a, b, c))
    rows = rows.withColumns({f"s{n}": x for n, x in zip("xyz", s)}).withColumn("distance", V.distance(p, V.columns("s")))
    return rows.drop("_at", "_va", "_vb", "_vc", *names)


def triangle_distances(p: list[np.ndarray], corners: list[list[np.ndarray]]) -> np.ndarray:
    """Distances of points from triangles, pair by pair: what ``with_closest`` gives, in the same steps, to tell which pairs matter."""
    a, b, c = corners
    minus = lambda s, t: [x - y for x, y in zip(s, t)]
    dot = lambda s, t: s[0] * t[0] + s[1] * t[1] + s[2] * t[2]
    ab, ac = minus(b, a), minus(c, a)
    d1, d2, d3, d4, d5, d6 = (dot(side, minus(p, corner)) for side, corner in ((ab, a), (ac, a), (ab, b), (ac, b), (ab, c), (ac, c)))
    va, vb, vc = d3 * d6 - d5 * d4, d5 * d2 - d1 * d6, d1 * d4 - d3 * d2
    share = lambda x, y: np.divide(x, y, out=np.zeros_like(x), where=y != 0)
    zero, one, along_bc, whole = np.zeros_like(d1), np.ones_like(d1), share(d4 - d3, (d4 - d3) + (d5 - d6)), va + vb + vc
    cases = [
        ((d1 <= 0) & (d2 <= 0), zero, zero), ((d3 >= 0) & (d4 <= d3), one, zero), ((vc <= 0) & (d1 >= 0) & (d3 <= 0), share(d1, d1 - d3), zero),
        ((d6 >= 0) & (d5 <= d6), zero, one), ((vb <= 0) & (d2 >= 0) & (d6 <= 0), zero, share(d2, d2 - d6)), ((va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0), one - along_bc, along_bc),
    ]
    v, w = (np.select([case[0] for case in cases], [case[k] for case in cases], share(x, whole)) for k, x in ((1, vb), (2, vc)))
    u = one - v - w
    d = minus(p, [u * x + v * y + w * z for x, y, z in zip(a, b, c)])
    return np.sqrt(dot(d, d))


def closest_on_surface(points: DataFrame, triangles: DataFrame, start: float, on: tuple[str, ...] = ()) -> DataFrame:
    """For each point (point_id, x, y, z) the nearest triangle (fid, a*, b*, c*): ``on``, point_id, fid, u, v, w, sx, sy, sz, distance; ties go to the smaller fid.

    ``on`` names columns that points and triangles share: each point looks at triangles with equal ones only, so many surfaces are
    searched at once. Points and triangles whose values aren't finite are left out.

    Points are dealt to tiles with the triangles whose boxes lie within ``start`` (see ``tiles.deal``), and a task looks at those only that may
    be nearer than what a point has already, so pairs of points and triangles are neither shuffled nor sorted. Points whose best is farther go
    on with twice the reach; it ends when none is left or it is as large as everything. Each round is written.
    """
    finite = lambda names: reduce(Column.__and__, (V.is_finite(F.col(n)) for n in names))
    at = [f"{t}{c}" for t in "abc" for c in "xyz"]
    low, high = (tuple(f(*[F.col(f"{t}{c}") for t in "abc"]) for c in "xyz") for f in (F.least, F.greatest))
    surface = written(triangles.where(finite(at)).select(*on, "fid", *at), "triangles")
    rest = written(points.where(finite("xyz")).select(*on, "point_id", "x", "y", "z"), "open")
    span = rest.agg(*[F.min(c) for c in "xyz"], *[F.max(c) for c in "xyz"]).first()
    box = surface.agg(*[F.min(c) for c in low], *[F.max(c) for c in high]).first()
    none = span[0] is None or box[0] is None
    widest = 0.0 if none else math.sqrt(sum((max(span[i + 3], box[i + 3]) - min(span[i], box[i])) ** 2 for i in range(3)))
    keys, done, scratch, size = [*on, "point_id"], None, [surface, rest], start
    while True:
        last = size >= widest
        dealt = tiles.deal(rest, surface, low, high, size, POINTS_A_TILE, on)
        near = tiles.closest_candidates(dealt, [tuple(f"{t}{c}" for c in "xyz") for t in "abc"], triangle_distances, math.inf if last else size)
        met = with_closest(near.select(*[f"q.{c}" for c in (*keys, "x", "y", "z")], *[f"o.{c}" for c in ("fid", *at)]))
        best = met.groupBy(*keys).agg(F.min(F.struct("distance", "fid", "u", "v", "w", "sx", "sy", "sz")).alias("m"))
        best = best.select(*keys, "m.fid", "m.u", "m.v", "m.w", "m.sx", "m.sy", "m.sz", "m.distance")
        found = written(best if last else best.where(F.col("distance") <= size), "closest")
        done = found if done is None else done.unionByName(found)
        if last:
            break
        # Spark guesses the size of what was found from its files, so it isn't to send it to the driver for a broadcast.
        rest = written(rest.join(found.select(*keys).hint("merge"), keys, "left_anti"), "open")
        scratch.append(rest)
        if rest.isEmpty():
            break
        size *= 2
    forget(*scratch)
    return done


def two_way_distances(first_points: DataFrame, first: DataFrame, second_points: DataFrame, second: DataFrame, start: float) -> DataFrame:
    """One row: samples, median, p95 and p99 of the distances of each surface's points from the other surface."""
    both = closest_on_surface(first_points, second, start).select("distance").unionByName(closest_on_surface(second_points, first, start).select("distance"))
    both = written(both, "distances")
    high = exact_percentiles(both, [], {"median": (F.col("distance"), 0.5), "p95": (F.col("distance"), 0.95), "p99": (F.col("distance"), 0.99)})
    return high.select(F.lit(both.count()).alias("samples"), "median", "p95", "p99")


def normal_agreement(pairs: DataFrame, by: list[str]) -> DataFrame:
    """How normals (n*) agree with those of neighbours (o*): by, pairs, p50 to p99 of their angle and of the angle of their planes in degrees, shares of dot products below 0, -0.5 and -0.9.

    Pairs with a vector that isn't finite or is shorter than 1e-12 don't count.
    """
    n, o = V.columns("n"), V.columns("o")
    whole = F.lit(True)
    for x in (*n, *o):
        whole = whole & V.is_finite(x)
    good = pairs.where(whole & (V.norm(n) > 1e-12) & (V.norm(o) > 1e-12)).withColumn("dot", V.clip(V.dot(n, o) / (V.norm(n) * V.norm(o)), -1, 1))
    turned, plane = F.degrees(F.acos("dot")), F.degrees(F.acos(F.abs(F.col("dot"))))
    shares = [F.avg((F.col("dot") < x).cast("double")).alias(name) for name, x in (("below_0", 0.0), ("below_half", -0.5), ("below_most", -0.9))]
    counts = good.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), *shares)
    high = exact_percentiles(good, by, {f"{name}_p{round(100 * q)}": (angle, q) for name, angle in (("angle", turned), ("plane", plane)) for q in (0.5, 0.9, 0.95, 0.99)})
    return counts.join(high, by) if by else counts.crossJoin(high)  # a row each
