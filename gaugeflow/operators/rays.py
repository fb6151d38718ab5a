"""Where rays first meet a surface: rays walk a grid, and triangles wait in the cells of their own size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.scratch import forget, written

FINEST = 1024  # the least cell is this part of the longest side of the box around all triangles
FIRST_STEP = 16  # finest cells that rays walk in the first round; twice as many in each further one


def _leveled(triangles: DataFrame) -> tuple[DataFrame, dict[str, float] | None]:
    """Triangles with a row for each cell of their box (level, gx, gy, gz), at the level whose cells are as large as they are; and the box around all."""
    low = {c: F.least(*[F.col(f"{n}{c}") for n in "abc"]) for c in "xyz"}
    high = {c: F.greatest(*[F.col(f"{n}{c}") for n in "abc"]) for c in "xyz"}
    ok = reduce(Column.__and__, (V.is_finite(F.col(f"{n}{c}")) for n in "abc" for c in "xyz"))
    sized = triangles.where(ok).withColumns({f"l{c}": low[c] for c in "xyz"} | {f"h{c}": high[c] for c in "xyz"})
    box = sized.agg(*[F.min(f"l{c}").alias(f"l{c}") for c in "xyz"], *[F.max(f"h{c}").alias(f"h{c}") for c in "xyz"]).first().asDict()
    if box["lx"] is None:
        return sized.limit(0), None
    widest = max(box[f"h{c}"] - box[f"l{c}"] for c in "xyz") or 1.0
    extent = F.greatest(*[F.col(f"h{c}") - F.col(f"l{c}") for c in "xyz"], F.lit(widest / FINEST))
    rows = sized.withColumn("level", F.ceil(F.log2(extent)).cast("int")).withColumn("cell", F.pow(F.lit(2.0), F.col("level")))
    for c in "xyz":
        slack = F.col("cell") * 1e-9
        rows = rows.withColumn(f"g{c}", F.explode(F.sequence(F.floor((F.col(f"l{c}") - slack) / F.col("cell")), F.floor((F.col(f"h{c}") + slack) / F.col("cell")))))
    return rows.drop("cell", *[f"{e}{c}" for e in "lh" for c in "xyz"]), box


def _time_at(o: Column, d: Column):
    return lambda plane: (plane * F.col("cell") - o) / d


def _walked(rays: DataFrame) -> DataFrame:
    """A row for each cell that a ray crosses from ``t0`` to ``t1`` at each of its ``levels``: level, gx, gy, gz.

    A ray enters a new cell where it crosses a plane of the grid, so cells lie between neighbouring crossings of all three axes.
    """
    rows = rays.withColumn("level", F.explode("levels")).drop("levels").withColumn("cell", F.pow(F.lit(2.0), F.col("level")))
    crossings = []
    for c in "xyz":
        o, d = F.col(f"o{c}"), F.col(f"d{c}")
        ends = [F.floor((o + d * F.col(t)) / F.col("cell")) for t in ("t0", "t1")]
        planes = F.sequence(F.least(*ends) + 1, F.greatest(*ends))
        some = (d != 0) & (ends[0] != ends[1])
        crossings.append(F.when(some, F.transform(F.when(some, planes), _time_at(o, d))).otherwise(F.array().cast("array<double>")))
    rows = rows.withColumn("times", F.array_sort(F.concat(F.array("t0", "t1"), *crossings)))
    rows = rows.select("*", F.posexplode("times").alias("k", "from")).where(F.col("k") + 1 < F.size("times"))
    middle = (F.col("from") + F.get(F.col("times"), F.col("k") + 1)) / 2
    return rows.withColumns({f"g{c}": F.floor((F.col(f"o{c}") + F.col(f"d{c}") * middle) / F.col("cell")) for c in "xyz"}).drop("times", "k", "from", "cell")


def first_hits(rays: DataFrame, triangles: DataFrame) -> DataFrame:
    """ray_id, fid, t: the nearest triangle in front of each ray, and how far, in lengths of its direction; ties go to the smaller fid.

    rays: ray_id (unique), o*, d* (not zero); triangles: fid, a*, b*, c*. Rays that meet none are left out, as are those and triangles with
    values that aren't finite; both sides of a triangle count.

    Each triangle lies in the few cells of a grid whose cells are as large as it is. Rays walk all grids at once, in rounds that go
    farther each time, from where they enter the box around all triangles; a ray that has met a triangle before the end of its round is done. So a round joins
    rays and triangles by equal cells, never all with all, and the number of rounds grows with the logarithm of the box.
    """
    placed, box = _leveled(triangles)
    placed = written(placed, "cells")
    if box is None:
        return rays.select("ray_id").limit(0).join(placed.select("fid"), F.lit(False)).withColumn("t", F.lit(0.0))
    levels = sorted(r.level for r in placed.select("level").distinct().collect())  # 11 at most: of sizes from the box's to 1/1024 of it
    d = V.columns("d")
    finite = reduce(Column.__and__, (V.is_finite(F.col(f"{n}{c}")) for n in "od" for c in "xyz"))
    enter, leave = F.lit(0.0), F.lit(float("inf"))
    slack = 1e-9 * 2.0 ** levels[-1]
    for c in "xyz":
        o, s = F.col(f"o{c}"), F.col(f"d{c}")
        a, b = F.try_divide(F.lit(box[f"l{c}"] - slack) - o, s), F.try_divide(F.lit(box[f"h{c}"] + slack) - o, s)
        inside = o.between(box[f"l{c}"] - slack, box[f"h{c}"] + slack)
        enter = F.greatest(enter, F.when(s != 0, F.least(a, b)).when(inside, 0.0).otherwise(float("inf")))
        leave = F.least(leave, F.when(s != 0, F.greatest(a, b)).otherwise(float("inf")))
    open_rays = rays.select("ray_id", *[f"{n}{c}" for n in "od" for c in "xyz"]).where(finite & (V.dot(d, d) > 0)).withColumns({"t0": enter, "leave": leave}).where("t0 <= leave")
    step = F.lit(FIRST_STEP * 2.0 ** levels[0]) / V.norm(d)
    open_rays = written(open_rays.withColumns({"step": step, "levels": F.lit(levels)}), "rays")
    found = []
    while not open_rays.isEmpty():
        now = open_rays.withColumn("t1", F.least(F.col("t0") + F.col("step"), F.col("leave")))
        met = _walked(now).join(placed, ["level", "gx", "gy", "gz"])
        a, e1, e2 = V.columns("a"), V.minus(V.columns("b"), V.columns("a")), V.minus(V.columns("c"), V.columns("a"))
        p = V.cross(d, e2)
        det, s = V.dot(e1, p), V.minus(V.columns("o"), a)
        q = V.cross(s, e1)
        hit = met.withColumns({"u": F.try_divide(V.dot(s, p), det), "v": F.try_divide(V.dot(d, q), det), "t": F.try_divide(V.dot(e2, q), det)})
        hit = hit.where("u >= 0 AND v >= 0 AND u + v <= 1 AND t > 0 AND t <= t1")
        hit = written(hit.groupBy("ray_id").agg(F.min(F.struct("t", "fid")).alias("m")).select("ray_id", "m.fid", "m.t"), "hits")
        found.append(hit)
        old = open_rays
        rest = now.where("t1 < leave").join(hit.select("ray_id"), "ray_id", "left_anti")
        open_rays = written(rest.withColumns({"t0": F.col("t1"), "step": F.col("step") * 2}).drop("t1"), "rays")
        forget(old)
    out = reduce(DataFrame.unionByName, found) if found else placed.limit(0).select(F.lit(None).cast(rays.schema["ray_id"].dataType).alias("ray_id"), "fid", F.lit(0.0).alias("t"))
    result = written(out, "first-hits")
    forget(placed, *found)
    return result


def surface_observations(rays: DataFrame, triangles: DataFrame, estimates: DataFrame, most: float = 0.025) -> DataFrame:
    """ray_id, landmark, fid, t, x, y, z: where the rays of each landmark meet the surface, for hits within ``most`` of the landmark's estimate (landmark, ex, ey, ez); farther ones are other parts of the surface, or its back. rays: ray_id, landmark, o*, d*."""
    hits = first_hits(rays, triangles).join(rays, "ray_id").join(estimates, "landmark")
    at = tuple(F.col(f"o{c}") + F.col("t") * F.col(f"d{c}") for c in "xyz")
    return hits.where(V.distance(at, V.columns("e")) <= most).select("ray_id", "landmark", "fid", "t", *[v.alias(c) for v, c in zip(at, "xyz")])
