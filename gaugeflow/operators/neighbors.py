"""Nearest neighbours of points in space by a grid of cells: exact for all neighbours within the cell size."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.scratch import forget, written
from . import tiles


POINTS_A_PART = 4096
FEW_A_CELL = 4  # points on average
PLACES_A_TASK = 1024
POINTS_A_TILE = 8192
POINTS_A_SEARCH = 2048


def _cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size).cast("long")


def radius_pairs(points: DataFrame, radius: float, queries: DataFrame | None = None, keep: tuple[str, ...] = (), places: bool = False) -> DataFrame:
    """(point_id, neighbor_id, distance) of all other points within the radius of each query point (all points by default).

    ``keep`` names columns of the queries to carry along, ``places`` adds the neighbour's nx, ny, nz, so pairs need not be joined again.
    Cells are as large as the radius, so a neighbour is in one of 27 cells: queries are exploded to those and joined on equal cells. Where
    there are many points, each cell is cut into parts, so no task gets a crowded cell whole; queries meet the parts one by one.
    """
    queries = points if queries is None else queries
    parts = math.ceil(points.count() / POINTS_A_PART)
    cells = points.select(F.col("point_id").alias("neighbor_id"), *[F.col(c).alias("n" + c) for c in "xyz"], *[_cell(c, radius).alias("c" + c) for c in "xyz"])
    around = queries.select("point_id", "x", "y", "z", *keep, *[_cell(c, radius).alias("q" + c) for c in "xyz"])
    for c in "xyz":
        around = around.withColumn("c" + c, F.explode(F.array(F.col("q" + c) - 1, F.col("q" + c), F.col("q" + c) + 1)))
    on = ["cx", "cy", "cz"]
    if parts > 1:
        # Queries are dealt to parts, and each part has all points of its cells.
        on = [*on, "part"]
        cells = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        around = around.withColumn("part", F.pmod(F.xxhash64("point_id"), F.lit(parts)).cast("int")).repartition(8 * parts, *on)
    met = around.join(cells, on).where("point_id <> neighbor_id")
    found = met.withColumn("distance", V.distance(V.columns(""), V.columns("n"))).where(F.col("distance") <= radius)
    return found.select("point_id", "neighbor_id", "distance", *keep, *(["nx", "ny", "nz"] if places else []))


def whole(points: DataFrame) -> DataFrame:
    """``points`` without those that have no id or a place that isn't finite; none of them is near any other."""
    for c in "xyz":
        points = points.where(V.is_finite(F.col(c)))
    return points.where("point_id IS NOT NULL")


def radius_sums(points: DataFrame, radius: float) -> DataFrame:
    """Over all other points (of unequal id) within the radius of each point: point_id, their number n, sums nx, ny, nz, and sums of products nx_nx, nx_ny, ... Points without any are left out. Ids are whole numbers.

    The pairs are those of ``radius_pairs``, but they are made and summed block by block within a task (see ``tiles.deal``).
    """
    points = whole(points).select(F.col("point_id").cast("long").alias("point_id"), "x", "y", "z")
    limit, products = tiles.square_limit(radius), [(i, j) for i in range(3) for j in range(i, 3)]
    names = ["point_id", "n", "nx", "ny", "nz", *[f"n{'xyz'[i]}_n{'xyz'[j]}" for i, j in products]]

    def sums(batches):
        for mine, others in tiles.tiles(batches):
            ids, *q = tiles.numbers(mine, "point_id", "x", "y", "z")
            out = np.zeros((len(ids), 10))
            for rows, p, inside in tiles.near_blocks(q, ids, np.arange(0, len(ids), 64), others, limit):
                values = np.stack([np.ones(len(p[0])), *p, *[p[i] * p[j] for i, j in products]], axis=1)
                out[rows] += values.sum(axis=0) if inside is None else inside.astype(float) @ values
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(out[:, 0].astype(np.int64)), *[pa.array(v) for v in out[:, 1:].T]], names=names)

    rows = dealt_within(points, points, radius)
    parts = rows.mapInArrow(sums, "point_id long, n long, " + ", ".join(f"{n} double" for n in names[2:]))
    return parts.groupBy("point_id").agg(*[F.sum(n).alias(n) for n in names[1:]]).where("n > 0")


def dealt_within(queries: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Rows for tasks that look at all points within the radius of each query point: see ``tiles.deal``."""
    most = min(POINTS_A_TILE, max(256, points.count() // 64))
    place = V.columns("")
    return tiles.deal(queries, points.select("point_id", "x", "y", "z"), place, place, radius, most)


def fine_size(points: DataFrame, reach: float) -> float:
    """``reach``, halved until cells of that size hold few points on average."""
    n, size = points.count(), reach
    for _ in range(20):
        if points.select(*[_cell(c, size).alias(c) for c in "xyz"]).distinct().count() * FEW_A_CELL >= n:
            break
        size /= 2
    return size


def nearest_within(points: DataFrame, queries: DataFrame, reach: float, size: float, places: bool = False) -> DataFrame:
    """(point_id, distance, neighbor_id) of the nearest point within ``reach`` of each query point that has one; ties go to the smaller id. ``places`` adds the point's x, y, z and the neighbour's nx, ny, nz.

    Points within ``size`` are looked at first (see ``fine_size``); queries whose nearest is farther than that go on with eight times as much,
    up to ``reach``, so what is sent follows the points, not all that lie within ``reach``. Pairs are made and compared within a task (see ``tiles.deal``).
    """
    rest, done, scratch = whole(queries).select("point_id", "x", "y", "z"), None, []
    goal, place = whole(points).select("point_id", "x", "y", "z"), V.columns("")
    while True:
        dealt = tiles.deal(rest, goal, place, place, size, POINTS_A_SEARCH)
        close = tiles.closest_candidates(dealt, [("x", "y", "z")], lambda p, corners: np.sqrt(sum((a - b) * (a - b) for a, b in zip(p, corners[0]))), size)
        met = close.select("q.*", F.col("o.point_id").alias("neighbor_id"), *[F.col(f"o.{c}").alias("n" + c) for c in "xyz"])
        met = met.withColumn("distance", V.distance(place, V.columns("n"))).where(F.col("distance") <= size)
        first = F.min(F.struct("distance", "neighbor_id", "x", "y", "z", "nx", "ny", "nz")).alias("m")
        near = written(met.groupBy("point_id").agg(first).select("point_id", "m.*"), "near")
        done = near if done is None else done.unionByName(near)
        if size >= reach:
            break
        rest = written(rest.join(near.select("point_id").hint("merge"), "point_id", "left_anti"), "rest")
        scratch.append(rest)
        if rest.isEmpty():
            break
        size = min(reach, size * 8)
    forget(*scratch)
    return done if places else done.select("point_id", "distance", "neighbor_id")


def _positions(points: DataFrame, most: int) -> DataFrame:
    """x, y, z and ids: each place once, with the ``most`` smallest ids there; more can't be among the nearest of any point."""
    same = [(F.col(c) + 0.0).alias(c) for c in "xyz"]  # -0.0 is the same place as 0.0
    first = points.select("point_id", *same).selectExpr("*", "row_number() OVER (PARTITION BY x, y, z ORDER BY point_id) AS n").where(F.col("n") <= most)
    return first.groupBy("x", "y", "z").agg(F.array_sort(F.collect_list("point_id")).alias("ids"))


def _refined(places: DataFrame, radius: float, most: int, deepest: int = 40) -> DataFrame:
    """``places`` with ``level``: how often cells as large as the radius have to be halved around each for its own cell to hold no more than ``most`` places."""
    left, done, scratch = places.withColumn("level", F.lit(0)), None, []
    for level in range(deepest):
        keys = [_cell(c, radius / 2**level).alias("g" + c) for c in "xyz"]
        placed = left.select("*", *keys)
        crowded = placed.groupBy("gx", "gy", "gz").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
        if level == 0 and crowded.isEmpty():
            return left
        split = written(placed.join(crowded.select("gx", "gy", "gz", F.lit(True).alias("crowded")), ["gx", "gy", "gz"], "left").drop("gx", "gy", "gz"), "refined")
        scratch.append(split)
        own = split.where("crowded IS NULL").drop("crowded")
        done = own if done is None else done.unionByName(own)
        left = split.where("crowded").drop("crowded").withColumn("level", F.lit(level + 1))
        if left.isEmpty():
            break
    out = written(done.unionByName(left), "levels")
    forget(*scratch)
    return out


def knn(points: DataFrame, k: int, start_radius: float) -> DataFrame:
    """The k nearest other points of each point: point_id, rank, neighbor_id, distance; ties go to the smaller id.

    Places that several points share are searched once, and at most k + 1 ids of each can matter. Cells are as large as ``start_radius``, and
    are halved where they are crowded, until they hold 16 k places (128 at least) or fewer; a place looks into the 27 cells around it of its own size, so
    pairs grow with the points, however dense some regions are, and only the k + 1 best of a place are written. Places that find fewer
    within their cell's size go on with cells twice as large, so the result is exact. It ends when none is left, or when cells
    are as large as the box around all points: then every other point has been found, be it fewer than k.
    """
    box = points.agg(*[(F.max(c) - F.min(c)).alias(c) for c in "xyz"]).first()
    widest = math.sqrt(sum((x or 0.0) ** 2 for x in box))
    places = written(_positions(points, k + 1), "places")
    tasks = places.count() // PLACES_A_TASK
    open_places = _refined(places, start_radius, max(128, 16 * k))
    found, scratch = [], [places]
    while True:
        levels = sorted(r.level for r in open_places.select("level").distinct().collect())  # halvings and doublings: a few
        if not levels:
            break
        size = F.lit(start_radius) / F.pow(F.lit(2.0), F.col("level"))
        at = lambda c: F.floor(F.col(c) / size).cast("long")
        cells = places.withColumn("level", F.explode(F.lit(levels))).select("level", *[at(c).alias("g" + c) for c in "xyz"], *[F.col(c).alias("n" + c) for c in "xyz"], "ids")
        around = open_places.select("x", "y", "z", "level")
        for c in "xyz":
            around = around.withColumn("g" + c, F.explode(F.array(at(c) - 1, at(c), at(c) + 1)))
        if tasks > 8:  # a task has as many pairs as its places have, however many places there are
            around = around.repartition(tasks, "level", "gx", "gy", "gz")
        met = around.join(cells, ["level", "gx", "gy", "gz"]).withColumn("distance", V.distance(V.columns(""), V.columns("n")))
        last = F.pow(F.lit(2.0), F.col("level")) * widest <= start_radius
        near = met.where((F.col("distance") <= size) | last).select("x", "y", "z", "level", "distance", F.explode("ids").alias("neighbor_id"))
        best = near.selectExpr("*", "row_number() OVER (PARTITION BY x, y, z ORDER BY distance, neighbor_id) AS n").where(F.col("n") <= k + 1).drop("n")
        best = written(best, "knn")
        # A place is in one of its own cells, so each open place has rows here.
        inside = best.groupBy("x", "y", "z", "level").agg(F.count("neighbor_id").alias("n")).withColumn("done", (F.col("n") > k) | last)
        found.append(best.join(inside.where("done").select("x", "y", "z"), ["x", "y", "z"], "left_semi").select("x", "y", "z", "distance", "neighbor_id"))
        scratch += [open_places, best]
        open_places = inside.where("NOT done").select("x", "y", "z", (F.col("level") - 1).alias("level"))
    if not found:
        return points.select("point_id", F.lit(1).alias("rank"), F.col("point_id").alias("neighbor_id"), F.lit(0.0).alias("distance")).limit(0)
    all_found = found[0]
    for more in found[1:]:
        all_found = all_found.unionByName(more)
    of_place = written(all_found.groupBy("x", "y", "z").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbor_id"))).alias("near")), "nearest")  # k + 1 a place
    forget(*scratch)
    mine = points.select("point_id", *[(F.col(c) + 0.0).alias(c) for c in "xyz"]).join(of_place, ["x", "y", "z"])
    others = F.slice(F.filter("near", lambda n: n["neighbor_id"] != F.col("point_id")), 1, k)
    return mine.select("point_id", F.posexplode(others).alias("rank", "n")).select("point_id", (F.col("rank") + 1).alias("rank"), "n.neighbor_id", "n.distance")


def outliers(neighbors: DataFrame, ratio: float) -> DataFrame:
    """point_id, mean_distance, outlier: whether the mean distance to the k nearest is above mean + ratio * sd (of n - 1) over all points."""
    each = neighbors.groupBy("point_id").agg(F.avg("distance").alias("mean_distance"))
    limit = each.agg((F.avg("mean_distance") + ratio * F.stddev_samp("mean_distance")).alias("limit"))
    return each.withColumn("outlier", F.col("mean_distance") > limit.scalar())


def without_outliers(points: DataFrame, neighbors: DataFrame, ratio: float, most_share: float = 0.05) -> DataFrame:
    """``points`` without the outliers; points without neighbours stay. More than ``most_share`` of the points are an error: the cloud isn't one of a surface then, or the ratio is wrong."""
    marked = written(outliers(neighbors, ratio), "outliers")
    gone, n = marked.agg(F.count_if("outlier")).first()[0], points.count()
    if gone > most_share * n:
        raise ValueError(f"{gone} of {n} points are outliers, more than a share of {most_share:g}")
    return points.join(marked.where("outlier").select("point_id"), "point_id", "left_anti")


def nearest_of_pairs(pairs: DataFrame, most: int) -> DataFrame:
    """Of the neighbours of each point (point_id, neighbor_id, distance) the ``most`` nearest; ties go to the smaller id. Each task keeps its nearest first."""
    return pairs.selectExpr("*", "row_number() OVER (PARTITION BY point_id ORDER BY distance, neighbor_id) AS _n").where(F.col("_n") <= most).drop("_n")


def voxel_means(points: DataFrame, by: list[str], size: float) -> DataFrame:
    """The mean point of each occupied cell of a grid."""
    return points.groupBy(*by, *[_cell(c, size).alias("v" + c) for c in "xyz"]).agg(*[F.avg(c).alias(c) for c in "xyz"], F.count(F.lit(1)).alias("points"))


def seeded_sample(rows: DataFrame, row_id: str, n: int, seed: int) -> DataFrame:
    """n rows (a bounded number), the same for the same seed whatever the partitions: those with the smallest hashes. Each task keeps its n smallest; only those meet."""
    return rows.withColumn("_h", F.xxhash64(F.col(row_id), F.lit(seed))).orderBy("_h", row_id).limit(n).drop("_h")


def triangle_hits(rays: DataFrame, triangles: DataFrame, on: list[str]) -> DataFrame:
    """Nearest triangle that each ray meets, among those with equal keys ``on`` (a cell or a case): ray_id, fid, t. Rays: o*, d*; triangles: a*, b*, c*."""
    a, b, c = V.columns("a"), V.columns("b"), V.columns("c")
    e1, e2, d = V.minus(b, a), V.minus(c, a), V.columns("d")
    p = V.cross(d, e2)
    det = V.dot(e1, p)
    s = V.minus(V.columns("o"), a)
    u, q = F.try_divide(V.dot(s, p), det), V.cross(s, e1)
    v, t = F.try_divide(V.dot(d, q), det), F.try_divide(V.dot(e2, q), det)
    met = rays.join(triangles, on).withColumns({"u": u, "v": v, "t": t}).where("u >= 0 AND v >= 0 AND u + v <= 1 AND t > 0")
    return met.groupBy("ray_id").agg(F.min(F.struct("t", "fid")).alias("m")).select("ray_id", "m.fid", "m.t")
