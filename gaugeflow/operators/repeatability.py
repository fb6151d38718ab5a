"""Repeatability of surfaces: all pairs of cases are aligned at once, state keyed by pair, and compared both ways around their landmarks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.scratch import forget, written
from ..sources.workers import share_package
from .gates import named
from .neighbors import voxel_means
from .quantiles import exact_percentiles
from .solve import moment_sums, similarity_from_sums, umeyama_fit
from .surfaces import closest_on_surface

PAIR = ["first", "second"]
#: Landmarks that distances are taken around, and limits in millimetres.
NASAL = ("nasion", "pronasale", "subnasale", "left_alare", "right_alare")
PASS_MM, FAIL_MM = 1.0, 2.0
LEAST_LANDMARKS = 6


def _moved(r: str, t: str, of: str = "") -> list[Column]:
    """The point (``of`` + x, y, z) turned by the array ``r`` (row by row) and shifted by ``t``."""
    return [sum((F.col(r)[3 * i + j] * F.col(of + c) for j, c in enumerate("xyz")), F.col(t)[i]) for i in range(3)]


def _as(names: str, values: list[Column]) -> list[Column]:
    return [v.alias(names + c) for v, c in zip(values, "xyz")]


def align_pairs(clouds: DataFrame, starts: DataFrame, *, reach: float, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """first, second, r, t, n, rmse, fitness, rounds, converged: the rigid motion that takes each pair's first cloud to its second, by iterated closest points.

    clouds: case_id, point_id, x, y, z; starts: first, second, r (9 numbers), t (3). In each round the open pairs' points are moved,
    each is joined with the nearest point of the other cloud within ``reach``, by cells, and the best motion of all pairs' points is added:
    sums with partial results, of which Python gets a row a pair. A pair leaves when neither the share of points with a partner (fitness) nor
    their root mean square distance changes by ``tolerance`` of itself, or when fewer than three points have a partner. The state is a small table,
    written each round, so nothing depends on the number of pairs.
    """
    spark = clouds.sparkSession
    share_package(spark)
    keys = ", ".join(f"{n} {starts.schema[n].dataType.simpleString()}" for n in PAIR)
    sizes = clouds.groupBy(F.col("case_id").alias("first")).agg(F.count("point_id").alias("size"))
    state = written(starts.select(*PAIR, "r", "t").join(sizes, "first").selectExpr(*PAIR, "r", "t", "size", "0L AS n", "CAST(NULL AS DOUBLE) AS rmse", "0D AS fitness", "0 AS rounds", "false AS converged", "true AS open"), "pairs")
    cells = clouds.select(F.col("case_id").alias("second"), F.col("point_id").alias("near"), *[F.col(c).alias("t" + c) for c in "xyz"], *[F.floor(F.col(c) / reach).alias("g" + c) for c in "xyz"])
    cells = written(cells, "cells")

    def solve(batches):
        for batch in batches:
            out = []
            for _, row in batch.iterrows():
                r, t = np.reshape(row["r"], (3, 3)), np.asarray(row["t"], float)
                n, rmse, fitness = int(row["pairs"]), row["error"], row["pairs"] / max(1, row["size"])
                before = row["rmse"]
                done = n < 3 or (before is not None and before == before and abs(before - rmse) <= tolerance * max(rmse, 1e-300) and abs(row["fitness"] - fitness) <= tolerance * fitness)
                if not done:
                    _, more, shift = similarity_from_sums(row.rename({"pairs": "n"}), with_scale=False)
                    r, t = more @ r, more @ t + shift
                out.append((row["first"], row["second"], r.ravel().tolist(), t.tolist(), row["size"], n, rmse, fitness, row["rounds"] + 1, bool(done and n >= 3), not done))
            yield pd.DataFrame(out, columns=[*PAIR, "r", "t", "size", "n", "rmse", "fitness", "rounds", "converged", "open"])

    for _ in range(rounds):
        open_pairs = state.where("open")
        moved = open_pairs.join(clouds.withColumnRenamed("case_id", "first"), "first").select(*PAIR, "point_id", *_as("s", _moved("r", "t")))
        around = moved
        for c in "xyz":
            around = around.withColumn("g" + c, F.explode(F.array(*[F.floor(F.col("s" + c) / reach) + k for k in (-1, 0, 1)])))
        met = around.join(cells, ["second", "gx", "gy", "gz"]).withColumn("distance", V.distance(V.columns("s"), V.columns("t"))).where(F.col("distance") <= reach)
        nearest = met.groupBy(*PAIR, "point_id").agg(F.min(F.struct("distance", "near", "sx", "sy", "sz", "tx", "ty", "tz")).alias("m")).select(*PAIR, "m.*")
        nearest = written(nearest, "nearest")
        errors = nearest.groupBy(*PAIR).agg(F.sqrt(F.avg(F.col("distance") * F.col("distance"))).alias("error"))
        sums = moment_sums(nearest, PAIR).withColumnRenamed("n", "pairs")
        known = open_pairs.drop("n").join(sums.join(errors, PAIR), PAIR, "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))
        stepped = known.mapInPandas(solve, f"{keys}, r array<double>, t array<double>, size long, n long, rmse double, fitness double, rounds int, converged boolean, open boolean")
        before, state = state, written(state.where("NOT open").unionByName(stepped), "pairs")
        forget(before, nearest)
        if state.where("open").isEmpty():
            break
    forget(cells)
    return state.drop("open", "size")


def surface_repeatability(vertices: DataFrame, faces: DataFrame, landmarks: DataFrame, pairs: DataFrame, *, voxel: float = 0.0015, reach: float = 0.006, central: float = 0.075, least_central: int = 1000, nasal: float = 0.022, least_nasal: int = 500, cell: float = 0.002, rounds: int = 100) -> DataFrame:
    """A row a pair of cases: first, second, landmarks, landmark_scale, icp_fitness, icp_rmse_mm, icp_rounds, icp_converged, samples, median_mm, p95_mm, p99_mm, status, overall_status.

    vertices: case_id, vid, x, y, z; faces: case_id, fid, v0, v1, v2; landmarks: case_id, landmark, x, y, z; all in metres; pairs: first,
    second. Pairs are aligned rigidly, first by their common landmarks, then by iterated closest points of what lies within ``central``
    of the landmarks' middle (all of a case where that is fewer than ``least_central``), thinned to voxel means. Then distances are
    taken both ways between the surfaces, at vertices within ``nasal`` of the landmarks around the nose. No scale is applied; what the landmarks would
    suggest is told. The worst pair's p95 decides ``overall_status``. Errors: pairs with fewer than six common landmarks, or with fewer
    than ``least_nasal`` vertices to compare on either side.
    """
    marks = landmarks.select("case_id", "landmark", "x", "y", "z")
    sides = [marks.select(F.col("case_id").alias(k), "landmark", *[F.col(c).alias(p + c) for c in "xyz"]) for k, p in (("first", "s"), ("second", "t"))]
    common = written(pairs.select(*PAIR).join(sides[0], "first").join(sides[1], ["second", "landmark"]), "common")
    counts = pairs.select(*PAIR).join(common.groupBy(*PAIR).agg(F.count("landmark").alias("landmarks")), PAIR, "left").withColumn("landmarks", F.coalesce("landmarks", F.lit(0)))
    few = counts.where(F.col("landmarks") < LEAST_LANDMARKS).limit(3).collect()
    if few:
        raise ValueError(f"pairs with fewer than {LEAST_LANDMARKS} common landmarks: {[(r.first, r.second) for r in few]}")
    starts = written(umeyama_fit(common, PAIR, with_scale=False).select(*PAIR, "r", "t"), "starts")
    scales = umeyama_fit(common, PAIR).select(*PAIR, F.col("scale").alias("landmark_scale"))

    centers = marks.groupBy("case_id").agg(*[F.avg(c).alias("m" + c) for c in "xyz"])
    placed = vertices.join(centers, "case_id").withColumn("inside", V.distance(V.columns(""), V.columns("m")) <= central)
    enough = placed.groupBy("case_id").agg((F.count_if("inside") >= least_central).alias("enough"))
    middle = placed.join(enough, "case_id").where("inside OR NOT enough")
    clouds = written(voxel_means(middle, ["case_id"], voxel).select("case_id", F.struct("vx", "vy", "vz").alias("point_id"), "x", "y", "z"), "voxels")
    fits = written(align_pairs(clouds, starts, reach=reach, rounds=rounds), "fits")

    def turned(rows: DataFrame, of: str = "") -> DataFrame:
        """Rows of first cases, moved for each pair."""
        return fits.select(*PAIR, "r", "t").join(rows.withColumnRenamed("case_id", "first"), "first").withColumns(dict(zip((of + c for c in "xyz"), _moved("r", "t", of)))).drop("r", "t")

    def kept(rows: DataFrame) -> DataFrame:
        return fits.select(*PAIR).join(rows.withColumnRenamed("case_id", "second"), "second")

    def nose(points: DataFrame, marks: DataFrame) -> DataFrame:
        anchors = marks.where(F.col("landmark").isin(*NASAL)).groupBy(*PAIR).agg(F.collect_list(F.struct("x", "y", "z")).alias("anchors"))  # five a case
        near = F.exists("anchors", lambda a: V.distance(V.columns(""), (a["x"], a["y"], a["z"])) <= nasal)
        return points.join(anchors, PAIR).where(near).select(*PAIR, F.col("vid").alias("point_id"), "x", "y", "z")

    corner = lambda n: vertices.select("case_id", F.col("vid").alias(f"v{n}"), *[F.col(c).alias("abc"[n] + c) for c in "xyz"])
    triangles = faces.select("case_id", "fid", "v0", "v1", "v2")
    for n in range(3):
        triangles = triangles.join(corner(n), ["case_id", f"v{n}"])
    triangles = written(triangles.drop("v0", "v1", "v2"), "triangles")
    moved_triangles = triangles.withColumnRenamed("case_id", "first").join(fits.select(*PAIR, "r", "t"), "first")
    for corner_name in "abc":
        moved_triangles = moved_triangles.withColumns(dict(zip((corner_name + c for c in "xyz"), _moved("r", "t", corner_name))))
    moved_triangles = moved_triangles.drop("r", "t")
    one = written(nose(turned(vertices), turned(marks)), "nose")
    two = written(nose(kept(vertices), kept(marks)), "nose")
    sampled = [n.groupBy(*PAIR).agg(F.count("point_id").alias(c)) for n, c in ((one, "n1"), (two, "n2"))]
    small = fits.select(*PAIR).join(sampled[0], PAIR, "left").join(sampled[1], PAIR, "left").where(F.least(F.coalesce("n1", F.lit(0)), F.coalesce("n2", F.lit(0))) < least_nasal).limit(3).collect()
    if small:
        raise ValueError(f"pairs with fewer than {least_nasal} vertices around the nose: {[(r.first, r.second) for r in small]}")
    both = closest_on_surface(one, kept(triangles), cell, on=tuple(PAIR)).select(*PAIR, "distance").unionByName(closest_on_surface(two, moved_triangles, cell, on=tuple(PAIR)).select(*PAIR, "distance"))
    both = written(both.select(*PAIR, (F.col("distance") * 1000).alias("mm")), "distances")
    high = exact_percentiles(both, PAIR, {"median_mm": (F.col("mm"), 0.5), "p95_mm": (F.col("mm"), 0.95), "p99_mm": (F.col("mm"), 0.99)})
    rows = counts.join(scales, PAIR).join(fits, PAIR).join(both.groupBy(*PAIR).agg(F.count("mm").alias("samples")), PAIR).join(high, PAIR)
    rank = F.when(F.col("p95_mm") <= PASS_MM, 0).when(F.col("p95_mm") <= FAIL_MM, 1).otherwise(2)
    rows = written(rows.select(*PAIR, "landmarks", "landmark_scale", F.col("fitness").alias("icp_fitness"), (F.col("rmse") * 1000).alias("icp_rmse_mm"), F.col("rounds").alias("icp_rounds"), F.col("converged").alias("icp_converged"), "samples", "median_mm", "p95_mm", "p99_mm", rank.alias("rank")), "repeatability")
    worst = rows.agg(F.max("rank").alias("worst"))
    out = rows.join(F.broadcast(worst), F.lit(True))  # one row
    forget(common, starts, clouds, triangles, one, two, both)
    return out.select(*[c for c in rows.columns if c != "rank"], named(F.col("rank")).alias("status"), named(F.col("worst")).alias("overall_status"))
