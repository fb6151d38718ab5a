"""Rigid registration of point clouds by iterated closest points."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .neighbors import fine_size, nearest_within, voxel_means
from .solve import moment_sums, similarity_from_sums

STRAIGHT = 0.9  # cosine of motions that go on in one direction
FARTHEST = 16.0


def moved(points: DataFrame, r: np.ndarray, t: np.ndarray) -> DataFrame:
    """``points`` with x, y, z rotated by r, then shifted by t."""
    new = [sum((F.col(c) * float(r[i, j]) for j, c in enumerate("xyz")), F.lit(float(t[i]))) for i in range(3)]
    return points.withColumns(dict(zip("xyz", new)))


def _thinned(points: DataFrame, voxel: float, name: str) -> DataFrame:
    return written(voxel_means(points, [], voxel).select(F.concat_ws(":", F.lit(name), "vx", "vy", "vz").alias("point_id"), "x", "y", "z"), "voxels")


def _turn(r: np.ndarray) -> np.ndarray:
    """The axis of a rotation, as long as its angle."""
    axis = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]]) / 2
    sine = np.linalg.norm(axis)
    return axis * (math.atan2(sine, (np.trace(r) - 1) / 2) / sine) if sine > 1e-300 else axis


def _times(r: np.ndarray, t: np.ndarray, center: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """The motion r, t taken ``factor`` times, turn and shift of the center each."""
    turn = _turn(r) * factor
    angle = np.linalg.norm(turn)
    x, y, z = turn / angle if angle > 0 else turn
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    new = np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * (k @ k)
    return new, center + factor * (r @ center + t - center) - new @ center


def closest_points(source: DataFrame, target: DataFrame, *, voxel: float, reach: float, rounds: int = 100, tolerance: float = 1e-7) -> DataFrame:
    """The rotation r (row by row) and shift t that take ``source`` to ``target``; one row with n, rmse, rounds and converged too.

    Both clouds (x, y, z) are thinned to the means of their voxels. In each round every source point within ``reach`` of a target point
    is paired with the nearest, and the best rigid motion of the pairs is added; the pairs are written, and one row of sums comes to the
    driver. It ends when the root mean square distance changes by no more than ``tolerance`` (``converged``) or after ``rounds``. n and rmse are of the last pairs, before the
    last motion. Where rounds go on in one direction, as in clouds much denser than they are off, a motion is taken two, four, up to
    ``FARTHEST`` times; if that makes pairs fewer or the distance larger, it is taken once instead. With fewer than three pairs no motion is added and rmse is null where there is none.
    """
    spark = source.sparkSession
    source, target = _thinned(source, voxel, "s"), _thinned(target, voxel, "t")
    size = fine_size(target, reach)
    r, t, rmse, n, done, converged = np.eye(3), np.zeros(3), None, 0, 0, False
    plain, step, factor = None, None, 1.0  # where the last round's own motion led, that motion as a vector, and how many times it was taken
    while done < rounds:
        done += 1
        now = moved(source, r, t)
        nearest = nearest_within(target, now, reach, size, places=True)
        pairs = nearest.select("distance", *[F.col(a + c).alias(b + c) for a, b in (("", "s"), ("n", "t")) for c in "xyz"])
        error = F.sqrt(F.avg(F.col("distance") * F.col("distance")))
        met, found = pairs.agg(F.count(F.lit(1)), error).first()
        if factor > 1 and (met < n or found > rmse):  # too far: the round is done again from where its own motion led
            (r, t), step, factor = plain, None, 1.0
            continue
        before, n, rmse = rmse, met, found
        if n < 3:
            break
        sums = moment_sums(pairs.withColumn("all", F.lit(1)), ["all"]).toPandas().iloc[0]
        _, more_r, more_t = similarity_from_sums(sums, with_scale=False)
        center = np.array([sums[f"s{c}"] for c in "xyz"]) / n
        last, step = step, np.append(_turn(more_r) * math.sqrt(max(0.0, sums["s2"] / n - center @ center)), more_r @ center + more_t - center)
        plain = more_r @ r, more_r @ t + more_t
        along = 0.0 if last is None else last @ step / max(np.linalg.norm(last) * np.linalg.norm(step), 1e-300)
        factor = min(2 * factor, FARTHEST) if along >= STRAIGHT and np.linalg.norm(step) >= np.linalg.norm(last) / 2 else 1.0
        converged = before is not None and abs(before - rmse) <= tolerance
        if converged:
            factor = 1.0
        more_r, more_t = _times(more_r, more_t, center, factor)
        r, t = (more_r @ r, more_r @ t + more_t) if factor > 1 else plain
        if converged:
            break
    return spark.createDataFrame([(r.ravel().tolist(), t.tolist(), n, rmse, done, converged)], "r array<double>, t array<double>, n long, rmse double, rounds int, converged boolean")
