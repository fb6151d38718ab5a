"""Small least-squares fits of groups of any size: sums are Spark aggregates, and only 3x3 problems of a row a group are solved in NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.scratch import forget, written
from ..sources.workers import share_package
from .quantiles import exact_percentiles


def moment_sums(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Sums that a similarity between point pairs (sx, sy, sz) and (tx, ty, tz) needs: counts, means' sums, products, squares."""
    s, t = [f"s{c}" for c in "xyz"], [f"t{c}" for c in "xyz"]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in t for b in s]
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in s + t], *products, F.sum(sum((F.col(c) * F.col(c) for c in s[1:]), F.col(s[0]) * F.col(s[0]))).alias("s2"))


def similarity_from_sums(row: pd.Series, with_scale: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """Scale, rotation and translation that take source points to targets best (closed form, reflections excluded)."""
    n = row["n"]
    ms, mt = (np.array([row[f"{k}{c}"] for c in "xyz"]) / n for k in "st")
    cov = np.array([[row[f"t{a}_s{b}"] for b in "xyz"] for a in "xyz"]) / n - np.outer(mt, ms)
    u, d, vt = np.linalg.svd(cov)
    sign = np.diag([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
    r = u @ sign @ vt
    variance = row["s2"] / n - ms @ ms
    scale = float(np.trace(np.diag(d) @ sign) / variance) if with_scale and variance > 0 else 1.0
    return scale, r, mt - scale * r @ ms


FIT = "scale double, r array<double>, t array<double>, n long"


def umeyama_fit(pairs: DataFrame, by: list[str], with_scale: bool = True) -> DataFrame:
    """A similarity for each group: scale, r (row by row), t, n. A group reaches Python as one row of sums, however many points it has."""

    def solve(batches):
        for batch in batches:
            fits = [similarity_from_sums(r, with_scale) for _, r in batch.iterrows()]
            yield batch[by].assign(scale=[f[0] for f in fits], r=[f[1].ravel().tolist() for f in fits], t=[f[2].tolist() for f in fits], n=batch["n"])

    share_package(pairs.sparkSession)
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*by).schema)
    return moment_sums(pairs, by).mapInPandas(solve, f"{keys}, {FIT}")


def ransac_fit(pairs: DataFrame, by: list[str], row_id: str, *, hypotheses: int = 1000, sample: int = 8, threshold: float = 0.025, seed: int = 1) -> DataFrame:
    """The similarity of the hypothesis with most inliers (then the lowest median residual among them), fitted again to its inliers; ``accepted`` if these are 20 and half of the group at least.

    Each hypothesis draws ``sample`` pairs of a group, those with the smallest hashes; all are fitted from one aggregate, and scored on
    all pairs in a second. So neither a group nor the pairs of a group need fit a task.
    """
    spark = pairs.sparkSession
    trials = spark.range(hypotheses).withColumnRenamed("id", "trial")
    sizes = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    mark = F.pmod(F.xxhash64(row_id, "trial", F.lit(seed)), F.lit(1 << 30))
    tried = pairs.join(sizes, by).crossJoin(F.broadcast(trials)).withColumn("_h", mark)  # trials: a fixed number
    likely = tried.where(F.col("_h") < F.lit(4.0 * sample) / F.col("_n") * (1 << 30))  # among which the smallest nearly always are
    drawn = likely.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "trial").orderBy("_h", row_id))).where(F.col("_r") <= sample)
    fits = written(umeyama_fit(drawn, [*by, "trial"]).where(F.col("n") >= 4).withColumnRenamed("n", "drawn"), "fits")
    scored = pairs.join(fits, by).withColumn("residual", residual())
    inside = F.when(F.col("residual") <= threshold, F.col("residual"))
    score = written(scored.groupBy(*by, "trial").agg(F.count(inside).alias("inliers")), "score")
    most = score.groupBy(*by).agg(F.max("inliers").alias("inliers"))
    leading = score.join(most, [*by, "inliers"])  # hypotheses with most inliers; of these the one whose inliers fit best, then the first
    medians = exact_percentiles(scored.join(leading.select(*by, "trial"), [*by, "trial"]), [*by, "trial"], {"median": (inside, 0.5)})
    best = leading.join(medians, [*by, "trial"]).groupBy(*by).agg(F.min(F.struct(F.coalesce("median", F.lit(float("inf"))).alias("m"), "trial", "inliers")).alias("b")).select(*by, "b.trial", "b.inliers")
    kept = scored.join(best, [*by, "trial"]).where(F.col("residual") <= threshold)
    enough = F.greatest(F.lit(20.0), F.bround(F.col("_n") * 0.5, 0))
    return umeyama_fit(kept, by).join(best.drop("trial"), by).join(sizes, by).withColumn("accepted", F.col("inliers") >= enough).drop("_n")


def residual():
    """Distance of a transformed source point from its target, for rows with scale, r and t."""
    parts = [F.col("scale") * sum((F.col("r")[3 * i + j] * F.col(f"s{c}") for j, c in enumerate("xyz")), F.lit(0.0)) + F.col("t")[i] - F.col(f"t{'xyz'[i]}") for i in range(3)]
    return F.sqrt(sum((p * p for p in parts), F.lit(0.0)))


def ray_points(rays: DataFrame, by: list[str]) -> DataFrame:
    """The point nearest to all rays (c*: center, d*: unit direction) of each group: px, py, pz; null if they are all alike.

    Sums of I - dd' and of its product with c are an aggregate; the 3x3 problem is an expression of its six entries.
    """
    m = {(i, j): (F.lit(1.0) if i == j else F.lit(0.0)) - F.col(f"d{i}") * F.col(f"d{j}") for i in "xyz" for j in "xyz"}
    right = {i: sum((m[i, j] * F.col(f"c{j}") for j in "xyz"), F.lit(0.0)) for i in "xyz"}
    sums = rays.groupBy(*by).agg(*[F.sum(m[i, j]).alias(f"m{i}{j}") for i in "xyz" for j in "xyz" if i <= j], *[F.sum(right[i]).alias(f"b{i}") for i in "xyz"])
    a = lambda i, j: F.col(f"m{min(i, j)}{max(i, j)}")
    minor = lambda r, c: a(r[0], c[0]) * a(r[1], c[1]) - a(r[0], c[1]) * a(r[1], c[0])
    rest = {"x": "yz", "y": "xz", "z": "xy"}
    sign = lambda i, j: 1.0 if ("xyz".index(i) + "xyz".index(j)) % 2 == 0 else -1.0
    det = sum((a("x", j) * minor("yz", rest[j]) * sign("x", j) for j in "xyz"), F.lit(0.0))
    solved = [F.try_divide(sum((minor(rest[i], rest[j]) * sign(i, j) * F.col(f"b{j}") for j in "xyz"), F.lit(0.0)), det).alias(f"p{i}") for i in "xyz"]
    return sums.select(*by, *solved)


def _median_and_mad(rows: DataFrame, by: list[str]) -> DataFrame:
    """Median ``m`` of ``r`` over kept rows, and ``s``, the median distance from it."""
    middle = exact_percentiles(rows, by, {"m": (F.when(F.col("keep"), F.col("r")), 0.5)})
    return exact_percentiles(rows.join(middle, by), by, {"s": (F.when(F.col("keep"), F.abs(F.col("r") - F.col("m"))), 0.5)}).join(middle, by)


def _trimmed(rows: DataFrame, by: list[str], rounds: int, least: int, distances, limit) -> DataFrame:
    """``rows`` with ``keep``, after rounds in which each group's rows are measured against its kept ones and those beyond a limit leave, or come back. Groups with fewer than ``least`` kept rows stay as they are.

    A round is a few aggregates over all groups at once, written to the shared folder; it ends early where nothing changed.
    """
    now = written(rows.withColumn("keep", F.lit(True)), "kept")
    for _ in range(rounds):
        counts = now.groupBy(*by).agg(F.count_if("keep").alias("_k"))
        measured = written(distances(now, by).join(counts, by), "measured")
        bounds = _median_and_mad(measured, by)
        new = measured.join(bounds, by, "left").withColumn("_new", F.when(F.col("_k") >= least, F.col("r") <= limit(F.col("m"), F.col("s"))).otherwise(F.col("keep")))
        new = written(new.select(*rows.columns, F.coalesce("_new", F.lit(False)).alias("keep"), F.coalesce(F.col("_new") != F.col("keep"), F.lit(False)).alias("_changed")), "kept")
        forget(now, measured)
        now = new
        if now.where("_changed").isEmpty():
            break
    return now.select(*rows.columns, "keep")


def robust_rays(rays: DataFrame, by: list[str], least: int = 6, rounds: int = 4) -> DataFrame:
    """Triangulates each group's rays (c*, d*), without those whose distance is beyond median + 3 MAD, twice the median and 1e-6, whichever is most: by, x, y, z, used, n.

    The point is that of the rays kept last. It is null where fewer than ``least`` are.
    """
    length = V.norm(V.columns("d"))
    unit = rays.select(*by, *[F.col(f"c{c}") for c in "xyz"], *[(F.col(f"d{c}") / length).alias(f"d{c}") for c in "xyz"])

    def distances(now: DataFrame, by: list[str]) -> DataFrame:
        points = ray_points(now.where("keep"), by)
        return now.join(points, by, "left").withColumn("r", V.norm(V.cross(V.minus(V.columns("p"), V.columns("c")), V.columns("d"))))

    kept = _trimmed(unit, by, rounds, least, distances, lambda m, s: F.greatest(m + 3 * s, 2 * m, F.lit(1e-6)))
    counts = kept.groupBy(*by).agg(F.count_if("keep").alias("used"), F.count(F.lit(1)).alias("n"))
    enough = F.col("used") >= least
    return counts.join(ray_points(kept.where("keep"), by), by, "left").select(*by, *[F.when(enough, F.col(f"p{c}")).alias(c) for c in "xyz"], "used", "n")


def consensus_point(points: DataFrame, by: list[str], low: float = 0.0025, high: float = 0.008, least: int = 6, rounds: int = 5) -> DataFrame:
    """Mean of each group's points within median + 3 * 1.4826 MAD (held to low..high) of the coordinate-wise median of the kept ones: by, x, y, z, used, n; null where fewer than ``least`` are kept."""

    def distances(now: DataFrame, by: list[str]) -> DataFrame:
        center = exact_percentiles(now, by, {f"p{c}": (F.when(F.col("keep"), F.col(c)), 0.5) for c in "xyz"})
        return now.join(center, by, "left").withColumn("r", V.distance(V.columns(""), V.columns("p")))

    kept = _trimmed(points.select(*by, "x", "y", "z"), by, rounds, least, distances, lambda m, s: F.least(F.lit(high), F.greatest(F.lit(low), m + 3 * 1.4826 * s)))
    enough = F.count_if("keep") >= least
    return kept.groupBy(*by).agg(*[F.when(enough, F.avg(F.when(F.col("keep"), F.col(c)))).alias(c) for c in "xyz"], F.count_if("keep").alias("used"), F.count(F.lit(1)).alias("n"))


def local_planes(neighbors: DataFrame) -> DataFrame:
    """Normal of the plane through each point's neighbours (nx, ny, nz of each row) and their RMS distance from it: point_id, normal, mean, rms, n.

    Covariance sums are an aggregate; Python gets a row a point.
    """
    c = [f"n{a}" for a in "xyz"]
    return planes_of_sums(neighbors.groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(a) for a in c], *[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(c) for b in c[i:]]))


def planes_of_sums(sums: DataFrame) -> DataFrame:
    """``local_planes`` of each point's neighbours from their number n, sums nx, ny, nz and sums of products nx_nx, nx_ny, ..."""
    c = [f"n{a}" for a in "xyz"]
    sums = sums.where("n >= 3")

    def solve(batches):
        for b in batches:
            n = b["n"].to_numpy(float)
            m = b[c].to_numpy(float) / n[:, None]
            cov = np.zeros((len(b), 3, 3))
            for i, x in enumerate(c):
                for j, y in enumerate(c):
                    cov[:, i, j] = b[f"{min(x, y)}_{max(x, y)}"].to_numpy(float) / n - m[:, i] * m[:, j]
            w, v = np.linalg.eigh(cov)
            yield pd.DataFrame({"point_id": b["point_id"], "normal": v[:, :, 0].tolist(), "mean": m.tolist(), "rms": np.sqrt(np.maximum(w[:, 0], 0)), "n": b["n"]})

    share_package(sums.sparkSession)
    return sums.mapInPandas(solve, "point_id long, normal array<double>, mean array<double>, rms double, n long")
