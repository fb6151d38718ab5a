"""Exact percentiles and medians that outliers don't move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import is_finite
from ..sources.scratch import written
from .quantiles import exact_percentiles


def finite_percentiles(rows: DataFrame, by: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """Linear-interpolated percentiles of the finite values: p05 for 0.05 and so on; null where there are none."""
    v = F.when(is_finite(F.col(value)), F.col(value))
    return exact_percentiles(rows, by, {f"p{round(100 * q):02d}": (v, q) for q in quantiles})


def mad_filtered(rows: DataFrame, group: str, value: str, least: int = 15, spread: float = 3.5, floor: float = 0.01, least_groups: int = 15) -> DataFrame:
    """One row: groups, n, kept, median, mad_percent, enough. Values of groups with ``least`` rows, without those beyond the median by more than ``spread`` MADs (or ``floor`` of the median).

    mad_percent is the median distance of the kept values from their median, in percent of it; ``enough`` says whether ``least_groups`` groups
    are large enough for the result to count.
    """
    big = rows.groupBy(group).agg(F.count(value).alias("_c")).where(F.col("_c") >= least).select(F.col(group).alias("_g"))
    # Groups grow with the rows, so they aren't broadcast; a broadcast found late would have each task read all that another task shuffled.
    own = written(rows.join(big.hint("shuffle_hash"), F.col(group) == F.col("_g")).select(group, F.col(value).alias("_v")), "ratios")
    center = exact_percentiles(own, [], {"_m": (F.col("_v"), 0.5)}).first()
    middle = F.lit(center["_m"] if center else None).cast("double")
    off = F.abs(F.col("_v") - middle)
    mad = exact_percentiles(own, [], {"_s": (off, 0.5)}).first()
    limit = F.greatest(spread * F.lit(mad["_s"] if mad else None).cast("double"), floor * middle)
    kept = F.when(off <= limit, F.col("_v"))
    last = exact_percentiles(own, [], {"median": (kept, 0.5)}).first()
    median = F.lit(last["median"] if last else None).cast("double")
    rest = exact_percentiles(own, [], {"_r": (F.abs(kept - median), 0.5)}).first()
    deviation = F.lit(rest["_r"] if rest else None).cast("double")
    out = own.agg(F.count_distinct(group).alias("groups"), F.count("_v").alias("n"), F.count(kept).alias("kept"))
    return out.select("groups", "n", "kept", median.alias("median"), F.try_divide(deviation * 100, median).alias("mad_percent"), (F.col("groups") >= least_groups).alias("enough"))


def percentile_trim(rows: DataFrame, by: list[str], value: str, quantile: float = 0.04) -> DataFrame:
    """Rows not below the quantile of their group."""
    cut = exact_percentiles(rows, by, {"_cut": (F.col(value), quantile)})
    return rows.join(cut, by).where(F.col(value) >= F.col("_cut")).drop("_cut")


def positive_medians(rows: DataFrame, by: list[str], value: Column, least: float = 1e-6) -> DataFrame:
    """``median`` of each group's values above ``least``; 0 if there are none."""
    found = exact_percentiles(rows, by, {"median": (F.when(value > least, value), 0.5)})
    return found.withColumn("median", F.coalesce("median", F.lit(0.0)))


def band_summary(rows: DataFrame, distance: str, value: str, bands: list[tuple[str, float, float]], above: float = 0.1) -> DataFrame:
    """For each band [low, high) of ``distance``: count, median of ``value`` and share above a limit; zeros for an empty band."""
    named = F.array(*[F.struct(F.lit(n).alias("band"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for n, a, b in bands])
    wide = rows.select(F.col(distance).alias("_d"), F.col(value).alias("_v"), F.explode(named).alias("_b"))
    inside = (F.col("_d") >= F.col("_b.a")) & (F.col("_d") < F.col("_b.b"))
    placed = wide.select(F.col("_b.band").alias("band"), F.when(inside, F.col("_v")).alias("_v"))
    counts = placed.groupBy("band").agg(F.count("_v").alias("n"), F.coalesce(F.avg((F.col("_v") > above).cast("double")), F.lit(0.0)).alias("share"))
    medians = exact_percentiles(placed, ["band"], {"median": (F.col("_v"), 0.5)})
    return counts.join(medians, "band").select("band", "n", F.coalesce("median", F.lit(0.0)).alias("median"), "share")


def section_width(rows: DataFrame, by: list[str], across: str, height: str, depth: float) -> DataFrame:
    """Extent of ``across`` where ``height`` is within ``depth`` of its group's maximum; 0 with fewer than two such rows."""
    top = rows.groupBy(*by).agg(F.max(height).alias("_top"))
    near = F.when(F.col(height) >= F.col("_top") - depth, F.col(across))
    return rows.join(top, by).groupBy(*by).agg(F.when(F.count(near) >= 2, F.max(near) - F.min(near)).otherwise(0.0).alias("width"))


def quadratic_fit(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Least squares of y = a x^2 + b x + c over each group: by, n, a, b, c; null where fewer than three different x are.

    Powers of x about the group's mean are summed, so far-off groups lose no digits; the 3x3 problem is an expression of the sums.
    """
    mean = rows.groupBy(*by).agg(F.avg(x).alias("_m"))
    t = F.col(x) - F.col("_m")
    sums = rows.join(mean, by).groupBy(*by, "_m").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.pow(t, k)).alias(f"_s{k}") for k in range(1, 5)], *[F.sum(F.pow(t, k) * F.col(y)).alias(f"_t{k}") for k in range(3)], F.count_distinct(x).alias("_d"))
    n, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("n", "_s1", "_s2", "_s3", "_s4", "_t0", "_t1", "_t2"))
    det3 = lambda p, q, r, u, v, w, k, m, o: p * (v * o - w * m) - q * (u * o - w * k) + r * (u * m - v * k)
    det = det3(s4, s3, s2, s3, s2, s1, s2, s1, n)
    a = F.try_divide(det3(t2, s3, s2, t1, s2, s1, t0, s1, n), det)
    b = F.try_divide(det3(s4, t2, s2, s3, t1, s1, s2, t0, n), det)
    c = F.try_divide(det3(s4, s3, t2, s3, s2, t1, s2, s1, t0), det)
    ok = F.col("_d") >= 3
    solved = sums.select(*by, "n", "_m", F.when(ok, a).alias("a"), F.when(ok, b).alias("_b"), F.when(ok, c).alias("_c"))
    m = F.col("_m")
    return solved.select(*by, "n", "a", (F.col("_b") - 2 * F.col("a") * m).alias("b"), (F.col("_c") - F.col("_b") * m + F.col("a") * m * m).alias("c"))


def sidewall_position(rows: DataFrame, by: list[str], inside: Column, across: str, height: str) -> DataFrame:
    """by, across_median, height_median over the rows that are inside; 0 where none is."""
    found = exact_percentiles(rows, by, {"across_median": (F.when(inside, F.col(across)), 0.5), "height_median": (F.when(inside, F.col(height)), 0.5)})
    return found.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("across_median", "height_median")})
