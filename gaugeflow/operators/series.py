"""Ordered series: windows of equal duration, differences of neighbours, smoothing, gaps, profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from .quantiles import exact_percentiles


def window_top1(rows: DataFrame, time: str, score: str, row_id: str, windows: int, minimum: float, by: list[str] | None = None) -> DataFrame:
    """The best row of each of ``windows`` spans of equal duration; ``time`` is a whole number, the last row falls into the last span.

    Ties go to the first row; windows whose best is below ``minimum`` are dropped after the choice; with fewer rows than windows there are as
    many windows as rows. Bounds are an aggregate joined back, the choice a maximum with partial results, so a series need not fit a task.
    """
    by = by or []
    bounds = rows.groupBy(*by).agg(F.min(time).alias("_t0"), F.max(time).alias("_t1"), F.least(F.count(time), F.lit(windows)).alias("_n"))
    placed = (rows.join(bounds, by) if by else rows.crossJoin(bounds)).where(F.col(score).isNotNull() & ~F.isnan(score))  # one row of bounds
    placed = placed.withColumn("window", F.expr(f"(({time} - _t0) * _n) DIV (_t1 - _t0 + 1)"))
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(row_id)).alias("r"), F.col(time).alias("t"))).alias("b")
    return placed.groupBy(*by, "window").agg(best).select(*by, "window", (-F.col("b.r")).alias(row_id), F.col("b.t").alias(time), F.col("b.s").alias(score)).where(F.col(score) >= minimum)


def adjacent_motion(track: DataFrame, case: str, order: str, time: str, center: V.Vector, quaternion: V.Vector, span: int = 4096) -> DataFrame:
    """Each row with interval, step, linear_speed, angle and angular_speed since the row before it in its case; null on the first.

    ``order`` is a whole number. A case is cut into spans of it that are put in order apart; the first row of a span finds the one before in a
    table of the spans' last rows, so a case of any length is many tasks.
    """
    state = F.struct(F.col(time).alias("t"), *[x.alias(f"c{i}") for i, x in enumerate(center)], *[x.alias(f"q{i}") for i, x in enumerate(quaternion)])
    rows = track.withColumns({"_s": state, "_part": F.expr(f"{order} DIV {span}")})
    lasts = rows.groupBy(case, "_part").agg(F.max(F.struct(F.col(order).alias("o"), F.col("_s").alias("s"))).alias("_l"))
    lasts = lasts.select(case, "_part", F.lag("_l.s").over(W.partitionBy(case).orderBy("_part")).alias("_before"))
    rows = rows.join(lasts, [case, "_part"]).withColumn("_b", F.coalesce(F.lag("_s").over(W.partitionBy(case, "_part").orderBy(order)), F.col("_before")))
    at = lambda r, n, k: tuple(F.col(f"{r}.{n}{i}") for i in range(k))
    here, turn = at("_s", "q", len(quaternion)), at("_b", "q", len(quaternion))
    interval = F.col("_s.t") - F.col("_b.t")
    cosine = V.clip(F.abs(F.try_divide(V.dot(here, turn), V.norm(here) * V.norm(turn))), 0, 1)
    out = rows.withColumns({"interval": interval, "step": V.distance(at("_s", "c", len(center)), at("_b", "c", len(center))), "angle": F.degrees(F.acos(cosine) * 2)})
    return out.withColumns({"linear_speed": F.try_divide("step", "interval"), "angular_speed": F.try_divide("angle", "interval")}).drop("_s", "_part", "_before", "_b")


def motion_summary(moved: DataFrame, case: str, time: str, center: V.Vector, jump: float = 0.15) -> DataFrame:
    """A row a case: frames, duration, rate, p95 interval in ms, path length, span, jumps, p95 speeds; strictly_increasing says if every interval is positive."""
    spread = [F.max(c) - F.min(c) for c in center]
    plain = moved.groupBy(case).agg(
        F.count(time).alias("n"), (F.max(time) - F.min(time)).alias("duration"), F.try_divide(F.count(time) - 1, F.max(time) - F.min(time)).alias("rate"),
        F.sum("step").alias("path_length"), F.sqrt(sum((s * s for s in spread), F.lit(0.0))).alias("span"), F.count_if(F.col("step") > jump).alias("jumps"), F.coalesce(F.min("interval") > 0, F.lit(True)).alias("strictly_increasing"),
    )
    high = exact_percentiles(moved, [case], {"interval_p95_ms": (F.col("interval") * 1000, 0.95), "linear_p95": (F.col("linear_speed"), 0.95), "angular_p95": (F.col("angular_speed"), 0.95)})
    return plain.join(high, case)


def conditional_percentiles(rows: DataFrame, by: list[str], value: str, selected: Column) -> DataFrame:
    """p10 and p50 of the selected rows beside median and p05-p95 range of all rows, finite values only."""
    v = F.when(V.is_finite(F.col(value)), F.col(value))
    some = F.when(selected, v)
    found = exact_percentiles(rows, by, {"selected_p10": (some, 0.1), "selected_p50": (some, 0.5), "all_p50": (v, 0.5), "_high": (v, 0.95), "_low": (v, 0.05)})
    return found.withColumn("all_range", F.col("_high") - F.col("_low")).drop("_high", "_low")


def contiguity(rows: DataFrame, case: str, position: str) -> DataFrame:
    """A row a case: whether positions are 0..n-1, each once. Counts and bounds say so; no sort is needed."""
    ok = (F.min(position) == 0) & (F.max(position) == F.count(position) - 1) & (F.count_distinct(position) == F.count(F.lit(1)))
    return rows.groupBy(case).agg(F.count(F.lit(1)).alias("n"), F.coalesce(ok, F.lit(False)).alias("contiguous"))


def gaussian_smooth(rows: DataFrame, case: str, position: str, value: str, sigma: float = 1.6) -> DataFrame:
    """Weighted mean over neighbours within max(2, ceil(3 sigma)); beyond the ends the end value repeats. Positions are 0..n-1."""
    radius = max(2, math.ceil(3 * sigma))
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    w = W.partitionBy(case).orderBy(position)
    ends = W.partitionBy(case).orderBy(position).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, last = F.first(value).over(ends), F.last(value).over(ends)
    parts = [F.coalesce(F.lag(value, -k).over(w), first if k < 0 else last) * (raw[k + radius] / sum(raw)) if k else F.col(value) * (raw[radius] / sum(raw)) for k in range(-radius, radius + 1)]
    return rows.withColumn("smooth", sum(parts[1:], parts[0]))


def interpolate_gaps(rows: DataFrame, case: str, position: str, value: str) -> DataFrame:
    """``filled``: null values on the line between their neighbours that have one; beyond the ends the end value."""
    back = W.partitionBy(case).orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(case).orderBy(F.col(position).desc()).rowsBetween(W.unboundedPreceding, 0)  # a frame to the end is computed anew for each row, one from the start is not
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(position).cast("double").alias("p"), F.col(value).alias("v")))
    a, b = F.last(at, ignorenulls=True).over(back), F.last(at, ignorenulls=True).over(ahead)
    both = rows.withColumns({"_a": a, "_b": b})
    share = F.try_divide(F.col(position) - F.col("_a.p"), F.col("_b.p") - F.col("_a.p"))
    return both.withColumn("filled", F.coalesce(F.col(value), F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * share, F.col("_a.v"), F.col("_b.v"))).drop("_a", "_b")


def binned_profile(rows: DataFrame, by: list[str], along: Column, height: str, low: float, high: float, bins: int, quantile: float = 0.9, least: int = 2) -> DataFrame:
    """A quantile of ``height`` in each of ``bins`` bins along an axis; null where a bin has fewer than ``least`` points. Every case has all bins."""
    spark = rows.sparkSession
    placed = rows.withColumn("bin", F.floor((along - low) * (bins / (high - low))).cast("int")).where(F.col("bin").between(0, bins - 1))
    got = placed.groupBy(*by, "bin").agg(F.count(height).alias("points")).join(exact_percentiles(placed, [*by, "bin"], {"level": (F.col(height), quantile)}), [*by, "bin"])
    spine = rows.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return spine.join(got, [*by, "bin"], "left").withColumns({"level": F.when(F.col("points") >= least, F.col("level")), "points": F.coalesce("points", F.lit(0))})


def second_difference(rows: DataFrame, case: str, position: str, value: str) -> DataFrame:
    """Largest absolute second difference of each case; null with fewer than three rows."""
    w = W.partitionBy(case).orderBy(position)
    d = F.col(value) - 2 * F.lag(value, 1).over(w) + F.lag(value, 2).over(w)
    return rows.withColumn("_d", F.abs(d)).groupBy(case).agg(F.max("_d").alias("max_second_difference"))


def uniform_subsample(rows: DataFrame, case: str, order: str, keep: int) -> DataFrame:
    """Of each case's rows in order about ``keep`` evenly spread ones, halves to even; all of a case that has no more than that."""
    placed = rows.withColumns({"_p": F.row_number().over(W.partitionBy(case).orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(W.partitionBy(case))})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda i: F.rint(i * ((F.col("_n") - 1) / (keep - 1))).cast("int"))
    return placed.where((F.col("_n") <= keep) | F.array_contains(wanted, F.col("_p"))).drop("_p", "_n")


def interpolate_at(knots: DataFrame, case: str, x: str, y: str, level: float) -> DataFrame:
    """The value at ``level`` on each case's line through its knots; beyond the ends the end value."""
    knot = F.struct(F.col(x).cast("double").alias("x"), F.col(y).alias("y"))
    ends = knots.groupBy(case).agg(F.max(F.when(F.col(x) <= level, knot)).alias("a"), F.min(F.when(F.col(x) >= level, knot)).alias("b"))
    line = F.col("a.y") + (F.col("b.y") - F.col("a.y")) * F.try_divide(F.lit(level) - F.col("a.x"), F.col("b.x") - F.col("a.x"))
    return ends.select(case, F.coalesce(line, F.col("a.y"), F.col("b.y")).alias("level_value"))


def first_argmax(rows: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """The row of each group with the highest score; of equal ones the smallest ``tie`` (a number)."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(tie)).alias("t"))).alias("b")
    return rows.groupBy(*by).agg(best).select(*by, (-F.col("b.t")).alias(tie), F.col("b.s").alias(score))
