"""Height profiles of a ridge and sections across it, regions around landmarks, and whether a change met its aims."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.scratch import forget, written
from . import tiles
from .geometry import LANDMARKS
from .neighbors import dealt_within, radius_sums, whole
from .quantiles import exact_percentiles
from .series import gaussian_smooth, interpolate_gaps
from .solve import planes_of_sums

BINS = 1 << 14  # of residuals on either side of a plane
#: What ``plane_residuals`` tells: what is put in order and which share of it lies below.
RESIDUALS = {"median_absolute": ("abs", 0.5), "p90": ("abs", 0.9), "p95": ("abs", 0.95), "p99": ("abs", 0.99), "_m": ("signed", 0.5), "mad": ("mad", 0.5)}


def _binned(points: DataFrame, case: str, bins: int, least: int, enough: int, sigma: float) -> DataFrame:
    """From rows (case, bin, height): case, bin, level (smoothed 90th percentile of a bin's heights, gaps bridged), covered (whether ``enough`` bins have ``least`` points)."""
    counts = points.groupBy(case, "bin").agg(F.count("height").alias("points"))
    known = exact_percentiles(points, [case, "bin"], {"high": (F.col("height"), 0.9)}).join(counts, [case, "bin"]).where(F.col("points") >= least).select(case, "bin", "high")
    covered = known.groupBy(case).agg((F.count("bin") >= enough).alias("covered"))
    spine = points.select(case).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    filled = interpolate_gaps(spine.join(known, [case, "bin"], "left"), case, "bin", "high")
    smooth = gaussian_smooth(filled, case, "bin", "filled", sigma)  # windows of a fixed number of bins a case
    return smooth.join(covered, case, "left").select(case, "bin", F.col("smooth").alias("level"), F.coalesce("covered", F.lit(False)).alias("covered"))


def ridge_profile(points: DataFrame, frames: DataFrame, case: str, bins: int = 64) -> DataFrame:
    """The height along a ridge: case, bin, center, profile, target, covered.

    points: case, longitudinal, lateral, anterior; frames: case, roi_end_mm, half_width_mm. Points within a strip around the middle fall into
    bins from 0 to the region's end; a bin's height is its 90th percentile, from two points on. Gaps are bridged and the series smoothed.
    The target is the line through the medians near both ends. ``covered`` is false, and the line not to be trusted, where fewer than a
    third of the bins, or 12, have a height.
    """
    placed = points.join(frames.select(case, "roi_end_mm", "half_width_mm"), case).where(F.abs("lateral") <= F.least(F.lit(2.5), F.col("half_width_mm") * 0.35))
    placed = placed.withColumn("bin", F.floor(F.col("longitudinal") / (F.col("roi_end_mm") / bins)).cast("int")).where(F.col("bin").between(0, bins - 1))
    rows = _binned(placed.select(case, "bin", F.col("anterior").alias("height")), case, bins, 2, max(12, bins // 3), 1.6)
    rows = rows.join(frames.select(case, "roi_end_mm"), case).withColumn("center", (F.col("bin") + 0.5) * F.col("roi_end_mm") / bins)
    share = (F.col("bin") + 0.5) / bins
    ends = {"a": share.between(0.01, 0.08), "b": share.between(0.94, 0.995)}
    medians = [F.percentile(F.when(inside, F.col(c)), F.lit(0.5)).alias(f"_{n}_{c}") for n, inside in ends.items() for c in ("center", "level")]  # a few bins of a case
    line = rows.groupBy(case).agg(*medians)
    slope = (F.col("_b_level") - F.col("_a_level")) / (F.col("_b_center") - F.col("_a_center"))
    return rows.join(line, case).select(case, "bin", "center", F.col("level").alias("profile"), (F.col("_a_level") + slope * (F.col("center") - F.col("_a_center"))).alias("target"), "covered")


def cross_section(points: DataFrame, levels: DataFrame, case: str, bins: int = 49) -> DataFrame:
    """The height across a ridge: case, bin, center, height, covered. levels: case, level_mm, window_mm, half_width_mm; points within the window around the level fall into bins from -half_width to half_width; from 9 bins, or a fifth of them, a section is covered."""
    placed = points.join(levels, case).where(F.abs(F.col("longitudinal") - F.col("level_mm")) <= F.col("window_mm"))
    placed = placed.withColumn("bin", F.floor((F.col("lateral") + F.col("half_width_mm")) / (2 * F.col("half_width_mm") / bins)).cast("int")).where(F.col("bin").between(0, bins - 1))
    rows = _binned(placed.select(case, "bin", F.col("anterior").alias("height")), case, bins, 1, max(9, bins // 5), 1.0)
    return rows.join(levels.select(case, "half_width_mm"), case).select(case, "bin", ((F.col("bin") + 0.5) * 2 / bins * F.col("half_width_mm") - F.col("half_width_mm")).alias("center"), F.col("level").alias("height"), "covered")


def profile_acceptance(profile: DataFrame, case: str, anchor: float = 0.88) -> DataFrame:
    """Whether a change of a ridge met what was asked: a row a case with its figures and ``passed``.

    profile: case, position (0..), normalized (0 to 1 along the region), source, final, target, requested, applied (the reduction asked for
    in all, the same in every row of a case). Where nothing was asked for, the case passes. Else it passes if at the highest request 85 to
    115 % were achieved, the 10th percentile over the positions where something was asked for is 80 % or more, the target is missed by
    no more than 0.3 and 15 % of the reduction, requests are smooth, and both ends stay. Profiles have a fixed number of positions.
    """
    w = Window.partitionBy(case).orderBy("position")
    bend = F.abs(F.col("requested") - 2 * F.lag("requested", 1).over(w) + F.lag("requested", 2).over(w))
    rows = profile.withColumns({"_bend": bend, "_done": F.col("source") - F.col("final"), "_off": F.abs(F.col("final") - F.col("target"))})
    active = F.col("requested") >= F.greatest(F.lit(0.05), 0.05 * F.col("applied"))
    ratio = F.col("_done") / F.greatest(F.col("requested"), F.lit(1e-9))
    apex = F.max(F.struct("requested", (-F.col("position")).alias("first"), F.col("_done").alias("done")))
    out = rows.groupBy(case).agg(
        F.first("applied").alias("applied"), apex.alias("_apex"), F.max("_bend").alias("maximum_second_difference"), F.coalesce(F.max(F.when(F.col("normalized") <= 0.03, F.abs("_done"))), F.lit(0.0)).alias("maximum_at_start"),
        F.coalesce(F.max(F.when(F.col("normalized") >= anchor, F.abs("_done"))), F.lit(0.0)).alias("maximum_at_end"), F.count_if(active).alias("active"), F.percentile(F.when(active, ratio), F.lit(0.1)).alias("p10_achievement"), F.max(F.when(active, F.col("_off"))).alias("maximum_target_error"),
    )
    asked = F.col("applied")
    out = out.withColumn("apex_achievement", F.col("_apex.done") / F.greatest(F.col("_apex.requested"), F.lit(1e-9)))
    stays = F.greatest(F.lit(0.25), 0.1 * asked)
    met = F.col("apex_achievement").between(0.85, 1.15) & (F.col("p10_achievement") >= 0.8) & (F.col("maximum_target_error") <= F.greatest(F.lit(0.3), 0.15 * asked)) & (F.col("maximum_second_difference") <= F.greatest(F.lit(0.1), 0.08 * asked)) & (F.col("maximum_at_start") <= stays) & (F.col("maximum_at_end") <= stays)
    return out.select(case, "active", "apex_achievement", "p10_achievement", "maximum_target_error", "maximum_second_difference", "maximum_at_start", "maximum_at_end", ((asked <= 0) | F.coalesce(met & (F.col("active") > 0), F.lit(False))).alias("passed"))


def diagnostic_regions(points: DataFrame, wide: DataFrame, case: str) -> DataFrame:
    """Points (case, point_id, x, y, z in millimetres) with each region around pivoted landmarks that holds them: case, point_id, region; points in no region, and cases that lack a landmark, are left out.

    Spheres of 10 mm: the forehead, 14 mm above the glabella away from the subnasale, and both cheeks, 12 mm outwards from the middle of eye and
    alare; of 6 mm: the tip. A tube of 4 mm: the dorsum, from 15 to 75 % of the way from nasion to pronasale.
    """
    at = lambda n: tuple(F.col(f"{n}.{c}") for c in "xyz")
    middle = lambda a, b: tuple((x + y) / 2 for x, y in zip(at(a), at(b)))
    shifted = lambda p, d, k: tuple(x + y * k for x, y in zip(p, V.unit(d)))
    eyes, p = middle("left_endocanthion", "right_endocanthion"), V.columns("")
    cheek = lambda side: shifted(anchor := middle(f"{side}_endocanthion", f"{side}_alare"), V.minus(anchor, eyes), 12.0)
    nasion, tip = at("nasion"), at("pronasale")
    axis = V.minus(tip, nasion)
    share = F.try_divide(V.dot(V.minus(p, nasion), axis), V.dot(axis, axis))
    near = tuple(x + d * V.clip(share, 0, 1) for x, d in zip(nasion, axis))
    inside = {
        "central_forehead": V.distance(p, shifted(at("glabella"), V.minus(at("glabella"), at("subnasale")), 14.0)) <= 10.0,
        "left_cheek": V.distance(p, cheek("left")) <= 10.0,
        "right_cheek": V.distance(p, cheek("right")) <= 10.0,
        "nasal_tip": V.distance(p, tip) <= 6.0,
        "nasal_dorsum": (V.dot(axis, axis) > 1e-12) & share.between(0.15, 0.75) & (V.distance(p, near) <= 4.0),
    }
    known = wide.where(" AND ".join(f"{n} IS NOT NULL" for n in LANDMARKS if n != "columella"))
    named = F.explode(F.array_compact(F.array(*[F.when(i, F.lit(n)) for n, i in inside.items()]))).alias("region")
    return points.join(known, case).select(case, "point_id", named)


def plane_residuals(neighbors: DataFrame, planes: DataFrame | None, by: list[str], least: int = 6) -> DataFrame:
    """How far neighbours (point_id, n*) are from the plane through all neighbours of their point (planes: point_id, normal, mean, n): by, neighborhoods, residuals, median_absolute, mad (about the signed median), p90, p95, p99. Neighbourhoods of fewer than ``least`` don't count. ``planes`` may be None where ``neighbors`` carry normal, mean and n already: pairs are made anew in each pass then, and neither shuffled nor written."""
    offsets = [F.col("normal")[i] * (F.col(f"n{c}") - F.col("mean")[i]) for i, c in enumerate("xyz")]
    met = neighbors.where(F.col("n") >= least) if planes is None else neighbors.join(planes.where(F.col("n") >= least), "point_id")
    rows = met.withColumn("r", offsets[0] + offsets[1] + offsets[2]).select("point_id", *by, "r")
    counts = rows.groupBy(*by).agg(F.count_distinct("point_id").alias("neighborhoods"), F.count("r").alias("residuals"))
    high = exact_percentiles(rows, by, {"median_absolute": (F.abs("r"), 0.5), "p90": (F.abs("r"), 0.9), "p95": (F.abs("r"), 0.95), "p99": (F.abs("r"), 0.99), "_m": (F.col("r"), 0.5)})
    high = written(high, "residuals")
    mad = exact_percentiles(rows.join(F.broadcast(high.select(*by, "_m")), by), by, {"mad": (F.abs(F.col("r") - F.col("_m")), 0.5)})
    return counts.join(high.drop("_m"), by).join(mad, by)


def _bounds(bins: np.ndarray, counts: np.ndarray, scale: float) -> list[tuple]:
    """For each of ``RESIDUALS`` of a group, from the numbers of residuals in its bins: name, ranks that it lies between and part of the way, residuals surely below, bins (from, to) that may hold it."""
    total, out, middle = int(counts.sum()), [], (0.0, 0.0)
    low, high = (bins - 1e-6) / scale, (bins + 1 + 1e-6) / scale  # a bin and a little more, as bins are rounded
    low[bins <= -BINS], high[bins >= BINS - 1] = -np.inf, np.inf
    for name, (kind, share) in RESIDUALS.items():
        if kind == "signed":
            least, most = low, high
        else:  # distances from the middle, which lies within a bin
            center = middle if kind == "mad" else (0.0, 0.0)
            least = np.maximum(0, np.maximum(low - center[1], center[0] - high))
            most = np.maximum(high - center[0], center[1] - low)
        at = share * (total - 1)
        ranks = int(np.floor(at)), int(np.ceil(at))
        ordered = lambda v, rank: v[o := np.argsort(v, kind="stable")][np.searchsorted(np.cumsum(counts[o]), rank, side="right")]
        a, b = ordered(least, ranks[0]), ordered(most, ranks[1])
        if kind == "signed":
            middle = a, b
        kept = np.sort(bins[(most >= a) & (least <= b)])
        cuts = np.flatnonzero(np.diff(kept) > 1) + 1
        spans = [{"a": int(s[0]), "b": int(s[-1])} for s in np.split(kept, cuts)]
        out.append((name, ranks[0], ranks[1], at - ranks[0], int(counts[most < a].sum()), spans))
    return out


def plane_residuals_within(points: DataFrame, radius: float, by: list[str], least: int = 6) -> DataFrame:
    """``plane_residuals`` of all neighbours within the radius of each point (point_id, ``by``, x, y, z), of all pairs, which are neither shuffled nor written.

    Pairs are made three times, block by block within a task (see ``tiles.deal``): for the planes, to count residuals by fine bins, and to
    keep those of the few bins that can hold a percentile; only these are put in order. So time grows with the pairs, memory and disk don't.
    """
    points = whole(points)
    planes = planes_of_sums(radius_sums(points, radius)).where(F.col("n") >= least)
    groups = written((points.select(*by).where(" AND ".join(f"{c} IS NOT NULL" for c in by)).distinct() if by else points.sparkSession.range(1).select()).withColumn("g", F.monotonically_increasing_id()), "groups")
    fit = [F.col(n)[i].alias(f"{n[0]}{c}") for n in ("normal", "mean") for i, c in enumerate("xyz")]
    queries = points.join(groups, by) if by else points.crossJoin(groups)
    queries = written(queries.join(planes, "point_id").select(F.col("point_id").cast("long").alias("point_id"), "g", "x", "y", "z", *fit), "planes")
    limit, scale = tiles.square_limit(radius), BINS / (2 * radius)  # a neighbour and the mean lie within the radius of a point

    def residuals(batches, extra: tuple[str, ...] = ()):
        """(group, row of its first query in this tile, the tile's queries, residuals of a block of its pairs)"""
        for mine, others in tiles.tiles(batches):
            ids, g, *q = tiles.numbers(mine, "point_id", "g", "x", "y", "z", "nx", "ny", "nz", "mx", "my", "mz")
            order = np.argsort(g, kind="stable")
            mine, ids, g, q = mine.take(pa.array(order)), ids[order], g[order], [v[order] for v in q]
            firsts = np.append(np.flatnonzero(np.append(True, g[1:] != g[:-1])), len(g))
            starts = np.concatenate([np.arange(a, b, 64) for a, b in zip(firsts[:-1], firsts[1:])])
            for rows, p, inside in tiles.near_blocks(q[:3], ids, starts, others, limit):
                r = 0.0
                for x, normal, mean in zip(p, q[3:6], q[6:9]):
                    d = x - mean[rows, None]
                    d *= normal[rows, None]
                    r = r + d
                yield int(g[rows.start]), mine, rows.start, r.ravel() if inside is None else r[inside]

    def bin_of(r: np.ndarray) -> np.ndarray:
        return np.clip(r * scale + BINS, 0, 2 * BINS - 1).astype(np.int32)

    def count(batches):
        held, counts = {}, {}

        def tell(groups):
            for k in groups:
                flush(k)
                at = np.flatnonzero(counts[k])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at - BINS), pa.array(counts.pop(k)[at])], names=["g", "bin", "n"])

        def flush(k):
            values = held.pop(k, [])
            if values:
                counts[k] = counts.get(k, 0) + np.bincount(bin_of(np.concatenate(values)), minlength=2 * BINS)

        sizes = {}
        for k, _, _, r in residuals(batches):
            held.setdefault(k, []).append(r)
            sizes[k] = sizes.get(k, 0) + len(r)
            if sizes.pop(k) if sizes[k] > 1 << 18 else 0:
                flush(k)
            if len(held.keys() | counts.keys()) > 64:
                for j in list(held):
                    flush(j)
                yield from tell(list(counts))
                sizes = {}
        for j in list(held):
            flush(j)
        yield from tell(list(counts))

    def keep(batches):
        tables, held, size = {}, [], 0
        for k, mine, row, r in residuals(batches):
            if k not in tables:
                if len(tables) > 1024:
                    tables.clear()
                table = tables[k] = np.zeros(2 * BINS, bool)
                for s in mine.field("spans")[row].as_py():
                    table[s["a"] + BINS : s["b"] + BINS + 1] = True
            at = bin_of(r)
            chosen = np.flatnonzero(tables[k][at])
            if len(chosen):
                held.append((np.full(len(chosen), k), at[chosen].astype(np.int64) - BINS, r[chosen]))
                size += len(chosen)
            if size > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*held)], names=["g", "bin", "r"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*held)], names=["g", "bin", "r"])

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _bounds(pdf["bin"].to_numpy(), pdf["n"].to_numpy(), scale)
        return pd.DataFrame([(pdf["g"].iloc[0], *r) for r in rows], columns=["g", "name", "lo", "hi", "part", "below", "spans"])

    counted = written(dealt_within(queries, points, radius).mapInArrow(count, "g long, bin long, n long").groupBy("g", "bin").agg(F.sum("n").alias("n")), "bins")
    # No more than 2 * BINS rows a group.
    wanted = written(counted.groupBy("g").applyInPandas(bound, "g long, name string, lo long, hi long, part double, below long, spans array<struct<a: long, b: long>>"), "bounds")
    spans = wanted.groupBy("g").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # a few a group
    kept = written(dealt_within(queries.join(spans, "g"), points, radius).mapInArrow(keep, "g long, bin long, r double"), "residuals")

    def found(names: list[str], rows: DataFrame, value: Column) -> DataFrame:
        """g, and the values of ``names``, from the residuals kept for them."""
        own = rows.join(wanted.where(F.col("name").isin(names)), "g").where(F.exists("spans", lambda s: F.col("bin").between(s["a"], s["b"])))
        equal = own.select("g", "name", "lo", "hi", "part", "below", value.alias("v")).groupBy("g", "name", "lo", "hi", "part", "below", "v").agg(F.count(F.lit(1)).alias("n"))
        upto = equal.withColumn("upto", F.col("below") + F.sum("n").over(Window.partitionBy("g", "name").orderBy("v")))
        at = lambda rank: F.min(F.when(F.col("upto") > F.col(rank), F.col("v")))
        ends = upto.groupBy("g", "name").agg(at("lo").alias("a"), at("hi").alias("b"), F.first("part").alias("part"))
        each = lambda n: F.max(F.when(F.col("name") == n, F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part"))).alias(n)
        return ends.groupBy("g").agg(*[each(n) for n in names])

    value = F.when(F.col("name") == "_m", F.col("r")).otherwise(F.abs("r"))
    high = written(found([n for n in RESIDUALS if n != "mad"], kept, value), "percentiles")
    mad = found(["mad"], kept.join(high.select("g", "_m"), "g"), F.abs(F.col("r") - F.col("_m")))
    residual_counts = counted.groupBy("g").agg(F.sum("n").alias("residuals"))
    neighborhoods = queries.groupBy("g").agg(F.count_distinct("point_id").alias("neighborhoods"))
    out = reduce(lambda a, b: a.join(b, "g"), [neighborhoods, residual_counts, high.drop("_m"), mad])
    out = written(out.join(groups, "g").select(*by, "neighborhoods", "residuals", "median_absolute", "p90", "p95", "p99", "mad"), "residuals")
    forget(groups, queries, counted, wanted, kept, high)
    return out
