"""The reduction of a ridge on a surface between landmarks: where it is highest, what each vertex should move, and one smooth field that does it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.scratch import forget, written
from .components import connected_components
from .geometry import anatomical_frame, basis_coordinates, pivot_landmarks
from .mesh import unique_edges
from .profiles import ridge_profile
from .quantiles import exact_percentiles
from .smoothing import smooth_offsets

BINS = 64
#: Shares of the region at which the target fades in and out and its apex is looked for, widths of the bell around the
#: apex, and the greatest movement towards the middle in millimetres.
START_FADE, END_FADE, END_ANCHOR, APEX_SEARCH = 0.16, 0.64, 0.88, (0.16, 0.62)
SIGMA_BEFORE, SIGMA_AFTER = 0.34, 0.16
MOST_REDUCTION, MOST_MEDIAL = 5.0, 0.6
#: Shares of the half width at which the cross-wise target bends, and of the region that is held.
CORE, RIM, HELD_ENDS = 0.68, 0.94, (0.04, 0.96)


def _refuse(rows: DataFrame, condition: str, what: str) -> None:
    """An error that names the first few cases for which the condition doesn't hold."""
    wrong = rows.where(f"NOT coalesce({condition}, false)").select("case_id").limit(3).collect()
    if wrong:
        raise ValueError(f"{what}: {[r.case_id for r in wrong]}")


def ridge_targets(points: DataFrame, frames: DataFrame, reduction_mm: float) -> DataFrame:
    """case_id, bin, center, normalized, source, reference, apex (whether it is the apex's bin), excess, requested: what the ridge should lose at each bin.

    The apex is the bin with the greatest height over the line between both ends (the first, if several), between 16 and 62 % of the region. It loses
    ``reduction_mm``; the loss falls off from there as a bell, wider before than after it, and fades to nothing at both ends. The line
    serves to find the apex only and limits nothing.
    """
    rows = ridge_profile(points, frames, "case_id", BINS).withColumn("normalized", (F.col("bin") + 0.5) / BINS).withColumn("excess", F.greatest(F.col("profile") - F.col("target"), F.lit(0.0)))
    rows = written(rows, "ridge")
    _refuse(rows, "covered", "too few points along the ridge")
    inside = F.when(F.col("normalized").between(*APEX_SEARCH), F.struct("excess", (-F.col("bin")).alias("first")))
    apex = rows.groupBy("case_id").agg(F.max(inside).alias("m")).select("case_id", (-F.col("m.first")).alias("apex_bin"), F.col("m.excess").alias("apex_excess"))
    if reduction_mm > 0:
        _refuse(apex, "apex_excess > 1e-6", "no height over the line between both ends")
    away = F.col("normalized") - (F.col("apex_bin") + 0.5) / BINS
    bell = F.exp(-0.5 * (away / F.when(away <= 0, SIGMA_BEFORE).otherwise(SIGMA_AFTER)) ** 2)
    fades = V.smootherstep(F.col("normalized") / START_FADE) * (1 - V.smootherstep((F.col("normalized") - END_FADE) / (END_ANCHOR - END_FADE)))
    weight = F.when(F.col("bin") == F.col("apex_bin"), 1.0).otherwise(V.clip(bell * fades, 0, 1))
    out = rows.join(apex, "case_id").select("case_id", "bin", "center", "normalized", F.col("profile").alias("source"), F.col("target").alias("reference"), (F.col("bin") == F.col("apex_bin")).alias("apex"), "excess", (weight * reduction_mm).alias("requested"))
    out = written(out, "targets")
    forget(rows)
    return out


def _between(values: str, at: Column, outside: Column | None = None) -> Column:
    """A case's array of a value a bin, on the line between bins at ``at`` (in bins, 0 at the first center); beyond the ends the end value, or ``outside``."""
    i = F.least(F.greatest(F.floor(at), F.lit(0)), F.lit(BINS - 2)).cast("int")
    share = V.clip(at - i, 0, 1)
    inner = F.get(F.col(values), i) * (1 - share) + F.get(F.col(values), i + 1) * share
    return inner if outside is None else F.when((at < 0) | (at > BINS - 1), outside).otherwise(inner)


def vertex_targets(vertices: DataFrame, frames: DataFrame, targets: DataFrame, reduction_mm: float) -> DataFrame:
    """What each vertex should move, and whether it lies in the band over which the ridge is spread: case_id, vid, x, y, z, longitudinal, lateral, anterior, radius (0 in the middle, 1 where movement ends), candidate, target0 (backwards), target1 (along the lateral axis), apex_score (null outside the band)."""
    by_bin = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("bin", c))), lambda x: x[c]).alias(f"{c}s")
    arrays = targets.groupBy("case_id").agg(by_bin("source"), by_bin("requested"), F.max(F.when(F.col("apex"), F.struct("center", "source"))).alias("top"))  # 64 bins a case
    rows = vertices.join(frames.join(arrays, "case_id"), "case_id")
    at = F.col("longitudinal") / (F.col("roi_end_mm") / BINS) - 0.5
    width = F.least(F.lit(22.0), 0.56 * F.col("alar_width_mm"), 2 * F.col("half_width_mm"))
    depth = max(8.0, reduction_mm + 4.0)
    rows = rows.withColumns({"ridge": _between("sources", at), "asked": _between("requesteds", at, F.lit(0.0)), "gap": F.lit(0.0)}).withColumn("gap", F.col("ridge") - F.col("anterior"))
    inwards = 0.8 * F.sqrt(V.clip(F.greatest(F.col("gap"), F.lit(0.0)) / depth, 0, 1))
    rows = rows.withColumn("radius", F.greatest(F.abs("lateral") / F.greatest(width, F.lit(1e-9)), inwards))
    band = (F.col("longitudinal") > 0) & (F.col("longitudinal") < F.col("roi_end_mm")) & (F.col("radius") < 1) & F.col("gap").between(-1.5, depth)
    r = F.col("radius")
    across = F.when(r <= CORE, 1 - (1 - RIM) * V.smootherstep(r / CORE)).otherwise(RIM * (1 - V.smootherstep((r - CORE) / (1 - CORE))))
    narrowing = V.smootherstep(r / 0.35) * (1 - V.smootherstep((r - 0.72) / 0.28))
    medial = min(MOST_MEDIAL, 0.1 * reduction_mm)
    share = F.col("asked") / reduction_mm if reduction_mm > 0 else F.lit(0.0)
    score = F.abs(F.col("longitudinal") - F.col("top.center")) + 2 * F.abs("lateral") + F.abs(F.col("anterior") - F.col("top.source"))
    return rows.select(
        "case_id", "vid", "x", "y", "z", "longitudinal", "lateral", "anterior", "roi_end_mm", "radius", band.alias("candidate"),
        F.when(band, F.col("asked") * across).otherwise(0.0).alias("target0"), (-F.signum("lateral") * medial * share * narrowing).alias("target1"), F.when(band, score).alias("apex_score"),
    )


def _region_roles(points: DataFrame, edges: DataFrame) -> DataFrame:
    """case_id, vid, role for the connected part of the band that holds the vertex nearest to the apex: the rim is held, a ring beside it is free, the rest is constrained."""
    name = lambda v: F.concat_ws(":", "case_id", F.col(v).cast("string"))
    inside = points.where("candidate").select("case_id", "vid")
    within = edges
    for end in "ab":
        within = within.join(inside.withColumnRenamed("vid", end), ["case_id", end], "left_semi")
    parts = connected_components(within.select(name("a").alias("a"), name("b").alias("b")))
    first = points.where("candidate").groupBy("case_id").agg(F.min(F.struct("apex_score", "vid")).alias("m")).select("case_id", F.col("m.vid").alias("vid"))
    seeds = first.select("case_id", name("vid").alias("node")).join(parts, "node").select("case_id", "component")
    _refuse(points.select("case_id").distinct().join(seeds, "case_id", "left"), "component IS NOT NULL", "the apex is on no edge of the band")
    region = points.withColumn("node", name("vid")).join(parts, "node").join(seeds.select("component"), "component", "left_semi")
    region = written(region.select("case_id", "vid", "radius", (F.col("longitudinal") / F.col("roi_end_mm")).alias("along")), "region")
    both = edges.select("case_id", F.explode(F.array(F.struct(F.col("a").alias("vid"), F.col("b").alias("other")), F.struct(F.col("b").alias("vid"), F.col("a").alias("other")))).alias("e")).select("case_id", "e.vid", "e.other")
    own = both.join(region.select("case_id", "vid"), ["case_id", "vid"], "left_semi")
    outside = own.join(region.select("case_id", F.col("vid").alias("other")), ["case_id", "other"], "left_anti").select("case_id", "vid").distinct().withColumn("crosses", F.lit(True))
    held = F.coalesce("crosses", F.lit(False)) | (F.col("along") <= HELD_ENDS[0]) | (F.col("along") >= HELD_ENDS[1]) | (F.col("radius") >= RIM)
    marked = written(region.join(outside, ["case_id", "vid"], "left").select("case_id", "vid", held.alias("held")), "held")
    beside = own.join(marked.where("held").select("case_id", F.col("vid").alias("other")), ["case_id", "other"], "left_semi").select("case_id", "vid").distinct().withColumn("beside", F.lit(True))
    return marked.join(beside, ["case_id", "vid"], "left").select("case_id", "vid", F.when(F.col("held"), "boundary").when(F.col("beside"), "free").otherwise("constraint").alias("role"))


def reduce_ridge(vertices: DataFrame, faces: DataFrame, landmarks: DataFrame, reduction_mm: float) -> tuple[DataFrame, DataFrame]:
    """(vertices after the reduction, profiles) of every case.

    vertices: case_id, vid, x, y, z in metres; faces: case_id, fid, v0, v1, v2; landmarks: case_id, landmark, x, y, z in millimetres. The first table has
    case_id, vid, x, y, z (moved), posterior_mm, lateral_mm, displacement_mm, role (null outside the region), radius, longitudinal, target0, target1 and residual
    of the solution; the second case_id, position, center, normalized, source, reference, target, final, requested, applied, apex, as
    ``profile_acceptance`` reads it.

    Vertices move backwards, and a little towards the middle, never across or away from it, by one smooth field over the connected band around the ridge. A
    reduction of 0 changes nothing at all. Errors: a reduction that isn't 0 to 5 mm, landmarks missing or too close, vertices that
    aren't finite, a ridge with too few points or without any height, an apex on no edge, too few vertices to constrain or hold.
    """
    if not 0.0 <= reduction_mm <= MOST_REDUCTION:
        raise ValueError(f"the reduction must be 0 to {MOST_REDUCTION:g} mm")
    wide = pivot_landmarks(landmarks, "case_id")
    needed = ("nasion", "pronasale", "subnasale", "left_alare", "right_alare")
    _refuse(wide, " AND ".join(f"{n} IS NOT NULL" for n in needed), f"one of the landmarks {', '.join(needed)} is missing")
    frames = written(anatomical_frame(wide, "case_id").join(wide.select("case_id", "nasion"), "case_id"), "frames")
    _refuse(frames, "usable", "landmarks are too close")
    finite = V.is_finite(F.col("x")) & V.is_finite(F.col("y")) & V.is_finite(F.col("z"))
    _refuse(vertices.where(~finite).withColumn("ok", F.lit(False)), "ok", "vertices aren't finite")

    axes = tuple(tuple(F.col(f"{a}.{c}") for c in "xyz") for a in ("vertical", "lateral", "anterior"))

    def placed(rows: DataFrame) -> DataFrame:
        millimetres = tuple(F.col(c) * 1000 for c in "xyz")
        s, side, front = basis_coordinates(millimetres, tuple(F.col(f"nasion.{c}") for c in "xyz"), axes)
        return rows.join(frames.select("case_id", "nasion", "vertical", "lateral", "anterior"), "case_id").select("case_id", "vid", "x", "y", "z", s.alias("longitudinal"), side.alias("lateral"), front.alias("anterior"))

    points = written(placed(vertices), "coordinates")
    sizes = frames.select("case_id", "roi_end_mm", "half_width_mm", "alar_width_mm")
    targets = ridge_targets(points, sizes, reduction_mm)
    wanted = written(vertex_targets(points, sizes, targets, reduction_mm), "wanted")
    if reduction_mm > 0:
        edges = written(unique_edges(faces.withColumnRenamed("case_id", "mesh")).select(F.col("mesh").alias("case_id"), "a", "b"), "edges")
        roles = written(_region_roles(wanted, edges), "roles")
        nodes = wanted.join(roles, ["case_id", "vid"]).select(F.col("case_id").alias("mesh"), "vid", "role", "target0", "target1", F.lit(float(reduction_mm)).alias("limit0"), F.lit(min(MOST_MEDIAL, 0.1 * reduction_mm)).alias("limit1"))
        solved = smooth_offsets(faces.withColumnRenamed("case_id", "mesh"), nodes).withColumnRenamed("mesh", "case_id")
        wanted = wanted.join(roles, ["case_id", "vid"], "left").join(solved, ["case_id", "vid"], "left")
    else:
        wanted = wanted.withColumns({"role": F.lit(None).cast("string"), "offset0": F.lit(0.0), "offset1": F.lit(0.0), "residual": F.lit(0.0)})
    back, side = F.coalesce("offset0", F.lit(0.0)), F.coalesce("offset1", F.lit(0.0))
    side = F.when(F.col("side") * side > 0, 0.0).otherwise(F.signum(side) * F.least(F.abs(side), 0.45 * F.abs("side")))
    moved = wanted.withColumnRenamed("lateral", "side").withColumns({"posterior_mm": back, "lateral_mm": side}).drop("anterior")
    moved = moved.join(frames.select("case_id", "lateral", "anterior"), "case_id")
    step = {c: F.when((F.col("posterior_mm") == 0) & (F.col("lateral_mm") == 0), F.col(c)).otherwise(F.col(c) - F.col("posterior_mm") * F.col(f"anterior.{c}") / 1000 + F.col("lateral_mm") * F.col(f"lateral.{c}") / 1000) for c in "xyz"}
    moved = moved.withColumns(step).withColumn("displacement_mm", F.hypot("posterior_mm", "lateral_mm"))
    moved = written(moved.select("case_id", "vid", "x", "y", "z", "posterior_mm", "lateral_mm", "displacement_mm", "role", "radius", "longitudinal", "target0", "target1", "residual"), "moved")

    after = ridge_profile(placed(moved), sizes, "case_id", BINS).select("case_id", "bin", F.col("profile").alias("final"))
    rows = targets.join(after, ["case_id", "bin"])
    profiles = rows.select("case_id", F.col("bin").alias("position"), "center", "normalized", "source", "reference", (F.col("source") - F.col("requested")).alias("target"), "final", "requested", F.lit(float(reduction_mm)).alias("applied"), "apex", "excess")
    return moved, profiles


def coverage(moved: DataFrame, profiles: DataFrame, sizes: DataFrame) -> DataFrame:
    """How the movement at the apex's level spreads over ridge, slopes and sidewalls: a row a case with each band's vertices, median and share moved over 0.1 mm, the ratios of the medians to the ridge's, and ``strip`` (only a strip in the middle moved). sizes: case_id, roi_end_mm."""
    apex = profiles.where("apex").select("case_id", "center")
    level = moved.where("role IS NOT NULL").join(apex, "case_id").join(sizes.select("case_id", "roi_end_mm"), "case_id").where(F.abs(F.col("longitudinal") - F.col("center")) <= F.greatest(F.lit(1.0), 0.035 * F.col("roi_end_mm")))
    r = F.col("radius")
    banded = level.withColumn("band", F.when(r < 0.25, "ridge").when(r < 0.6, "slopes").when(r < 0.85, "sidewalls")).where("band IS NOT NULL")
    found = banded.groupBy("case_id", "band").agg(F.count("vid").alias("vertices"), F.avg((F.col("posterior_mm") > 0.1).cast("double")).alias("moved")).join(exact_percentiles(banded, ["case_id", "band"], {"median": (F.col("posterior_mm"), 0.5)}), ["case_id", "band"])
    columns = [F.coalesce(F.max(F.when(F.col("band") == n, F.col(c))), F.lit(0)).alias(f"{n}_{c}") for n in ("ridge", "slopes", "sidewalls") for c in ("vertices", "median", "moved")]
    out = sizes.select("case_id").join(found, "case_id", "left").groupBy("case_id").agg(*columns)
    ratio = lambda n: F.when(F.col("ridge_median") > 1e-9, F.col(f"{n}_median") / F.col("ridge_median")).otherwise(0.0)
    return out.withColumns({"slopes_ratio": ratio("slopes"), "sidewalls_ratio": ratio("sidewalls")}).withColumn("strip", (F.col("slopes_ratio") < 0.75) | (F.col("sidewalls_ratio") < 0.45))
