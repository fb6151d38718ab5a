"""Sections across a ridge at several levels of several surfaces of a case, and how its sides moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import forget, written
from .deformation import END_ANCHOR, MOST_MEDIAL
from .profiles import _binned, profile_acceptance
from .quantiles import exact_percentiles
from .robust import quadratic_fit, section_width

BINS, DEPTH, SIDE_DEPTH = 49, 1.5, 5.0  # millimetres below the ridge that count to its width, and to its sides
KEY = ["case_id", "level", "surface"]
#: The levels of a region besides that of the apex.
LEVELS = {"upper_dorsum": 0.18, "mid_dorsum": 0.64, "supratip": 0.88}


def section_levels(sizes: DataFrame, apexes: DataFrame) -> DataFrame:
    """case_id, level, normalized, level_mm, window_mm: three fixed levels and that of the apex. sizes: case_id, roi_end_mm; apexes: case_id, normalized."""
    each = [F.struct(F.lit(n).alias("level"), F.lit(float(s)).alias("normalized")) for n, s in LEVELS.items()]
    named = F.explode(F.array(*each, F.struct(F.lit("hump_region").alias("level"), F.col("normalized").cast("double").alias("normalized"))))
    rows = sizes.select("case_id", "roi_end_mm").join(apexes.select("case_id", "normalized"), "case_id").select("case_id", "roi_end_mm", named.alias("l"))
    return rows.select("case_id", "l.level", "l.normalized", (F.col("l.normalized") * F.col("roi_end_mm")).alias("level_mm"), F.greatest(F.lit(0.8), 0.025 * F.col("roi_end_mm")).alias("window_mm"))


def cross_sections(points: DataFrame, levels: DataFrame) -> DataFrame:
    """case_id, level, surface, bin, center, height, covered: the height across the ridge in 49 bins, its gaps bridged and smoothed.

    points: case_id, surface, longitudinal, lateral, anterior; levels: case_id, level, level_mm, window_mm, half_width_mm. A case has any number of levels and
    surfaces; each is a section of its own. From nine bins with a point a section is covered.
    """
    placed = points.join(levels.select("case_id", "level", "level_mm", "window_mm", "half_width_mm"), "case_id").where(F.abs(F.col("longitudinal") - F.col("level_mm")) <= F.col("window_mm"))
    at = F.floor((F.col("lateral") + F.col("half_width_mm")) / (2 * F.col("half_width_mm") / BINS)).cast("int")
    rows = placed.select(F.struct(*KEY).alias("section"), at.alias("bin"), F.col("anterior").alias("height")).where(F.col("bin").between(0, BINS - 1))
    found = _binned(rows, "section", BINS, 1, max(9, BINS // 5), 1.0).select("section.*", "bin", F.col("level").alias("height"), "covered")
    return found.join(levels.select("case_id", "level", "half_width_mm"), ["case_id", "level"]).select(*KEY, "bin", ((F.col("bin") + 0.5) * 2 / BINS * F.col("half_width_mm") - F.col("half_width_mm")).alias("center"), "height", "covered")


def section_report(points: DataFrame, levels: DataFrame) -> DataFrame:
    """A row a case, level and surface: what a section looks like and where its sides are.

    points: case_id, vid, surface, longitudinal, lateral, anterior in millimetres, where surface 'source' has every vertex before a change and other
    surfaces have the same vertices after it; levels: case_id, level, level_mm, window_mm, half_width_mm, core_mm, bridge_mm.

    Of the section's envelope: envelope_width (within 1.5 mm of the top), central_height, ridge_lateral (where it is highest, the first if
    several), curvature (of a parabola through its middle), prominence (the middle's height over the shoulders between core and bridge), dent (whether that
    is below -0.05), covered. Of vertices that the source has near the level, followed by identity: width (of those within 1.5 mm of the
    source's 98th percentile; the envelope's with fewer than two), left_ and right_lateral, _anterior (medians of the sides' vertices, 0 without any), _vertices, and
    left_ and right_medial: the median of how far they moved towards the middle, of those that did.
    """
    levels = written(levels, "levels")
    bins = written(cross_sections(points, levels), "sections").join(levels.select("case_id", "level", "half_width_mm", "core_mm", "bridge_mm"), ["case_id", "level"])
    half, off = F.col("half_width_mm"), F.abs("center")
    middle = bins.where(off <= F.least(F.lit(4.5), 0.35 * half))
    shoulder = (off > F.col("core_mm")) & (off <= F.col("bridge_mm"))
    looks = bins.groupBy(*KEY).agg(
        F.max(F.when(F.col("bin") == BINS // 2, F.col("height"))).alias("central_height"), F.max(F.struct("height", (-F.col("bin")).alias("first"), "center"))["center"].alias("ridge_lateral"),
        F.max(F.when(shoulder, F.col("height"))).alias("_shoulder"), F.count_if(off <= F.col("core_mm")).alias("_core"), F.every("covered").alias("covered"),
    )
    looks = looks.withColumn("prominence", F.when(F.col("_core") > 0, F.coalesce(F.col("central_height") - F.col("_shoulder"), F.lit(0.0))).otherwise(0.0)).withColumn("dent", F.col("prominence") < -0.05)
    looks = looks.join(section_width(bins, KEY, "center", "height", DEPTH).withColumnRenamed("width", "envelope_width"), KEY).join(quadratic_fit(middle, KEY, "center", "height").select(*KEY, F.col("a").alias("curvature")), KEY, "left")

    near = points.where("surface = 'source'").join(levels, "case_id").where(F.abs(F.col("longitudinal") - F.col("level_mm")) <= F.col("window_mm"))
    top = exact_percentiles(near, ["case_id", "level"], {"_top": (F.col("anterior"), 0.98)})
    inner, outer = 0.4 * F.col("bridge_mm"), F.least(1.15 * F.col("bridge_mm"), 0.8 * half)
    on_side = (F.col("anterior") >= F.col("_top") - SIDE_DEPTH) & F.abs("lateral").between(inner, outer)
    side = F.when(on_side, F.when(F.col("lateral") < 0, "left").otherwise("right"))
    followed = near.join(top, ["case_id", "level"]).select("case_id", "level", "vid", F.col("lateral").alias("_before"), (F.col("anterior") >= F.col("_top") - DEPTH).alias("_bridge"), side.alias("_side"))
    met = points.join(followed, ["case_id", "vid"])
    inwards = F.when(F.col("_before") < 0, F.col("lateral") - F.col("_before")).otherwise(F.col("_before") - F.col("lateral"))

    def of(name: str, value: Column) -> Column:
        return F.when(F.col("_side") == name, value)

    on_bridge = F.when(F.col("_bridge"), F.col("lateral"))
    counts = met.groupBy(*KEY).agg(F.when(F.count(on_bridge) >= 2, F.max(on_bridge) - F.min(on_bridge)).alias("_width"), *[F.count(of(n, F.col("vid"))).alias(f"{n}_vertices") for n in ("left", "right")])
    wanted = {f"{n}_{c}": (of(n, F.col(c)), 0.5) for n in ("left", "right") for c in ("lateral", "anterior")} | {f"{n}_medial": (of(n, F.when(inwards > 1e-6, inwards)), 0.5) for n in ("left", "right")}
    sides = exact_percentiles(met, KEY, wanted).fillna(0.0, list(wanted))
    out = looks.join(counts, KEY, "left").join(sides, KEY, "left").withColumn("width", F.coalesce("_width", "envelope_width"))
    names = ["width", "envelope_width", "central_height", "ridge_lateral", "curvature", "prominence", "dent", "covered", *[f"{n}_{c}" for n in ("left", "right") for c in ("vertices", "lateral", "anterior", "medial")]]
    result = written(out.select(*KEY, *names), "section-report")
    forget(levels)
    return result


def reduction_acceptance(profiles: DataFrame, sections: DataFrame, coverage: DataFrame) -> DataFrame:
    """Whether a reduction met its aims along the ridge and across it: a row a case with passed, profile_passed, frontal_passed and what the latter rests on.

    profiles: as ``profile_acceptance`` takes them; sections: as ``section_report`` returns them, with surfaces 'source' and 'simulated'; coverage: case_id,
    strip (only a strip in the middle moved). Sections count where the middle went back by 0.1 mm and 5 % of the reduction; there must be
    one at least, and none of them may have a dent, be wider by more than 0.05 mm or narrower by more than twice the medial limit and 0.05 mm, or have a side that
    went outwards by more than 0.02 mm. Where nothing was asked for, the case passes.
    """
    along = profile_acceptance(profiles, "case_id", END_ANCHOR).select("case_id", F.col("passed").alias("profile_passed"))
    asked = profiles.groupBy("case_id").agg(F.max("applied").alias("applied"))
    columns = ("central_height", "width", "left_lateral", "right_lateral")
    side = lambda surface, p: sections.where(F.col("surface") == surface).select("case_id", "level", *[F.col(c).alias(p + c) for c in columns], F.col("dent").alias(p + "dent"))
    both = side("source", "a_").join(side("simulated", "b_"), ["case_id", "level"]).join(asked, "case_id")
    corrected = both.where(F.col("a_central_height") - F.col("b_central_height") >= F.greatest(F.lit(0.1), 0.05 * F.col("applied")))
    narrower = F.col("a_width") - F.col("b_width")
    found = corrected.groupBy("case_id").agg(
        F.count("level").alias("corrected_sections"), F.every(~F.col("b_dent")).alias("no_central_dent"), F.every(narrower >= -0.05).alias("no_width_expansion"),
        F.every((F.col("b_left_lateral") >= F.col("a_left_lateral") - 0.02) & (F.col("b_right_lateral") <= F.col("a_right_lateral") + 0.02)).alias("sidewalls_not_outward"),
        F.every(narrower.between(0.0, 2 * MOST_MEDIAL + 0.05)).alias("mild_narrowing"),
    )
    flags = ["no_central_dent", "no_width_expansion", "sidewalls_not_outward", "mild_narrowing", "no_center_strip"]
    rows = asked.join(along, "case_id").join(found, "case_id", "left").join(coverage.select("case_id", (~F.col("strip")).alias("no_center_strip")), "case_id", "left")
    rows = rows.withColumn("corrected_sections", F.coalesce("corrected_sections", F.lit(0)))
    nothing = F.col("applied") <= 0
    for c in flags:
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit(False)) | nothing)
    frontal = F.col(flags[0])
    for c in flags[1:]:
        frontal = frontal & F.col(c)
    rows = rows.withColumn("frontal_passed", frontal)
    return rows.select("case_id", (F.col("profile_passed") & F.col("frontal_passed")).alias("passed"), "profile_passed", "frontal_passed", "corrected_sections", *flags)
