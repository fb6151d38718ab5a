"""Acceptance reports of cases: a fixed catalogue of checks in ten sections, and repeatability of measurements over cases of a subject."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .gates import named, rank, status


@dataclass(frozen=True)
class Check:
    """A check of the catalogue.

    kind: min, max or range (a metric against limits; null warns); fail or warn (a flag: true passes, else that); tri (true passes, false
    fails, null warns); always (warns whatever the value); gone (the only check of a section whose document is missing; it has the status
    ``absent``). ``when``: always, or present (only if the case has the metric).
    """

    section: str
    check_id: str
    label: str
    kind: str
    limits: tuple[float | None, float | None, float | None, float | None] = (None, None, None, None)
    unit: str = ""
    when: str = "always"
    absent: str = ""

    @property
    def criteria(self) -> str:
        a, b, c, d = self.limits
        if self.kind == "min":
            return f"PASS >= {a:g}; WARN >= {c:g}; FAIL < {c:g}"
        if self.kind == "max":
            return f"PASS <= {b:g}; WARN <= {d:g}; FAIL > {d:g}"
        if self.kind == "range":
            return f"PASS {a:g}-{b:g}; WARN {c:g}-{d:g}; FAIL outside WARN range"
        return {"fail": "PASS when true; else FAIL", "warn": "PASS when true; else WARN", "tri": "PASS when true; WARN when unknown; FAIL when false", "always": "WARN until approved", "gone": "PASS when present"}[self.kind]


#: Sections in the order of a report, with the document that each needs, if any.
SECTIONS = (
    ("input_capture", "Input capture", None),
    ("face_masking", "Face masking", None),
    ("sparse_reconstruction", "Sparse reconstruction", "sfm"),
    ("dense_fusion", "Raw dense stereo fusion", "mvs"),
    ("metric_scale", "Metric scale", "scale"),
    ("authoritative_mesh", "Authoritative mesh", "mesh"),
    ("landmarks", "Landmark registration", "landmarks"),
    ("registered_assets", "Registered measurement and visual assets", None),
    ("measurements", "Measurements", None),
    ("pipeline_execution", "Pipeline execution", None),
)


def _low(section: str, check_id: str, label: str, p: float, f: float, unit: str, when: str = "always") -> Check:
    return Check(section, check_id, label, "min", (float(p), None, float(f), None), unit, when)


def _high(section: str, check_id: str, label: str, p: float, f: float, unit: str, when: str = "always") -> Check:
    return Check(section, check_id, label, "max", (None, float(p), None, float(f)), unit, when)


def _band(section: str, check_id: str, label: str, a: float, b: float, x: float, y: float, unit: str) -> Check:
    return Check(section, check_id, label, "range", (float(a), float(b), float(x), float(y)), unit)


#: The checks, in order. Ids, labels and limits of the engineering profile.
CHECKS = (
    _low("input_capture", "capture.frame_count", "Synchronized frames", 750, 540, "frames"),
    _band("input_capture", "capture.duration", "Capture duration", 25, 45, 18, 60, "s"),
    _low("input_capture", "capture.fps", "Effective frame rate", 29, 24, "fps"),
    _low("input_capture", "capture.resolution", "Longest RGB dimension", 1920, 1280, "px"),
    _low("input_capture", "capture.path", "Camera path length", 1.2, 0.75, "m"),
    _low("input_capture", "capture.span", "Trajectory span", 0.4, 0.25, "m"),
    _low("input_capture", "capture.orientation_coverage", "View-direction coverage", 140, 120, "deg"),
    _high("input_capture", "capture.tracking_jumps", "Tracking jumps over 15 cm", 0, 1, "frames"),
    _high("input_capture", "capture.focal_drift", "Focal-length drift", 1, 2, "%"),
    _high("input_capture", "capture.linear_speed", "95th-percentile camera speed", 0.15, 0.30, "m/s"),
    _high("input_capture", "capture.angular_speed", "95th-percentile angular speed", 30, 60, "deg/s"),
    _low("input_capture", "video.sharpness_p10", "Evaluated-frame sharpness p10", 80, 40, "Laplacian variance"),
    _low("input_capture", "video.sharpness_median", "Evaluated-frame median sharpness", 150, 80, "Laplacian variance"),
    _high("input_capture", "video.dark_pixels", "Median clipped-black pixels", 1, 5, "%"),
    _high("input_capture", "video.bright_pixels", "Median clipped-white pixels", 1, 5, "%"),
    _high("input_capture", "video.luminance_stability", "Temporal luminance range", 40, 70, "8-bit levels"),
    _low("input_capture", "capture.selected_frames", "Selected reconstruction frames", 100, 60, "frames", "present"),
    _low("input_capture", "capture.depth_coverage", "LiDAR depth-frame coverage", 0.95, 0.80, "ratio"),
    _low("face_masking", "mask.success_ratio", "Accepted face-mask ratio", 0.95, 0.85, "ratio"),
    Check("sparse_reconstruction", "sfm.metrics", "Sparse metrics available", "gone", absent="WARN"),
    _low("sparse_reconstruction", "sfm.registered_images", "Registered images", 80, 40, "images"),
    _low("sparse_reconstruction", "sfm.registration_ratio", "Image registration ratio", 0.85, 0.60, "ratio"),
    _low("sparse_reconstruction", "sfm.sparse_points", "Sparse 3D points", 10_000, 2_000, "points"),
    Check("dense_fusion", "mvs.fusion_metrics", "Stereo-fusion diagnostics available", "gone", absent="WARN"),
    Check("dense_fusion", "mvs.fused_artifact_exists", "Direct stereo-fusion point cloud exists", "fail"),
    Check("dense_fusion", "mvs.fused_artifact_role", "Artifact is explicitly pre-Poisson stereo fusion", "fail"),
    _low("dense_fusion", "mvs.fused_point_count", "Fused dense points", 100_000, 10_000, "points"),
    _high("dense_fusion", "mvs.nonfinite_points", "Non-finite fused points", 0, 0, "points"),
    Check("dense_fusion", "mvs.fused_file_size", "Persisted file size matches diagnostics", "fail", unit="bytes"),
    Check("dense_fusion", "mvs.fused_bounding_box", "Finite fused-point bounding box", "fail"),
    Check("dense_fusion", "mvs.fused_normals", "Normals present in persisted fusion output", "warn"),
    Check("metric_scale", "scale.exists", "Scale report exists", "gone", absent="FAIL"),
    _low("metric_scale", "scale.pose_inlier_ratio", "Pose inlier ratio", 0.80, 0.60, "ratio"),
    _high("metric_scale", "scale.pose_median_residual", "Pose alignment median residual", 10, 20, "mm"),
    _high("metric_scale", "scale.pose_p95_residual", "Pose alignment p95 residual", 20, 30, "mm"),
    Check("metric_scale", "scale.lidar_verification", "Independent LiDAR scale verification", "tri"),
    Check("authoritative_mesh", "mesh.exists", "Mesh exists", "gone", absent="FAIL"),
    _high("authoritative_mesh", "mesh.nonfinite", "Non-finite vertex values", 0, 0, "values"),
    _high("authoritative_mesh", "mesh.degenerate", "Degenerate triangles", 0, 50, "triangles"),
    _low("authoritative_mesh", "mesh.largest_component", "Largest connected component", 0.999, 0.99, "ratio"),
    _high("authoritative_mesh", "mesh.component_count", "Connected components", 1, 50, "components"),
    _band("authoritative_mesh", "mesh.edge_sampling", "Median edge length", 0.2, 1.0, 0.1, 1.5, "mm"),
    Check("authoritative_mesh", "mesh.winding", "Consistent triangle winding", "fail"),
    Check("authoritative_mesh", "mesh.watertight", "Watertight surface", "warn"),
    Check("landmarks", "landmarks.quality", "Landmark quality metadata", "gone", absent="FAIL"),
    _low("landmarks", "landmarks.minimum_inlier_ratio", "Minimum multi-view inlier ratio", 0.70, 0.50, "ratio"),
    _high("landmarks", "landmarks.maximum_ray_residual", "Maximum median ray residual", 1.5, 2.0, "mm"),
    _high("landmarks", "landmarks.maximum_surface_snap", "Maximum surface-snap distance", 1.0, 2.0, "mm"),
    _low("landmarks", "landmarks.minimum_surface_hits", "Minimum visible surface intersections", 20, 10, "views", "present"),
    _high("landmarks", "landmarks.maximum_surface_dispersion_p95", "Maximum surface-consensus p95 dispersion", 2.0, 4.0, "mm", "present"),
    Check("registered_assets", "assets.geometry_identity", "Geometry identity across assets", "fail"),
    _high("registered_assets", "assets.render_deviation", "Render-to-authoritative maximum deviation", 1e-6, 1e-4, "m"),
    _low("registered_assets", "assets.texture_resolution", "Texture atlas longest dimension", 4096, 2048, "px"),
    _high("registered_assets", "assets.texture_black_faces", "Face-sampled near-black texture", 2, 8, "%"),
    _high("registered_assets", "assets.texture_white_faces", "Face-sampled near-white texture", 1, 5, "%"),
    Check("registered_assets", "assets.skin_material", "Non-metallic PBR skin material", "warn"),
    Check("measurements", "measurements.count", "Six measurements present", "fail", unit="measurements"),
    Check("measurements", "measurements.definition_validation", "Surgeon-approved measurement definitions", "always"),
    _high("pipeline_execution", "pipeline.runtime", "Total recorded stage runtime", 3600, 5400, "s"),
    Check("pipeline_execution", "pipeline.stage_completion", "Recorded stages complete", "fail"),
)


#: What a report says of a metric that is missing, and of one that was compared with its limits.
NO_METRIC, COMPARED = "Metric was not available.", "Threshold evaluated."


def case_checks(cases: DataFrame, metrics: DataFrame, documents: DataFrame, checks: tuple[Check, ...] = CHECKS) -> DataFrame:
    """Every check of every case (case_id): case_id, section, position, check_id, label, status, value, unit, criteria, message.

    ``metrics`` (case_id, check_id, value) has what is known; flags are 1 and 0, and of repeated rows the largest value counts.
    ``documents`` (case_id, document) says which documents a case has. A metric that is missing warns (a flag of kind fail fails), so no case
    passes for lack of data; a section whose document is missing has one check that says so. A metric of an unknown check is an error.
    Cases without any metric are reported too. Checks are constants, so each case is exploded by them; nothing is crossed.
    """
    needs = {s: d for s, _, d in SECTIONS}
    rows = [F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in zip(("section", "position", "check_id", "label", "kind", "pass_low", "pass_high", "warn_low", "warn_high", "unit", "criteria", "present", "absent", "document"), (c.section, i, c.check_id, c.label, c.kind, *c.limits, c.unit, c.criteria, c.when == "present", c.absent, needs[c.section]), ("string", "int", "string", "string", "string", "double", "double", "double", "double", "string", "string", "boolean", "string", "string"))]) for i, c in enumerate(checks)]
    have = documents.groupBy("case_id").agg(F.collect_set("document").alias("_have"))
    known = metrics.groupBy("case_id", "check_id").agg(F.max("value").alias("value"))
    ids = F.array(*[F.lit(c.check_id) for c in checks])
    unknown = F.raise_error(F.concat(F.lit("unknown check: "), F.coalesce("check_id", F.lit("null")))).cast("string")
    known = known.withColumn("check_id", F.when(F.coalesce(F.array_contains(ids, F.col("check_id")), F.lit(False)), F.col("check_id")).otherwise(unknown))
    every = cases.select("case_id").distinct().join(have, "case_id", "left").withColumn("_c", F.explode(F.array(*rows))).select("case_id", "_c.*", F.coalesce(F.array_contains("_have", F.col("_c.document")), F.col("_c.document").isNull()).alias("has"))
    every = every.where((F.col("kind") == "gone") != F.col("has")).join(known, ["case_id", "check_id"], "left").where(~F.col("present") | F.col("value").isNotNull())
    flag = F.col("value") != 0
    limits = status(*[F.col(c) for c in ("kind", "value", "pass_low", "pass_high", "warn_low", "warn_high")])
    verdict = (
        F.when(F.col("kind") == "gone", F.col("absent"))
        .when(F.col("kind") == "always", "WARN")
        .when(F.col("kind") == "fail", F.when(flag, "PASS").otherwise("FAIL"))
        .when(F.col("kind") == "warn", F.when(flag, "PASS").otherwise("WARN"))
        .when(F.col("kind") == "tri", F.when(flag, "PASS").when(~flag, "FAIL").otherwise("WARN"))
        .otherwise(limits)
    )
    message = F.when(F.col("kind") == "gone", "The document is missing.").when(F.col("value").isNull() & F.col("kind").isin("min", "max", "range"), NO_METRIC).otherwise(COMPARED)
    return every.select("case_id", "section", "position", "check_id", "label", verdict.alias("status"), "value", "unit", "criteria", message.alias("message"))


def case_report(checks: DataFrame) -> DataFrame:
    """A row a case: overall status, labels of failed and of warned sections in the order of the report, and all sections with their checks nested. It makes no clinical claim."""
    order = F.create_map(*[F.lit(x) for i, (s, _, _) in enumerate(SECTIONS) for x in (s, i)])
    label = F.create_map(*[F.lit(x) for s, name, _ in SECTIONS for x in (s, name)])
    nested = F.array_sort(F.collect_list(F.struct("position", "check_id", "label", "status", "value", "unit", "criteria", "message"))).alias("checks")
    section = checks.groupBy("case_id", "section").agg(F.max(rank(F.col("status"))).alias("r"), nested)
    section = section.select("case_id", "r", F.struct(order[F.col("section")].alias("position"), F.col("section").alias("id"), label[F.col("section")].alias("label"), named(F.col("r")).alias("status"), "checks").alias("s"))
    out = section.groupBy("case_id").agg(F.max("r").alias("r"), F.array_sort(F.collect_list("s")).alias("sections"))
    pick = lambda s: F.transform(F.filter("sections", lambda x: x["status"] == s), lambda x: x["label"])
    return out.select("case_id", named(F.col("r")).alias("overall_status"), pick("FAIL").alias("failed_sections"), pick("WARN").alias("warning_sections"), "sections", F.lit(False).alias("clinical_use_authorized"))


#: Largest difference between two cases of a subject that passes, and above which it fails. Fixed values.
REPEATABILITY_LIMITS = {
    "nasofrontal_angle_deg": (3.0, 5.0, "deg"),
    "nasolabial_angle_deg": (3.0, 5.0, "deg"),
    "goode_ratio": (0.03, 0.05, "ratio"),
    "nose_length_mm": (1.0, 2.0, "mm"),
    "nose_width_mm": (1.0, 2.0, "mm"),
    "midline_deviation_mm": (1.0, 2.0, "mm"),
}


def repeatability_report(rows: DataFrame) -> DataFrame:
    """From rows (subject_id, case_id, measurement, value): subject_id, measurement, cases, mean, sample_standard_deviation, coefficient_of_variation_percent, maximum_pairwise_difference, unit, status and overall_status of the subject.

    A subject with fewer than two cases, or with a case that lacks one of the six measurements, is an error. The coefficient is null where
    the mean is nearly 0. Measurements of other names are left out.
    """
    limits = F.create_map(*[x for n, (p, f, u) in REPEATABILITY_LIMITS.items() for x in (F.lit(n), F.struct(F.lit(p).alias("p"), F.lit(f).alias("f"), F.lit(u).alias("u")))])
    known = rows.where(F.col("measurement").isin(*REPEATABILITY_LIMITS) & F.col("value").isNotNull())
    each = known.groupBy("subject_id", "measurement").agg(F.count_distinct("case_id").alias("cases"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), (F.max("value") - F.min("value")).alias("d"))
    # One more row a measurement for every subject, so that a missing one shows.
    subjects = rows.groupBy("subject_id").agg(F.count_distinct("case_id").alias("all_cases")).withColumn("measurement", F.explode(F.array(*[F.lit(n) for n in REPEATABILITY_LIMITS])))
    full = subjects.join(each, ["subject_id", "measurement"], "left")
    bad = F.when(F.col("all_cases") < 2, F.concat(F.lit("fewer than two cases: "), F.col("subject_id").cast("string"))).when(F.coalesce("cases", F.lit(0)) < F.col("all_cases"), F.concat(F.lit("cases lack a measurement: "), F.col("subject_id").cast("string"), F.lit(":"), F.col("measurement")))
    full = full.withColumn("d", F.when(bad.isNotNull(), F.raise_error(bad).cast("double")).otherwise(F.col("d"))).withColumn("l", limits[F.col("measurement")])
    verdict = F.when(F.col("d") <= F.col("l.p"), 0).when(F.col("d") <= F.col("l.f"), 1).otherwise(2)
    cv = F.when(F.abs("m") > 1e-12, F.bround(F.abs(F.col("s") / F.col("m")) * 100, 3))
    full = full.withColumn("r", verdict)
    overall = named(F.max("r").over(Window.partitionBy("subject_id")))  # six rows a subject
    return full.select("subject_id", "measurement", "cases", F.bround("m", 4).alias("mean"), F.bround("s", 4).alias("sample_standard_deviation"), cv.alias("coefficient_of_variation_percent"), F.bround("d", 4).alias("maximum_pairwise_difference"), F.col("l.u").alias("unit"), named(F.col("r")).alias("status"), overall.alias("overall_status"))


def stage_runtime(stages: DataFrame) -> DataFrame:
    """From rows (case_id, stage, status, elapsed_seconds): case_id, runtime (of complete stages), incomplete (names of others, the report's own left out), complete."""
    done = F.col("status") == "complete"
    left = F.when((F.col("stage") != "quality") & ~F.coalesce(done, F.lit(False)), F.col("stage"))
    out = stages.groupBy("case_id").agg(F.bround(F.coalesce(F.sum(F.when(done, F.coalesce("elapsed_seconds", F.lit(0.0)))), F.lit(0.0)), 3).alias("runtime"), F.array_sort(F.collect_set(left)).alias("incomplete"))
    return out.withColumn("complete", F.size("incomplete") == 0)


def landmark_metrics(quality: DataFrame) -> DataFrame:
    """From rows (case_id, landmark, inliers, observations, ray_residual_mm, snap_mm): the worst of each case; a residual or distance that is missing counts as infinite."""
    lost = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("inf")))
    worst = F.max(F.struct(lost("snap_mm").alias("d"), "landmark"))
    return quality.groupBy("case_id").agg(F.count_distinct("landmark").alias("landmark_count"), F.bround(F.min(F.try_divide("inliers", "observations")), 4).alias("minimum_inlier_ratio"), F.bround(F.max(lost("ray_residual_mm")), 3).alias("maximum_median_ray_residual_mm"), F.bround(F.max(lost("snap_mm")), 3).alias("maximum_surface_snap_distance_mm"), worst["landmark"].alias("worst_surface_snap_landmark"))
