"""A capture's figures in one row, and as metrics for the gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .gates import unpivot
from .geometry import max_pairwise_angle
from .series import adjacent_motion, motion_summary

#: Which column of the validation answers which check.
METRICS = {
    "frame_count": "capture.frame_count", "duration_seconds": "capture.duration", "effective_fps": "capture.fps", "longest_side": "capture.resolution", "path_length_m": "capture.path", "trajectory_span_m": "capture.span",
    "orientation_coverage_degrees": "capture.orientation_coverage", "tracking_jump_count": "capture.tracking_jumps", "focal_length_drift_percent": "capture.focal_drift", "linear_speed_p95_m_per_s": "capture.linear_speed", "angular_speed_p95_deg_per_s": "capture.angular_speed",
}
VIDEO = {"sharpness_p10": "video.sharpness_p10", "sharpness_median": "video.sharpness_median", "dark_percent": "video.dark_pixels", "bright_percent": "video.bright_pixels", "luminance_range": "video.luminance_stability"}


def capture_validation(frames: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row a case: frame_count, width, height, longest_side, duration_seconds, effective_fps, timestamp_interval_p95_ms, path_length_m, trajectory_span_m, orientation_coverage_degrees, tracking_jump_count, linear_speed_p95_m_per_s, angular_speed_p95_deg_per_s, focal_length_drift_percent, has_depth, depth_frame_count, depth_frame_coverage, confidence_frame_count, confidence_frame_coverage.

    frames: case_id, frame_id, ts (seconds), x, y, z (metres), qx, qy, qz, qw, fx, has_depth, has_confidence (whether that frame has such a
    file); sizes: case_id, width, height. A case with fewer than two frames, or whose time doesn't rise from frame to frame, is an
    error that names it. Coverage is the widest angle between two view directions; focal drift is the range of fx over its mean.
    """
    q = V.columns("q", "xyzw")
    moved = adjacent_motion(frames, "case_id", "frame_id", "ts", V.columns(""), q)
    rows = motion_summary(moved, "case_id", "ts", V.columns(""))
    views = frames.select("case_id", "frame_id", *[v.alias("v" + c) for v, c in zip(V.view_direction(q), "xyz")])
    angles = max_pairwise_angle(views, ["case_id"], "frame_id", ("vx", "vy", "vz"))
    more = frames.groupBy("case_id").agg((F.try_divide(F.max("fx") - F.min("fx"), F.avg("fx")) * 100).alias("drift"), F.count_if("has_depth").alias("depth"), F.count_if("has_confidence").alias("confidence"))
    both = rows.join(more, "case_id").join(angles, "case_id", "left").join(sizes.select("case_id", "width", "height"), "case_id", "left")
    bad = F.when(F.col("n") < 2, "fewer than two frames: ").when(~F.col("strictly_increasing"), "time doesn't rise: ")
    n = F.when(bad.isNotNull(), F.raise_error(F.concat(bad, F.col("case_id").cast("string"))).cast("long")).otherwise(F.col("n"))
    share = lambda c: F.bround(F.col(c) / F.col("n"), 4)
    return both.select(
        "case_id", n.alias("frame_count"), "width", "height", F.greatest("width", "height").alias("longest_side"), F.bround("duration", 3).alias("duration_seconds"), F.bround("rate", 3).alias("effective_fps"), F.bround("interval_p95_ms", 3).alias("timestamp_interval_p95_ms"),
        F.bround("path_length", 3).alias("path_length_m"), F.bround("span", 3).alias("trajectory_span_m"), F.bround("max_angle", 2).alias("orientation_coverage_degrees"), F.col("jumps").alias("tracking_jump_count"), F.bround("linear_p95", 3).alias("linear_speed_p95_m_per_s"),
        F.bround("angular_p95", 2).alias("angular_speed_p95_deg_per_s"), F.bround("drift", 3).alias("focal_length_drift_percent"), (F.col("depth") > 0).alias("has_depth"), F.col("depth").alias("depth_frame_count"), share("depth").alias("depth_frame_coverage"), F.col("confidence").alias("confidence_frame_count"), share("confidence").alias("confidence_frame_coverage"),
    )


def capture_metrics(validation: DataFrame, video: DataFrame | None = None, selected: DataFrame | None = None) -> DataFrame:
    """case_id, check_id, value: what the gates of a capture's section read. video: case_id and the columns of ``VIDEO``; selected: case_id, selected_frames. A capture without depth has no value for its coverage, which warns; figures that aren't given are left out."""
    rows = unpivot(validation, ["case_id"], METRICS).unionByName(unpivot(validation.withColumn("depth", F.when(F.col("has_depth"), F.col("depth_frame_coverage"))), ["case_id"], {"depth": "capture.depth_coverage"}))
    if video is not None:
        rows = rows.unionByName(unpivot(video, ["case_id"], VIDEO))
    if selected is not None:
        rows = rows.unionByName(unpivot(selected, ["case_id"], {"selected_frames": "capture.selected_frames"}))
    return rows.where("value IS NOT NULL")
