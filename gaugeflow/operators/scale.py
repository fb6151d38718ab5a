"""Metric scale from poses and from depth: joins of observations, and the check of one against the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pose_pairs(images: DataFrame, index: DataFrame, frames: DataFrame, least: int = 30) -> DataFrame:
    """Centers of reconstructed images beside those of the frames they were taken from: image, frame_id, s*, t*, enough.

    images: image, x, y, z; index: image, frame_id; frames: frame_id, x, y, z. Images that are in no index or whose frame is unknown are left
    out; ``enough`` says whether ``least`` pairs remain, without which no scale should be fitted.
    """
    s = images.select("image", *[F.col(c).alias(f"s{c}") for c in "xyz"])
    t = frames.select("frame_id", *[F.col(c).alias(f"t{c}") for c in "xyz"])
    pairs = s.join(index.select("image", "frame_id"), "image").join(t, "frame_id")
    total = pairs.agg((F.count(F.lit(1)) >= least).alias("enough"))
    return pairs.crossJoin(F.broadcast(total)).select("image", "frame_id", *[f"{n}{c}" for n in "st" for c in "xyz"], "enough")  # one row


def depth_ratios(observations: DataFrame, index: DataFrame, depth: DataFrame, width: float, height: float, columns: int, rows: int, confidence: int = 2, near: float = 0.25, far: float = 1.5) -> DataFrame:
    """Measured over reconstructed depth for every usable observation: image, point_id, ratio.

    observations: image, point_id, z (depth in the reconstruction's unit), u, v (pixel in the frame), mask (0 to 255, or null where there
    is no mask); index: image, frame_id; depth: frame_id, px, py, depth, confidence, a row a pixel of a grid of ``columns`` x ``rows``.
    Left out are observations behind the camera, outside the frame or the mask (below 128), of low confidence, or whose measured depth is
    not between ``near`` and ``far``.
    """
    inside = observations.where((F.col("z") > 0) & (F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height) & (F.coalesce("mask", F.lit(255)) >= 128))
    pixel = lambda c, size, n: F.least(F.greatest(F.floor(F.col(c) / size * n), F.lit(0)), F.lit(n - 1)).cast("long")
    placed = inside.select("image", "point_id", "z", pixel("u", width, columns).alias("px"), pixel("v", height, rows).alias("py"))
    good = depth.where((F.col("confidence") >= confidence) & F.col("depth").between(near, far)).select("frame_id", F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py"), "depth")
    # Pixels are by far the most rows, however small the table they were made of, so they aren't broadcast; nor is the index, which grows with the images.
    return placed.join(index.select("image", "frame_id").hint("merge"), "image").join(good.hint("merge"), ["frame_id", "px", "py"]).select("image", "point_id", (F.col("depth") / F.col("z")).alias("ratio"))


def combined_scale(pose: DataFrame, depth: DataFrame, by: str, most: float = 2.0) -> DataFrame:
    """by, pose_scale, depth_scale, scale_disagreement_percent, scale_verified, scale_mm_per_unit: the poses' scale, checked by that from depth.

    Verified if they differ by ``most`` percent at most; null where a case has no scale from depth.
    """
    both = pose.select(by, "pose_scale").join(depth.select(by, "depth_scale"), by, "left")
    off = F.abs(F.col("depth_scale") - F.col("pose_scale")) / F.col("pose_scale") * 100
    return both.select(by, "pose_scale", "depth_scale", F.bround(off, 3).alias("scale_disagreement_percent"), (off <= most).alias("scale_verified"), (F.col("pose_scale") * 1000).alias("scale_mm_per_unit"))


def measured_intrinsics(cameras: DataFrame, images: DataFrame, measured: DataFrame) -> DataFrame:
    """Each camera's measured parameters: camera_id, name and the columns of ``measured`` (by name). A camera of several images, which one row can't describe, is an error, and so is one without measured parameters."""
    counts = images.groupBy("camera_id").agg(F.count(F.lit(1)).alias("_n"), F.min("name").alias("name"))
    joined = cameras.select("camera_id").join(counts, "camera_id").join(measured.withColumn("_known", F.lit(True)), "name", "left")
    bad = F.when(F.col("_n") > 1, F.concat(F.lit("several images share camera "), F.col("camera_id").cast("string"))).when(F.col("_known").isNull(), F.concat(F.lit("no measured parameters for "), F.col("name")))
    checked = F.when(bad.isNotNull(), F.raise_error(bad).cast("string")).otherwise(F.col("name"))
    return joined.select("camera_id", checked.alias("name"), *[c for c in measured.columns if c != "name"])


def one_identity(rows: DataFrame, by: str, part: str, identity: str, parts: tuple[str, ...]) -> DataFrame:
    """by, matches: whether each of ``parts`` has an identity and all are the same one."""
    known = rows.where(F.col(part).isin(*parts) & F.col(identity).isNotNull())
    seen = known.groupBy(by).agg(F.count_distinct(part).alias("_p"), F.count_distinct(identity).alias("_i"))
    return rows.select(by).distinct().join(seen, by, "left").select(by, F.coalesce((F.col("_p") == len(parts)) & (F.col("_i") == 1), F.lit(False)).alias("matches"))
