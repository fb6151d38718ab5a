"""Capture files: odometry, camera matrices, landmark and measurement documents; and report sinks."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ODOMETRY = ("timestamp", "frame", "x", "y", "z", "qx", "qy", "qz", "qw", "fx", "fy", "cx", "cy")


def _number(c: str) -> Column:
    """A trimmed field as a number; blank is null (a plain cast of a blank is an error)."""
    return F.nullif(F.trim(F.col(c)), F.lit("")).cast("double")


def read_odometry(spark: SparkSession, path: str, matrix: list[float]) -> DataFrame:
    """Frames of a case from CSV with a header, which may carry spaces; blank or absent intrinsics come from the 3x3 matrix (row by row)."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    if lost := [c for c in ODOMETRY[:9] if c not in raw.columns]:
        raise ValueError(f"columns missing: {', '.join(sorted(lost))}")
    fallback = {"fx": matrix[0], "fy": matrix[4], "cx": matrix[2], "cy": matrix[5]}
    optional = [F.coalesce(_number(c), F.lit(float(v))).alias(c) if c in raw.columns else F.lit(float(v)).alias(c) for c, v in fallback.items()]
    return raw.select(F.trim("frame").cast("long").alias("frame_id"), _number("timestamp").alias("ts"), *[_number(c).alias(c) for c in ODOMETRY[2:9]], *optional)


def checked_frames(frames: DataFrame, case: str | None = None) -> DataFrame:
    """``frames`` (frame_id, ts and poses, of one case or by ``case``) if they can be used, else an error: ids 0 to n - 1 each once, two frames at least, times that grow with the ids.

    Ids are checked by counts and bounds, times by the gap to the frame before, which joins on the id; nothing is sorted.
    """
    by = [case] if case else []
    before = frames.select(*by, (F.col("frame_id") + 1).alias("frame_id"), F.col("ts").alias("_before"))
    gaps = frames.join(before, [*by, "frame_id"], "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct("frame_id").alias("_d"), F.min("frame_id").alias("_a"), F.max("frame_id").alias("_b"), F.coalesce(F.min(F.col("ts") - F.col("_before")), F.lit(1.0)).alias("_gap")
    )
    bad = F.when(F.col("_n") < 2, "fewer than two frames").when((F.col("_a") != 0) | (F.col("_b") != F.col("_n") - 1) | (F.col("_d") != F.col("_n")), "frame ids are not 0 to n - 1").when(F.col("_gap") <= 0, "timestamps do not grow")
    verdict = gaps.select(*by, F.when(bad.isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(F.lit(True)).alias("_ok"))
    joined = frames.join(verdict, by) if by else frames.crossJoin(F.broadcast(verdict))  # one row
    return joined.where("_ok").drop("_ok")


def read_matrix(spark: SparkSession, path: str) -> list[float]:
    """The nine numbers of a 3x3 CSV, row by row; other shapes are an error."""
    rows = [[float(x) for x in r.value.split(",")] for r in spark.read.text(path).where("trim(value) <> ''").limit(4).collect()]
    if [len(r) for r in rows] != [3, 3, 3]:
        raise ValueError(f"not a 3x3 matrix: {path}")
    return [x for r in rows for x in r]


def production_settings(documents: DataFrame) -> DataFrame:
    """From rows (case_id, document, value) with JSON values: case_id, scale_mm_per_unit (an error if absent) and poisson_depth (9 if absent)."""
    pick = lambda name, path: F.max(F.when(F.col("document") == name, F.get_json_object("value", path)))
    out = documents.groupBy("case_id").agg(pick("scale", "$.scale_mm_per_unit").cast("double").alias("s"), pick("case", "$.stages.mvs.parameters.poisson_depth").cast("int").alias("d"))
    lost = F.raise_error(F.concat(F.lit("no scale for case "), F.col("case_id").cast("string"))).cast("double")
    return out.select("case_id", F.when(F.col("s").isNull(), lost).otherwise(F.col("s")).alias("scale_mm_per_unit"), F.coalesce("d", F.lit(9)).alias("poisson_depth"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def read_landmarks(spark: SparkSession, path: str) -> DataFrame:
    """path, landmark, x, y, z from JSON documents {"landmarks": {name: [x, y, z]}}; a document without the key is the map itself."""
    return _map_rows(spark, path, "landmarks", "map<string, array<double>>").selectExpr("path", "key AS landmark", "value[0] AS x", "value[1] AS y", "value[2] AS z")


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """path, measurement, value from JSON documents {"measurements": {name: number}}, or the map itself."""
    return _map_rows(spark, path, "measurements", "map<string, double>").selectExpr("path", "key AS measurement", "value")


def _map_rows(spark: SparkSession, path: str, key: str, kind: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    inner = F.coalesce(F.get_json_object("value", f"$.{key}"), F.col("value"))
    return whole.select("path", F.explode(F.from_json(inner, kind)))


def read_comparison(spark: SparkSession, path: str) -> DataFrame:
    """case_id, measurement, true_value (blank: null)."""
    return spark.read.option("header", True).schema("case_id string, measurement string, true_value double").csv(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def render_html(rows: list[dict], title: str) -> str:
    """A table of checks, escaped, for one case's report."""
    cells = "".join(f"<tr class='{html.escape(str(r['status']))}'>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
    head = "".join(f"<th>{html.escape(c)}</th>" for c in (rows[0] if rows else {}))
    return f"<!doctype html><title>{html.escape(title)}</title><table><tr>{head}</tr>{cells}</table>"
