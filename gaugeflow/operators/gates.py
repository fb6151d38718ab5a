"""Threshold gates: metrics meet a threshold table, checks roll up to sections and reports by their worst status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATUS = ("PASS", "WARN", "FAIL")
THRESHOLD_SCHEMA = "section string, check_id string, kind string, pass_low double, pass_high double, warn_low double, warn_high double, unit string"


def thresholds(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A threshold table. kind min: pass from pass_low, warn from warn_low; max: pass to pass_high, warn to warn_high; range: both bands, ends included."""
    return spark.createDataFrame(rows, THRESHOLD_SCHEMA)


def status(kind: Column, value: Column, pass_low: Column, pass_high: Column, warn_low: Column, warn_high: Column) -> Column:
    """Null warns. NaN, which Spark holds above every number, fails a bound and warns in a range."""
    nan = F.isnan(value)
    low = F.when(nan, "FAIL").when(value >= pass_low, "PASS").when(value >= warn_low, "WARN").otherwise("FAIL")
    high = F.when(nan, "FAIL").when(value <= pass_high, "PASS").when(value <= warn_high, "WARN").otherwise("FAIL")
    band = F.when(nan, "WARN").when(value.between(pass_low, pass_high), "PASS").when((value < warn_low) | (value > warn_high), "FAIL").otherwise("WARN")
    return F.when(value.isNull(), "WARN").when(kind == "min", low).when(kind == "max", high).otherwise(band)


def tri_state(flag: Column) -> Column:
    """True passes, false fails, null warns."""
    return F.when(flag, "PASS").when(~flag, "FAIL").otherwise("WARN")


def rank(s: Column) -> Column:
    return F.when(s == "FAIL", 2).when(s == "WARN", 1).otherwise(0)


def named(r: Column) -> Column:
    return F.when(r == 2, "FAIL").when(r == 1, "WARN").otherwise("PASS")


def unpivot(metrics: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    """Wide metrics to rows (keys, check_id, value); names: column -> check_id."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("check_id"), F.col(c).cast("double").alias("value")) for c, i in names.items()]))
    return metrics.select(*keys, each.alias("m")).select(*keys, "m.check_id", "m.value")


def evaluate(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """Checks: each metric row with its section, unit and status; an unknown check_id is an error. The threshold table is a constant of the code, so it is broadcast."""
    known = limits.withColumnRenamed("check_id", "_known")
    joined = metrics.join(F.broadcast(known), F.col("check_id") == F.col("_known"), "left")
    unknown = F.raise_error(F.concat(F.lit("unknown check: "), F.coalesce("check_id", F.lit("null")))).cast("string")
    joined = joined.withColumn("section", F.when(F.col("_known").isNull(), unknown).otherwise(F.col("section"))).drop("_known")
    return joined.withColumn("status", status(*[F.col(c) for c in ("kind", "value", "pass_low", "pass_high", "warn_low", "warn_high")])).drop("kind", "pass_low", "pass_high", "warn_low", "warn_high")


def worst(checks: DataFrame, by: list[str], all_groups: DataFrame | None = None) -> DataFrame:
    """The worst status of each group; groups of ``all_groups`` without a check warn."""
    got = checks.groupBy(*by).agg(F.max(rank(F.col("status"))).alias("_r"), F.count("status").alias("checks"))
    got = all_groups.select(*by).distinct().join(got, by, "left") if all_groups is not None else got
    return got.select(*by, named(F.coalesce("_r", F.lit(1))).alias("status"), F.coalesce("checks", F.lit(0)).alias("checks"))


def report(checks: DataFrame, by: list[str]) -> DataFrame:
    """A row a case: overall status, failed and warned check ids in order, sections with their checks nested. It makes no clinical claim."""
    pick = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("check_id"))))
    section = checks.groupBy(*by, "section").agg(F.max(rank(F.col("status"))).alias("r"), F.array_sort(F.collect_list(F.struct("check_id", "value", "unit", "status"))).alias("checks"), pick("FAIL").alias("f"), pick("WARN").alias("w"))
    sections = F.array_sort(F.collect_list(F.struct("section", named(F.col("r")).alias("status"), "checks"))).alias("sections")
    out = section.groupBy(*by).agg(named(F.max("r")).alias("status"), F.array_sort(F.flatten(F.collect_list("f"))).alias("failed"), F.array_sort(F.flatten(F.collect_list("w"))).alias("warned"), sections)
    return out.withColumn("clinical_use_authorized", F.lit(False))
