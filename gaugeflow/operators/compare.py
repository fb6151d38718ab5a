"""Comparing tables of measurements: outer joins that keep nulls, repeats, pairs, keys that are missing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024  # rows of a group that meet those of another block in one go
MOST_TASKS = 4096


def outer_compare(truth: DataFrame, predicted: DataFrame, keys: list[str], true_value: str, value: str) -> DataFrame:
    """Full outer join on keys, null keys alike; error and absolute_error are null where a side is. Repeated keys multiply."""
    t = truth.select(*[F.col(k).alias(f"_t{k}") for k in keys], F.col(true_value).alias("true_value"))
    p = predicted.select(*[F.col(k).alias(f"_p{k}") for k in keys], F.col(value).alias("predicted"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"_t{k}").eqNullSafe(F.col(f"_p{k}"))
    error = F.col("predicted") - F.col("true_value")
    return t.join(p, on, "full_outer").select(*[F.coalesce(f"_t{k}", f"_p{k}").alias(k) for k in keys], "true_value", "predicted", error.alias("error"), F.abs(error).alias("absolute_error"))


def repeatability(rows: DataFrame, by: list[str], value: str, per_unit: int) -> DataFrame:
    """mean, sd (n - 1), cv_percent and range of repeats; groups of one are left out.

    Values are taken as whole numbers of 1/per_unit, so sums are exact and don't depend on the order of rows; cv is null where the mean is 0.
    """
    u = F.rint(F.col(value) * per_unit).cast("long")
    s = rows.withColumn("_u", u).groupBy(*by).agg(F.count("_u").alias("n"), F.sum("_u").alias("_s"), F.sum(F.col("_u") * F.col("_u")).alias("_q"), (F.max("_u") - F.min("_u")).alias("_r")).where("n >= 2")
    mean = F.col("_s") / (F.lit(float(per_unit)) * F.col("n"))
    sd = F.sqrt((F.col("n") * F.col("_q") - F.col("_s") * F.col("_s")).cast("double") / (F.col("n") * (F.col("n") - 1)).cast("double")) / float(per_unit)
    return s.select(*by, "n", mean.alias("mean"), sd.alias("sd"), F.when(F.col("_s") != 0, F.abs(sd / mean) * 100).alias("cv_percent"), (F.col("_r") / float(per_unit)).alias("range"))


def pairs_within(rows: DataFrame, by: list[str], row_id: str, value: str) -> DataFrame:
    """Every pair of a group's rows (smaller id first) with the difference of their values. The pairs are the result, so they grow with the square of a group.

    Groups are cut into blocks of about ``BLOCK`` rows; each pair of a group's blocks is joined by itself, and there are tasks for the number of pairs, so what one task makes doesn't grow.
    """
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    tasks = math.ceil((sizes.agg(F.sum(F.col("_n").cast("double") ** 2)).first()[0] or 0) / BLOCK**2)
    a = rows.select(*by, F.col(row_id).alias("a"), F.col(value).alias("_va"))
    b = rows.select(*by, F.col(row_id).alias("b"), F.col(value).alias("_vb"))
    on = [*by]
    if tasks > 1:
        on = [*by, "_i", "_j"]
        blocks = sizes.select(*by, F.ceil(F.col("_n") / BLOCK).cast("int").alias("_n"))
        block = lambda c: F.pmod(F.xxhash64(c), F.col("_n")).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
        a = a.join(blocks, by).withColumns({"_i": block("a"), "_j": each}).repartition(min(tasks, MOST_TASKS), *on)
        b = b.join(blocks, by).withColumns({"_i": each, "_j": block("b")}).drop("_n").hint("merge")
    return a.join(b, on).where("a < b").select(*by, "a", "b", F.abs(F.col("_va") - F.col("_vb")).alias("difference"))


def missing_keys(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return required.select(*keys).distinct().join(present.select(*keys), keys, "left_anti")


def common_keys(a: DataFrame, b: DataFrame, key: str, by: list[str], least: int) -> DataFrame:
    """Keys of both sides in each group, for groups with at least ``least`` of them."""
    both = a.select(*by, key).distinct().join(b.select(*by, key).distinct(), [*by, key])
    enough = both.groupBy(*by).agg(F.count(key).alias("n")).where(F.col("n") >= least)
    return both.join(enough, by)


def conflicting_keys(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that map to more than one value: what must be empty for ``value`` to be a function of ``key``."""
    return rows.select(key, value).distinct().groupBy(key).agg(F.count(value).alias("values")).where("values > 1")
