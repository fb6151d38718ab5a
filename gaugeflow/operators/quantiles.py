"""Exact percentiles of groups of any size, without gathering or sorting a group."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000  # of the sketch: a rank is off by a share 1 / ACCURACY at most
MARGIN = 3 / ACCURACY
SMALL = 20_000  # up to so many values a group is looked at whole


def exact_percentiles(rows: DataFrame, by: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """A row a group: ``by`` and a column for each of ``wanted``, its value (nulls left out; null if there are none) at a share 0..1 of the way from the least to the most, linear between neighbours.

    Groups up to ``SMALL`` rows, which a count tells first, are looked at whole. For the larger ones, of which there are no more than a ``SMALL``-th of the rows, a sketch with partial results in
    each task bounds where the ranks can be; the bounds are broadcast. A second pass counts the values below the bounds, again
    with partial results, and keeps the few between them, equal ones as one with their number; only those are put in order. So a
    group of any size, or a value that a third of all rows have, is spread over all tasks, and rows aren't shuffled.
    The passes read ``rows`` anew each, so what is dear to make is to be written first.
    """
    names = list(wanted)
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    small = lambda r: r.groupBy(*by).agg(*[F.percentile(wanted[n][0].cast("double"), F.lit(float(wanted[n][1]))).alias(n) for n in names])
    if by:
        found = counts.agg(F.max("_rows"), F.min("_rows")).first()
        if (found[0] or 0) <= SMALL:
            return small(rows)
        if found[1] <= SMALL:
            large = F.broadcast(counts.where(F.col("_rows") > SMALL).select(*[F.col(c).alias(f"_l_{c}") for c in by]))
            on = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_l_{c}")) for c in by))
            return small(rows.join(large, on, "left_anti")).unionByName(_large_groups(rows.join(large, on, "left_semi"), by, wanted))
    return _large_groups(rows, by, wanted)


def _large_groups(rows: DataFrame, by: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """``exact_percentiles`` of few groups, by two passes."""
    names = list(wanted)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), wanted[n][0].cast("double").alias("v")) for i, n in enumerate(names)])).alias("_e")
    long = rows.select(*by, each).select(*by, F.col("_e.k").alias("_k"), F.col("_e.v").alias("_v"))
    shares = [wanted[n][1] for n in names]
    ends = [s for q in shares for s in (max(0.0, q - MARGIN), min(1.0, q + MARGIN))]
    keys = [*by, "_k"]
    sketch = long.groupBy(*keys).agg(F.count("_v").alias("_n"), F.percentile_approx("_v", ends, ACCURACY).alias("_s"))
    share = F.element_at(F.array(*[F.lit(float(q)) for q in shares]), F.col("_k") + 1)
    at = share * (F.col("_n") - 1)
    few = F.col("_n") <= SMALL
    bounds = sketch.select(
        *[F.col(c).alias(f"_b_{c}") for c in by], F.col("_k").alias("_bk"), F.floor(at).alias("_lo"), F.ceil(at).alias("_hi"), (at - F.floor(at)).alias("_part"),
        F.when(few, -math.inf).otherwise(F.element_at("_s", 2 * F.col("_k") + 1)).alias("_a"), F.when(few, math.inf).otherwise(F.element_at("_s", 2 * F.col("_k") + 2)).alias("_b"),
    )
    on = F.col("_k") == F.col("_bk")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    near = long.join(F.broadcast(bounds), on).where(F.col("_v").isNull() | (F.col("_v") <= F.col("_b")))
    counted = near.groupBy(*keys, "_lo", "_hi", "_part", F.when(F.col("_v") >= F.col("_a"), F.col("_v")).alias("_v")).agg(F.count(near["_v"]).alias("_c"))
    upto = counted.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())))
    first = lambda rank: F.min(F.when(F.col("_upto") > F.col(rank), F.col("_v")))
    found = upto.groupBy(*keys).agg(first("_lo").alias("_x"), first("_hi").alias("_y"), F.any_value("_part").alias("_part"))
    value = F.col("_x") * (1 - F.col("_part")) + F.col("_y") * F.col("_part")
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_k") == i, value)).alias(n) for i, n in enumerate(names)])
