"""Structured Streaming forms of operators that make sense on unbounded input. Captures are finite, so there is one: windowed maxima of a scored series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_of_windows(stream: DataFrame, time: str, score: str, row_id: str, every: str, late: str) -> DataFrame:
    """The best row of each tumbling window of a stream: window, row_id, score; ties go to the smaller id. Rows later than ``late`` are dropped."""
    best = F.max(F.struct(F.col(score).alias("score"), (-F.col(row_id)).alias("back"))).alias("best")
    return stream.withWatermark(time, late).groupBy(F.window(time, every)).agg(best).select("window", (-F.col("best.back")).alias(row_id), F.col("best.score").alias(score))
