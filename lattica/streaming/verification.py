"""Verification of a stream: error sums per window and variable, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(pairs: DataFrame, window: str = "12 hours", late: str = "6 hours", time: str = "t", by: tuple[str, ...] = ("variable",)) -> DataFrame:
    """(start, by, n, bias, mae, rmse) of pairs (t, a, b) per tumbling window; batch or stream. Rows later than the watermark are left out of a stream."""
    d = F.col("a") - F.col("b")
    stamped = pairs.withColumn("_t", F.col(time).cast("timestamp"))
    if pairs.isStreaming:
        stamped = stamped.withWatermark("_t", late)
    sums = stamped.groupBy(F.window("_t", window), *by).agg(F.count(d).alias("n"), F.avg(d).alias("bias"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"))
    return sums.select(F.col("window.start").cast("timestamp_ntz").alias("start"), *by, "n", "bias", "mae", "rmse")
