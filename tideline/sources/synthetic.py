"""A made-up hourly signal with known parts, for trials and tests."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly_signal(spark: SparkSession, series: int = 1, days: int = 90, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """(series_id, t, ts, y, z, trend, seasonal, exog, spikes): hourly series with a two-day gap.

    The trend is a valley, the seasons are a day and a week, the covariate ``z`` acts through a
    sigmoid, and five spikes stand out. y is their sum and noise, and null in the gap.
    """
    n = 24 * days
    t = F.col("t").cast("double")
    rows = spark.range(series * n).select((F.col("id") / n).cast("long").alias("series_id"), (F.col("id") % n).alias("t"))
    trend = 2 * F.pow(2 * t / n - 1, F.lit(2.0))
    seasonal = F.sin(2 * math.pi * t / 24) + 0.4 * F.cos(2 * math.pi * t / 168)
    parts = rows.withColumns({"z": F.randn(seed), "trend": trend, "seasonal": seasonal}).withColumn("exog", 1.5 / (1 + F.exp(-2 * F.col("z"))))
    parts = parts.withColumn("spikes", F.when(F.col("t") % (n // 5) == n // 10, 3.0).otherwise(0.0))
    total = F.col("trend") + F.col("seasonal") + F.col("exog") + F.col("spikes") + noise * F.randn(seed + 1)
    gap = F.col("t").between(n // 2, n // 2 + 47)
    stamp = F.timestamp_seconds(F.lit(1577836800) + 3600 * F.col("t")).cast("timestamp_ntz")
    return parts.select("series_id", "t", stamp.alias("ts"), F.when(~gap, total).alias("y"), "z", "trend", "seasonal", "exog", "spikes")
