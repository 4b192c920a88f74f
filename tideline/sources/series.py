"""Reading tables as long series, and writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def time_column(df: DataFrame, name: str | None = None) -> str:
    """The stated column, or the first whose name contains ``time`` in any case."""
    if name:
        return name
    found = next((c for c in df.columns if "time" in c.lower()), None)
    if found is None:
        raise ValueError("no column with a time; name one")
    return found


def long_series(df: DataFrame, value: str, time: str | None = None, series: Column | None = None, ordinal: str | None = None) -> DataFrame:
    """(series_id, ts, value, ordinal) from any table; NaN values become NULL, time zones are dropped."""
    if value not in df.columns:
        raise ValueError(f"no column {value!r}")
    v = F.col(value).cast("double")
    order = F.col(ordinal) if ordinal else F.monotonically_increasing_id()
    return df.select((F.lit("series") if series is None else series).alias("series_id"), F.col(time_column(df, time)).cast("timestamp_ntz").alias("ts"), F.when(~F.isnan(v), v).alias("value"), order.alias("ordinal"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)
