"""Vectors as integers: the rows that take part, their common length, and sums by component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def integer_vectors(vectors: DataFrame, scale: int, most: int, *carried: str, vector: str = "embedding") -> DataFrame:
    """(carried, x) with ``x`` the components' ``floor(scale * c)`` of every row whose vector is whole.

    Rows whose vector is null, or holds null or non-finite components, are left out; an empty vector
    stays. A scaled component of magnitude ``most`` or more is an error of the query, as exact sums
    would not fit 64 bits.
    """
    c = F.col(vector)
    whole = c.isNotNull() & ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    large = F.concat(F.lit(f"a component times {scale} has a magnitude of {most} or more in "), F.to_json(F.struct(*carried)))

    def scaled(v: F.Column) -> F.Column:
        wide = F.floor(v.cast("double") * scale)
        return F.when(F.abs(v.cast("double") * scale) < most, wide).otherwise(F.raise_error(large).cast("bigint"))

    return vectors.where(whole).select(*carried, F.transform(c, scaled).alias("x"))


def width(rows: DataFrame) -> int:
    """The length of all ``x``, 0 where there are no rows; different lengths are an error."""
    ends = rows.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    if ends.low != ends.high:
        raise ValueError(f"vectors of {ends.low} to {ends.high} components; all must have as many")
    return ends.low or 0


def matrix(column: pa.Array | pa.ChunkedArray, size: int, kind: type = np.int64) -> np.ndarray:
    """A list column without nulls as an array of ``size`` columns."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, size)


def listed(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of an array as a list column."""
    bounds = np.arange(0, rows.size + 1, max(rows.shape[1], 1), dtype=np.int32) if rows.shape[1] else np.zeros(len(rows) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(rows.ravel()).cast(kind))


def component_sums(rows: DataFrame, size: int) -> list[int]:
    """The exact sum of each component of ``x``; each task sends ``size`` numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += matrix(batch["x"], size).sum(0)
        yield pa.RecordBatch.from_pydict({"i": np.arange(size, dtype=np.int32), "s": total})

    found = rows.select("x").mapInArrow(add, "i int, s bigint").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = [0] * size
    for row in found:
        out[row.i] = int(row.s)
    return out
