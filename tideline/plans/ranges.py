"""Long series cut into ranges of bounded rows, and scans that pass from range to range.

A *part* is a range of a series, named by its least possible place, so that parts are in the order of
their names. Windows run inside parts. What a part's first rows need of the parts before (the last
row, totals, the last known value) is a row a part, found by a window over parts, and joined to
the part's rows. So no task holds a series, only a part, or a row for each of a series' parts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a part at most, where the rows of a series have places of their own.
RANGE_ROWS = 1 << 16


def by_place(df: DataFrame, size: int | None = None, place: str = "t") -> DataFrame:
    """``df`` with ``part``: ranges of ``size`` places. With one row a place none has more rows than that."""
    size = size or RANGE_ROWS
    return df.withColumn("part", F.col(place) - F.pmod(F.col(place), F.lit(size)))


def by_value(df: DataFrame, value: Column, size: int | None = None, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """``df`` with ``part`` over an integer ``value``: ranges of at most ``size`` rows, however unevenly they lie.

    Ranges of more rows are cut evenly between their least and largest value, again and again, until
    none is left that has more rows and different values. Each pass looks at the data once.
    """
    size, keys = size or RANGE_ROWS, list(keys)
    cut = df.withColumn("_at", value).withColumn("part", F.lit(None).cast("bigint"))
    while True:
        ends = cut.groupBy(*keys, F.col("part").alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_low"), F.max("_at").alias("_high"))
        large = ends.where((F.col("_n") > size) & (F.col("_low") < F.col("_high")))
        if large.isEmpty():
            break
        pieces = F.ceil(F.col("_n") / size)
        large = large.withColumn("_width", F.floor((F.col("_high") - F.col("_low")) / pieces) + 1)
        same = F.col("part").eqNullSafe(F.col("_part"))
        names = {k: f"_{k}_" for k in keys}
        for k, other in names.items():
            large = large.withColumnRenamed(k, other)
            same = same & F.col(k).eqNullSafe(F.col(other))
        inner = F.col("_low") + F.floor((F.col("_at") - F.col("_low")) / F.col("_width")) * F.col("_width")
        cut = cut.join(large, same, "left").withColumn("part", F.coalesce(inner, F.col("part"))).drop("_part", "_n", "_low", "_high", "_width", *names.values())
    # a series that was never cut is one part
    return cut.withColumn("part", F.coalesce("part", F.lit(-(1 << 62)))).drop("_at")


def scan(
    df: DataFrame, order: str = "t", previous: Mapping[str, str] | None = None, totals: Mapping[str, Column] | None = None,
    latest: Mapping[str, str] | None = None, keys: Sequence[str] = ("series_id",),
) -> DataFrame:
    """``df`` (with ``part``) with values that pass along a series' rows in ``order``, across its parts.

    ``previous``: a column of the row before. ``totals``: a running sum, this row included, nulls
    as 0. ``latest``: the last value that is not null, this row included.
    """
    previous, totals, latest = dict(previous or {}), dict(totals or {}), dict(latest or {})
    inside = Window.partitionBy(*keys, "part").orderBy(order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumns({f"_sum_{k}": F.coalesce(c, F.lit(0)) for k, c in totals.items()})
    known = lambda c: F.when(F.col(c).isNotNull(), F.col(order))
    ends = rows.groupBy(*keys, "part").agg(
        F.max_by(F.struct(F.lit(1).alias("_"), *[F.col(c).alias(k) for k, c in previous.items()]), order).alias("_end"),
        *[F.sum(f"_sum_{k}").alias(f"_all_{k}") for k in totals], *[F.max_by(c, known(c)).alias(f"_last_{k}") for k, c in latest.items()],
    )
    parts = Window.partitionBy(*keys).orderBy("part")
    earlier = parts.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *[F.col(k).alias(f"_{k}_") for k in keys], F.col("part").alias("_part"), F.lag("_end").over(parts).alias("_end"),
        *[F.coalesce(F.sum(f"_all_{k}").over(earlier), F.lit(0)).alias(f"_all_{k}") for k in totals], *[F.last(f"_last_{k}", ignorenulls=True).over(earlier).alias(f"_last_{k}") for k in latest],
    )
    rows = rows.withColumn("_first", F.row_number().over(inside) == 1)
    rows = rows.withColumns({f"_before_{k}": F.lag(c).over(inside) for k, c in previous.items()} | {f"_now_{k}": F.sum(f"_sum_{k}").over(so_far) for k in totals} | {f"_new_{k}": F.last(c, ignorenulls=True).over(so_far) for k, c in latest.items()})
    same = F.col("part") == F.col("_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}_"))
    both = rows.join(carried, same)
    out = {k: F.when(F.col("_first"), F.col(f"_end.{k}")).otherwise(F.col(f"_before_{k}")) for k in previous}
    out |= {k: F.col(f"_now_{k}") + F.col(f"_all_{k}") for k in totals} | {k: F.coalesce(f"_new_{k}", f"_last_{k}") for k in latest}
    return both.select(*[F.col(c) for c in df.columns if c not in out], *[c.alias(k) for k, c in out.items()])


def cogroup(rows: DataFrame, of: Column, control: DataFrame, step: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``step`` of a series' rows of one part, told by ``of``, and the ``control`` rows (series_id, part, ...) of that part.

    Both may come from one table: the second side gets names of its own on its way.
    """
    names = ["series_id", "part", *[c for c in control.columns if c not in ("series_id", "part")]]
    other = control.select(*[F.col(c).alias(f"_of_{c}") for c in names])
    return rows.groupBy("series_id", of).cogroup(other.groupBy("_of_series_id", "_of_part")).applyInArrow(lambda a, b: step(a, b.rename_columns(names)), schema)
