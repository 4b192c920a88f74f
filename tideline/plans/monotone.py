"""Isotonic least squares of series of any length, by hulls of ranges.

The best rising fit is the slope of the greatest convex minorant of the running sums, whose points are
(observed values so far, their sum); a falling fit is that of the negated values. Each part of a series pools
its own values into blocks of rising means, the edges of its hull. Of all parts' hulls a line of given
slope touches one lowest, and the touching point only moves on as the slope rises. So some edges' means,
drawn by a hash, cut the whole minorant into bands, from one touching point to the next; a band holds the
edges with means in it and the points that its lower slope touches between, and is pooled in a task of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.plans import ranges
from tideline.plans.decompose import observed
from tideline.plans.specs import Component

#: Edges of a band, on average.
BAND_ROWS = 1 << 14


def pool(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Which of the blocks (values, their sum), in order, begin a block once neighbours of falling means are pooled."""
    begin, n, s = [], [], []
    for i, (c, v) in enumerate(zip(count.tolist(), total.tolist(), strict=True)):
        begin.append(i)
        n.append(c)
        s.append(v)
        while len(n) > 1 and s[-2] * n[-1] >= s[-1] * n[-2]:
            c, v = n.pop(), s.pop()
            n[-1] += c
            s[-1] += v
            begin.pop()
    return np.array(begin, np.int64)


def _edges(df: DataFrame, sign: float, size: int | None) -> DataFrame:
    """Each part's own blocks with their first and last place, and the points (values, sum) before and after them in the series."""
    kind = df.schema["series_id"].dataType.simpleString()
    seen = ranges.by_place(df.where(observed()), size).select("series_id", "part", "t", (F.col("y") * sign).alias("v"))

    def own(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("t")
        v, t = rows["v"].to_numpy(), rows["t"].to_numpy()
        begin = pool(np.ones(len(v)), v)
        ends = np.r_[begin[1:], len(v)]
        same = {c: rows[c].take(pa.array(begin)) for c in ("series_id", "part")}
        return pa.table(same | {"first": t[begin], "last": t[ends - 1], "n": ends - begin, "s": np.add.reduceat(v, begin)})

    found = seen.groupBy("series_id", "part").applyInArrow(own, f"series_id {kind}, part bigint, first bigint, last bigint, n bigint, s double")
    return ranges.scan(found, "first", previous={"before": "last"}, totals={"i": F.col("n"), "h": F.col("s")})


def monotone_levels(df: DataFrame, increasing: bool = False, size: int | None = None, band_rows: int | None = None) -> DataFrame:
    """(series_id, place, level): the fit's levels, each for observed values from ``place`` on."""
    sign, kind = (1.0 if increasing else -1.0), df.schema["series_id"].dataType.simpleString()
    edges = _edges(df, sign, size)
    drawn = F.pmod(F.xxhash64("series_id", "first"), F.lit(band_rows or BAND_ROWS)) == 0
    slopes = edges.groupBy("series_id").agg(F.array_sort(F.collect_set(F.when(drawn, F.col("s") / F.col("n")))).alias("slopes"))
    each = edges.select("series_id", "part").distinct()
    of = slopes.select(F.col("series_id").alias("_of"), "slopes")
    parts = each.join(of, F.col("series_id").eqNullSafe(F.col("_of"))).drop("_of")

    def touch(rows: pa.Table, own: pa.Table) -> pa.Table:
        """A part's touching point of every slope, and each edge's end in the band of its mean."""
        rows = rows.sort_by("first")
        n, s, i, h, last = (rows[c].to_numpy() for c in ("n", "s", "i", "h", "last"))
        before = rows["before"][0].as_py()
        before = rows["first"][0].as_py() - 1 if before is None else before
        slope, mean = np.r_[-np.inf, np.array(own["slopes"][0].as_py(), float)], s / n
        at = np.searchsorted(mean, slope, "right")
        points = {"i": np.r_[i[0] - n[0], i], "h": np.r_[h[0] - s[0], h], "place": np.r_[before, last] + 1}
        band = np.r_[np.arange(len(slope)), np.searchsorted(slope, mean, "left") - 1]
        which = np.r_[at, np.arange(1, len(mean) + 1)]
        height = np.where(np.isfinite(slope), points["h"][at] - np.where(np.isfinite(slope), slope, 0.0) * points["i"][at], points["i"][at])
        out = {"series_id": rows["series_id"].take(pa.array(np.zeros(len(which), np.int64))), "band": pa.array(band, pa.int32())} | {c: p[which] for c, p in points.items()}
        return pa.table(out | {"height": pa.array(np.r_[height, np.zeros(len(mean))], mask=np.r_[np.zeros(len(slope), bool), np.ones(len(mean), bool)])})

    points = ranges.cogroup(edges, F.col("part"), parts, touch, f"series_id {kind}, band int, i bigint, h double, place bigint, height double")
    lowest = points.where("height is not null").groupBy("series_id", "band").agg(F.min_by("i", F.struct("height", "i")).alias("low"))
    bands = Window.partitionBy("series_id").orderBy("band")
    lowest = lowest.withColumn("low", F.max("low").over(bands)).withColumn("high", F.lead("low").over(bands)).withColumnRenamed("series_id", "_of").withColumnRenamed("band", "_band")
    inside = points.join(lowest, F.col("series_id").eqNullSafe(F.col("_of")) & (F.col("band") == F.col("_band"))).where("i >= low and (high is null or i <= high)")

    def levels(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        i, first = np.unique(rows["i"].to_numpy(), return_index=True)
        h, place = rows["h"].to_numpy()[first], rows["place"].to_numpy()[first]
        n, s = np.diff(i), np.diff(h)
        begin = pool(n, s)
        mean = np.add.reduceat(s, begin) / np.add.reduceat(n, begin) if len(begin) else s
        return pa.table({"series_id": rows["series_id"].take(pa.array(np.zeros(len(begin), np.int64))), "place": place[begin], "level": sign * mean})

    return inside.select("series_id", "band", "i", "h", "place").groupBy("series_id", "band").applyInArrow(levels, f"series_id {kind}, place bigint, level double")


def monotone_curves(df: DataFrame, component: Component, size: int | None = None, band_rows: int | None = None) -> DataFrame:
    """``df`` with the role of a ``monotone`` part alone under l2 without a penalty, residual and reconstruction; for series of any length.

    A place without an observed value takes the value of the observed one before it, or of the first.
    A series without any has nulls.
    """
    if component.kind != "monotone" or component.params["weight"] or component.lower is not None or component.upper is not None:
        raise ValueError("a monotone part without a penalty or bounds is needed")
    increasing, columns = component.params["increasing"], df.columns
    levels = monotone_levels(df, increasing, size, band_rows)
    starts = levels.select("series_id", F.col("place").alias("t"), F.col("level").alias("_level"))
    rows = df.withColumn("_row", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    rows = ranges.by_place(rows, size).withColumn("_order", F.struct("t", F.coalesce("_row", F.lit(0)).alias("row")))
    rows = ranges.scan(rows, "_order", latest={"_now": "_level"}).where("_row = 1").withColumn("_seen", F.when(observed(), F.col("_now")))
    rows = ranges.scan(rows, latest={"_role": "_seen"})
    first = levels.groupBy(F.col("series_id").alias("_of")).agg((F.min if increasing else F.max)("level").alias("_first"))
    out = rows.join(first, F.col("series_id").eqNullSafe(F.col("_of")), "left").withColumn(component.role, F.coalesce("_role", "_first"))
    left = F.when(observed(), F.col("y") - F.col(component.role)).when(F.col(component.role).isNotNull(), F.lit(0.0))
    return out.select(*columns, component.role, F.col(component.role).alias("reconstruction"), left.alias("residual"))
