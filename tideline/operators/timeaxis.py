"""Irregular stamps to a regular grid, as DataFrame operations over (series_id, ts, value, ordinal)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.plans import ranges

# Standard sampling steps by name, in seconds; a day is 86,400 s.
STANDARD = {
    "s": 1,
    "5s": 5,
    "15s": 15,
    "30s": 30,
    "min": 60,
    "5min": 300,
    "10min": 600,
    "15min": 900,
    "30min": 1800,
    "h": 3600,
    "2h": 7200,
    "3h": 10800,
    "6h": 21600,
    "12h": 43200,
    "D": 86400,
}
# Units of other fixed steps, in seconds.
UNITS = {"us": 1e-6, "ms": 1e-3, "s": 1.0, "min": 60.0, "h": 3600.0}


def step_seconds(freq: str) -> float:
    """Seconds of a fixed step such as ``h``, ``15min`` or ``D``; calendar steps (weeks, months) are an error."""
    if freq in STANDARD:
        return float(STANDARD[freq])
    found = re.fullmatch(r"(\d*\.?\d*)(us|ms|s|min|h)", freq)
    step = float(found[1] or 1) * UNITS[found[2]] if found and found[1] != "." else 0.0
    if step <= 0:
        raise ValueError(f"{freq!r} is not a fixed step; use one of up to a day, such as 15min, h or D")
    return step


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000


def clean(df: DataFrame) -> DataFrame:
    """Drops null stamps; of equal stamps of a series the first in ``ordinal`` stays."""
    return df.where(F.col("ts").isNotNull()).groupBy("series_id", "ts").agg(F.min_by(F.struct("value"), "ordinal")["value"].alias("value"))


def gaps(df: DataFrame) -> DataFrame:
    """(series_id, ts, gap, before): positive seconds from the stamp before, over ranges of stamps."""
    stamps = df.where("ts is not null").select("series_id", "ts").distinct()
    parts = ranges.by_value(stamps, F.unix_micros(F.col("ts").cast("timestamp")))
    rows = ranges.scan(parts, "ts", previous={"before": "ts"}).where("before is not null")
    return rows.select("series_id", "ts", (seconds(F.col("ts")) - seconds(F.col("before"))).alias("gap"), "before")


def rates(df: DataFrame, rel_tol: float = 0.02) -> DataFrame:
    """(series_id, rate, n, share), commonest first by ``place``: clusters of a series' gaps.

    Gaps in ascending order join the last cluster while they lie within ``rel_tol`` of its median.
    The work is on distinct gaps with counts, aggregated before the grouped step. Where a gap exceeds
    the one before by more than ``rel_tol``, no cluster reaches across, so each such run is a group.
    """
    counted = gaps(df).groupBy("series_id", "gap").agg(F.count("*").alias("n"))
    ascending = Window.partitionBy("series_id").orderBy("gap")
    # a median is at most the gap before, so a gap beyond that by more than the tolerance starts a cluster
    apart = F.coalesce(F.col("gap") > F.lag("gap").over(ascending) * (1 + rel_tol), F.lit(True))
    runs = counted.withColumn("run", F.sum(apart.cast("long")).over(ascending))

    def cluster(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("gap")
        found = clusters(g["gap"].to_list(), g["n"].to_list(), rel_tol)
        return pd.DataFrame({"series_id": [g["series_id"].iloc[0]] * len(found), "rate": [r for r, _ in found], "n": [n for _, n in found]})

    kind = df.schema["series_id"].dataType.simpleString()
    found = runs.groupBy("series_id", "run").applyInPandas(cluster, f"series_id {kind}, rate double, n bigint")
    every = Window.partitionBy("series_id")
    return found.withColumns({"place": F.row_number().over(every.orderBy(F.desc("n"), "rate")), "share": F.col("n") / F.sum("n").over(every)})


def clusters(gaps: list[float], counts: list[int], rel_tol: float) -> list[tuple[float, int]]:
    """(median, count) of clusters of ascending distinct gaps, in one pass: a cluster's median only moves up."""
    found: list[tuple[float, int]] = []
    first = at = total = below = 0  # the cluster's first gap, that of its median, all counts, counts before the median's gap
    middle = 0.0
    for i, (gap, n) in enumerate(zip(gaps, counts, strict=True)):
        if i and abs(gap - middle) > rel_tol * middle:
            found.append((middle, total))
            first = i
        if i == first:
            at, total, below = i, 0, 0
        total += n
        while 2 * (below + counts[at]) < total:
            below += counts[at]
            at += 1
        middle = gaps[at] if 2 * (below + counts[at]) > total else (gaps[at] + gaps[at + 1]) / 2
    return [*found, (middle, total)] if gaps else []


def _refused(delta: Column, snap_tol: float) -> Column:
    """Raises for steps that no standard step can stand for; else null."""
    longest = max(STANDARD.values()) * (1 + snap_tol)
    error = lambda what: F.raise_error(F.concat(F.lit(f"a step of {what}: "), delta.cast("string"), F.lit(" s")))
    return F.when(delta <= 0, error("no length")).when(delta > longest, error("more than a day; give such data a calendar of its own"))


def _nearest(delta: Column, snap_tol: float) -> Column:
    """struct(s, name) of the nearest standard step within ``snap_tol``, else null; ties to the shorter."""
    steps = F.array(*[F.struct(F.lit(float(s)).alias("s"), F.lit(name).alias("name")) for name, s in STANDARD.items()])
    best = F.array_min(F.transform(steps, lambda x: F.struct((F.abs(delta - x["s"]) / x["s"]).alias("d"), x["s"].alias("s"), x["name"].alias("name"))))
    return F.coalesce(_refused(delta, snap_tol).cast("struct<s:double,name:string>"), F.when(best["d"] <= snap_tol, F.struct(best["s"].alias("s"), best["name"].alias("name"))))


def nearest_standard(delta: Column, snap_tol: float = 0.01) -> Column:
    """The nearest standard step's seconds if it lies within ``snap_tol`` of ``delta``, else null; ties to the shorter.

    A ``delta`` of 0 or less, or of more than a day beyond the tolerance, is an error of the query.
    """
    return _nearest(delta, snap_tol)["s"]


def standard_name(delta: Column, snap_tol: float = 0.01) -> Column:
    """The name of ``nearest_standard``, such as ``15min``, else null."""
    return _nearest(delta, snap_tol)["name"]


def derive_delta(df: DataFrame, rel_tol: float = 0.02) -> DataFrame:
    """(series_id, delta): the median of the commonest cluster of gaps; series without two stamps have no row."""
    return rates(df, rel_tol).where("place = 1").select("series_id", F.col("rate").alias("delta"))


def standard_delta(df: DataFrame, rel_tol: float = 0.02, snap_tol: float = 0.01) -> DataFrame:
    """(series_id, delta, freq): the commonest rate, snapped to a standard step (``freq`` names it) where one is near."""
    near = derive_delta(df, rel_tol).withColumn("near", _nearest(F.col("delta"), snap_tol))
    return near.select("series_id", F.coalesce("near.s", "delta").alias("delta"), F.col("near.name").alias("freq"))


def scan_rates(df: DataFrame, rel_tol: float = 0.02, min_fraction: float = 0.05) -> DataFrame:
    """(series_id, modal_seconds, rates, multiple_rates): ``rates`` hold more than ``min_fraction`` of gaps, commonest first.

    One row for every series with two distinct stamps, also where no rate is that common.
    """
    kept = F.collect_list(F.when(F.col("share") > min_fraction, F.struct("place", "rate")))
    found = rates(df, rel_tol).groupBy("series_id").agg(F.min_by("rate", "place").alias("modal_seconds"), F.array_sort(kept).alias("kept"))
    return found.select("series_id", "modal_seconds", F.transform("kept", lambda r: r["rate"]).alias("rates"), (F.size("kept") > 1).alias("multiple_rates"))


def rate_changes(df: DataFrame, rel_tol: float = 0.02, min_fraction: float = 0.05) -> DataFrame:
    """(series_id, date_before, date_after) between days whose median nearest rate differs, in series of several rates."""
    known = scan_rates(df, rel_tol, min_fraction).where("multiple_rates").select("series_id", "rates")
    near = gaps(df).join(known, "series_id")
    # of rates equally near the commoner one
    rate = F.array_min(F.transform("rates", lambda r, i: F.struct(F.abs(F.col("gap") - r).alias("d"), i.alias("i"), r.alias("r"))))["r"]
    daily = near.groupBy("series_id", F.to_date("before").alias("day")).agg(F.median(rate).alias("rate"))
    by_day = Window.partitionBy("series_id").orderBy("day")
    moved = daily.withColumns({"was": F.lag("rate").over(by_day), "date_before": F.lag("day").over(by_day)})
    return moved.where("was is not null and was != rate").select("series_id", "date_before", F.col("day").alias("date_after"))


def to_grid(df: DataFrame, step: float | DataFrame) -> DataFrame:
    """(series_id, t, ts, y): each series from midnight of its first day to the end of its last day.

    ``step`` is seconds, or a table (series_id, delta). A grid point takes the nearest sample within
    one step, ties to the later; a sample can fill two points. The last point is dropped.
    """
    return _grid(clean(df), step)


def _grid(tidy: DataFrame, step: float | DataFrame, strict: bool = False) -> DataFrame:
    """``to_grid`` of tidy stamps; where ``strict``, a series of fewer than two of them is an error.

    A merge of samples and points by ranges of points: every range begins with a marker, and each
    marker or filled point makes the points up to the next one. So points are made where they stay, and only
    samples and markers are shuffled.
    """
    day = F.date_trunc("day", F.col("ts"))
    spans = tidy.groupBy("series_id").agg(F.min(day).alias("start"), F.max(day).alias("last"), F.count("*").alias("stamps"))
    if isinstance(step, DataFrame):
        spans = spans.join(step.select("series_id", "delta"), "series_id")
    else:
        spans = spans.withColumn("delta", F.lit(float(step)))
    if strict:
        few = F.raise_error(F.concat(F.lit("fewer than two stamps in series "), F.col("series_id").cast("string")))
        spans = spans.where(F.when(F.col("stamps") < 2, few.cast("boolean")).otherwise(F.lit(True)))
    origin = seconds(F.col("start"))
    points = F.greatest(F.floor((seconds(F.col("last")) - origin + 86400) / F.col("delta")).cast("long"), F.lit(1))
    spans = spans.select("series_id", "start", "delta", origin.alias("origin"), points.alias("points"))
    at = tidy.join(spans, "series_id").withColumn("x", (seconds(F.col("ts")) - F.col("origin")) / F.col("delta"))
    low = F.floor("x")
    option = lambda t, late: F.struct(t.cast("long").alias("t"), F.abs(t - F.col("x")).alias("d"), F.lit(late).alias("left"))
    # right candidates (samples at or after the point) win ties
    spread = F.when(F.col("x") == low, F.array(option(low, 0), option(low + 1, 1), option(low - 1, 0))).otherwise(F.array(option(low, 0), option(low + 1, 1)))
    offers = at.select("series_id", "start", "delta", "points", "value", F.explode(spread).alias("o")).where("o.t >= 0 and o.t < points")
    best = offers.groupBy("series_id", F.col("o.t").alias("t")).agg(F.min_by(F.struct("value", "start", "delta", "points"), F.struct("o.d", "o.left")).alias("b"))
    filled = best.select("series_id", "t", "b.start", "b.delta", "b.points", F.lit(1).alias("own"), "b.value")
    size = ranges.RANGE_ROWS
    marks = spans.select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("points") - 1, F.lit(size).cast("long"))).alias("t"), "start", "delta", "points", F.lit(0).alias("own"), F.lit(None).cast(best.schema["b"].dataType["value"].dataType).alias("value"))
    rows = ranges.by_place(filled.unionByName(marks), size)
    inside = Window.partitionBy("series_id", "part").orderBy("t", "own")
    following = F.coalesce(F.lead("t").over(inside), F.least(F.col("part") + size, F.col("points")))
    # where a range's first point is filled, its marker makes none
    runs = rows.withColumn("end", following).where("t < end")
    each = runs.select("series_id", "start", "delta", F.col("t").alias("from"), "own", "value", F.explode(F.sequence(F.col("t"), F.col("end") - 1)).alias("t"))
    micros = (F.col("t") * F.col("delta") * 1_000_000).cast("long")
    stamp = F.timestamp_micros(F.unix_micros(F.col("start").cast("timestamp")) + micros).cast("timestamp_ntz")
    y = F.when((F.col("own") == 1) & (F.col("t") == F.col("from")) & ~F.isnan("value"), F.col("value"))
    return each.select("series_id", "t", stamp.alias("ts"), y.alias("y"))


def axis_status(df: DataFrame, snap_tol: float = 0.01, rel_tol: float = 0.02) -> DataFrame:
    """(series_id, stamps, delta, status): whether each series can be standardized, and why not.

    ``ok``, ``fewer than two stamps`` or ``a step of more than a day``; ``delta`` is the commonest gap, null without one.
    """
    counts = df.groupBy("series_id").agg(F.count_distinct("ts").alias("stamps"))
    found = counts.join(derive_delta(df, rel_tol), "series_id", "left")
    status = F.when(F.col("stamps") < 2, "fewer than two stamps").when(F.col("delta") > max(STANDARD.values()) * (1 + snap_tol), "a step of more than a day").otherwise("ok")
    return found.select("series_id", "stamps", "delta", status.alias("status"))


def standardize(df: DataFrame, freq: str | float | None = None, rel_tol: float = 0.02, snap_tol: float = 0.01, strict: bool = True) -> DataFrame:
    """``to_grid`` with the asserted step (a name such as ``15min``, or seconds), or with each series' own derived one.

    Derived steps that match no standard one are cut to whole seconds. A series with fewer than two
    distinct stamps is an error of the query, as is a derived step of more than a day; where not
    ``strict``, such series are left out instead, and ``axis_status`` names them.
    """
    stamps = clean(df)
    if freq is not None:
        step = step_seconds(freq) if isinstance(freq, str) else float(freq)
        if step <= 0:
            raise ValueError("a step must be positive")
        if strict:
            return _grid(stamps, step, True)
        enough = stamps.groupBy("series_id").agg(F.count("*").alias("n")).where("n >= 2").select("series_id", F.lit(step).alias("delta"))
        return _grid(stamps, enough)
    rates_of = df
    if not strict:
        good = axis_status(df, snap_tol, rel_tol).where("status = 'ok'").select("series_id")
        rates_of = df.join(good, "series_id", "left_semi")
    own = standard_delta(rates_of, rel_tol, snap_tol)
    own = own.withColumn("delta", F.when(F.col("freq").isNull(), F.greatest(F.floor("delta"), F.lit(1)).cast("double")).otherwise(F.col("delta")))
    if strict:  # a series without two stamps has no rate, and must still be seen
        own = stamps.select("series_id").distinct().join(own, "series_id", "left").withColumn("delta", F.coalesce("delta", F.lit(86400.0)))
    return _grid(stamps, own, strict)
