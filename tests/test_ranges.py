"""Scans over ranges against windows over whole series, with ranges forced small."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.operators import diagnostics, timeaxis, validation
from tideline.plans import ranges


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 7)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(0)
    rows = []
    for name, n in (("a", 100), ("b", 1), ("c", 23), (None, 15)):
        kept = np.flatnonzero(rng.random(n) < 0.8) if n > 1 else [0]
        rows += [(name, int(t), None if rng.random() < 0.2 else float(rng.integers(-9, 9))) for t in kept]
    rows += [("empty", t, None) for t in range(20)]
    return spark.createDataFrame(rows, "series_id string, t bigint, y double")


def test_scan_equals_windows(series, small):
    w = Window.partitionBy("series_id").orderBy("t")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    want = series.withColumns({"was": F.lag("y").over(w), "at": F.lag("t").over(w), "s": F.coalesce(F.sum("y").over(so_far), F.lit(0.0)), "n": F.count("y").over(so_far), "last": F.last("y", True).over(so_far)})
    got = ranges.scan(ranges.by_place(series), previous={"was": "y", "at": "t"}, totals={"s": F.col("y"), "n": F.col("y").isNotNull().cast("long")}, latest={"last": "y"})
    key = ["series_id", "t", "y", "was", "at", "s", "n", "last"]
    assert sorted(map(str, got.select(*key).collect())) == sorted(map(str, want.select(*key).collect()))


def test_values_are_cut_evenly_however_they_lie(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 10**15, 50), 10**12 + rng.integers(0, 1000, 500), np.full(30, 5), 10**6 * np.arange(40)])
    df = spark.createDataFrame(pd.DataFrame({"series_id": ["x"] * len(values), "v": values})).union(spark.createDataFrame([("y", 3)], "series_id string, v bigint"))
    rows = ranges.by_value(df, F.col("v"), 20).toPandas()
    x = rows[rows.series_id == "x"].sort_values("v", kind="stable")
    counts = x.groupby("part").v.agg(["size", "nunique"])
    assert ((counts["size"] <= 20) | (counts["nunique"] == 1)).all() and len(x) == len(values)
    assert x.part.is_monotonic_increasing and (rows[rows.series_id == "y"].part < 0).all()


def test_operators_do_not_depend_on_ranges(series, spark, monkeypatch):
    stamps = [("a", dt.datetime(2021, 1, 1) + dt.timedelta(seconds=int(s)), float(i), i) for i, s in enumerate(np.random.default_rng(2).integers(0, 3 * 86400, 60))]
    raw = spark.createDataFrame([*stamps, stamps[3]], "series_id string, ts timestamp_ntz, value double, ordinal int")
    curves = series.withColumns({"reconstruction": F.col("y") * 2, "residual": F.col("y")})
    runs = {
        "gaps": lambda: timeaxis.gaps(raw), "grid": lambda: timeaxis.standardize(raw, "h"), "lag": lambda: diagnostics.lag_correlation(series, "y"),
        "adjacent": lambda: diagnostics.lag_correlation(series, "y", True), "ends": lambda: validation.valid_endpoints(series, 10, 7), "changes": lambda: diagnostics.change_counts(series, "y", 3.0),
        "bends": lambda: diagnostics.change_counts(series, "y", 3.0, 2), "rows": lambda: diagnostics.change_rows(series, "y", 3.0), "lines": lambda: validation.expanding_lines(series, 10, 7, 1.0),
        "centre": lambda: validation.centre_block(series), "levels": lambda: diagnostics.refit_levels(curves, "y", 3.0),
    }
    rounded = lambda rows: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)
    want = {k: rounded(f().collect()) for k, f in runs.items()}
    monkeypatch.setattr(ranges, "RANGE_ROWS", 7)
    for k, f in runs.items():
        assert rounded(f().collect()) == want[k] and want[k], k


def test_grid_points(spark, small):
    start = dt.datetime(2021, 3, 1)
    at = lambda h: start + dt.timedelta(hours=h)
    rows = [("s", at(2), 1.0, 0), ("s", at(5.5), 2.0, 1), ("s", at(5.5), 3.0, 2), ("s", at(9.2), 4.0, 3), ("s", at(9.4), 5.0, 4), ("s", at(30), 6.0, 5), ("t", at(-0.1), 7.0, 6), ("t", at(23.9), 8.0, 7)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double, ordinal int")
    got = timeaxis.standardize(df, "h").orderBy("series_id", "t").toPandas()
    s = got[got.series_id == "s"].set_index("t").y
    assert len(s) == 48 and s.dropna().to_dict() == {1: 1.0, 2: 1.0, 3: 1.0, 5: 2.0, 6: 2.0, 9: 4.0, 10: 5.0, 29: 6.0, 30: 6.0, 31: 6.0}
    t = got[got.series_id == "t"].set_index("t")
    assert len(t) == 48 and t.y.dropna().to_dict() == {23: 7.0, 24: 7.0, 47: 8.0}
    assert t.ts[24] == start


def test_series_that_cannot_be_standardized_are_named(spark):
    start = dt.datetime(2021, 3, 1)
    rows = [("ok", start + dt.timedelta(hours=i), 1.0, i) for i in range(5)] + [("one", start, 1.0, 0), ("one", start, 2.0, 1)] + [("slow", start + dt.timedelta(days=9 * i), 1.0, i) for i in range(3)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double, ordinal int")
    assert {r.series_id: r.status for r in timeaxis.axis_status(df).collect()} == {"ok": "ok", "one": "fewer than two stamps", "slow": "a step of more than a day"}
    assert {r.series_id for r in timeaxis.standardize(df, strict=False).collect()} == {"ok"}
    assert {r.series_id for r in timeaxis.standardize(df, "h", strict=False).select("series_id").distinct().collect()} == {"ok", "slow"}
    with pytest.raises(Exception, match="fewer than two stamps"):
        timeaxis.standardize(df.where("series_id != 'slow'")).collect()
