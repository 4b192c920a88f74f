"""Grids, rates and validation windows on small tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import timeaxis, validation
from tideline.sources.series import long_series


def frame(spark, stamps, values=None):
    values = values or [float(i) for i in range(len(stamps))]
    return spark.createDataFrame([("s", a, v, i) for i, (a, v) in enumerate(zip(stamps, values))], "series_id string, ts timestamp_ntz, value double, ordinal bigint")


def test_missing_hours_keep_neighbours(spark):
    start = dt.datetime(2021, 3, 1)
    hours = [i for i in range(48) if not 10 <= i <= 14]
    rows = timeaxis.standardize(frame(spark, [start + dt.timedelta(hours=i) for i in hours])).orderBy("t").collect()
    assert len(rows) == 48 and [r.t for r in rows if r.y is None] == [11, 12, 13]


def test_lone_sample_fills_two_points(spark):
    rows = timeaxis.to_grid(frame(spark, [dt.datetime(2021, 3, 1, 3, 30)]), 3600).where("y is not null").orderBy("t").collect()
    assert [r.t for r in rows] == [3, 4]


def test_first_of_equal_stamps_stays(spark):
    at = dt.datetime(2021, 3, 1)
    rows = timeaxis.clean(frame(spark, [at, at], [7.0, 8.0])).collect()
    assert [r.value for r in rows] == [7.0]


def test_two_rates(spark):
    at, stamps = dt.datetime(2021, 3, 1), []
    for i in range(200):
        at += dt.timedelta(seconds=(300 + i % 3) if i < 100 else 60)
        stamps.append(at)
    (row,) = timeaxis.scan_rates(frame(spark, stamps)).collect()
    assert row.multiple_rates and len(row.rates) == 2 and row.modal_seconds == row.rates[0]
    assert timeaxis.rate_changes(frame(spark, stamps)).count() <= 1
    (row,) = timeaxis.scan_rates(frame(spark, stamps), min_fraction=0.9).collect()
    assert row.rates == [] and not row.multiple_rates


def test_one_rate(spark):
    (row,) = timeaxis.scan_rates(frame(spark, [dt.datetime(2021, 1, 1) + dt.timedelta(seconds=900 * i) for i in range(200)])).collect()
    assert row.rates == [900.0] and not row.multiple_rates


def test_changes_of_rate_are_dated(spark):
    start = dt.datetime(2021, 3, 1)
    stamps = [start + dt.timedelta(minutes=5 * i) for i in range(2 * 288)] + [start + dt.timedelta(days=2, minutes=i) for i in range(2 * 1440)]
    rows = timeaxis.rate_changes(frame(spark, stamps)).collect()
    assert [(r.date_before, r.date_after) for r in rows] == [(dt.date(2021, 3, 2), dt.date(2021, 3, 3))]


def test_standard_steps(spark):
    steps = [47.0, 59.8, 7200.0, 10800.0, 21500.0, 43200.0, 86400.0, 2.0, 120.0, 3599.0]
    got = spark.createDataFrame([(i, d) for i, d in enumerate(steps)], "i int, d double").orderBy("i")
    rows = got.select(timeaxis.nearest_standard(F.col("d")).alias("f"), timeaxis.standard_name(F.col("d")).alias("n")).collect()
    assert [r.f for r in rows] == [None, 60.0, 7200.0, 10800.0, 21600.0, 43200.0, 86400.0, None, None, 3600.0]
    assert [r.n for r in rows] == [None, "min", "2h", "3h", "6h", "12h", "D", None, None, "h"]


@pytest.mark.parametrize("bad", [0.0, -5.0, 30 * 86400.0])
def test_steps_out_of_range_are_errors(spark, bad):
    with pytest.raises(Exception, match="a step of"):
        spark.createDataFrame([(bad,)], "d double").select(timeaxis.nearest_standard(F.col("d"))).collect()


def test_names_of_steps():
    assert [timeaxis.step_seconds(f) for f in ("h", "15min", "D", "45s", "250ms", "1.5h")] == [3600, 900, 86400, 45, 0.25, 5400]
    for bad in ("MS", "W", "month", "", "0s", "2D3"):
        with pytest.raises(ValueError):
            timeaxis.step_seconds(bad)


def test_clusters_equal_a_plain_scan():
    rng = np.random.default_rng(3)
    for _ in range(50):
        gaps = np.round(rng.choice([60, 61, 61.5, 62, 300, 305, 311], 40) * (1 + rng.normal(0, 0.004, 40)), 2)
        found = []
        for g in np.sort(gaps):
            if not found or abs(g - np.median(found[-1])) > 0.02 * np.median(found[-1]):
                found.append([])
            found[-1].append(g)
        distinct, n = np.unique(gaps, return_counts=True)
        got = timeaxis.clusters(distinct.tolist(), n.tolist(), 0.02)
        assert [(round(r, 9), m) for r, m in got] == [(round(float(np.median(c)), 9), len(c)) for c in found]


def test_asserted_and_derived_steps(spark):
    start = dt.datetime(2021, 3, 1)
    df = frame(spark, [start + dt.timedelta(seconds=37 * i) for i in range(100)])
    assert timeaxis.standardize(df, "min").count() == 1440
    odd = frame(spark, [start + dt.timedelta(seconds=47 * i) for i in range(200)])
    (row,) = timeaxis.standard_delta(odd).collect()
    assert (row.delta, row.freq) == (47.0, None)
    assert timeaxis.standardize(odd).count() == 86400 // 47
    days = frame(spark, [start + dt.timedelta(days=i) for i in range(400)])
    (row,) = timeaxis.standard_delta(days).collect()
    assert (row.delta, row.freq) == (86400.0, "D")
    two = frame(spark, [start + dt.timedelta(days=2 * i) for i in range(3)])
    assert timeaxis.derive_delta(two).first().delta == 172800


def test_what_cannot_be_gridded_is_an_error(spark):
    start = dt.datetime(2021, 3, 1)
    with pytest.raises(Exception, match="more than a day"):
        timeaxis.standardize(frame(spark, [start + dt.timedelta(days=30 * i) for i in range(12)])).collect()
    with pytest.raises(Exception, match="fewer than two stamps"):
        timeaxis.standardize(frame(spark, [start, start])).collect()
    with pytest.raises(ValueError):
        timeaxis.standardize(frame(spark, [start, start]), "W")


def test_jitter(spark):
    rng = np.random.default_rng(0)
    stamps = [dt.datetime(2021, 3, 1) + dt.timedelta(hours=i, seconds=float(s)) for i, s in enumerate(rng.uniform(-20, 20, 48))]
    stamps = [s for i, s in enumerate(stamps) if i and not 10 <= i <= 14]
    rows = timeaxis.standardize(frame(spark, [*stamps, stamps[0]])).collect()
    assert len(rows) == 48 and 3 <= sum(r.y is None for r in rows) <= 6


def test_endpoints(spark):
    df = spark.createDataFrame([("s", i, None if 45 <= i < 55 else float(i)) for i in range(100)], "series_id string, t bigint, y double")
    ends = sorted(r.n for r in validation.valid_endpoints(df, 20, 10).collect())
    assert 45 in ends and ends[-1] == 100 and 50 not in ends


def test_convergence(spark):
    path = spark.createDataFrame([("s", 1, 5.0), ("s", 2, 1.1), ("s", 3, 1.0), ("r", 1, 1.0), ("r", 2, None)], "series_id string, n bigint, value double")
    got = {r.series_id: r.n for r in validation.converged_at(path, 0.2).collect()}
    assert got == {"s": 2, "r": None}


def test_long_series_names_its_time(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 1, 1), 1.0)], "Read_Time timestamp, v double")
    assert long_series(df, "v").columns == ["series_id", "ts", "value", "ordinal"]
