"""Normal equations of few long series: no task holds or sorts a series' rows."""

import pytest
from pyspark.sql import functions as F

from tideline.operators import certificates
from tideline.plans import decompose as fit
from tideline.plans import specs, steps
from tideline.plans.specs import Model

SPLINE = Model((specs.exog_spline("z", knots=(1.0, 10.0, 30.0, 50.0)),))
ROBUST = Model((specs.linear_trend(), specs.exog_linear("z")), "huber", 3.0)


def rows(spark):
    base = spark.range(6000).withColumnRenamed("id", "t").withColumns({"z": F.col("t") % 50 + 1.0, "key": F.when(F.col("t") % 3 > 0, F.concat(F.lit("s"), F.col("t") % 3))})
    return base.select(F.col("key").alias("series_id"), "t", "z", (F.col("z") * 900 + F.pmod(F.hash("t"), F.lit(100))).cast("double").alias("y"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("fits", [10_000, 0])
def test_gaps_stay_small_and_unsorted(spark, monkeypatch, fits):
    monkeypatch.setattr(steps, "BROADCAST_FITS", fits)
    got = certificates.normal_gaps(rows(spark), SPLINE)
    assert "SortAggregate" not in plan_of(got)
    found = {(r.series_id, r.place): r.gap for r in got.collect()}
    assert found == {(s, i): 0 for s in (None, "s1", "s2") for i in (1, 2, 3)}


def test_slopes_are_those_of_a_broadcast(spark, monkeypatch):
    df = rows(spark)
    theta = steps.reliable(fit.gram_fit(df, Model(ROBUST.components)))
    got = {}
    for fits in (10_000, 0):
        monkeypatch.setattr(steps, "BROADCAST_FITS", fits)
        gaps = certificates.slope_gaps(df, ROBUST, theta)
        assert "SortAggregate" not in plan_of(gaps)
        got[fits] = {(r.series_id, r.place): r.gap for r in gaps.collect()}
    assert got[0] == got[10_000] and set(got[0]) == {(s, i) for s in (None, "s1", "s2") for i in (1, 2, 3)}
