"""Replicates from sums of blocks against refits of the same draws."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions.basis import seasonal_matrix
from tideline.operators import validation
from tideline.plans import decompose, ranges, resample, specs
from tideline.plans.specs import Model

MODEL = Model((specs.linear_trend(slope_weight=0.3), specs.multiperiodic((24.0, 7.0), (2, 1), 0.05, "season", max_cross_k=1)))


def stated(rep, number, many):
    return F.pmod(rep * 7919 + number * 104729, many)


def refits(g, block, resamples):
    t, y = g.t.to_numpy(float), g.y.to_numpy(float)
    s, pen = seasonal_matrix(t, (24.0, 7.0), (2, 1), max_cross=1)
    a = np.column_stack([np.ones(len(t)), t, s])
    penalty = np.r_[0, 0.3, (0.05 * pen) ** 2]
    seen = ~np.isnan(y)
    b, m = a[seen], int(seen.sum())
    solve = lambda v: np.linalg.solve(b.T @ b / len(t) + np.diag(penalty), b.T @ v / len(t))
    theta = solve(y[seen])
    left, width, out = y[seen] - b @ theta, min(block, m), {0: theta}
    for rep in range(1, resamples + 1):
        starts = [(rep * 7919 + k * 104729) % (m - width + 1) for k in range(-(-m // width))]
        drawn = np.concatenate([left[s : s + width] for s in starts])[:m]
        out[rep] = solve(b @ theta + drawn)
    return out


def frame():
    rng = np.random.default_rng(5)
    out = []
    for key, n, gaps in (("a", 400, rng.random(400) < 0.15), ("b", 300, np.isin(np.arange(300) // 37, (2, 5))), (None, 130, np.zeros(130, bool)), ("few", 60, np.arange(60) > 12), ("none", 60, np.ones(60, bool))):
        t = np.arange(n)
        y = 2 - 0.01 * t + np.cos(2 * np.pi * t / 24) + rng.normal(size=n).cumsum() * 0.1
        out.append(pd.DataFrame({"series_id": key, "t": t, "y": np.where(gaps, np.nan, y)}))
    return pd.concat(out)


def test_equals_refits_of_the_same_draws(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 64)
    rows = frame()
    got = resample.bootstrap_thetas(spark.createDataFrame(rows), MODEL, 16, 9, start=stated).toPandas()
    assert "none" not in set(got.series_id)
    for key, g in rows[rows.series_id.fillna("null") != "none"].groupby("series_id", dropna=False):
        mine = got[got.series_id.isna() if pd.isna(key) else got.series_id == key]
        want = refits(g, 16, 9)
        assert sorted(mine.rep) == sorted(want)
        for rep, theta in zip(mine.rep, mine.theta, strict=True):
            assert np.allclose(theta, want[rep], rtol=1e-9, atol=1e-9)


def test_intervals_of_several_scalars(spark):
    rows = spark.createDataFrame(frame())
    thetas = resample.bootstrap_thetas(rows, MODEL, 16, 40, seed=3)
    assert thetas.count() == resample.bootstrap_thetas(rows, MODEL, 16, 40, seed=3).distinct().count()
    got = resample.bootstrap_intervals(thetas, MODEL, {"slope": "trend_b * 365", "swing": F.hypot("season_0", "season_1"), "bad": "CAST(NULL AS DOUBLE)"}).toPandas()
    assert set(got.scalar) == {"slope", "swing"} and (got.used == 40).all()
    assert (got.low <= got.high).all()
    one = thetas.where("series_id = 'a' and rep > 0").toPandas()
    mine = got[(got.series_id == "a") & (got.scalar == "slope")].iloc[0]
    assert np.allclose([mine.low, mine.high], np.quantile(np.stack(one.theta)[:, 1] * 365, [0.159, 0.841]))


def test_other_models_and_draws_are_errors(spark):
    rows = spark.createDataFrame(frame())
    for model in (Model((specs.exog_linear("y"),)), Model((specs.multiperiodic(24.0, 1, standing_wave=True),))):
        with pytest.raises(ValueError):
            resample.bootstrap_thetas(rows, model, 16)
    for block, many, share in ((0, 10, 68.0), (5, 0, 68.0), (5, 10, 100.0)):
        with pytest.raises(ValueError):
            validation.bootstrap(rows, MODEL, "trend_b", block, many, share)


def test_lines_of_places_beyond_ten_million(spark):
    rows = spark.range(2000).select(F.lit("a").alias("series_id"), (F.col("id") * 20_000).alias("t"), (3.0 + 0.5 * F.col("id")).alias("y"))
    theta = decompose.gram_fit(rows, Model((specs.linear_trend(),))).first().theta
    assert np.allclose(theta, [3.0, 0.5 / 20_000], rtol=1e-6)
