"""Recovery of known parts from synthetic signals, and properties of the solutions."""

import numpy as np
import pandas as pd
import pytest

from tideline.functions.basis import period_samples, seasonal_matrix
from tideline.plans import decompose as fit
from tideline.plans import specs
from tideline.plans.solver import residual_loss, solve
from tideline.plans.specs import Model


def rmse(a, b):
    return float(np.sqrt(np.mean((a - b) ** 2)))


def test_trend_through_a_gap():
    rng = np.random.default_rng(0)
    t = np.arange(600)
    truth, season = 0.002 * t, 0.5 * np.sin(2 * np.pi * t / 50)
    y = truth + season + rng.normal(0, 0.05, 600)
    y[200:230] = np.nan
    got = solve(y, Model((specs.smooth_trend(100.0), specs.multiperiodic(50.0, 3, 0.01))))
    shift = (got["values"]["trend"] - truth).mean()
    assert rmse(got["values"]["trend"] - shift, truth) < 0.05
    assert np.linalg.norm(got["residual"][200:230]) < 1e-8


def test_four_parts():
    rng = np.random.default_rng(2)
    t = np.arange(500)
    trend, season = 1 + 0.003 * t, 0.6 * np.sin(2 * np.pi * t / 50)
    events = np.zeros(500)
    at = rng.choice(np.r_[0:150, 180:500], 6, replace=False)
    events[at] = rng.uniform(1.5, 2.5, 6) * rng.choice([-1, 1], 6)
    y = trend + season + events + rng.normal(0, 0.05, 500)
    y[150:180] = np.nan
    got = solve(y, Model((specs.smooth_trend(100.0), specs.multiperiodic(50.0, 3, 0.01), specs.sparse(0.6))))
    assert rmse(got["values"]["trend"], trend) < 0.1 and rmse(got["values"]["periodic"], season) < 0.1
    assert (np.abs(got["values"]["sparse"][at]) > 0.5).sum() >= 5


def test_line():
    rng = np.random.default_rng(3)
    got = solve(2 + 0.01 * np.arange(300) + rng.normal(0, 0.02, 300), Model((specs.linear_trend(),)))
    assert abs(got["scalars"]["trend_b"] - 0.01) < 0.005 and abs(got["scalars"]["trend_a"] - 2) < 0.05


def test_steps():
    rng = np.random.default_rng(11)
    truth = np.repeat([1.0, -0.5, 0.3], [70, 70, 60])
    got = solve(truth + rng.normal(0, 0.05, 200), Model((specs.pwc_trend(1.0),)))["values"]["trend"]
    assert np.corrcoef(got, truth)[0, 1] > 0.99
    assert 2 <= (np.abs(np.diff(got)) > 1e-3).sum() <= 12


def test_kink():
    t = np.arange(300)
    truth = np.where(t < 150, 0.01 * t, 1.5 - 0.02 * (t - 150))
    got = solve(truth + np.random.default_rng(5).normal(0, 0.05, 300), Model((specs.pwl_trend(5.0),)))["values"]["trend"]
    assert rmse(got, truth) < 0.06


def test_bounds():
    y = 5 + np.random.default_rng(5).normal(0, 1, 200)
    got = solve(y, Model((specs.bounded(specs.smooth_trend(1.0), 0.0, 3.0),)))["values"]["trend"]
    assert got.max() <= 3 + 1e-6 and got.min() >= -1e-6


def test_two_periods():
    rng = np.random.default_rng(1)
    t = np.arange(730)
    truth = np.sin(2 * np.pi * t / 365.2425) + 0.3 * np.cos(2 * np.pi * t / 7)
    y = truth + rng.normal(0, 0.05, 730)
    y[100:140] = np.nan
    got = solve(y, Model((specs.multiperiodic((365.2425, 7.0), 2, 0.01),)))["values"]["periodic"]
    assert rmse(got, truth) < 0.05


def test_coefficients_of_two_periods():
    columns, penalty = seasonal_matrix(np.arange(30.0), (365.2425, 7.0), 6)
    assert columns.shape[1] == len(penalty) == 168
    assert period_samples(86400, 3600) == 24
    with pytest.raises(ValueError):
        period_samples(1, 0)


def test_covariates():
    rng = np.random.default_rng(0)
    z = rng.normal(size=400)
    got = solve(1.7 * z + rng.normal(0, 0.02, 400), Model((specs.exog_linear("z"),)), {"z": z})
    assert abs(got["scalars"]["exog_beta"] - 1.7) < 0.05
    z = np.sort(rng.uniform(-3, 3, 600))
    truth = np.sin(z) + 0.3 * z
    got = solve(truth + rng.normal(0, 0.03, 600), Model((specs.exog_spline("z", 16, weight=1e-5), specs.linear_trend())), {"z": z})
    assert rmse(got["values"]["exog"] + got["values"]["trend"], truth) < 0.07


@pytest.mark.parametrize("loss,param", [("l1", 1.0), ("huber", 0.5), ("quantile", 0.8)])
def test_losses_are_minimal(loss, param):
    rng = np.random.default_rng(4)
    t = np.arange(120.0)
    y = 1 + 0.02 * t + rng.standard_t(2, 120) * 0.2
    got = solve(y, Model((specs.linear_trend(),), loss, param))
    best = residual_loss(got["residual"], loss, param, 120)
    a, b = got["scalars"]["trend_a"], got["scalars"]["trend_b"]
    for da in (-0.01, 0, 0.01):
        for db in (-2e-4, 0, 2e-4):
            assert residual_loss(y - (a + da) - (b + db) * t, loss, param, 120) >= best - 1e-5


def test_sparse_equals_huber():
    y = np.random.default_rng(9).standard_t(2, 150)
    one = solve(y, Model((specs.smooth_trend(5.0), specs.sparse(1.0))))
    two = solve(y, Model((specs.smooth_trend(5.0),), "huber", 0.5))
    assert rmse(one["values"]["trend"], two["values"]["trend"]) < 1e-3


def test_monotone_pools_and_admm_agree():
    y = np.linspace(2, 0, 80) + np.random.default_rng(7).normal(0, 0.2, 80)
    pooled = solve(y, Model((specs.monotone_trend(),)))["values"]["trend"]
    general = solve(y, Model((specs.bounded(specs.monotone_trend(), -100.0, 100.0),)))["values"]["trend"]
    assert (np.diff(pooled) <= 1e-12).all() and rmse(pooled, general) < 1e-3


def test_invalid_models():
    with pytest.raises(ValueError):
        specs.smooth_trend(-1.0)
    with pytest.raises(ValueError):
        Model((specs.linear_trend(), specs.smooth_trend(1.0)))
    with pytest.raises(ValueError):
        Model((specs.linear_trend("residual"),))
    with pytest.raises(ValueError):
        Model((specs.linear_trend(),), "quantile", 1.0)
    with pytest.raises(ValueError):
        solve(np.full(5, np.nan), Model((specs.linear_trend(),)))


def test_sums_and_series_solver_agree(spark):
    rng = np.random.default_rng(3)
    t = np.arange(400)
    frame = pd.DataFrame({"series_id": np.repeat(["a", "b"], 400), "t": np.tile(t, 2), "z": rng.normal(size=800)})
    frame["y"] = 0.01 * frame.t + np.sin(2 * np.pi * frame.t / 24) + 0.5 * frame.z + rng.normal(0, 0.1, 800)
    frame.loc[50:80, "y"] = None
    model = Model((specs.linear_trend(slope_weight=0.1), specs.multiperiodic(24.0, 2, 0.1), specs.exog_linear("z", 0.01)))
    df = spark.createDataFrame(frame)
    one = fit.gram_curves(df, model).orderBy("series_id", "t").toPandas()
    two = fit.curves(fit.decompose(df, model), model).orderBy("series_id", "t").toPandas()
    for role in model.roles:
        assert rmse(one[role], two[role]) < 1e-6


def test_failed_series_is_a_status(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, None)], "series_id string, t bigint, y double")
    rows = {r.series_id: r.status for r in fit.summary(fit.decompose(df, Model((specs.linear_trend(),)))).collect()}
    assert rows["a"] == "optimal" and rows["b"].startswith("failed")
