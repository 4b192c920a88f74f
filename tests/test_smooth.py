"""Smooth trends by ranges against one dense system, and the one rule for missing covariates."""

import numpy as np
import pandas as pd
import pytest

from tideline.functions import basis
from tideline.plans import decompose as fit
from tideline.plans import smooth, specs
from tideline.plans.specs import Model


def dense(y, weight, order, b=None, penalty=None):
    n, seen = len(y), np.isfinite(y)
    d = np.diff(np.eye(n), order, axis=0)
    b = np.zeros((n, 0)) if b is None else b
    z = np.concatenate([np.eye(n), b], 1)
    pen = np.zeros((z.shape[1], z.shape[1]))
    pen[:n, :n] = weight * d.T @ d
    pen[n:, n:] = np.diag([] if penalty is None else penalty)
    v = np.linalg.solve(z[seen].T @ z[seen] / n + pen, z[seen].T @ y[seen] / n)
    return v[:n], v[n:]


def made(n, seed=0, gap=True):
    rng = np.random.default_rng(seed)
    y = np.cumsum(rng.normal(0, 0.1, n)) + rng.normal(0, 0.3, n)
    if gap:
        y[n // 3 : n // 2] = np.nan
        y[:3] = np.nan
    return y


def frame(spark, series, drop=()):
    rows = [pd.DataFrame({"series_id": k, "t": np.arange(len(y)), "y": y, "note": "x"}) for k, y in series.items()]
    df = pd.concat(rows)
    return spark.createDataFrame(df[~df.t.isin(drop)]).replace(float("nan"), None, ["y"])


@pytest.mark.parametrize(("size", "fan", "order"), [(1 << 16, 512, 2), (32, 3, 2), (20, 2, 2), (33, 2, 1), (64, 4, 3)])
def test_ranges_equal_one_system(spark, monkeypatch, size, fan, order):
    monkeypatch.setattr(smooth, "FAN", fan)
    series = {"a": made(500), "b": made(37, 1), "c": made(3, 2, False), "d": made(200, 3)}
    got = smooth.smooth_curves(frame(spark, series), Model((specs.smooth_trend(2.0, order),)), size).toPandas()
    assert set(got.columns) == {"series_id", "t", "y", "note", "trend", "reconstruction", "residual"}
    for k, y in series.items():
        if len(y) > order:
            mine = got[got.series_id == k].sort_values("t")
            want, _ = dense(y, 2.0, order)
            assert len(mine) == len(y) and np.abs(mine.trend - want).max() < (1e-8 if order < 3 else 1e-6), k
            assert (mine.residual[np.isnan(y)] == 0).all()


def test_absent_rows_are_unobserved(spark):
    y = made(300, 4)
    drop = set(range(100, 180))
    y[list(drop)] = np.nan
    got = smooth.smooth_curves(frame(spark, {"a": y}, drop), Model((specs.smooth_trend(50.0),)), 25).toPandas().sort_values("t")
    want, _ = dense(y, 50.0, 2)
    assert len(got) == 220 and np.abs(got.trend - want[got.t]).max() < 1e-8


def test_season_beside_the_trend(spark):
    n, rng = 400, np.random.default_rng(5)
    t = np.arange(n)
    y = made(n, 6) + np.sin(2 * np.pi * t / 24)
    z = rng.normal(size=n)
    df = frame(spark, {"a": y + z}).toPandas()
    df["z"] = np.where(t % 50 == 7, np.nan, z)
    model = Model((specs.multiperiodic(24.0, 2, 0.1), specs.smooth_trend(5.0), specs.exog_linear("z", 0.01)))
    got = smooth.smooth_curves(spark.createDataFrame(df).replace(float("nan"), None, ["y"]), model, 48).toPandas().sort_values("t")
    season, pen = basis.seasonal_matrix(t.astype(float), 24.0, 2)
    b = np.concatenate([season, np.nan_to_num(df.z.to_numpy())[:, None]], 1)
    want, theta = dense(df.y.astype(float).to_numpy(), 5.0, 2, b, [*((0.1 * pen) ** 2), 0.01])
    assert np.abs(got.trend - want).max() < 1e-7 and np.abs(got.periodic - season @ theta[:-1]).max() < 1e-7
    assert np.abs(got.exog - b[:, -1] * theta[-1]).max() < 1e-7


@pytest.mark.parametrize(("last", "columns"), [(specs.exog_linear("w", role="other"), 12), (specs.exog_spline("w", knots=(0.0, 1.0, 2.0), weight=0.1, role="other"), 13)])
def test_missing_covariates_count_as_zero_everywhere(spark, last, columns):
    """Twelve columns are summed by expressions, more in batches, and the series solver gathers the series."""
    n, rng = 200, np.random.default_rng(7)
    z = rng.normal(size=n)
    y = 2 * z + 0.01 * np.arange(n) + rng.normal(0, 0.1, n)
    z[[5, 50]] = np.nan
    df = pd.DataFrame({"series_id": "a", "t": np.arange(n), "y": y, "z": z, "w": np.abs(z)})
    model = Model((specs.linear_trend(), specs.exog_linear("z"), specs.multiperiodic(24.0, 4, 0.1), last))
    assert len(fit.design(model)[0]) == columns
    for some in (spark.createDataFrame(df), spark.createDataFrame(df).replace(float("nan"), None, ["z", "w"])):
        one = fit.gram_curves(some, model).orderBy("t").toPandas()
        two = fit.curves(fit.decompose(some, model), model).orderBy("t").toPandas()
        for role in (*model.roles, "residual", "reconstruction"):
            assert np.abs(one[role] - two[role]).max() < 1e-6, role


def test_probes_estimate_the_degrees_of_freedom(spark):
    y = made(400, 9)
    seen, d = np.isfinite(y).astype(float), np.diff(np.eye(400), 2, axis=0)
    want = np.trace(np.linalg.solve(np.diag(seen) / 400 + 0.01 * d.T @ d, np.diag(seen) / 400))
    got = smooth.smooth_dof(frame(spark, {"a": y}), 0.01, probes=64, size=96).first().dof
    assert abs(got - want) < 0.04 * want


def test_what_it_does_not_solve(spark):
    df = frame(spark, {"a": made(20)})
    for model in (Model((specs.linear_trend(),)), Model((specs.nonneg(specs.smooth_trend(1.0)),)), Model((specs.smooth_trend(1.0),), "l1")):
        with pytest.raises(ValueError):
            smooth.smooth_curves(df, model)
    assert smooth.smooth_curves(df.limit(0), Model((specs.smooth_trend(1.0),))).count() == 0
