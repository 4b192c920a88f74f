"""Refits on the kinks of a piecewise-linear role against least squares over hinges."""

import numpy as np
import pandas as pd

from tideline.operators import diagnostics
from tideline.plans import ranges


def hinges(t, y, knots):
    a = np.column_stack([np.ones(len(t)), t, *[np.maximum(t - k, 0) for k in knots]])
    seen = ~np.isnan(y)
    return a @ np.linalg.lstsq(a[seen], y[seen], rcond=None)[0]


def frame(key, t, knots, missing=()):
    rng = np.random.default_rng(len(t))
    slope = sum(np.maximum(t - k, 0) * s for k, s in zip(knots, (0.5, -1.0, 2.0, -0.3, 0.7), strict=False))
    other = np.sin(t)
    y = 1 + 0.2 * slope + other + rng.normal(size=len(t))
    return pd.DataFrame({"series_id": key, "t": t, "y": np.where(np.isin(t, list(missing)), np.nan, y), "trend": 0.1 * t + slope, "reconstruction": 0.1 * t + slope + other})


def test_equals_hinges(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 32)
    steps = np.arange(150)
    series = {
        "plain": frame("plain", steps, (20, 70, 71, 140)),
        "gaps": frame("gaps", steps, (30, 90), range(60, 85)),
        "uneven": frame("uneven", np.cumsum(1 + steps % 3)[:100] + 10_000_000, (10_000_101,)),
        "straight": frame("straight", steps, ()).assign(trend=lambda g: 0.1 * g.t, reconstruction=lambda g: 0.1 * g.t + np.sin(g.t)),
    }
    got = diagnostics.refit_kinks(spark.createDataFrame(pd.concat(series.values())), "trend", 1e-6).toPandas()
    for key, knots in (("plain", (20, 70, 71, 140)), ("gaps", (30, 90)), ("straight", ())):
        g = series[key]
        mine = got[got.series_id == key].sort_values("t")
        assert np.allclose(mine.refit, hinges(g.t.to_numpy(float), (g.y - g.reconstruction + g.trend).to_numpy(), knots), atol=1e-7)
    g = series["uneven"]
    mine, t = got[got.series_id == "uneven"].sort_values("t"), g.t.to_numpy(float) - 10_000_000
    inner = np.flatnonzero(np.abs(np.diff(np.diff(g.trend) / np.diff(t))) > 1e-6) + 1
    assert 0 < len(inner) <= 2 and np.allclose(mine.refit, hinges(t, (g.y - g.reconstruction + g.trend).to_numpy(), t[inner]), atol=1e-6)


def test_kinks_that_rows_do_not_fix(spark):
    steps = np.arange(60)
    some = [frame("hidden", steps, (20, 25, 30), range(19, 35)), frame("one", steps, (20,), [t for t in steps if t != 7]), frame("none", steps, (20,), steps), frame(None, steps[:1], ())]
    some[3]["trend"], some[3]["reconstruction"] = 0.0, 0.0
    got = diagnostics.refit_kinks(spark.createDataFrame(pd.concat(some)), "trend", 1e-6).toPandas()
    assert got[got.series_id == "none"].refit.isna().all()
    g = some[1].iloc[7]
    assert np.allclose(got[got.series_id == "one"].refit, g.y - g.reconstruction + g.trend)
    assert np.allclose(got[got.series_id.isna()].refit, some[3].y)
    hidden = got[got.series_id == "hidden"].sort_values("t").refit.to_numpy()
    assert np.isfinite(hidden).all()
    # as good on the observed rows as all hinges, and straight but for at most one kink inside the gap
    g = some[0]
    rest, seen = (g.y - g.reconstruction + g.trend).to_numpy(), g.y.notna().to_numpy()
    best = hinges(steps.astype(float), rest, (20, 25, 30))
    assert ((rest - hidden)[seen] ** 2).sum() <= ((rest - best)[seen] ** 2).sum() * 1.2 + 1e-9
