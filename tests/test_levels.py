"""Piecewise-constant trends by messages between ranges: the conditions of a best solution, and one range against many."""

import numpy as np
import pandas as pd
import pytest

from tideline.plans import levels, solver, specs
from tideline.plans.specs import Model


def made(kind, n=240):
    rng = np.random.default_rng(8)
    y = {
        "steps": np.repeat([0.0, 3.0, 1.0, 4.0], n // 4) + rng.normal(0, 0.4, n), "walk": np.cumsum(rng.normal(0, 1, n)), "rise": 0.1 * np.arange(n), "noise": rng.normal(0, 1, n),
        "ties": rng.integers(0, 3, n).astype(float), "one": np.where(np.arange(n) == 77, 2.0, np.nan), "two": np.where(np.arange(n) == 200, 5.0, np.where(np.arange(n) == 3, 1.0, np.nan)), "spike": np.where(np.arange(n) == 31, 1e4, 0.0),
    }[kind]
    if kind not in ("one", "two"):
        y[rng.random(n) < 0.2] = np.nan
        y[60:110] = np.nan
        y[:5] = np.nan
        y[-7:] = np.nan
    return y


KINDS = ("steps", "walk", "rise", "noise", "ties", "one", "two", "spike")


def excess(y, x, weight):
    """How far a solution is from its conditions: the dual of the jumps lies within its bounds, and on them where x jumps."""
    n, bound = len(y), weight / (len(y) - 1)
    pull = np.where(np.isfinite(y), 2 * (x - np.nan_to_num(y)) / n, 0.0)
    dual = np.cumsum(pull)
    jump = np.diff(x)
    slack = bound * np.abs(jump) - dual[:-1] * jump
    return max(abs(dual[-1]) / bound, (np.abs(dual) - bound).max() / bound, slack.max() / max(bound * np.abs(jump).sum(), 1e-12) if len(jump) else 0)


@pytest.mark.parametrize("weight", [0.05, 1.0, 30.0])
@pytest.mark.parametrize("size", [1 << 16, 16, 3])
def test_solutions_meet_their_conditions(spark, weight, size):
    df = pd.concat([pd.DataFrame({"series_id": k, "t": np.arange(240), "y": made(k), "note": "x"}) for k in KINDS])
    got = levels.pwc_curves(spark.createDataFrame(df).replace(float("nan"), None, ["y"]), specs.pwc_trend(weight), size).toPandas()
    assert list(got.columns) == ["series_id", "t", "y", "note", "trend", "reconstruction", "residual"]
    for k in KINDS:
        mine = got[got.series_id == k].sort_values("t")
        assert len(mine) == 240 and excess(made(k), mine.trend.to_numpy(), weight) < 1e-8, k
        assert np.abs(mine.residual - np.nan_to_num(made(k) - mine.trend.to_numpy())).max() < 1e-12


def test_the_series_solver_agrees(spark):
    y = made("steps")
    df = spark.createDataFrame(pd.DataFrame({"series_id": "a", "t": np.arange(240), "y": y})).replace(float("nan"), None)
    got = levels.pwc_curves(df, specs.pwc_trend(2.0), 10).orderBy("t").toPandas()
    gap = got.trend - solver.solve(y, Model((specs.pwc_trend(2.0),)))["values"]["trend"]
    assert np.abs(gap[np.isfinite(y)]).max() < 1e-3  # in a gap a jump may lie anywhere


def test_odd_series(spark):
    df = spark.createDataFrame([("none", 0, None), ("none", 9, None), (None, 0, 2.0), (None, 7, 1.0), ("b", 4, 3.0)], "series_id string, t bigint, y double")
    got = {(r.series_id, r.t): r.trend for r in levels.pwc_curves(df, specs.pwc_trend(100.0), 3).collect()}
    assert got[("none", 0)] is None and got[("none", 9)] is None and got[("b", 4)] == pytest.approx(3.0)
    assert got[(None, 0)] == pytest.approx(1.5) and got[(None, 7)] == pytest.approx(1.5)
    assert levels.pwc_curves(df.limit(0), specs.pwc_trend(1.0)).count() == 0
    for part in (specs.pwl_trend(1.0), specs.nonneg(specs.pwc_trend(1.0))):
        with pytest.raises(ValueError):
            levels.pwc_curves(df, part)
