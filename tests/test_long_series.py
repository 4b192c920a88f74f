"""Models with free values: the banded solve gives what a dense one gives, and no row is lost."""

import numpy as np
import pytest

from tideline import registry
from tideline.plans import decompose as fit
from tideline.plans import solver, specs
from tideline.plans.specs import Model


def signal(n):
    rng = np.random.default_rng(1)
    y = 10 + np.cumsum(rng.normal(0, 0.1, n)) + 2 * np.sin(np.arange(n) * np.pi / 4) + rng.normal(0, 0.3, n)
    y[n // 3 : n // 3 + 9] = np.nan
    return y


def dense(y, model):
    """Values by role from the same steps on dense matrices."""
    parts = [solver._Part(c, np.arange(len(y)), {}, False) for c in model.components]
    ends = np.cumsum([p.size for p in parts])
    cut = [slice(e - p.size, e) for p, e in zip(parts, ends, strict=True)]
    v, status = solver._solve_dense(parts, cut, y, np.isfinite(y), model, 1e-7, 8000, None)
    return {p.c.role: v[s] if p.basis is None else p.basis @ v[s] for p, s in zip(parts, cut, strict=True)}, status


@pytest.mark.parametrize("name", sorted(set(registry.MODELS) - {"solve_monotone"}))
def test_banded_is_dense(name):
    y, model = signal(240), registry.MODELS[name]
    want, status = dense(y, model)
    got = solver.solve(y, model)
    assert got["status"] == status
    for role, x in want.items():
        assert np.abs(got["values"][role] - x).max() < 1e-2


def test_long_series_are_solved():
    got = solver.solve(signal(3500), registry.MODELS["solve_smooth"])
    assert got["status"] == "optimal" and np.abs(got["residual"]).mean() < 3


def test_rows_of_failed_series_stay(spark):
    model = Model((specs.smooth_trend(10.0),))
    rows = [("a", t, float(t % 5)) for t in range(20)] + [("b", t, None) for t in range(20)]
    got = fit.curves(fit.decompose(spark.createDataFrame(rows, "series_id string, t bigint, y double"), model), model).collect()
    assert len(got) == 40
    assert all((r.trend is None) == (r.series_id == "b") for r in got)
