"""Free trends of values far above their weights meet the conditions of a best solution, told from the curves alone."""

import numpy as np
import pandas as pd
import pytest

from tideline import registry
from tideline.operators import certificates
from tideline.plans import solver, specs
from tideline.plans.specs import Model


def sums(size, n=300):
    rng = np.random.default_rng(5)
    y = size * (1200 + 150 * np.sin(np.arange(n) / 20) + rng.normal(0, 250, n))
    y[40:46] = np.nan
    return y


def gaps(spark, name, y):
    model = registry.MODELS[name]
    got = solver.solve(y, model)
    assert got["status"] == "optimal"
    rows = pd.DataFrame({"series_id": "a", "t": np.arange(len(y)), "y": y, "residual": got["residual"], **got["values"]})
    df = spark.createDataFrame(rows.astype(object).where(rows.notna(), None), "series_id string, t bigint, y double, residual double, trend double")
    row = certificates.dual_gaps(df, model).first()
    return row.gap, row.excess


@pytest.mark.parametrize("size", [1.0, 60.0, 360.0])
def test_quantile(spark, size):
    assert gaps(spark, "solve_quantile", sums(size)) == (0, 0)


@pytest.mark.parametrize("size", [1.0, 60.0, 360.0])
def test_bounded_huber(spark, size):
    assert gaps(spark, "solve_bounded_huber", sums(size)) == (0, 0)


@pytest.mark.parametrize("size", [1.0, 60.0, 360.0])
def test_kinks(spark, size):
    assert gaps(spark, "solve_kinks", sums(size)) == (0, 0)


def test_gap_left_in_one_row(spark):
    y = np.round(360 * np.random.default_rng(774).gamma(28, 50, 720), 2)
    assert gaps(spark, "solve_bounded_huber", y) == (0, 0)


def test_forces_summed_over_a_long_series(spark):
    rng = np.random.default_rng(2)
    y = np.round(rng.gamma(rng.poisson(1670, 7200), 50), 4)
    assert gaps(spark, "solve_kinks", y) == (0, 0)


def test_absolute_losses_of_few_coefficients():
    y = sums(360.0)[60:]
    got = solver.solve(y, Model((specs.linear_trend(),), "l1"))
    r = y - got["values"]["trend"]
    assert got["status"] == "optimal" and (np.abs(r) < 1e-6 * np.abs(y).max()).sum() == 2


def test_bounds_beside_rows_of_no_weight():
    y = sums(60.0)
    got = solver.solve(y, Model((specs.bounded(specs.pwc_trend(5.0), 60_000.0, 75_000.0), specs.sparse(0.0))))
    assert got["values"]["trend"].min() >= 60_000 * (1 - 1e-9) and got["values"]["trend"].max() <= 75_000 * (1 + 1e-9)
