"""Isotonic fits by ranges and bands against plain pooling of whole series."""

import numpy as np
import pandas as pd
import pytest

from tideline.plans import monotone, solver, specs
from tideline.plans.specs import Model


def made(kind, n=260):
    rng = np.random.default_rng(3)
    t = np.arange(n)
    y = {
        "walk": np.cumsum(rng.normal(0, 1, n)), "rise": t + rng.normal(0, 3, n), "fall": -t + rng.normal(0, 3, n), "noise": rng.normal(0, 1, n), "steps": np.repeat(rng.integers(0, 4, -(-n // 10)), 10)[:n].astype(float),
        "late drop": np.where(t < n - 5, t, -5.0 * n), "flat": np.zeros(n), "one": np.where(t == 40, 2.0, np.nan), "exact": t.astype(float),
    }[kind]
    if kind not in ("one", "flat"):
        y[rng.random(n) < 0.15] = np.nan
        y[:4] = np.nan
        y[100:130] = np.nan
    return y


KINDS = ("walk", "rise", "fall", "noise", "steps", "late drop", "flat", "one", "exact")


@pytest.mark.parametrize("increasing", [True, False])
@pytest.mark.parametrize(("size", "band_rows"), [(1 << 16, 1 << 14), (16, 4), (5, 1)])
def test_ranges_equal_pooling(spark, increasing, size, band_rows):
    df = pd.concat([pd.DataFrame({"series_id": k, "t": np.arange(260), "y": made(k), "note": "x"}) for k in KINDS])
    part = specs.monotone_trend(increasing=increasing)
    got = monotone.monotone_curves(spark.createDataFrame(df).replace(float("nan"), None, ["y"]), part, size, band_rows).toPandas()
    assert list(got.columns) == ["series_id", "t", "y", "note", "trend", "reconstruction", "residual"]
    for k in KINDS:
        mine = got[got.series_id == k].sort_values("t")
        want = solver.solve(made(k), Model((part,)))["values"]["trend"]
        assert len(mine) == 260 and np.abs(mine.trend - want).max() < 1e-8, k
        assert np.abs(mine.residual - np.nan_to_num(made(k) - want)).max() < 1e-8


def test_odd_series(spark):
    df = spark.createDataFrame([("none", 0, None), ("none", 5, None), (None, 0, 2.0), (None, 1, 1.0)], "series_id string, t bigint, y double")
    got = {(r.series_id, r.t): r.trend for r in monotone.monotone_curves(df, specs.monotone_trend(increasing=True)).collect()}
    assert got == {("none", 0): None, ("none", 5): None, (None, 0): 1.5, (None, 1): 1.5}
    assert monotone.monotone_curves(df.limit(0), specs.monotone_trend()).count() == 0
    for part in (specs.monotone_trend(1.0), specs.smooth_trend(1.0), specs.nonneg(specs.monotone_trend())):
        with pytest.raises(ValueError):
            monotone.monotone_curves(df, part)
