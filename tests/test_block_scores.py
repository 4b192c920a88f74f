"""Holdout scores by blocks from sums against refits of every fold."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import validation
from tideline.plans import decompose, gram, specs
from tideline.plans.specs import Model


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(8)
    out = []
    for key, n in (("a", 200), ("b", 120), (None, 60), ("one block", 40), ("unseen", 40)):
        t = np.arange(n)
        z = rng.normal(size=n)
        y = 5 + 0.03 * t + z + np.sin(2 * np.pi * t / 12) + rng.normal(size=n) * 0.2
        y[rng.random(n) < 0.1] = np.nan
        if key == "unseen":
            y[:] = np.nan
        out.append(pd.DataFrame({"series_id": key, "t": t, "y": y, "z": z, "block": 0 if key == "one block" else t // 37}))
    return spark.createDataFrame(pd.concat(out)).withColumn("y", F.nanvl("y", F.lit(None)))


@pytest.mark.parametrize("harmonics", [1, 6])
def test_equals_refits(df, harmonics):
    line, season = specs.linear_trend(slope_weight=0.2), specs.multiperiodic(12.0, harmonics, 0.1)
    some = [("line", Model((line,))), ("season", Model((line, season))), ("heavy", Model((specs.linear_trend(slope_weight=9.0), specs.multiperiodic(12.0, harmonics, 2.0), specs.exog_linear("z"))))]
    got = gram.gram_block_scores(df, some).toPandas()
    assert got[got.series_id == "one block"].score.isna().all() and (got.series_id == "one block").sum() == 3
    assert "unseen" not in set(got.series_id) and got.series_id.isna().sum() == 6
    want = validation.block_scores(df.where("series_id in ('a', 'b')"), some).toPandas()
    both = got.merge(want, on=["series_id", "fold", "place", "candidate"])
    assert len(both) == len(want) == 3 * (6 + 4)
    assert np.allclose(both.score_x, both.score_y, atol=1e-7)


def test_other_models_are_errors(df):
    for model in (Model((specs.smooth_trend(1.0),)), Model((specs.linear_trend(),), "huber")):
        with pytest.raises(ValueError):
            gram.gram_block_scores(df, [("x", model)])


@pytest.mark.parametrize("harmonics", [2, 7])
def test_a_null_series_is_fitted_by_expressions_and_in_batches(df, harmonics):
    model = Model((specs.linear_trend(), specs.multiperiodic(12.0, harmonics, 0.1)))
    named = decompose.gram_fit(df.where("series_id is null").withColumn("series_id", F.lit("x")), model).first()
    got = decompose.gram_fit(df, model).where("series_id is null").first()
    assert got.n == 60 and np.allclose(got.theta, named.theta, atol=1e-9)
