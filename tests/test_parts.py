"""Further parts of models, reports, files and the rules that choose among fits."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions import basis
from tideline.operators import diagnostics, reporting, validation
from tideline.plans import decompose as fit
from tideline.plans import solver, specs
from tideline.plans.specs import Model
from tideline.sources import series, synthetic


def test_sparse_mix_of_atoms():
    rng = np.random.default_rng(1)
    atoms = {f"a{i}": rng.normal(size=300) for i in range(8)}
    y = 2 * atoms["a1"] - atoms["a6"] + rng.normal(0, 0.05, 300)
    got = solver.solve(y, Model((specs.dictionary(list(atoms), 0.1),)), atoms)
    theta = np.array(got["vectors"]["atoms_theta"])
    assert set(np.flatnonzero(np.abs(theta) > 1e-4)) == {1, 6}


def test_stencils_are_the_known_trends():
    y = np.repeat([1.0, -0.5, 0.3], [70, 70, 60]) + np.random.default_rng(11).normal(0, 0.05, 200)
    for stencil, same in (((-1, 1), specs.pwc_trend(1.0)), ((1, -2, 1), specs.pwl_trend(1.0))):
        one = solver.solve(y, Model((specs.analysis(stencil, 1.0),)))["values"]["trend"]
        two = solver.solve(y, Model((same,)))["values"]["trend"]
        assert np.abs(one - two).max() < 1e-3


def test_standing_waves_by_period():
    t = np.arange(100.0)
    mixed, _ = basis.seasonal_matrix(t, (40.0, 10.0), (2, 3), (True, False), 0)
    waves, _ = basis.seasonal_matrix(t, 40.0, 2, True)
    rounds, _ = basis.seasonal_matrix(t, 10.0, 3)
    assert np.allclose(mixed, np.concatenate([waves, rounds], 1))
    with pytest.raises(ValueError):
        basis.seasonal_matrix(t, (40.0, 10.0), 2, (True,))


def test_bounds_hold_closely():
    y = 5 + np.random.default_rng(5).normal(0, 1, 200)
    got = solver.solve(y, Model((specs.bounded(specs.smooth_trend(1.0), 0.0, 3.0),)))["values"]["trend"]
    assert got.max() <= 3 + 1e-6 and got.min() >= -1e-6


def test_report(spark):
    rows = [("a", t, 10 + 0.1 * t if t != 3 else None) for t in range(20)]
    df = spark.createDataFrame(rows, "series_id string, t bigint, y double")
    model = Model((specs.linear_trend(),))
    solved = fit.decompose(df, model)
    text = reporting.format_report(fit.curves(solved, model), fit.summary(solved), model.roles, "a", "Test")
    assert text.startswith("# Test") and "- **trend:** 100.0%" in text and "- **observed entries:** 19 / 20 (95.0% coverage)" in text
    assert "- **trend_b:** 0.1" in text and "residual:** " not in text.split("## Residual")[0]
    with pytest.raises(ValueError):
        reporting.format_report(fit.curves(solved, model), fit.summary(solved), model.roles, "b")
    assert "-0.750 %/yr" in reporting.degradation_report(-0.75, {"Trend": "linear"})


def test_shares_add_up(spark):
    df = spark.createDataFrame([("a", t, 5.0, 3.0, 4.0, -2.0) for t in range(4)], "series_id string, t bigint, y double, p double, q double, residual double")
    n = reporting.report_numbers(df, ["p", "q"]).first()
    assert n.share_p == pytest.approx(36) and n.share_q == pytest.approx(64)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2.5), ("b", 2, None)], "series_id string, t bigint, y double")
    series.write_csv(df, f"{tmp_path}/csv")
    assert sorted(series.read_csv(spark, f"{tmp_path}/csv", "series_id string, t bigint, y double").collect()) == sorted(df.collect())
    series.write_parquet(df, f"{tmp_path}/parquet")
    assert sorted(series.read_parquet(spark, f"{tmp_path}/parquet").collect()) == sorted(df.collect())


def test_made_up_signal(spark):
    rows = synthetic.hourly_signal(spark, series=2).toPandas()
    assert len(rows) == 2 * 2160 and rows.y.isna().sum() == 2 * 48
    assert (rows.spikes > 0).sum() == 2 * 5
    left = (rows.y - rows[["trend", "seasonal", "exog", "spikes"]].sum(axis=1)).dropna()
    assert left.std() == pytest.approx(0.1, rel=0.1)


def test_admissible_or_null_result(spark):
    rows = [("a", 1.0, 0.5, 9, 2.0), ("a", 2.0, 0.4, 2, 1.5), ("a", 4.0, 0.3, 1, 3.0), ("a", 8.0, 0.0, 0, None), ("b", 1.0, 0.5, 2, 0.1), ("b", 8.0, 0.0, 0, None)]
    scans = spark.createDataFrame(rows, "family string, weight double, gain double, changes int, jump double")
    got = {r.family: (r.weight, r.found) for r in validation.admissible(scans, 0.1, 3, 1.0).collect()}
    assert got == {"a": (2.0, True), "b": (8.0, False)}


def test_levels_are_refitted(spark):
    level = np.repeat([1.0, 4.0, 2.0], 20)
    y = level + np.random.default_rng(2).normal(0, 0.1, 60)
    df = spark.createDataFrame(pd.DataFrame({"series_id": "a", "t": range(60), "y": y}))
    model = Model((specs.pwc_trend(2.0),))
    got = diagnostics.refit_levels(fit.curves(fit.decompose(df, model), model), "trend", 0.5).orderBy("t").toPandas()
    want = np.concatenate([np.full(20, y[i : i + 20].mean()) for i in (0, 20, 40)])
    assert np.abs(got.refit - want).max() < 1e-9
    jumps = diagnostics.change_rows(fit.curves(fit.decompose(df, model), model), "trend", 0.5).orderBy("t").collect()
    assert [r.t for r in jumps] == [20, 40]


def test_line_blocks_equal_refits(spark):
    rng = np.random.default_rng(6)
    rows = [("a", t, dt.datetime(2020, 1, 1) + dt.timedelta(days=30 * t), None if t in (4, 9) else float(2 + 0.1 * t + rng.normal())) for t in range(60)]
    df = validation.calendar_blocks(spark.createDataFrame(rows, "series_id string, t bigint, ts timestamp_ntz, y double"))
    one = {(r.fold, r.weight): r.score for r in validation.line_block_scores(df, (0.0, 50.0)).collect()}
    models = [(w, Model((specs.linear_trend(slope_weight=float(w)),))) for w in ("0", "50")]
    two = {(r.fold, float(r.candidate)): r.score for r in validation.block_scores(df, models).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_expanding_lines_equal_refits(spark):
    rng = np.random.default_rng(7)
    rows = [("a", t, None if 30 <= t < 35 else float(1 + 0.05 * t + rng.normal())) for t in range(100)]
    df = spark.createDataFrame(rows, "series_id string, t bigint, y double")
    fits = validation.expanding_fits(df, Model((specs.linear_trend(slope_weight=3.0),)), 20, 15)
    want = {r.n: r.b for r in fits.select("n", F.col("scalars")["trend_b"].alias("b")).collect()}
    got = {r.n: r.trend_b for r in validation.expanding_lines(df, 20, 15, 3.0).collect()}
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-9 for n in got)


def test_a_path_of_weights_equals_single_solves(spark):
    rng = np.random.default_rng(9)
    y = np.repeat([0.0, 2.0, 1.0], 40) + rng.normal(0, 0.2, 120)
    y[30:36] = np.nan
    models = [Model((specs.pwc_trend(w), specs.multiperiodic(12.0, 1, 0.1))) for w in (0.1, 1.0, 10.0)] + [Model((specs.smooth_trend(5.0), specs.sparse(1.0)))]
    df = spark.createDataFrame(pd.DataFrame({"series_id": "a", "t": range(120), "y": y})).replace(float("nan"), None)
    rows = {r.place: r for r in fit.weight_path(df, models).collect()}
    for i, m in enumerate(models):
        alone = solver.solve(y, m)
        assert rows[i].status == "optimal" and rows[i].objective == pytest.approx(alone["objective"], rel=1e-4)
        assert np.abs(np.array(rows[i].roles["trend"]) - alone["values"]["trend"]).max() < 1e-2


def test_sums_by_expressions_and_by_batches_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    t = np.arange(300)
    frame = pd.DataFrame({"series_id": np.repeat(["a", "b"], 300), "t": np.tile(t, 2), "y": rng.normal(size=600) + np.tile(0.01 * t, 2)})
    frame.loc[10:30, "y"] = None
    df = spark.createDataFrame(frame)
    model = Model((specs.linear_trend(slope_weight=0.1), specs.multiperiodic(24.0, 2, 0.1)))
    one = {r.series_id: r for r in fit.gram_fit(df, model).collect()}
    monkeypatch.setattr(fit, "SUMS", 0)
    two = {r.series_id: r for r in fit.gram_fit(df, model).collect()}
    assert all(one[k].n == two[k].n and np.allclose(one[k].theta, two[k].theta, atol=1e-9) for k in ("a", "b"))
