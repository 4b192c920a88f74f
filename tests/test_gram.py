"""Fits from sums of products against NumPy: prefixes, sparse mixes, degrees of freedom, robust losses, bases of one's own."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions import basis
from tideline.plans import decompose as fit
from tideline.plans import gram, solver, specs
from tideline.plans.specs import Model

N = 300


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(2)
    t = np.arange(N)
    z = rng.normal(size=N)
    y = 3 + 0.02 * t + 1.5 * z + np.sin(2 * np.pi * t / 24) + rng.standard_t(2, N) * 0.3
    y[40:60] = np.nan
    return pd.DataFrame({"series_id": "a", "t": t, "y": y, "z": z} | {f"a{i}": rng.normal(size=N) + z * (i == 2) for i in range(4)})


@pytest.fixture(scope="module")
def df(spark, frame):
    rows = spark.createDataFrame(frame).replace(float("nan"), None, ["y"])
    return rows.union(rows.select(F.lit("b").alias("series_id"), "t", (F.col("y") * 2 - 1).alias("y"), *rows.columns[3:]))


def parts(frame, model):
    t = frame.t.to_numpy(float)
    out = []
    for c in model.components:
        p = c.params
        if c.kind == "linear":
            out.append((np.stack([np.ones(N), t], 1), np.array([0.0, p["weight"]])))
        elif c.kind == "exog_linear":
            out.append((frame[[p["column"]]].to_numpy(), np.array([p["weight"]])))
        else:
            b, pen = basis.seasonal_matrix(t, p["periods"], p["harmonics"], p["standing"], p["cross"])
            out.append((b, (p["weight"] * pen) ** 2))
    return out


MODEL = Model((specs.linear_trend(slope_weight=0.1), specs.exog_linear("z"), specs.multiperiodic(24.0, 3, 0.3)))


@pytest.mark.parametrize("most", [12, 0])
def test_prefixes_and_dof(frame, df, monkeypatch, most):
    monkeypatch.setattr(gram, "SUMS", most - 2)
    seen = frame.y.notna().to_numpy()
    y = frame.y.to_numpy()[seen]
    got = {r.place: r for r in gram.nested_explained(df, MODEL).where("series_id = 'a'").collect()}
    every = parts(frame, MODEL)
    for k in (1, 2, 3):
        a, pen = np.concatenate([b for b, _ in every[:k]], 1)[seen], np.concatenate([p for _, p in every[:k]])
        theta = np.linalg.solve(a.T @ a / N + np.diag(pen), a.T @ y / N)
        assert got[k].role == MODEL.roles[k - 1] and got[k].explained == pytest.approx(1 - np.var(y - a @ theta) / np.var(y), abs=1e-10)
    influence = np.linalg.solve(a.T @ a / N + np.diag(pen), a.T / N)
    dof = {r.role: r.dof for r in gram.effective_dof(df, MODEL).where("series_id = 'b'").collect()}
    assert dof["total"] == pytest.approx(np.trace(a @ influence), abs=1e-9)
    assert dof["trend"] == pytest.approx(np.trace(a[:, :2] @ influence[:2]), abs=1e-9) and dof["periodic"] == pytest.approx(np.trace(a[:, 3:] @ influence[3:]), abs=1e-9)


def test_prefixes_of_columns_that_repeat(df):
    model = Model((specs.exog_linear("z"), specs.exog_linear("z", role="again"), specs.linear_trend()))
    got = [r.explained for r in gram.nested_explained(df, model).where("series_id = 'a'").orderBy("place").collect()]
    assert got[0] == pytest.approx(got[1], abs=1e-9) and got[2] > got[1]


@pytest.mark.parametrize("weight", [0.01, 0.5, 5.0, 1e3])
def test_sparse_mixes_meet_their_conditions(frame, df, weight):
    names = [f"a{i}" for i in range(4)] + ["z"]
    model = Model((specs.linear_trend(), specs.dictionary(names, weight)))
    row = gram.lasso_fit(df, model).where("series_id = 'a'").first()
    theta, seen = np.array(row.theta), frame.y.notna().to_numpy()
    a = np.concatenate([np.stack([np.ones(N), np.arange(N)], 1), frame[names].to_numpy()], 1)[seen]
    pull = 2 * a.T @ (frame.y.to_numpy()[seen] - a @ theta) / N
    size = np.abs(2 * a.T @ frame.y.to_numpy()[seen] / N).max()
    assert np.abs(pull[:2]).max() < 1e-7 * size
    assert (np.abs(pull[2:]) <= weight + 1e-7 * size).all() and np.abs(pull[2:] - weight * np.sign(theta[2:]))[theta[2:] != 0].max(initial=0) < 1e-7 * size
    assert (theta[2:] != 0).sum() == (0 if weight == 1e3 else (theta[2:] != 0).sum())
    curves = gram.curves_of(df, model, gram.lasso_fit(df, model)).where("series_id = 'a'").orderBy("t").toPandas()
    assert np.abs(curves.atoms - frame[names].to_numpy() @ theta[2:]).max() < 1e-9


@pytest.mark.parametrize(("loss", "param"), [("huber", 0.5), ("quantile", 0.8)])
def test_robust_fits(frame, df, loss, param):
    model = Model((specs.linear_trend(), specs.exog_linear("z", 0.001), specs.multiperiodic(24.0, 1, 0.01)), loss, param)
    row = gram.robust_fit(df, model, 40).where("series_id = 'a'").first()
    every, theta, seen = parts(frame, model), np.array(row.theta), frame.y.notna().to_numpy()
    a, pen, y = np.concatenate([b for b, _ in every], 1)[seen], np.concatenate([p for _, p in every]), frame.y.to_numpy()[seen]

    def objective(v):
        r = y - a @ v
        size = {"huber": np.where(np.abs(r) <= param, r * r, 2 * param * np.abs(r) - param**2), "l1": np.abs(r), "quantile": 2 * np.maximum(param * r, (param - 1) * r)}[loss]
        return size.sum() / N + pen @ v**2

    best, rng = objective(theta), np.random.default_rng(0)
    for scale in (1e-1, 1e-2, 1e-3):
        for _ in range(300):
            assert objective(theta + rng.normal(size=len(theta)) * scale * np.array([1, 0.003, *np.ones(len(theta) - 2)])) > best - 1e-6 * best
    one = solver.solve(frame.y.to_numpy(), model, {"z": frame.z.to_numpy()})
    assert best <= one["objective"] * (1 + 1e-5)


def test_all_seasonal_forms_as_expressions(frame, df):
    for args in (((48.0, 24.0), (1, 2), (True, False), 1), (24.0, 3, True), ((50.5, 10.0), 2, False, None)):
        one, two = specs.multiperiodic(args[0], args[1], 0.1, "periodic", args[2], args[3] if len(args) > 3 else None), parts
        b, pen = basis.seasonal_matrix(np.arange(N, dtype=float), *args)
        columns, weights = basis.seasonal_design(F.col("t").cast("double"), *args)
        got = np.array([list(r) for r in df.where("series_id = 'a'").orderBy("t").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()])
        assert np.abs(got - b).max() < 1e-9 and np.allclose(weights, pen)
        assert len(fit.design(Model((one,)))[0]) == b.shape[1] and two


def test_knots_of_each_series_own(frame, df):
    wide = df.withColumn("z", F.when(F.col("series_id") == "b", F.col("z") * 10 + 5).otherwise(F.col("z"))).withColumn("z", F.when(F.col("t") == 9, None).when(F.col("t") == 11, float("inf")).otherwise(F.col("z")))
    model = Model((specs.linear_trend(), specs.exog_spline("z", 5, weight=0.01)))
    got = fit.gram_curves(wide.where("t != 11"), model).toPandas()
    assert set(got.columns) == {*df.columns, "trend", "exog", "reconstruction", "residual"}
    for k, g in wide.where("t != 11").toPandas().groupby("series_id"):
        mine = got[got.series_id == k].sort_values("t")
        g = g.sort_values("t")
        z = g.z.to_numpy(float)
        a = np.concatenate([np.stack([np.ones(N - 1), g.t], 1), basis.spline_matrix(np.nan_to_num(z), basis.default_knots(np.nanmin(z), np.nanmax(z), 5))], 1)
        seen, y = g.y.notna().to_numpy(), g.y.to_numpy(float)
        theta = np.linalg.solve(a[seen].T @ a[seen] / (N - 1) + np.diag([0, 0, *[0.01] * 4]), a[seen].T @ y[seen] / (N - 1))
        assert np.abs(mine.exog - a[:, 2:] @ theta[2:]).max() < 1e-6
    flat = df.withColumn("z", F.lit(2.0))
    assert fit.gram_curves(flat, Model((specs.exog_spline("z", 4),))).where("exog is null").count() == 0
    with pytest.raises(ValueError):
        fit.gram_curves(df, Model((specs.exog_spline("z", 2),)))


def test_a_basis_of_ones_own(spark, frame, df):
    rng = np.random.default_rng(4)
    block = rng.normal(size=(7, 2))  # 7 rows do not divide 300 places
    table = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(block)], "row long, u double, v double")
    rows = basis.with_custom_basis(df, table, ["u", "v"])
    model = Model((specs.linear_trend(), specs.custom_periodic(["u", "v"], 7.0, 0.5)))
    got = fit.gram_curves(rows, model).where("series_id = 'a'").orderBy("t").toPandas()
    a = np.concatenate([np.stack([np.ones(N), np.arange(N)], 1), np.tile(block, (43, 1))[:N]], 1)
    pen = np.r_[0, 0, (0.5 * 2 * np.pi / np.sqrt(7) * np.arange(1, 3)) ** 2]
    seen = frame.y.notna().to_numpy()
    theta = np.linalg.solve(a[seen].T @ a[seen] / N + np.diag(pen), a[seen].T @ frame.y.to_numpy()[seen] / N)
    assert np.abs(got.periodic - a[:, 2:] @ theta[2:]).max() < 1e-9
    with pytest.raises(ValueError):
        basis.with_custom_basis(df, table.where("row != 3"), ["u", "v"])
