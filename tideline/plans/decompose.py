"""Fits a model to every series of a long DataFrame (series_id, t, y, covariates).

A missing value is NULL (NaN counts as NULL); a missing covariate counts as 0. Series are solved side by side, one group each; least
squares of few coefficients can instead be fitted from distributed sums, however long the series.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.basis import seasonal_design, spline_columns
from tideline.plans.solver import solve
from tideline.plans.specs import Model
from tideline.plans.steps import reliable, with_fits

for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_name, "1")

#: Columns of a model whose sums of products are plain aggregate expressions.
SUMS = 12

SOLVED = "status string, objective double, scalars map<string,double>, vectors map<string,array<double>>, t array<bigint>, y array<double>, residual array<double>, roles map<string,array<double>>"


def solved_row(group: pd.DataFrame, model: Model, path: dict | None = None) -> dict:
    """One series' solution; a failed solve is a status, not an error."""
    group = group.sort_values("t")
    y = group["y"].to_numpy(float)
    row = {"t": group["t"].to_numpy(np.int64), "y": [None if np.isnan(v) else v for v in y], "objective": None, "scalars": {}, "vectors": {}, "residual": [], "roles": {}}
    try:
        got = solve(y, model, {c: group[c].to_numpy(float) for c in model.columns}, path=path)
    except (ValueError, np.linalg.LinAlgError) as problem:
        return row | {"status": f"failed: {problem}"}
    return row | {"status": got["status"], "objective": got["objective"], "scalars": got["scalars"], "vectors": got["vectors"], "residual": got["residual"], "roles": got["values"]}


def fit_groups(df: DataFrame, keys: list[str], model_of: Callable[[pd.DataFrame], Model]) -> DataFrame:
    """One solution per group of ``keys``; ``model_of`` gives a group's model."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{k: group[k].iloc[0] for k in keys} | solved_row(group, model_of(group))])

    head = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    # solves are long and their rows few: by their bytes, partitions would be merged into one task
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys).groupBy(*keys).applyInPandas(run, f"{head}, {SOLVED}")


def weight_path(df: DataFrame, models: Sequence[Model]) -> DataFrame:
    """(series_id, place, solution) for every model, in their order: a series' path of weights.

    A series' models are solved one after another in one task. Those that ADMM solves start from the last one's end,
    and factors are used again where only weights of non-smooth parts change.
    """
    columns = list(dict.fromkeys(c for m in models for c in m.columns))
    kind = df.schema["series_id"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        path: dict = {}
        return pd.DataFrame([{"series_id": group["series_id"].iloc[0], "place": i} | solved_row(group, m, path) for i, m in enumerate(models)])

    return df.select("series_id", "t", "y", *columns).groupBy("series_id").applyInPandas(run, f"series_id {kind}, place int, {SOLVED}")


def decompose(df: DataFrame, model: Model, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """One row per series with its solution; see ``curves`` and ``summary``."""
    return fit_groups(df.select(*keys, "t", "y", *model.columns), list(keys), lambda _: model)


def curves(solved: DataFrame, model: Model, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """(keys, t, y, roles, residual, reconstruction), one row per grid point; nulls from the roles on where the solve failed."""
    none = F.array().cast("array<double>")
    zipped = F.arrays_zip("t", "y", "residual", *[F.coalesce(F.col("roles")[r], none).alias(r) for r in model.roles])
    rows = solved.select(*keys, F.explode(zipped).alias("r"))
    total = sum((F.col(f"r.`{r}`") for r in model.roles[1:]), F.col(f"r.`{model.roles[0]}`"))
    return rows.select(*keys, "r.t", "r.y", *[F.col(f"r.`{r}`").alias(r) for r in model.roles], F.col("r.residual").alias("residual"), total.alias("reconstruction"))


def summary(solved: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    return solved.select(*keys, "status", "objective", "scalars", "vectors")


def observed() -> Column:
    """Whether a row's y is known; NaN counts as missing."""
    return F.col("y").isNotNull() & ~F.isnan("y")


def covariate(name: str) -> Column:
    """A covariate as models read it: missing values (null or NaN) count as 0, in every way of fitting."""
    return F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def scaled(system: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A symmetric matrix with its diagonal values brought to 1, so that columns of any size count alike, and their roots."""
    size = np.sqrt(np.abs(np.diag(system)))
    size[size == 0] = 1.0
    return system / np.outer(size, size), size


def scaled_solve(system: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of normal equations; the shortest of its scaled coefficients where there are many."""
    unit, size = scaled(system)
    return np.linalg.lstsq(unit, right / size, rcond=1e-13)[0] / size


def scaled_inverse(system: np.ndarray) -> np.ndarray:
    """The matrix that ``scaled_solve`` multiplies by."""
    unit, size = scaled(system)
    return np.linalg.pinv(unit, rcond=1e-13, hermitian=True) / np.outer(size, size)


def gram_fit(df: DataFrame, model: Model) -> DataFrame:
    """(series_id, theta, n): ridge least squares from sums of products, one pass and one small shuffle.

    For ``linear``, ``exog_linear``, ``exog_spline``, ``periodic`` and ``columns`` under l2 without bounds. Up to ``SUMS`` columns the sums are
    expressions; beyond, batches give partial sums of ``p^2`` numbers.
    """
    df = prepared(df, model)
    columns, penalty = design(model)
    p = len(columns)
    if p <= SUMS:
        return _summed_fit(df, columns, penalty)
    flat = df.select("series_id", F.array(*[c.cast("double") for c in columns]).alias("a"), F.nanvl("y", F.lit(None)).alias("y"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, g in batch.groupby("series_id", dropna=False, sort=False):
                seen = g["y"].notna().to_numpy()
                a = np.stack(g["a"].to_numpy())[seen] if seen.any() else np.zeros((0, p))
                y = g["y"].to_numpy(float)[seen]
                yield pd.DataFrame({"series_id": [None if pd.isna(key) else key], "s": [np.concatenate([(a.T @ a).ravel(), a.T @ y]).tolist()], "n": [len(g)]})

    def total(g: pd.DataFrame) -> pd.DataFrame:
        s, n = np.sum(np.stack(g["s"].to_numpy()), 0), int(g["n"].sum())
        theta = scaled_solve(s[: p * p].reshape(p, p) / n + np.diag(penalty), s[p * p :] / n)
        return pd.DataFrame({"series_id": [g["series_id"].iloc[0]], "theta": [theta.tolist()], "n": [n]})

    kind = df.schema["series_id"].dataType.simpleString()
    sums = flat.mapInPandas(partial, f"series_id {kind}, s array<double>, n bigint")
    return sums.groupBy("series_id").applyInPandas(total, f"series_id {kind}, theta array<double>, n bigint")


def _summed_fit(df: DataFrame, columns: list, penalty: np.ndarray) -> DataFrame:
    p, seen = len(columns), observed()
    names = [f"a{i}" for i in range(p)]
    rows = df.select("series_id", F.when(seen, F.col("y")).alias("y"), *[F.when(seen, c.cast("double")).alias(n) for c, n in zip(columns, names, strict=True)])
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    squares = F.array(*[total(F.col(names[i]) * F.col(names[j])) for i, j in pairs])
    sums = rows.groupBy("series_id").agg(squares.alias("aa"), F.array(*[total(F.col(n) * F.col("y")) for n in names]).alias("ay"), F.count("*").alias("n"))
    place = np.zeros((p, p), int)
    for k, (i, j) in enumerate(pairs):
        place[i, j] = place[j, i] = k

    def solve_each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            theta = [scaled_solve(np.asarray(aa)[place] / n + np.diag(penalty), np.asarray(ay) / n).tolist() for aa, ay, n in zip(batch["aa"], batch["ay"], batch["n"], strict=True)]
            yield pd.DataFrame({"series_id": batch["series_id"], "theta": theta, "n": batch["n"]})

    kind = df.schema["series_id"].dataType.simpleString()
    return sums.mapInPandas(solve_each, f"series_id {kind}, theta array<double>, n bigint")


def design(model: Model) -> tuple[list, np.ndarray]:
    """The model's columns as expressions over t and covariates (of ``prepared`` rows), and their penalties."""
    if model.loss != "l2":
        raise ValueError("sums of products fit l2 only")
    columns, penalty = [], []
    for c in model.components:
        p = c.params
        if c.lower is not None or c.upper is not None:
            raise ValueError("bounds need the series solver")
        if c.kind == "linear":
            columns += [F.lit(1.0), F.col("t").cast("double")]
            penalty += [0.0, p["weight"]]
        elif c.kind == "exog_linear":
            columns.append(covariate(p["column"]))
            penalty.append(p["weight"])
        elif c.kind == "exog_spline":
            some = spline_columns(covariate(p["column"]), p["knots"] or _own_knots(p["column"], p["n_knots"]))
            columns += some
            penalty += [p["weight"]] * len(some)
        elif c.kind == "columns":
            columns += [covariate(name) for name in p["columns"]]
            penalty += [(p["weight"] * v) ** 2 for v in p["penalties"]]
        elif c.kind == "periodic":
            some, pen = seasonal_design(F.col("t").cast("double"), p["periods"], p["harmonics"], p["standing"], p["cross"])
            columns += some
            penalty += [(p["weight"] * v) ** 2 for v in pen]
        else:
            raise ValueError(f"{c.kind} needs the series solver")
    return columns, np.array(penalty)


def _own_knots(column: str, count: int) -> list[Column]:
    """Knots at even steps between a series' least and largest value of a covariate, which ``prepared`` gives."""
    if count < 3:
        raise ValueError("a spline needs 3 knots")
    low, high = F.col(f"_low_{column}"), F.col(f"_high_{column}")
    return [low + (high - low) * (i / (count - 1)) for i in range(count)]


def prepared(df: DataFrame, model: Model) -> DataFrame:
    """``df`` with each series' least and largest finite value of covariates whose knots are not stated.

    A covariate that has none, or only one, gives a spline of its column alone.
    """
    names = [c.params["column"] for c in model.components if c.kind == "exog_spline" and not c.params["knots"]]
    names = [n for n in dict.fromkeys(names) if f"_low_{n}" not in df.columns]
    if not names:
        return df
    finite = lambda n: F.when(F.abs(F.col(n)) < float("inf"), F.col(n).cast("double"))
    ends = df.groupBy(F.col("series_id").alias("_ends_of")).agg(*[f(finite(n)).alias(k + n) for n in names for k, f in (("_low_", F.min), ("_high_", F.max))])
    return df.join(ends, F.col("series_id").eqNullSafe(F.col("_ends_of"))).drop("_ends_of")


def fitted_curves(rows: DataFrame, model: Model, fit: DataFrame, columns_of: Callable[[Model], list[Column]]) -> DataFrame:
    """``rows`` with each role, residual and reconstruction from coefficients (series_id, theta), which are kept and brought to all rows."""
    out, at = with_fits(rows, reliable(fit.select("series_id", F.col("theta").alias("_theta")))), 0
    for c in model.components:
        some = columns_of(Model((c,)))
        value = sum((x * F.element_at("_theta", at + i + 1) for i, x in enumerate(some[1:], 1)), some[0] * F.element_at("_theta", at + 1))
        out, at = out.withColumn(c.role, value), at + len(some)
    total = sum((F.col(r) for r in model.roles[1:]), F.col(model.roles[0]))
    return out.withColumn("reconstruction", total).withColumn("residual", F.when(observed(), F.col("y") - F.col("reconstruction")).otherwise(0.0)).drop("_theta")


def gram_curves(df: DataFrame, model: Model) -> DataFrame:
    """``df`` with each role, residual and reconstruction from ``gram_fit``; fits go out by a join."""
    rows = prepared(df, model)
    out = fitted_curves(rows, model, gram_fit(rows, model), lambda m: design(m)[0])
    return out.select(*df.columns, *model.roles, "reconstruction", "residual")


def linear_closed_form(df: DataFrame, slope_weight: float = 0.0) -> DataFrame:
    """(series_id, trend_a, trend_b) of ``linear_trend`` alone under l2, in one aggregation."""
    seen = F.col("y").isNotNull()
    x, y = F.when(seen, F.col("t").cast("double")), F.col("y")
    sums = df.groupBy("series_id").agg(F.count("*").alias("n"), F.count(y).alias("m"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"))
    slope = F.col("sxy") / (F.col("sxx") + slope_weight * F.col("n"))
    return sums.select("series_id", (F.col("my") - slope * F.col("mx")).alias("trend_a"), slope.alias("trend_b"))


def exog_closed_form(df: DataFrame, column: str, weight: float = 0.0) -> DataFrame:
    """(series_id, beta) of ``exog_linear`` alone under l2."""
    z, seen = covariate(column), F.col("y").isNotNull()
    return df.groupBy("series_id").agg((F.sum(z * F.col("y")) / (F.sum(F.when(seen, z * z)) + weight * F.count("*"))).alias("beta"))


def sparse_closed_form(df: DataFrame, weight: float) -> DataFrame:
    """``df`` with ``sparse`` alone under l2: values beyond half the weight, shrunk by it."""
    return df.withColumn("sparse", F.coalesce(F.signum("y") * F.greatest(F.abs("y") - weight / 2, F.lit(0.0)), F.lit(0.0)))
