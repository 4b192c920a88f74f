"""How far a solution is from its problem's optimality conditions, told from the curves alone.

The models are convex, so a solution that meets these conditions is a best one, whatever solver gave
it. All of it is window sums and aggregates over (series_id, t, y, roles, residual).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.plans.decompose import design, gram_fit, prepared
from tideline.plans.specs import Model
from tideline.plans.steps import reliable, with_fits


def normal_gaps(df: DataFrame, model: Model, digits: int = 4) -> DataFrame:
    """(series_id, place, gap) of ``gram_fit``: by column its product with the residual less its penalty, over its size."""
    columns, penalty = design(model)
    df = prepared(df, model)
    fitted = with_fits(df.where("y is not null"), reliable(gram_fit(df, model))).withColumn("a", F.array(*[c.cast("double") for c in columns]))
    part = F.aggregate(F.zip_with("a", "theta", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    rows = fitted.withColumn("r", F.col("y") - part)
    return _gaps(rows, F.col("r") * F.col("x"), F.col("y") * F.col("x"), penalty, digits)


def _gaps(rows: DataFrame, product: Column, size: Column, penalty: np.ndarray, digits: int) -> DataFrame:
    """(series_id, place, gap) of ``rows(series_id, n, theta, a, y, r)`` by column x: the sum of products less the penalty, over the sum of sizes."""
    each = rows.select("series_id", "n", "theta", "y", "r", F.posexplode("a").alias("i", "x"))
    # numbers only, which are summed in place; an array in the sums would sort all rows
    sums = each.groupBy("series_id", "i").agg(F.sum(product).alias("rx"), F.sum(F.abs(size)).alias("size"), F.max("n").alias("n"), F.max(F.element_at("theta", F.col("i") + 1)).alias("theta"))
    pen = F.element_at(F.array(*[F.lit(float(p)) for p in penalty]), F.col("i") + 1) * F.col("theta")
    gap = F.abs(F.col("rx") - pen * F.col("n")) / F.greatest("size", F.lit(1e-12))
    return sums.select("series_id", (F.col("i") + 1).alias("place"), F.round(gap, digits).alias("gap"))


def slope_gaps(df: DataFrame, model: Model, theta: DataFrame, digits: int = 3) -> DataFrame:
    """(series_id, place, gap) of coefficients under huber loss: by column the loss's slope less the penalty's, over its size."""
    columns, penalty = design(Model(model.components))
    rows = with_fits(prepared(df, Model(model.components)).where("y is not null"), reliable(theta))
    r = F.col("y") - sum((c.cast("double") * F.element_at("theta", i + 1) for i, c in enumerate(columns)), F.lit(0.0))
    pull = F.greatest(F.least(r, F.lit(model.param)), F.lit(-model.param))
    rows = rows.select("series_id", "n", "theta", "y", pull.alias("r"), F.array(*[c.cast("double") for c in columns]).alias("a"))
    return _gaps(rows, F.col("r") * F.col("x"), F.col("r") * F.col("x"), penalty, digits)


def dual_gaps(curves: DataFrame, model: Model, digits: int = 2) -> DataFrame:
    """(series_id, n, observed, gap, excess) for one free part: ``smooth`` of order 2 (a quantile loss to one digit), ``pwc`` or ``pwl``.

    ``excess``: by how much the dual variable leaves its bounds, over their size. ``gap``: what is left
    of the conditions that bind, over the objective (``pwc``) or the largest force (others).
    """
    only = model.components[0]
    by_t, whole = Window.partitionBy("series_id").orderBy("t"), Window.partitionBy("series_id")
    rows = curves.withColumns({"x": F.col(only.role), "n": F.count("*").over(whole)})
    seen, n = F.col("y").isNotNull(), F.col("n")
    lead, lag = lambda c, k=1: F.lead(c, k).over(by_t), lambda c, k=1: F.coalesce(F.lag(c, k).over(by_t), F.lit(0.0))
    if only.kind == "pwc" and model.loss == "l2" and len(model.components) == 1:
        bound = only.params["weight"] / (n - 1)
        rows = rows.withColumns({"dual": -F.sum(2 * F.col("residual") / n).over(by_t), "step": lead("x") - F.col("x")})
        slack = bound * F.abs("step") - F.col("dual") * F.col("step")
        objective = F.sum(F.col("residual") ** 2 / n) + F.sum(F.coalesce(bound * F.abs("step"), F.lit(0.0)))
        gap, excess = F.sum(F.coalesce(slack, F.lit(0.0))) / objective, F.max(F.greatest(F.abs("dual") - bound, F.lit(0.0)) / bound)
    elif only.kind == "pwl" and model.loss == "l2" and len(model.components) == 1:
        bound = only.params["weight"] / (n - 2)
        rows = rows.withColumns({"once": F.sum(2 * F.col("residual") / n).over(by_t), "bend": F.col("x") - 2 * lead("x") + lead("x", 2)})
        rows = rows.withColumn("dual", F.sum("once").over(by_t))
        slack = bound * F.abs("bend") - F.col("dual") * F.col("bend")
        objective = F.sum(F.col("residual") ** 2 / n) + F.sum(F.coalesce(bound * F.abs("bend"), F.lit(0.0)))
        gap, excess = F.sum(F.coalesce(slack, F.lit(0.0))) / objective, F.max(F.greatest(F.abs("dual") - bound, F.lit(0.0)) / bound)
    elif only.kind == "smooth" and only.params["order"] == 2 and len(model.components) == 1:
        rows = rows.withColumn("d", F.coalesce(F.col("x") - 2 * lead("x") + lead("x", 2), F.lit(0.0)))
        force = 2 * only.params["weight"] * (F.col("d") - 2 * lag("d") + lag("d", 2))
        rows = rows.withColumn("force", force * n)  # must equal the slope of the loss, times n
        gap, excess = _smooth_gaps(model, seen)
        digits = min(digits, 1) if model.loss == "quantile" else digits
    else:
        raise ValueError("no certificate for this model")
    out = rows.groupBy("series_id").agg(F.first("n").alias("n"), F.count("y").alias("observed"), gap.alias("gap"), excess.alias("excess"))
    return out.select("series_id", "n", "observed", F.round(F.abs("gap"), digits).alias("gap"), F.round("excess", digits).alias("excess"))


def _smooth_gaps(model: Model, seen: Column) -> tuple[Column, Column]:
    r, force = F.col("residual"), F.col("force")
    if model.loss in ("l2", "huber"):
        pull = 2 * r if model.loss == "l2" else 2 * F.greatest(F.least(r, F.lit(model.param)), F.lit(-model.param))
        slope = F.when(seen, force - pull).otherwise(force)  # of the objective by x, times n
        size = F.max(F.abs(pull))
        if model.components[0].lower is None:
            return F.max(F.abs(slope)) / size, F.lit(0.0)
        # at the bound the objective may only rise
        return F.max(F.abs(slope * (F.col("x") - model.components[0].lower))) / (size * F.max(F.abs("x"))), F.max(F.greatest(-slope, F.lit(0.0))) / size
    if model.loss != "quantile":
        raise ValueError("no certificate for this loss")
    q = model.param
    slack = F.when(r > 0, (2 * q - force) * r).otherwise((2 * (1 - q) + force) * -r)  # 0 where the loss's slope is the force
    loss = F.sum(F.when(seen, 2 * F.greatest(q * r, (q - 1) * r)))
    outside = F.greatest(force - 2 * q, -2 * (1 - q) - force, F.lit(0.0))
    return F.sum(F.when(seen, slack)) / loss, F.max(F.when(seen, outside).otherwise(F.abs(force)))
