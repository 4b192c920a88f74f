"""Block bootstrap of lines and seasons from sums of blocks: no series is copied, gathered or refitted.

A replicate lays drawn blocks of residuals at other places, so it needs sums of columns at one place times
residuals of another. Lines, waves and products of waves moved by h are mixes of themselves, with factors
of h alone; so the sums of a drawn piece at its own place give those at any other. Gaps cut blocks into
pieces of one shift each. A replicate costs rows by the number of pieces, about rows / block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.basis import plan
from tideline.plans import ranges
from tideline.plans.decompose import design, fitted_curves, observed, scaled_inverse
from tideline.plans.gram import by_series, gram_sums
from tideline.plans.specs import Model
from tideline.plans.steps import reliable

Shift = dict[int, Callable[[Column], Column]]


def check_draws(block: int, resamples: int, confidence: float = 50.0) -> None:
    if block < 1 or resamples < 1:
        raise ValueError("block and resamples must be 1 or more")
    if not 0 < confidence < 100:
        raise ValueError("confidence lies between 0 and 100 percent")


def shifts(model: Model) -> list[Shift]:
    """For each of the model's columns, the mix of columns at t that gives it at t + h."""
    out: list[Shift] = []
    for c in model.components:
        if c.kind == "linear":
            at = len(out)
            out += [{at: lambda h: F.lit(1.0)}, {at + 1: lambda h: F.lit(1.0), at: lambda h: h}]
        elif c.kind == "periodic" and not np.any(c.params["standing"]):
            blocks = []
            for period, count, _ in plan(c.params["periods"], c.params["harmonics"]):
                first = len(out)
                for i in range(count):
                    out += _turned(len(out), 2 * math.pi * (i + 1) / period)
                blocks.append(range(first, len(out)))
            cut = None if c.params["cross"] is None else 2 * c.params["cross"]
            pairs = [(x, z) for a, one in enumerate(blocks) for two in blocks[a + 1 :] for x in one[:cut] for z in two[:cut]]
            place = {pair: len(out) + k for k, pair in enumerate(pairs)}
            out += [{place[k, m]: lambda h, f=f, g=g: f(h) * g(h) for k, f in out[x].items() for m, g in out[z].items()} for x, z in pairs]
        else:
            raise ValueError(f"{c.role}: sums of blocks move lines and full waves only; bootstrap refits other models")
    return out


def _turned(at: int, speed: float) -> list[Shift]:
    cos, sin = (lambda h: F.cos(h * speed)), (lambda h: F.sin(h * speed))
    return [{at: cos, at + 1: lambda h: -sin(h)}, {at: sin, at + 1: cos}]


def coefficient_names(model: Model) -> list[str]:
    """Names of a model's coefficients: ``role_a`` and ``role_b`` of lines, else ``role_0``, ``role_1`` and so on."""
    return [f"{c.role}_{'ab'[i] if c.kind == 'linear' else i}" for c in model.components for i in range(len(design(Model((c,)))[0]))]


def bootstrap_thetas(df: DataFrame, model: Model, block: int, resamples: int = 500, seed: int = 0, start: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """(series_id, rep, theta): coefficients of each replicate from 1 on; ``rep`` 0 is the fit itself.

    Observed rows are cut into blocks of ``block`` (of all, if a series has fewer); each gets the residuals of as
    many consecutive observed rows. ``start(rep, block number, choices)`` gives their first, from 0; without
    it draws come from a hash of series, rep, block and ``seed``. Series without an observed row have no rows.
    """
    check_draws(block, resamples)
    moves, (columns, penalty) = shifts(model), design(model)
    p = len(columns)

    def fitted(s: np.ndarray, n: int) -> list[dict]:
        gain = scaled_inverse(s[:p, :p] / n + np.diag(penalty)) / n
        theta = gain @ s[:p, p + 1]
        return [{"theta": theta.tolist(), "base": (gain @ s[:p, :p] @ theta).tolist(), "gain": gain.tolist(), "m": int(s[p, p])}] if s[p, p] else []

    fits = reliable(by_series(gram_sums(df, columns), fitted, "theta array<double>, base array<double>, gain array<array<double>>, m bigint"))
    pieces = reliable(_pieces(fitted_curves(df, model, fits, lambda m: design(m)[0]).where(observed()), columns, block))

    # targets: each piece, in each replicate, asks for as many residuals from the drawn place on
    sizes = fits.select(F.col("series_id").alias("_of"), "m")
    targets = pieces.select("series_id", "bucket", "offset", "low", "high").join(sizes, F.col("series_id").eqNullSafe(F.col("_of")))
    choices = F.col("m") - F.least(F.col("m"), F.lit(block)) + 1
    hashed = lambda rep, number, many: F.pmod(F.xxhash64(F.col("series_id"), rep, number, F.lit(seed)), many)
    targets = targets.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    targets = targets.withColumn("back", (start or hashed)(F.col("rep"), F.col("bucket"), choices) - F.col("bucket") * block)  # source rank less target rank
    targets = targets.withColumns({"low": F.col("low") + F.col("back"), "high": F.col("high") + F.col("back")})
    number = lambda rank: F.floor((rank - 1) / block)
    targets = targets.select(F.col("series_id").alias("_series"), "rep", "back", F.col("offset").alias("_offset"), F.col("low").alias("_low"), F.col("high").alias("_high"), F.explode(F.sequence(number(F.col("low")), number(F.col("high")))).alias("_bucket"))
    met = pieces.join(targets, F.col("series_id").eqNullSafe(F.col("_series")) & (F.col("bucket") == F.col("_bucket")))
    met = met.withColumns({"a": F.greatest("low", "_low"), "b": F.least("high", "_high")}).where("a <= b")
    met = met.select("series_id", "rep", (F.col("_offset") - F.col("offset") - F.col("back")).cast("double").alias("h"), F.get("sums", (F.col("b") - F.col("low")).cast("int"))["s"].alias("upto"), F.get("sums", (F.col("a") - F.col("low") - 1).cast("int"))["s"].alias("before"))
    own = [F.col("upto")[i] - F.coalesce(F.col("before")[i], F.lit(0.0)) for i in range(p)]
    moved = [sum((f(F.col("h")) * own[i] for i, f in mix.items()), F.lit(0.0)) for mix in moves]
    totals = met.groupBy("series_id", "rep").agg(*[F.sum(v).alias(f"_b{i}") for i, v in enumerate(moved)])
    of = fits.select(F.col("series_id").alias("_of"), "base", "gain")
    dot = lambda row: sum((row[j] * F.col(f"_b{j}") for j in range(p)), F.lit(0.0))
    theta = F.zip_with("base", F.transform("gain", dot), lambda x, y: x + y)
    drawn = totals.join(of, F.col("series_id").eqNullSafe(F.col("_of"))).select("series_id", "rep", theta.alias("theta"))
    return fits.select("series_id", F.lit(0).alias("rep"), "theta").union(drawn)


def _pieces(rows: DataFrame, columns: list[Column], block: int) -> DataFrame:
    """(series_id, bucket, offset, low, high, sums): ranks of observed rows in one block whose places less ranks are one ``offset``.

    ``sums`` holds, by rank, the running sums inside the piece of columns times residuals.
    """
    products = {f"_x{i}": c.cast("double") * F.col("residual") for i, c in enumerate(columns)}
    seen = ranges.scan(ranges.by_place(rows.select("series_id", "t", *[c.alias(k) for k, c in products.items()])), totals={"rank": F.lit(1).cast("long")})
    seen = seen.withColumns({"bucket": F.floor((F.col("rank") - 1) / block), "offset": F.col("t") - F.col("rank")})
    inside = Window.partitionBy("series_id", "bucket", "offset").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = seen.select("series_id", "bucket", "offset", "rank", F.array(*[F.sum(k).over(inside) for k in products]).alias("s"))
    return running.groupBy("series_id", "bucket", "offset").agg(F.min("rank").alias("low"), F.max("rank").alias("high"), F.array_sort(F.collect_list(F.struct("rank", "s"))).alias("sums"))


def bootstrap_intervals(thetas: DataFrame, model: Model, extractors: Mapping[str, Column | str], confidence: float = 68.2, min_success: float = 0.5) -> DataFrame:
    """(series_id, scalar, point, low, high, used): percentile intervals of several scalars over replicates.

    ``extractors`` are expressions over ``coefficient_names``. Values that are null or NaN are failures; a
    scalar of a series with too few successes is left out.
    """
    check_draws(1, 1, confidence)
    named = thetas.select("series_id", "rep", *[F.col("theta")[i].alias(k) for i, k in enumerate(coefficient_names(model))])
    each = [F.struct(F.lit(k).alias("scalar"), (F.expr(e) if isinstance(e, str) else e).cast("double").alias("value")) for k, e in extractors.items()]
    values = named.select("series_id", "rep", F.inline(F.array(*each))).withColumn("value", F.nanvl("value", F.lit(None)))
    drawn, tail = F.when(F.col("rep") > 0, F.col("value")), (100 - confidence) / 200
    cut = values.groupBy("series_id", "scalar").agg(
        F.max(F.when(F.col("rep") == 0, F.col("value"))).alias("point"), F.percentile(drawn, F.array(F.lit(tail), F.lit(1 - tail))).alias("p"), F.count(drawn).alias("used"), F.max("rep").alias("asked"),
    )
    return cut.where(F.col("used") >= F.greatest(min_success * F.col("asked"), F.lit(1.0))).select("series_id", "scalar", "point", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"), "used")
