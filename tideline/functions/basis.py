"""Period constants, seasonal and spline bases, and the losses as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seconds in a day, a week and a mean Gregorian year.
DAY, WEEK, YEAR = 86400.0, 7 * 86400.0, 365.2425 * 86400.0


def period_samples(seconds: float, delta: float) -> float:
    """A period in samples; never rounded."""
    if delta <= 0:
        raise ValueError("delta must be positive")
    return seconds / delta


def samples_per_year(delta: float) -> float:
    """Samples of a mean year, for a step of ``delta`` seconds."""
    return period_samples(YEAR, delta)


def plan(periods: Sequence[float] | float, harmonics: Sequence[int] | int, standing: Sequence[bool] | bool = False) -> list[tuple[float, int, bool]]:
    """(period, harmonics, standing), longest period first."""
    ps = [float(periods)] if np.isscalar(periods) else [float(p) for p in periods]
    hs = [int(harmonics)] * len(ps) if np.isscalar(harmonics) else [int(h) for h in harmonics]
    waves = [bool(standing)] * len(ps) if np.isscalar(standing) else [bool(s) for s in standing]
    if not len(ps) == len(hs) == len(waves):
        raise ValueError("one harmonic count and wave form are needed for each period")
    return sorted(zip(ps, hs, waves, strict=True), reverse=True)


def seasonal_matrix(t: np.ndarray, periods: Sequence[float] | float, harmonics: Sequence[int] | int = 6, standing: Sequence[bool] | bool = False, max_cross: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Columns without the offset, and each one's penalty per unit weight.

    Each period has interleaved cosines and sines (where ``standing``, half-period sines of the phase);
    each pair of periods has all products of their first ``2 * max_cross`` columns, which carry the
    shorter period's penalty.
    """
    blocks, weights = [], []
    for period, count, wave in plan(periods, harmonics, standing):
        if wave:
            columns = [np.sin(i * math.pi / period * np.mod(t, period)) for i in range(1, count + 1)]
            order = np.arange(1, count + 1)
        else:
            angles = [i * 2 * math.pi / period * t for i in range(1, count + 1)]
            columns = [f(a) for a in angles for f in (np.cos, np.sin)]
            order = np.repeat(np.arange(1, count + 1), 2)
        blocks.append(np.stack(columns, 1) if columns else np.empty((len(t), 0)))
        weights.append(2 * math.pi / math.sqrt(period) * order)
    out, pen = list(blocks), list(weights)
    for i in range(len(blocks)):
        for j in range(i + 1, len(blocks)):
            cut = slice(None if max_cross is None else 2 * max_cross)
            one, two = blocks[i][:, cut], blocks[j][:, cut]
            out.append((one[:, :, None] * two[:, None, :]).reshape(len(t), -1))
            pen.append(np.tile(weights[j][cut], one.shape[1]))
    return np.concatenate(out, 1), np.concatenate(pen)


def seasonal_columns(t: Column, periods: Sequence[float] | float, harmonics: Sequence[int] | int = 6) -> list[Column]:
    """The same columns (no products of periods) as expressions."""
    return [f(t * (i * 2 * math.pi / period)) for period, count, _ in plan(periods, harmonics) for i in range(1, count + 1) for f in (F.cos, F.sin)]


def seasonal_design(
    t: Column, periods: Sequence[float] | float, harmonics: Sequence[int] | int = 6, standing: Sequence[bool] | bool = False, max_cross: int | None = None,
) -> tuple[list[Column], list[float]]:
    """``seasonal_matrix`` as expressions: columns of all periods and of their products, and each one's penalty per unit weight."""
    blocks = []
    for period, count, wave in plan(periods, harmonics, standing):
        size, orders = 2 * math.pi / math.sqrt(period), range(1, count + 1)
        if wave:
            phase = t - F.floor(t / period) * period
            blocks.append([(F.sin(phase * (i * math.pi / period)), size * i) for i in orders])
        else:
            blocks.append([(f(t * (i * 2 * math.pi / period)), size * i) for i in orders for f in (F.cos, F.sin)])
    cut = None if max_cross is None else 2 * max_cross
    crossed = [(x * z, w) for a, one in enumerate(blocks) for two in blocks[a + 1 :] for x, _ in one[:cut] for z, w in two[:cut]]
    every = [pair for block in blocks for pair in block] + crossed
    return [c for c, _ in every], [w for _, w in every]


def with_custom_basis(df: DataFrame, table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with the columns of a basis ``table`` (row, columns), repeated along t for as long as the series is.

    Row ``t % n`` of the table's n rows, which are numbered from 0 without gaps, goes to place t.
    """
    ends = table.agg(F.count("*").alias("n"), F.min("row").alias("low"), F.max("row").alias("high"), F.count_distinct("row").alias("rows")).first()
    if not ends.n or (ends.low, ends.high, ends.rows) != (0, ends.n - 1, ends.n):
        raise ValueError("a basis table needs rows numbered from 0 without gaps")
    block = table.select(F.col("row").alias("_row"), *columns)
    return df.join(block, F.pmod(F.col("t"), F.lit(ends.n)) == F.col("_row"), "left").drop("_row")


def default_knots(low: float, high: float, n_knots: int = 10) -> list[float]:
    if n_knots < 3 or not (math.isfinite(low) and math.isfinite(high)):
        raise ValueError("a spline needs 3 knots and finite values")
    return np.linspace(low, high, n_knots).tolist()


def spline_matrix(x: np.ndarray, knots: Sequence[float]) -> np.ndarray:
    """Natural cubic spline columns without the constant: x, then ``d_i - d_(K-2)``."""
    k = np.asarray(knots, float)
    if len(k) < 3:
        raise ValueError("a spline needs 3 knots")

    def d(i: int) -> np.ndarray:
        return (np.maximum(x - k[i], 0) ** 3 - np.maximum(x - k[-1], 0) ** 3) / (k[-1] - k[i])

    return np.stack([x, *[d(i) - d(len(k) - 2) for i in range(len(k) - 2)]], 1)


def spline_columns(x: Column, knots: Sequence[float | Column]) -> list[Column]:
    """The same as expressions; knots may be columns, and where they fall together the columns but x are 0."""
    if len(knots) < 3:
        raise ValueError("a spline needs 3 knots")
    ks = [k if isinstance(k, Column) else F.lit(float(k)) for k in knots]

    def d(i: int) -> Column:
        up = lambda v: F.pow(F.greatest(x - v, F.lit(0.0)), F.lit(3.0))
        return F.coalesce((up(ks[i]) - up(ks[-1])) / F.nullif(ks[-1] - ks[i], F.lit(0.0)), F.lit(0.0))

    return [x, *[d(i) - d(len(ks) - 2) for i in range(len(ks) - 2)]]


def loss(name: str, x: Column, length: Column, param: float = 1.0) -> Column:
    """A residual loss as an aggregate: sums over x, divided by the grid's length."""
    if name == "l2":
        return F.sum(x * x) / length
    if name == "l1":
        return F.sum(F.abs(x)) / length
    if name == "huber":
        return F.sum(F.when(F.abs(x) <= param, x * x).otherwise(2 * param * F.abs(x) - param * param)) / length
    if name == "quantile":
        if not 0 < param < 1:
            raise ValueError("a quantile lies between 0 and 1")
        return 2 * F.sum(F.greatest(param * x, (param - 1) * x)) / length
    raise ValueError(f"unknown loss {name!r}")
