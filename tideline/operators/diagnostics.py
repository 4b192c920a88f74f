"""Folding by day, profiles, spectra and residual checks over (series_id, t, y)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.plans import fourier, ranges


def steps_per_day(delta: float) -> int:
    n = round(86400 / delta) if delta > 0 else 0
    if delta <= 0 or delta > 86400 or abs(86400 / delta - n) > 1e-6:
        raise ValueError("the step must divide a day")
    return n


def fold(df: DataFrame, delta: float, value: str = "y", trim: bool = True) -> DataFrame:
    """(series_id, day, step, value); leading and trailing days without a value are left out."""
    n = steps_per_day(delta)
    out = df.select("series_id", F.floor(F.col("t") / n).cast("long").alias("day"), (F.col("t") % n).cast("int").alias("step"), F.col(value).alias("value"))
    if not trim:
        return out
    full = out.where("value is not null").groupBy("series_id").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    return out.join(full, "series_id").where("day between lo and hi").drop("lo", "hi")


def fold_matrix(folded: DataFrame, days: list[int]) -> DataFrame:
    """One row per step, one column per day of ``days``."""
    return folded.groupBy("series_id", "step").pivot("day", days).agg(F.first("value"))


def profile(folded: DataFrame) -> DataFrame:
    """(series_id, step, mean): the mean by time of day; also of residuals, to see bias."""
    return folded.groupBy("series_id", "step").agg(F.avg("value").alias("mean"))


def peak_and_trough(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("series_id").agg(F.min_by("step", F.struct(-F.col("mean"), "step")).alias("peak"), F.min_by("step", F.struct("mean", "step")).alias("trough"))


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation over rows with both values; null where one of them does not vary."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def day_correlation(folded: DataFrame, one: int, other: int) -> DataFrame:
    """(series_id, corr) of two days' profiles."""
    a = folded.where(F.col("day") == one).select("series_id", "step", F.col("value").alias("a"))
    b = folded.where(F.col("day") == other).select("series_id", "step", F.col("value").alias("b"))
    return a.join(b, ["series_id", "step"]).groupBy("series_id").agg(correlation("a", "b").alias("corr"))


def periodogram(df: DataFrame, top: int = 6) -> DataFrame:
    """(series_id, k, period, magnitude): the ``top`` strongest frequencies k / length of a series' centred values.

    The length is the series' own, ``max(t) + 1``. Missing values count as the mean. A long series' transform
    is spread over tasks; each gives its own strongest ones.
    """
    turn = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("magnitude"), "k"))
    found = fourier.magnitudes(df, top).withColumn("turn", turn).where(F.col("turn") <= top)
    return found.select("series_id", F.col("k").cast("int").alias("k"), (F.col("n") / F.col("k")).alias("period"), "magnitude")


def lag_correlation(df: DataFrame, value: str = "residual", adjacent: bool = False) -> DataFrame:
    """(series_id, ac1): lag-1 autocorrelation; with ``adjacent`` only of rows observed at t and t - 1."""
    seen = ranges.by_place(df.where(F.col(value).isNotNull()).select("series_id", "t", F.col(value).alias("v")))
    rows = ranges.scan(seen, previous={"a": "v", "before": "t"}).where("before is not null")
    return (rows.where("t = before + 1") if adjacent else rows).groupBy("series_id").agg(correlation("a", "v").alias("ac1"))


def largest(df: DataFrame, value: str = "residual", top: int = 10) -> DataFrame:
    """(series_id, t, value): a series' values of largest magnitude."""
    turn = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc(F.abs(value)), "t"))
    return df.where(F.col(value).isNotNull()).select("series_id", "t", F.col(value).alias("value"), turn.alias("place")).where(F.col("place") <= top)


def variance_explained(curves: DataFrame) -> DataFrame:
    """(series_id, explained): 1 - var(residual) / var(y) on observed rows."""
    return curves.where("y is not null").groupBy("series_id").agg((1 - F.var_pop("residual") / F.nullif(F.var_pop("y"), F.lit(0.0))).alias("explained"))


def _moves(curves: DataFrame, role: str, order: int = 1) -> DataFrame:
    """``curves`` with ``part`` and ``moved``: a role's difference of ``order`` from the rows before."""
    rows = ranges.by_place(curves).withColumn("moved", F.col(role))
    for _ in range(order):
        rows = ranges.scan(rows, previous={"was": "moved"}).withColumn("moved", F.col("moved") - F.col("was")).drop("was")
    return rows


def change_counts(curves: DataFrame, role: str, least: float, order: int = 1) -> DataFrame:
    """(series_id, changes): differences of ``order`` larger than ``least`` in magnitude."""
    return _moves(curves.select("series_id", "t", role), role, order).groupBy("series_id").agg(F.count_if(F.abs("moved") > least).alias("changes"))


def change_rows(curves: DataFrame, role: str, least: float) -> DataFrame:
    """(series_id, t, jump): where a role moves by more than ``least`` from one row to the next."""
    return _moves(curves.select("series_id", "t", role), role).where(F.abs("moved") > least).select("series_id", "t", F.col("moved").alias("jump"))


def refit_levels(curves: DataFrame, role: str, least: float) -> DataFrame:
    """``curves`` with ``refit``: unpenalized levels on a piecewise-constant role's own change points.

    Between changes of more than ``least``, the mean of y less all other roles.
    """
    jump = F.coalesce(F.abs("moved") > least, F.lit(False)).cast("long")
    pieces = ranges.scan(_moves(curves, role), totals={"piece": jump})
    rest = F.col("y") - F.col("reconstruction") + F.col(role)
    levels = pieces.groupBy("series_id", "piece").agg(F.avg(rest).alias("refit"))
    return pieces.join(levels, ["series_id", "piece"]).select(*curves.columns, "refit")


def refit_kinks(curves: DataFrame, role: str, least: float) -> DataFrame:
    """``curves`` with ``refit``: an unpenalized continuous line with kinks at a piecewise-linear role's own places.

    A kink is where the role's slope changes by more than ``least``; y less all other roles is fitted.
    Kinks that the observed rows cannot fix are left out; a series with one observed row gets its
    level, one with none null. Pieces are summed apart; a task solves over a series' kinks, not its rows.
    """
    rows = ranges.scan(ranges.by_place(curves), previous={"_before": "t", "_was": role})
    rows = rows.withColumn("_slope", (F.col(role) - F.col("_was")) / (F.col("t") - F.col("_before")))
    rows = ranges.scan(rows, previous={"_last": "_slope"})
    bent = F.coalesce(F.abs(F.col("_slope") - F.col("_last")) > least, F.lit(False))
    rows = rows.withColumn("_knot", F.when(F.col("_before").isNull(), F.col("t")).when(bent, F.col("_before")))
    rows = ranges.scan(rows, totals={"piece": bent.cast("long")}, latest={"_start": "_knot"})
    d, rest = (F.col("t") - F.col("_start")).cast("double"), F.nanvl("y", F.lit(None)) - F.col("reconstruction") + F.col(role)
    seen = rest.isNotNull()
    sums = [F.count_if(seen), *[F.coalesce(F.sum(F.when(seen, v)), F.lit(0.0)) for v in (d, d * d, rest, d * rest)]]
    pieces = rows.groupBy("series_id", "piece").agg(F.min("_start").alias("start"), F.max("t").alias("stop"), F.array(*[s.cast("double") for s in sums]).alias("sums"))
    kind = curves.schema["series_id"].dataType.simpleString()

    def lines(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("piece")
        level, slope = kinked_line(g["start"].to_numpy(float), g["stop"].to_numpy(float), np.stack(g["sums"].to_numpy()))
        return pd.DataFrame({"series_id": g["series_id"], "piece": g["piece"], "level": level, "slope": slope})

    fitted = pieces.groupBy("series_id").applyInPandas(lines, f"series_id {kind}, piece bigint, level double, slope double")
    fitted = fitted.select(F.col("series_id").alias("_of"), F.col("piece").alias("_piece"), "level", "slope")
    out = rows.join(fitted, F.col("series_id").eqNullSafe(F.col("_of")) & (F.col("piece") == F.col("_piece")))
    return out.select(*[F.col(c) for c in curves.columns], (F.col("level") + F.col("slope") * d).alias("refit"))


def kinked_line(start: np.ndarray, stop: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level at its start and slope of each piece of the best continuous line.

    Pieces go from ``start`` to ``stop``, which is the next one's start; ``sums`` are, over a piece's observed rows,
    their number and the sums of d, d^2, v and d v, with d from its start. Heights at the kinks have a tridiagonal system.
    """
    groups = [[i] for i in range(len(start))]
    if not sums[:, 0].any():
        return np.full(len(start), np.nan), np.full(len(start), np.nan)
    while True:
        low, high = start[[g[0] for g in groups]], stop[[g[-1] for g in groups]]
        m, d, dd, v, dv = np.array([_shifted(sums[g], start[g] - start[g[0]]) for g in groups]).T
        size = np.maximum(high - low, 1.0)
        right, both = dd / size**2, d / size - dd / size**2
        left = m - 2 * d / size + right
        diagonal, force = np.zeros(len(groups) + 1), np.zeros(len(groups) + 1)
        diagonal[:-1] += left
        diagonal[1:] += right
        force[:-1] += v - dv / size
        force[1:] += dv / size
        pivots, bad = diagonal.copy(), None
        for i in range(len(pivots)):
            if i:
                pivots[i] -= both[i - 1] ** 2 / pivots[i - 1]
                force[i] -= both[i - 1] / pivots[i - 1] * force[i - 1]
            if pivots[i] <= 1e-10 * max(diagonal[i], 1e-300):
                bad = i
                break
        if bad is None:
            break
        if len(groups) == 1:
            return np.full(len(start), v[0] / m[0]), np.zeros(len(start))
        k = min(max(bad, 1), len(groups) - 1)
        groups[k - 1 : k + 1] = [groups[k - 1] + groups[k]]
    height = force / pivots
    for i in range(len(height) - 2, -1, -1):
        height[i] -= both[i] / pivots[i] * height[i + 1]
    slope = np.repeat(np.diff(height) / size, [len(g) for g in groups])
    level = np.repeat(height[:-1], [len(g) for g in groups]) + slope * (start - np.repeat(low, [len(g) for g in groups]))
    return level, slope


def _shifted(sums: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The sums of neighbouring pieces, all with d from the first one's start."""
    m, d, dd, v, dv = sums.T
    return np.array([m.sum(), (d + by * m).sum(), (dd + 2 * by * d + by * by * m).sum(), v.sum(), (dv + by * v).sum()])


def amplitude(curves: DataFrame, role: str, log: bool = False) -> DataFrame:
    """(series_id, amplitude): a role's range; of a ``log`` model, in percent."""
    size = F.max(role) - F.min(role)
    return curves.groupBy("series_id").agg((100 * F.expm1(size) if log else size).alias("amplitude"))


def peak_weeks(curves: DataFrame, role: str) -> DataFrame:
    """(series_id, peak_week, trough_week): the ISO weeks of a role's largest and least mean, ties to the first."""
    weekly = curves.groupBy("series_id", F.weekofyear("ts").alias("week")).agg(F.avg(role).alias("mean"))
    return weekly.groupBy("series_id").agg(F.min_by("week", F.struct(-F.col("mean"), "week")).alias("peak_week"), F.min_by("week", F.struct("mean", "week")).alias("trough_week"))


def by_covariate(curves: DataFrame, role: str, column: str) -> DataFrame:
    """(series_id, place, z, value): a role in the order of a covariate, to see its shape."""
    turn = F.row_number().over(Window.partitionBy("series_id").orderBy(column, "t"))
    return curves.where(F.col(column).isNotNull()).select("series_id", turn.alias("place"), F.col(column).alias("z"), F.col(role).alias("value"))


def degradation_rate(curves: DataFrame, role: str, per_year: float, mode: str = "absolute") -> DataFrame:
    """(series_id, rate): annualized chord slope; ``relative`` in percent of the start, ``log`` as expm1 percent."""
    ends = curves.where(F.col(role).isNotNull()).groupBy("series_id").agg(F.min_by(role, "t").alias("a"), F.max_by(role, "t").alias("b"), (F.max("t") - F.min("t")).alias("d")).where("d > 0")
    slope = (F.col("b") - F.col("a")) / F.col("d") * per_year
    rate = {"absolute": slope, "relative": 100 * slope / F.col("a"), "log": 100 * F.expm1(slope)}[mode]
    return ends.select("series_id", rate.alias("rate"))
