"""Refits as rows: holdout selection, expanding windows and block bootstrap.

Candidates, windows and replicates multiply the series' rows and are solved group by group.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.plans import ranges
from tideline.plans.decompose import decompose, fit_groups, solved_row
from tideline.plans.resample import check_draws
from tideline.plans.specs import Model


def centre_block(df: DataFrame, fraction: float = 0.2) -> DataFrame:
    """``df`` with ``held``: the middle share of a series' observed rows (half-even rounding, at least one)."""
    seen = df["y"].isNotNull()
    ranked = ranges.scan(ranges.by_place(df), totals={"_rank": seen.cast("long")})
    counts = df.groupBy(F.col("series_id").alias("_of")).agg(F.count("y").alias("_total"))
    n = F.greatest(F.lit(1), F.bround(F.col("_total") * fraction).cast("int"))
    start, rank = F.floor((F.col("_total") - n) / 2), F.col("_rank") - 1
    held = F.col("y").isNotNull() & (rank >= start) & (rank < start + n)
    return ranked.join(counts, F.col("series_id").eqNullSafe(F.col("_of"))).select(*df.columns, held.alias("held"))


def holdout_scores(df: DataFrame, candidates: Sequence[tuple[str, Model]], metric: str = "rmse", keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """(keys, place, candidate, score) on the rows of ``df`` that are ``held``; failed fits score null."""
    keys = list(keys)
    models = dict(enumerate(m for _, m in candidates))
    columns = list(dict.fromkeys(c for _, m in candidates for c in m.columns))
    names = F.array(*[F.lit(n) for n, _ in candidates])
    each = df.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(len(candidates) - 1))))
    masked = each.select(*keys, "place", "t", F.when(~F.col("held"), F.col("y")).alias("y"), *columns)
    fits = fit_groups(masked, [*keys, "place"], lambda g: models[int(g["place"].iloc[0])])
    value = F.aggregate(F.map_values("roles"), F.transform("t", lambda _: F.lit(0.0)), lambda s, r: F.zip_with(s, r, lambda a, b: a + b))
    fitted = fits.select(*keys, "place", F.explode(F.when(F.size("roles") > 0, F.arrays_zip("t", value.alias("v"))).otherwise(F.transform("t", lambda t: F.struct(t.alias("t"), F.lit(None).cast("double").alias("v"))))).alias("r")).select(*keys, "place", "r.t", "r.v")
    gap = F.col("y") - F.col("v")
    score = F.sqrt(F.avg(gap * gap)) if metric == "rmse" else F.avg(F.abs(gap))
    truth = df.where("held").select(*keys, "t", "y")
    return fitted.join(truth, [*keys, "t"]).groupBy(*keys, "place").agg(score.alias("score")).withColumn("candidate", F.element_at(names, F.col("place") + 1))


def calendar_blocks(df: DataFrame, part: str = "year") -> DataFrame:
    """``df`` with ``block``: the calendar year (or quarter, month, week) of ``ts``."""
    return df.withColumn("block", F.date_trunc(part, "ts").cast("date"))


def block_scores(df: DataFrame, candidates: Sequence[tuple[str, Model]], metric: str = "rmse") -> DataFrame:
    """(series_id, fold, place, candidate, score): every ``block`` of a series held out in turn, for every candidate."""
    folds = df.where("y is not null").select("series_id", F.col("block").alias("fold")).distinct()
    each = df.join(folds, "series_id").withColumn("held", F.col("y").isNotNull() & (F.col("block") == F.col("fold")))
    return holdout_scores(each, candidates, metric, ("series_id", "fold"))


def line_block_scores(df: DataFrame, weights: Sequence[float]) -> DataFrame:
    """``block_scores`` (rmse) of lines with slope ``weights``, from sums alone: no series is gathered.

    (series_id, fold, weight, score). A fold's sums are the series' less the block's.
    """
    x, y = F.col("t").cast("double"), F.col("y")
    names = ("n", "m", "sx", "sy", "sxx", "sxy", "syy")
    sums = (F.count("*"), F.count(y), F.sum(F.when(y.isNotNull(), x)), F.sum(y), F.sum(F.when(y.isNotNull(), x * x)), F.sum(x * y), F.sum(y * y))
    blocks = df.groupBy("series_id", F.col("block").alias("fold")).agg(*[s.cast("double").alias(k) for k, s in zip(names, sums, strict=True)])
    every = Window.partitionBy("series_id")
    for k in names:
        blocks = blocks.withColumn(f"all_{k}", F.sum(k).over(every))
    m, sx, sy, sxx, sxy = (F.col(f"all_{k}") - F.col(k) for k in ("m", "sx", "sy", "sxx", "sxy"))
    lines = blocks.where("m > 0").withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    # the series' length counts held rows too: they are masked, not removed
    lines = lines.withColumn("b", (sxy - sx * sy / m) / (sxx - sx * sx / m + F.col("weight") * F.col("all_n"))).withColumn("a", (sy - F.col("b") * sx) / m)
    square = F.expr("syy - 2 * a * sy - 2 * b * sxy + m * a * a + 2 * a * b * sx + b * b * sxx")
    return lines.select("series_id", "fold", "weight", F.sqrt(F.greatest(square, F.lit(0.0)) / F.col("m")).alias("score"))


def select_best(scores: DataFrame) -> DataFrame:
    """(series_id, candidate, score): the lowest finite score, ties to the first candidate."""
    best = scores.where(F.col("score").isNotNull() & ~F.isnan("score")).groupBy("series_id").agg(F.min_by(F.struct("candidate", "score"), F.struct("score", "place")).alias("b"))
    return best.select("series_id", "b.candidate", "b.score")


def score_summary(scores: DataFrame, *by: str) -> DataFrame:
    return scores.groupBy(*by).agg(F.median("score").alias("median"), F.stddev_samp("score").alias("std"))


def near_minimum(scores: DataFrame, delta: float, by: str = "family", absolute: bool = False) -> DataFrame:
    """Per ``by`` the largest weight whose score is at most the least score times 1 + ``delta`` (``absolute``: plus it).

    Scores that are not finite take no part.
    """
    finite = scores.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))
    low = F.min("score").over(Window.partitionBy(by))
    most = F.col("low") + delta if absolute else F.col("low") * (1 + delta)
    return finite.withColumn("low", low).where(F.col("score") <= most).groupBy(by).agg(F.max("weight").alias("weight"))


def admissible(scans: DataFrame, least_gain: float, most_changes: int, least_jump: float, by: str = "family") -> DataFrame:
    """(by, weight, found) from ``scans(by, weight, gain, changes, jump)`` over all observed data.

    The least weight whose fit gains enough, changes seldom enough and never by less than a jump that
    matters; where there is none, the largest weight, with ``found`` false. A fit without changes has
    no jump (null), and is no event.
    """
    good = (F.col("gain") >= least_gain) & F.col("changes").between(1, most_changes) & (F.col("jump") >= least_jump)
    out = scans.groupBy(by).agg(F.min(F.when(good, F.col("weight"))).alias("least"), F.max("weight").alias("most"))
    return out.select(by, F.coalesce("least", "most").alias("weight"), F.col("least").isNotNull().alias("found"))


def valid_endpoints(df: DataFrame, min_window: int, step: int) -> DataFrame:
    """(series_id, n): window lengths min, min + step, ... and the whole, moved back to end on an observed row."""
    length = df.groupBy("series_id").agg(F.max("t").alias("last")).withColumn("length", F.col("last") + 1)
    listed = F.when(F.col("length") >= min_window, F.sequence(F.lit(min_window).cast("long"), F.col("length"), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    asked = length.select("series_id", F.explode(F.array_distinct(F.concat(listed, F.array("length")))).alias("w"))
    # the last observed row before each asked end, by one scan over rows and ends in order
    rows = df.where("y is not null").select("series_id", F.col("t").alias("at"), F.lit(None).cast("bigint").alias("w"), (F.col("t") + 1).alias("seen"))
    ends = asked.select("series_id", (F.col("w") - 1).alias("at"), "w", F.lit(None).cast("bigint").alias("seen"))
    both = ranges.by_place(rows.union(ends), place="at").withColumn("order", F.struct("at", F.col("w").isNotNull().alias("end")))
    moved = ranges.scan(both, "order", latest={"n": "seen"}).where("w is not null")
    return moved.where(F.col("n") >= min_window).select("series_id", "n").distinct()


def expanding_fits(df: DataFrame, model: Model, min_window: int, step: int) -> DataFrame:
    """One solution per series and window length ``n``; a failed one has its status."""
    rows = df.select("series_id", "t", "y", *model.columns).join(valid_endpoints(df, min_window, step), "series_id").where("t < n")
    return fit_groups(rows, ["series_id", "n"], lambda _: model)


def expanding_lines(df: DataFrame, min_window: int, step: int, slope_weight: float = 0.0) -> DataFrame:
    """(series_id, n, trend_a, trend_b) of a line in every expanding window, from running sums of one pass."""
    x, y = F.col("t").cast("double"), F.col("y")
    seen = ranges.by_place(df.where(y.isNotNull()).select("series_id", "t", "y"))
    sums = {"m": F.lit(1), "sx": x, "sy": y, "sxx": x * x, "sxy": x * y}
    running = ranges.scan(seen, totals=sums).withColumn("n", F.col("t") + 1)
    ends = running.join(valid_endpoints(df, min_window, step), ["series_id", "n"])
    b = F.expr("(sxy - sx * sy / m)") / (F.expr("sxx - sx * sx / m") + slope_weight * F.col("n"))
    return ends.withColumn("trend_b", b).select("series_id", "n", ((F.col("sy") - F.col("trend_b") * F.col("sx")) / F.col("m")).alias("trend_a"), "trend_b")


def line_stability(lines: DataFrame) -> DataFrame:
    """``stability`` of lines from their coefficients: (series_id, n, next_n, rmsd) over the earlier window."""
    by_n = Window.partitionBy("series_id").orderBy("n")
    both = lines.withColumns({"next_n": F.lead("n").over(by_n), "da": F.lead("trend_a").over(by_n) - F.col("trend_a"), "db": F.lead("trend_b").over(by_n) - F.col("trend_b")})
    n = F.col("n").cast("double")
    first, second = (n - 1) / 2, (n - 1) * (2 * n - 1) / 6  # means of t and of its square
    power = lambda a, b: a * a + 2 * a * b * first + b * b * second
    moved = F.sqrt(F.greatest(power(F.col("da"), F.col("db")), F.lit(0.0)))
    return both.where("next_n is not null").select("series_id", "n", "next_n", (moved / (F.sqrt(power(F.col("trend_a"), F.col("trend_b"))) + 1e-12)).alias("rmsd"))


def stability(fits: DataFrame, role: str) -> DataFrame:
    """(series_id, n, next_n, rmsd, sdelta): how far a role moves when the window grows, over the earlier window."""
    snap = fits.where(F.size("roles") > 0).select("series_id", "n", F.posexplode(F.col("roles")[role]).alias("t", "a"))
    following = fits.where(F.size("roles") > 0).select("series_id", "n", F.lead("n").over(Window.partitionBy("series_id").orderBy("n")).alias("next_n"))
    later = snap.select("series_id", F.col("n").alias("next_n"), "t", F.col("a").alias("b"))
    both = snap.join(following.where("next_n is not null"), ["series_id", "n"]).join(later, ["series_id", "next_n", "t"])
    gap = F.col("b") - F.col("a")
    sums = both.groupBy("series_id", "n", "next_n").agg(F.count("*").alias("m"), F.avg(gap * gap).alias("q"), F.avg(F.col("a") ** 2).alias("s"), F.avg(F.abs(gap)).alias("g"), F.avg(F.abs("a")).alias("h"))
    return sums.where("m >= 2").select("series_id", "n", "next_n", (F.sqrt("q") / (F.sqrt("s") + 1e-12)).alias("rmsd"), (F.col("g") / (F.col("h") + 1e-12)).alias("sdelta"))


def history(fits: DataFrame, scalar: str) -> DataFrame:
    """(series_id, n, value, delta): a scalar by window and its step to the next window."""
    value = F.col("scalars")[scalar]
    following = F.lead(value).over(Window.partitionBy("series_id").orderBy("n"))
    return fits.select("series_id", "n", value.alias("value"), F.abs(following - value).alias("delta"))


def converged_at(path: DataFrame, tol: float) -> DataFrame:
    """(series_id, n): the first window from which all values stay within ``tol`` of the last finite one; null if none."""
    by_n = Window.partitionBy("series_id").orderBy("n")
    final = F.last(F.when(~F.isnan("value"), F.col("value")), ignorenulls=True).over(by_n.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = path.withColumn("outside", F.coalesce(F.abs(F.col("value") - final) > tol, F.lit(True)))
    last_out = out.groupBy("series_id").agg(F.max(F.when(F.col("outside"), F.col("n"))).alias("bad"))
    later = path.join(last_out, "series_id").where(F.col("bad").isNull() | (F.col("n") > F.col("bad")))
    return last_out.select("series_id").join(later.groupBy("series_id").agg(F.min("n").alias("n")), "series_id", "left")


def bootstrap(df: DataFrame, model: Model, scalar: str, block: int, resamples: int = 500, confidence: float = 68.2, min_success: float = 0.5, seed: int = 0) -> DataFrame:
    """(series_id, point, low, high, used): percentile interval of a scalar over block-resampled refits.

    Blocks of observed residuals are drawn with replacement; draws are seeded by series and replicate.
    Series with too few successful refits are left out. ``resample.bootstrap_thetas`` serves lines and seasons without refits.
    """
    check_draws(block, resamples, confidence)
    base = decompose(df, model).where(F.size("roles") > 0)
    covariates = df.groupBy("series_id").agg(*[F.transform(F.array_sort(F.collect_list(F.struct("t", c))), lambda r, c=c: r[c]).alias(f"z_{c}") for c in model.columns]) if model.columns else None
    work = base if covariates is None else base.join(covariates, "series_id")
    work = work.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).repartition("series_id", "rep")
    kind = df.schema["series_id"].dataType.simpleString()

    def refit(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                y = np.array([np.nan if v is None else v for v in r.y], float)
                seen = np.isfinite(y)
                whole = sum(np.asarray(v, float) for v in dict(r.roles).values())
                left = np.asarray(r.residual, float)[seen]
                rng = np.random.default_rng([seed, int(r.rep), zlib.crc32(str(r.series_id).encode())])
                width = min(block, len(left))
                starts = rng.integers(0, len(left) - width + 1, math.ceil(len(left) / width))
                drawn = np.concatenate([left[s : s + width] for s in starts])[: len(left)]
                again = np.full(len(y), np.nan)
                again[seen] = whole[seen] + drawn
                group = pd.DataFrame({"t": r.t, "y": again} | {c: getattr(r, f"z_{c}") for c in model.columns})
                got = solved_row(group, model)
                rows.append((r.series_id, r.rep, got["scalars"].get(scalar)))
            yield pd.DataFrame(rows, columns=["series_id", "rep", "value"])

    values = work.mapInPandas(refit, f"series_id {kind}, rep int, value double")
    tail = (100 - confidence) / 200
    cut = values.groupBy("series_id").agg(F.percentile("value", F.array(F.lit(tail), F.lit(1 - tail))).alias("p"), F.count("value").alias("used"))
    point = base.select("series_id", F.col("scalars")[scalar].alias("point"))
    return point.join(cut, "series_id").where(F.col("used") >= min_success * resamples).select("series_id", "point", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"), "used")
