"""The registered queries of the decomposition engine, and their SQL for DuckDB.

Series come from ``events`` (hourly sums by event type), from
``orders`` (daily totals by priority) and from ``lineitem``. Results are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import basis
from tideline.operators import certificates, diagnostics, reporting, timeaxis, transform, validation
from tideline.plans import decompose as fit
from tideline.plans import gram, levels, monotone, resample, smooth, specs
from tideline.plans.specs import Model
from tideline.sources.series import long_series

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Trend and daily cycle of hourly values: least squares from sums.
FLAGSHIP = Model((specs.linear_trend(), specs.multiperiodic(24.0, 2, 0.01, "daily")))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, t, ts, y): summed event values on a regular grid, by event type."""
    step = 3600
    slot = F.timestamp_seconds(F.floor(timeaxis.seconds(F.col("ts")) / step) * step).cast("timestamp_ntz")
    sums = _table(spark, sf_dir, "events").groupBy("event_type", slot.alias("slot_time")).agg(F.round(F.sum("value"), 4).alias("v"))
    return timeaxis.to_grid(long_series(sums, "v", series=F.col("event_type"), ordinal="slot_time"), step)


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, t, y): order totals by priority and day since 1995-01-01; days without orders are absent."""
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long")
    return _table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), day.alias("t")).agg(F.round(F.sum("o_totalprice"), 2).alias("y"))


_HOURLY = """
WITH sums AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS h, round(sum(value), 4) AS v FROM events GROUP BY ALL),
spans AS (SELECT series_id, date_trunc('day', min(h)) AS start, date_trunc('day', max(h)) AS last FROM sums GROUP BY series_id),
grid AS (SELECT series_id, start, unnest(generate_series(0, (datediff('day', start, last) + 1) * 24 - 1)) AS t FROM spans),
hours AS (
  SELECT g.series_id, g.t, g.start + g.t * INTERVAL 1 HOUR AS ts, coalesce(a.v, b.v, c.v) AS y FROM grid g
  LEFT JOIN sums a ON a.series_id = g.series_id AND a.h = g.start + g.t * INTERVAL 1 HOUR
  LEFT JOIN sums b ON b.series_id = g.series_id AND b.h = g.start + (g.t + 1) * INTERVAL 1 HOUR
  LEFT JOIN sums c ON c.series_id = g.series_id AND c.h = g.start + (g.t - 1) * INTERVAL 1 HOUR)
"""
_DAILY = """
WITH daily AS (
  SELECT o_orderpriority AS series_id, datediff('day', DATE '1995-01-01', o_orderdate::DATE)::BIGINT AS t, round(sum(o_totalprice), 2) AS y
  FROM orders GROUP BY ALL)
"""


@_register(_HOURLY + "SELECT series_id, t::BIGINT AS t, ts::TIMESTAMP AS ts, y FROM hours")
def hourly_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir)


#: Each grid point's nearest event before and after it, of which the nearer within an hour fills it, ties to the later.
@_register("""
WITH e AS (SELECT event_type AS series_id, ts, arg_min(value, event_id) AS v FROM events GROUP BY ALL),
spans AS (SELECT series_id, date_trunc('day', min(ts)) AS start, date_trunc('day', max(ts)) AS last FROM e GROUP BY series_id),
grid AS (SELECT series_id, start, unnest(generate_series(0, (datediff('day', start, last) + 1) * {steps} - 1)) AS t FROM spans),
p AS (SELECT series_id, t, start + t * INTERVAL {minutes} MINUTE AS ts FROM grid),
b AS (SELECT p.series_id, p.t, p.ts, e.v, epoch_us(p.ts) - epoch_us(e.ts) AS d FROM p ASOF LEFT JOIN e ON p.series_id = e.series_id AND p.ts >= e.ts),
a AS (SELECT p.series_id, p.t, e.v, epoch_us(e.ts) - epoch_us(p.ts) AS d FROM p ASOF LEFT JOIN e ON p.series_id = e.series_id AND p.ts <= e.ts)
SELECT b.series_id, b.t::BIGINT AS t, b.ts::TIMESTAMP AS ts,
CASE WHEN a.d <= {minutes} * 6e7 AND coalesce(b.d > {minutes} * 6e7 OR a.d <= b.d, true) THEN a.v WHEN b.d <= {minutes} * 6e7 THEN b.v END AS y
FROM b JOIN a ON a.series_id = b.series_id AND a.t = b.t
""".format(steps=96, minutes=15))
def standardized_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = long_series(_table(spark, sf_dir, "events"), "value", "ts", F.col("event_type"), "event_id")
    return timeaxis.standardize(rows, "15min")


@_register("""
WITH d AS (SELECT DISTINCT o_orderpriority AS series_id, o_orderdate AS ts FROM orders),
g AS (SELECT series_id, epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER (PARTITION BY series_id ORDER BY ts)) / 1e6 AS gap FROM d)
SELECT series_id, gap, count(*) AS n FROM g WHERE gap > 0 GROUP BY ALL
""")
def gap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("ts"))
    return timeaxis.gaps(rows).groupBy("series_id", "gap").agg(F.count("*").alias("n"))


@_register("""
WITH d AS (SELECT DISTINCT o_orderpriority AS series_id, o_orderdate AS ts FROM orders),
g AS (SELECT series_id, epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER (PARTITION BY series_id ORDER BY ts)) / 1e6 AS gap FROM d),
c AS (SELECT series_id, gap, count(*) AS n FROM g WHERE gap > 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY n DESC, gap) AS place FROM c)
SELECT series_id, CASE WHEN abs(gap - 86400) <= 864 THEN 86400.0::DOUBLE ELSE gap END AS delta, CASE WHEN abs(gap - 86400) <= 864 THEN 'D' END AS freq
FROM r WHERE place = 1
""")
def derived_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("ts"))
    return timeaxis.standard_delta(rows)


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, ts): one stamp a day by priority, and an hour later where the day's orders are dear."""
    orders = _table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.date_trunc("day", "o_orderdate").alias("d")).agg(F.max("o_totalprice").alias("p"))
    later = orders.where(F.col("p") > 100000).select("series_id", (F.col("d").cast("timestamp") + F.expr("INTERVAL 1 HOUR")).cast("timestamp_ntz").alias("ts"))
    return orders.select("series_id", F.col("d").cast("timestamp_ntz").alias("ts")).union(later)


#: Gaps of ``_visits``, whose distinct lengths lie further apart than the clusters' tolerance.
_VISITS = """
WITH o AS (SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate) AS d, max(o_totalprice) AS p FROM orders GROUP BY ALL),
v AS (SELECT series_id, d::TIMESTAMP AS ts FROM o UNION ALL SELECT series_id, d::TIMESTAMP + INTERVAL 1 HOUR FROM o WHERE p > 100000),
g AS (SELECT series_id, lag(ts) OVER w AS before, epoch(ts) - epoch(lag(ts) OVER w) AS gap FROM v WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
c AS (SELECT series_id, gap, count(*) AS n FROM g WHERE gap > 0 GROUP BY series_id, gap),
k AS (SELECT *, n > 0.05 * sum(n) OVER (PARTITION BY series_id) AS common, row_number() OVER (PARTITION BY series_id ORDER BY n DESC, gap) AS place FROM c),
"""


@_register(_VISITS + """
m AS (SELECT series_id, count(*) FILTER (common) > 1 AS multiple_rates FROM k GROUP BY series_id)
SELECT series_id, gap AS rate, (SELECT gap FROM k b WHERE b.series_id = a.series_id AND b.place = 1) AS modal_seconds, multiple_rates
FROM k a JOIN m USING (series_id) WHERE common
""")
def sampling_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeaxis.scan_rates(_visits(spark, sf_dir), rel_tol=0.001)
    return found.select("series_id", F.explode("rates").alias("rate"), "modal_seconds", "multiple_rates")


@_register(_VISITS + """
a AS (SELECT g.series_id, before, arg_min(k.gap, {'d': abs(g.gap - k.gap), 'p': place}) AS rate FROM g JOIN k ON k.series_id = g.series_id AND common GROUP BY g.series_id, before, g.gap),
y AS (SELECT series_id, before::DATE AS day, median(rate) AS rate FROM a WHERE before IS NOT NULL GROUP BY ALL),
l AS (SELECT series_id, day, rate, lag(rate) OVER w AS was, lag(day) OVER w AS date_before FROM y WINDOW w AS (PARTITION BY series_id ORDER BY day))
SELECT series_id, date_before::VARCHAR AS date_before, day::VARCHAR AS date_after FROM l WHERE was != rate AND (SELECT count(*) FILTER (common) FROM k WHERE k.series_id = l.series_id) > 1
""")
def rate_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeaxis.rate_changes(_visits(spark, sf_dir), rel_tol=0.001)
    return found.select("series_id", *[F.col(c).cast("string").alias(c) for c in ("date_before", "date_after")])


@_register("""
WITH d AS (SELECT DISTINCT l_quantity * f AS delta FROM lineitem, (SELECT unnest([0.13, 1.19, 13, 173, 1740]) AS f)),
s AS (SELECT delta, unnest([
  {'n': 's', 's': 1}, {'n': '5s', 's': 5}, {'n': '15s', 's': 15}, {'n': '30s', 's': 30}, {'n': 'min', 's': 60},
  {'n': '5min', 's': 300}, {'n': '10min', 's': 600}, {'n': '15min', 's': 900}, {'n': '30min', 's': 1800}, {'n': 'h', 's': 3600},
  {'n': '2h', 's': 7200}, {'n': '3h', 's': 10800}, {'n': '6h', 's': 21600}, {'n': '12h', 's': 43200}, {'n': 'D', 's': 86400}]) AS step FROM d),
b AS (SELECT *, row_number() OVER (PARTITION BY delta ORDER BY abs(delta - step.s) / step.s, step.s) AS place FROM s)
SELECT round(delta, 6) AS delta, CASE WHEN abs(delta - step.s) / step.s <= 0.05 THEN step.s::DOUBLE END AS freq,
       CASE WHEN abs(delta - step.s) / step.s <= 0.05 THEN step.n END AS name
FROM b WHERE place = 1
""")
def standard_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors = F.explode(F.array(*[F.lit(f) for f in (0.13, 1.19, 13.0, 173.0, 1740.0)]))
    deltas = _table(spark, sf_dir, "lineitem").select("l_quantity").distinct().select("l_quantity", factors.alias("f")).select((F.col("l_quantity") * F.col("f")).alias("delta")).distinct()
    return deltas.select(F.round("delta", 6).alias("delta"), timeaxis.nearest_standard(F.col("delta"), 0.05).alias("freq"), timeaxis.standard_name(F.col("delta"), 0.05).alias("name"))


@_register(_DAILY + "SELECT series_id, round(regr_intercept(y, t), 3) AS trend_a, round(regr_slope(y, t), 6) AS trend_b FROM daily GROUP BY series_id")
def linear_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fit.linear_closed_form(daily_orders(spark, sf_dir))
    return got.select("series_id", F.round("trend_a", 3).alias("trend_a"), F.round("trend_b", 6).alias("trend_b"))


@_register(_DAILY + """, s AS (SELECT series_id, count(*) AS n, avg(t) AS mx, avg(y) AS my, regr_sxx(y, t) AS sxx, regr_sxy(y, t) AS sxy FROM daily GROUP BY series_id)
SELECT series_id, round(my - sxy / (sxx + 1000 * n) * mx, 3) AS trend_a, round(sxy / (sxx + 1000 * n), 6) AS trend_b FROM s""")
def linear_trend_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fit.linear_closed_form(daily_orders(spark, sf_dir), 1000.0)
    return got.select("series_id", F.round("trend_a", 3).alias("trend_a"), F.round("trend_b", 6).alias("trend_b"))


@_register("SELECT l_returnflag AS series_id, round(sum(l_quantity * l_extendedprice) / (sum(l_quantity * l_quantity) + 0.5 * count(*)), 6) AS beta FROM lineitem GROUP BY ALL")
def covariate_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("series_id"), F.col("l_extendedprice").alias("y"), "l_quantity")
    return fit.exog_closed_form(rows, "l_quantity", 0.5).select("series_id", F.round("beta", 6).alias("beta"))


@_register(_HOURLY + "SELECT series_id, t::BIGINT AS t, y, round(coalesce(sign(y) * greatest(abs(y) - 20, 0), 0), 4) AS sparse FROM hours")
def sparse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.sparse_closed_form(hourly(spark, sf_dir), 40.0).select("series_id", "t", "y", F.round("sparse", 4).alias("sparse"))


@_register(_HOURLY + "SELECT series_id, t::BIGINT AS t, round(CASE WHEN y > 1e-6 THEN ln(y) END, 9) AS y FROM hours")
def log_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.prepare_input(hourly(spark, sf_dir), log=True).select("series_id", "t", F.round("y", 9).alias("y"))


@_register(_HOURLY + "SELECT series_id, (t // 24)::BIGINT AS day, (t % 24)::INTEGER AS step, y AS value FROM hours")
def folded_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.fold(hourly(spark, sf_dir), 3600.0, trim=False)


#: Without the low values of the first four and the last three days, so that days on both ends have none.
@_register(_HOURLY + """, v AS (SELECT series_id, (t // 24)::BIGINT AS day, (t % 24)::INTEGER AS step, CASE WHEN (t // 24 BETWEEN 4 AND 26 OR y > 400) AND t // 24 % 6 != 0 THEN y END AS value FROM hours),
r AS (SELECT series_id, min(day) AS lo, max(day) AS hi FROM v WHERE value IS NOT NULL GROUP BY series_id)
SELECT series_id, day, step, value FROM v JOIN r USING (series_id) WHERE day BETWEEN lo AND hi""")
def folded_days_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.col("t") / 24)
    kept = (day.between(4, 26) | (F.col("y") > 400)) & (day % 6 != 0)
    return diagnostics.fold(hourly(spark, sf_dir).withColumn("y", F.when(kept, F.col("y"))), 3600.0)


@_register(_HOURLY + "SELECT series_id, (t % 24)::INTEGER AS step, round(avg(y), 6) AS mean FROM hours GROUP BY ALL")
def daily_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.profile(diagnostics.fold(hourly(spark, sf_dir), 3600.0)).select("series_id", "step", F.round("mean", 6).alias("mean"))


@_register(_HOURLY + """, p AS (SELECT series_id, (t % 24)::INTEGER AS step, avg(y) AS mean FROM hours GROUP BY ALL)
SELECT series_id, arg_max(step, mean) AS peak, arg_min(step, mean) AS trough FROM p GROUP BY series_id""")
def peak_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.peak_and_trough(diagnostics.profile(diagnostics.fold(hourly(spark, sf_dir), 3600.0)))


@_register(_HOURLY + """, c AS (SELECT series_id, t, coalesce(y - avg(y) OVER (PARTITION BY series_id), 0) AS c FROM hours),
n AS (SELECT series_id, max(t) + 1 AS n FROM hours GROUP BY series_id),
k AS (SELECT series_id, n, unnest(generate_series(1, n // 2)) AS k FROM n),
s AS (SELECT series_id, n, k, sqrt(sum(c * cos(2 * pi() * k * t / n)) ** 2 + sum(c * sin(2 * pi() * k * t / n)) ** 2) AS m FROM c JOIN k USING (series_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY m DESC, k) AS place FROM s)
SELECT series_id, k::INTEGER AS k, round(n::DOUBLE / k, 6) AS period, round(m, 4) AS magnitude FROM r WHERE place <= 6""")
def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = diagnostics.periodogram(hourly(spark, sf_dir))
    return top.select("series_id", "k", F.round("period", 6).alias("period"), F.round("magnitude", 4).alias("magnitude"))


@_register(_HOURLY + """, l AS (SELECT series_id, y, lag(y) OVER (PARTITION BY series_id ORDER BY t) AS a FROM hours WHERE y IS NOT NULL)
SELECT series_id, round(covar_pop(a, y) / nullif(stddev_pop(a) * stddev_pop(y), 0), 9) AS ac1 FROM l WHERE a IS NOT NULL GROUP BY series_id""")
def lag_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.lag_correlation(hourly(spark, sf_dir), "y").select("series_id", F.round("ac1", 9).alias("ac1"))


@_register(_HOURLY + """, l AS (SELECT series_id, t, y, lag(y) OVER w AS a, lag(t) OVER w AS s FROM hours WHERE y IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY t))
SELECT series_id, round(covar_pop(a, y) / nullif(stddev_pop(a) * stddev_pop(y), 0), 9) AS ac1 FROM l WHERE s = t - 1 GROUP BY series_id""")
def lag_correlation_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.lag_correlation(hourly(spark, sf_dir), "y", adjacent=True).select("series_id", F.round("ac1", 9).alias("ac1"))


@_register(_HOURLY + """, r AS (SELECT series_id, t::BIGINT AS t, y AS value, row_number() OVER (PARTITION BY series_id ORDER BY abs(y) DESC, t)::INTEGER AS place FROM hours WHERE y IS NOT NULL)
SELECT * FROM r WHERE place <= 10""")
def largest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.largest(hourly(spark, sf_dir), "y")


@_register(_HOURLY + """, n AS (SELECT series_id, max(t) + 1 AS n FROM hours GROUP BY series_id),
w AS (SELECT series_id, unnest(list_distinct(list_append(generate_series(100, n, 70), n))) AS w FROM n)
SELECT DISTINCT series_id, e AS n FROM (
  SELECT w.series_id, w, (max(h.t) + 1)::BIGINT AS e FROM w JOIN hours h ON h.series_id = w.series_id AND h.t < w.w AND h.y IS NOT NULL GROUP BY ALL)
WHERE e >= 100""")
def window_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.valid_endpoints(hourly(spark, sf_dir), 100, 70)


@_register("SELECT o_orderpriority AS family, round(median(o_totalprice), 4) AS median, round(stddev_samp(o_totalprice), 4) AS std FROM orders GROUP BY ALL")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("family"), F.col("o_totalprice").alias("score"))
    return validation.score_summary(scores, "family").select("family", F.round("median", 4).alias("median"), F.round("std", 4).alias("std"))


@_register("""
WITH s AS (SELECT l_returnflag AS family, l_quantity AS weight, avg(l_discount) AS score FROM lineitem GROUP BY ALL)
SELECT family, max(weight) AS weight FROM (SELECT *, min(score) OVER (PARTITION BY family) AS low FROM s) WHERE score <= low * 1.02 GROUP BY family
""")
def near_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("family"), F.col("l_quantity").alias("weight")).agg(F.avg("l_discount").alias("score"))
    return validation.near_minimum(scores, 0.02)


@_register()
def trend_and_daily_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.gram_curves(hourly(spark, sf_dir), FLAGSHIP)


#: The normal equations of ``trend_and_daily_cycle``: columns' products with the residual against their penalties.
@_register(_HOURLY + """, n AS (SELECT DISTINCT series_id FROM hours)
SELECT series_id, unnest(generate_series(1, 6))::INTEGER AS place, 0.0::DOUBLE AS gap FROM n""")
def cycle_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return certificates.normal_gaps(hourly(spark, sf_dir), FLAGSHIP)


@_register("""SELECT l_returnflag AS series_id, unnest(generate_series(1, 3))::INTEGER AS place, 0.0::DOUBLE AS gap FROM (SELECT DISTINCT l_returnflag FROM lineitem)""")
def spline_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("series_id"), F.lit(0).alias("t"), F.col("l_extendedprice").alias("y"), "l_quantity")
    return certificates.normal_gaps(rows, Model((specs.exog_spline("l_quantity", knots=(1.0, 10.0, 30.0, 50.0)),)))


def _with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``daily_orders`` with the day's number of orders as the covariate z."""
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long")
    sums = _table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), day.alias("t"))
    return sums.agg(F.round(F.sum("o_totalprice"), 2).alias("y"), F.count("*").cast("double").alias("z"))


#: Trend and covariate by the normal equations: the covariate leaves out the line, then the line is fitted to the rest.
_COVARIATE = """
WITH daily AS (
  SELECT o_orderpriority AS series_id, datediff('day', DATE '1995-01-01', o_orderdate::DATE)::BIGINT AS t, round(sum(o_totalprice), 2) AS y, count(*)::DOUBLE AS z
  FROM orders GROUP BY ALL),
c AS (SELECT *, t - avg(t) OVER w AS ct, y - avg(y) OVER w AS cy, z - avg(z) OVER w AS cz FROM daily WINDOW w AS (PARTITION BY series_id)),
s AS (SELECT series_id, avg(t) AS mt, avg(y) AS my, avg(z) AS mz, sum(ct * ct) AS tt, sum(ct * cz) AS tz, sum(cz * cz) AS zz, sum(ct * cy) AS ty, sum(cz * cy) AS zy FROM c GROUP BY series_id),
b AS (SELECT series_id, mt, my, mz, (zy * tt - ty * tz) / (zz * tt - tz * tz) AS beta, (ty * zz - zy * tz) / (zz * tt - tz * tz) AS slope FROM s),
f AS (SELECT series_id, t, y, z, my - slope * mt - beta * mz + slope * t AS trend, beta * z AS exog FROM daily JOIN b USING (series_id)),
curves AS (SELECT *, trend + exog AS reconstruction, y - trend - exog AS residual FROM f)
"""
COVARIATE = Model((specs.linear_trend(), specs.exog_linear("z")))


@_register(_COVARIATE + "SELECT series_id, t, round(trend) AS trend, round(exog) AS exog, round(residual) AS residual FROM curves")
def trend_and_covariate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fit.gram_curves(_with_orders(spark, sf_dir), COVARIATE)
    return got.select("series_id", "t", *[F.round(c, 0).alias(c) for c in ("trend", "exog", "residual")])


@_register(_COVARIATE + """SELECT series_id, count(*) AS n, count(y) AS observed, round(100 * sum(trend ** 2) / (sum(trend ** 2) + sum(exog ** 2)), 6) AS share_trend,
round(100 * sum(exog ** 2) / (sum(trend ** 2) + sum(exog ** 2)), 6) AS share_exog, round(sqrt(avg(residual ** 2)), 3) AS rms, round(avg(abs(residual)), 3) AS mae,
round(sqrt(avg(residual ** 2)), 3) AS rms_observed, round(avg(abs(residual)), 3) AS mae_observed FROM curves GROUP BY series_id""")
def decomposition_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = reporting.report_numbers(fit.gram_curves(_with_orders(spark, sf_dir), COVARIATE), COVARIATE.roles)
    return got.select("series_id", "n", "observed", *[F.round(f"share_{r}", 6).alias(f"share_{r}") for r in COVARIATE.roles], *[F.round(c, 3).alias(c) for c in ("rms", "mae", "rms_observed", "mae_observed")])


@_register(_COVARIATE + "SELECT series_id, round(1 - var_pop(residual) / var_pop(y), 9) AS explained FROM curves GROUP BY series_id")
def explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = diagnostics.variance_explained(fit.gram_curves(_with_orders(spark, sf_dir), COVARIATE))
    return got.select("series_id", F.round("explained", 9).alias("explained"))


@_register(_COVARIATE + """, p AS (UNPIVOT (SELECT series_id, t, y, reconstruction, trend, exog, residual FROM curves) ON y, reconstruction, trend, exog, residual INTO NAME panel VALUE value)
SELECT series_id, t, panel, round(value) AS value FROM p""")
def decomposition_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = reporting.tidy(fit.gram_curves(_with_orders(spark, sf_dir), COVARIATE), COVARIATE.roles)
    return got.select("series_id", "t", "panel", F.round("value", 0).alias("value"))


@_register(_COVARIATE + "SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY z, t)::INTEGER AS place, z, round(exog) AS value FROM curves")
def part_by_covariate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = diagnostics.by_covariate(fit.gram_curves(_with_orders(spark, sf_dir), COVARIATE), "exog", "z")
    return got.withColumn("value", F.round("value", 0))


@_register(_COVARIATE + "SELECT series_id, round(max(exog) - min(exog), 3) AS amplitude FROM curves GROUP BY series_id")
def part_amplitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = diagnostics.amplitude(fit.gram_curves(_with_orders(spark, sf_dir), COVARIATE), "exog")
    return got.select("series_id", F.round("amplitude", 3).alias("amplitude"))


@_register(_COVARIATE + """SELECT series_id, round(100 * (arg_max(trend, t) - arg_min(trend, t)) / (max(t) - min(t)) * 365.2425 / arg_min(trend, t), 6) AS rate
FROM curves GROUP BY series_id""")
def yearly_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = diagnostics.degradation_rate(fit.gram_curves(_with_orders(spark, sf_dir), COVARIATE), "trend", basis.samples_per_year(basis.DAY), "relative")
    return got.select("series_id", F.round("rate", 6).alias("rate"))


_LOG_LINE = _HOURLY + """, logs AS (SELECT series_id, t::BIGINT AS t, y, CASE WHEN y > 1e-6 THEN ln(y) END AS l FROM hours),
line AS (SELECT series_id, regr_intercept(l, t) AS a, regr_slope(l, t) AS b FROM logs GROUP BY series_id)
"""


@_register(_LOG_LINE + """SELECT series_id, t, round(exp(l), 6) AS y, round(exp(a + b * t), 6) AS trend, round(exp(coalesce(l - a - b * t, 0)), 6) AS residual,
round(exp(a + b * t), 6) AS reconstruction FROM logs JOIN line USING (series_id)""")
def recovered_from_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = transform.prepare_input(hourly(spark, sf_dir), log=True)
    line = Model((specs.linear_trend(),))
    back = transform.recover_frame(fit.gram_curves(logs, line), line.roles, log=True)
    return back.select("series_id", "t", *[F.round(c, 6).alias(c) for c in ("y", "trend", "residual", "reconstruction")])


@_register(_LOG_LINE + "SELECT series_id, t, y, round(CASE WHEN l IS NOT NULL THEN a + b * t END, 9) AS trend FROM logs JOIN line USING (series_id)")
def masked_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = hourly(spark, sf_dir).select("series_id", "t", F.col("y").alias("raw"))
    line = Model((specs.linear_trend(),))
    logs = transform.prepare_input(hourly(spark, sf_dir), log=True)
    got = reporting.components_frame(fit.gram_curves(logs, line), line.roles, mask=True)
    return got.join(raw, ["series_id", "t"]).select("series_id", "t", F.col("raw").alias("y"), F.round("trend", 9).alias("trend"))


@_register(_HOURLY + """, a AS (SELECT series_id, t % 24 AS step, max(y) FILTER (t // 24 = 0) AS x, max(y) FILTER (t // 24 = 3) AS z FROM hours GROUP BY ALL)
SELECT series_id, round(covar_pop(x, z) / nullif(stddev_pop(x) FILTER (z IS NOT NULL) * stddev_pop(z) FILTER (x IS NOT NULL), 0), 9) AS corr FROM a GROUP BY series_id""")
def day_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = diagnostics.day_correlation(diagnostics.fold(hourly(spark, sf_dir), 3600.0), 0, 3)
    return got.select("series_id", F.round("corr", 9).alias("corr"))


@_register(_HOURLY + """SELECT series_id, (t % 24)::INTEGER AS step, max(y) FILTER (t // 24 = 0) AS "0", max(y) FILTER (t // 24 = 1) AS "1", max(y) FILTER (t // 24 = 2) AS "2"
FROM hours GROUP BY ALL""")
def folded_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.fold_matrix(diagnostics.fold(hourly(spark, sf_dir), 3600.0), [0, 1, 2])


@_register(_HOURLY + """, l AS (SELECT series_id, t, y - lag(y) OVER w AS d, y - 2 * lag(y) OVER w + lag(y, 2) OVER w AS dd FROM hours WINDOW w AS (PARTITION BY series_id ORDER BY t))
SELECT series_id, count(*) FILTER (abs(d) > 40) AS changes, count(*) FILTER (abs(dd) > 60) AS bends FROM l GROUP BY series_id""")
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hourly(spark, sf_dir)
    bends = diagnostics.change_counts(rows, "y", 60.0, 2).withColumnRenamed("changes", "bends")
    return diagnostics.change_counts(rows, "y", 40.0).join(bends, "series_id")


@_register(_HOURLY + """, w AS (SELECT series_id, weekofyear(ts) AS week, avg(y) AS mean FROM hours GROUP BY ALL)
SELECT series_id, arg_min(week, {'a': -mean, 'b': week})::INTEGER AS peak_week, arg_min(week, {'a': mean, 'b': week})::INTEGER AS trough_week FROM w GROUP BY series_id""")
def peak_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.peak_weeks(hourly(spark, sf_dir), "y")


@_register(_HOURLY + """, n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM hours)
SELECT series_id, round(sum(y * y) / any_value(n), 6) AS l2, round(sum(abs(y)) / any_value(n), 6) AS l1,
round(sum(CASE WHEN abs(y) <= 20 THEN y * y ELSE 40 * abs(y) - 400 END) / any_value(n), 6) AS huber, round(2 * sum(greatest(0.9 * y, -0.1 * y)) / any_value(n), 6) AS quantile
FROM n GROUP BY series_id""")
def loss_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = {name: F.round(basis.loss(name, F.col("y"), F.count("*"), p), 6).alias(name) for name, p in (("l2", 1.0), ("l1", 1.0), ("huber", 20.0), ("quantile", 0.9))}
    return hourly(spark, sf_dir).groupBy("series_id").agg(*sizes.values())


@_register("""WITH d AS (SELECT DISTINCT l_quantity AS x FROM lineitem),
u AS (SELECT x, (greatest(x - 1, 0) ** 3 - greatest(x - 50, 0) ** 3) / 49 AS a, (greatest(x - 10, 0) ** 3 - greatest(x - 50, 0) ** 3) / 40 AS b,
  (greatest(x - 30, 0) ** 3 - greatest(x - 50, 0) ** 3) / 20 AS c FROM d)
SELECT x, x AS h0, round(a - c, 6) AS h1, round(b - c, 6) AS h2 FROM u""")
def spline_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x")).distinct()
    columns = basis.spline_columns(F.col("x"), [1.0, 10.0, 30.0, 50.0])
    return x.select("x", *[F.round(c, 6).alias(f"h{i}") for i, c in enumerate(columns)])


@_register(_HOURLY + """SELECT DISTINCT t::BIGINT AS t, round(cos(2 * pi() * t / 168), 9) AS c0, round(sin(2 * pi() * t / 168), 9) AS c1, round(cos(4 * pi() * t / 168), 9) AS c2,
round(sin(4 * pi() * t / 168), 9) AS c3, round(cos(2 * pi() * t / 24), 9) AS c4, round(sin(2 * pi() * t / 24), 9) AS c5 FROM hours""")
def seasonal_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = basis.seasonal_columns(F.col("t").cast("double"), (basis.period_samples(basis.DAY, 3600), basis.period_samples(basis.WEEK, 3600)), (1, 2))
    return hourly(spark, sf_dir).select("t").distinct().select("t", *[F.round(c, 9).alias(f"c{i}") for i, c in enumerate(columns)])


_LINES = _HOURLY + """, n AS (SELECT series_id, max(t) + 1 AS n FROM hours GROUP BY series_id),
w AS (SELECT series_id, unnest(list_distinct(list_append(generate_series(180, n, 120), n))) AS w FROM n),
e AS (SELECT DISTINCT series_id, e AS n FROM (SELECT w.series_id, w, (max(h.t) + 1)::BIGINT AS e FROM w JOIN hours h ON h.series_id = w.series_id AND h.t < w.w AND h.y IS NOT NULL GROUP BY ALL) WHERE e >= 180),
lines AS (SELECT e.series_id, n, regr_intercept(y, t) AS a, regr_slope(y, t) AS b FROM e JOIN hours h ON h.series_id = e.series_id AND h.t < e.n GROUP BY ALL),
next AS (SELECT *, lead(n) OVER w AS m, lead(a) OVER w AS c, lead(b) OVER w AS d FROM lines WINDOW w AS (PARTITION BY series_id ORDER BY n))
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.expanding_lines(hourly(spark, sf_dir), 180, 120)


@_register(_LINES + "SELECT series_id, n, round(a, 6) AS trend_a, round(b, 9) AS trend_b FROM lines")
def expanding_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("series_id", "n", F.round("trend_a", 6).alias("trend_a"), F.round("trend_b", 9).alias("trend_b"))


@_register(_LINES + """, s AS (SELECT series_id, n, m, sqrt(avg((c + d * t - a - b * t) ** 2)) AS g, sqrt(avg((a + b * t) ** 2)) AS h, avg(abs(c + d * t - a - b * t)) AS i, avg(abs(a + b * t)) AS j
  FROM (SELECT *, unnest(generate_series(0, n - 1)) AS t FROM next WHERE m IS NOT NULL) GROUP BY ALL)
SELECT series_id, n, m AS next_n, round(g / (h + 1e-12), 9) AS rmsd FROM s""")
def line_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.line_stability(_lines(spark, sf_dir)).withColumn("rmsd", F.round("rmsd", 9))


#: The same windows refitted one by one, compared point by point.
@_register(_LINES + """, s AS (SELECT series_id, n, m, sqrt(avg((c + d * t - a - b * t) ** 2)) AS g, sqrt(avg((a + b * t) ** 2)) AS h, avg(abs(c + d * t - a - b * t)) AS i, avg(abs(a + b * t)) AS j
  FROM (SELECT *, unnest(generate_series(0, n - 1)) AS t FROM next WHERE m IS NOT NULL) GROUP BY ALL)
SELECT series_id, n, p.panel, round(p.value, 6) AS value FROM (SELECT series_id, n, unnest([{'panel': 'rmsd', 'value': g / (h + 1e-12)}, {'panel': 'sdelta', 'value': i / (j + 1e-12)}]) AS p FROM s)
UNION ALL SELECT series_id, n, p.panel, round(p.value, 6) FROM (SELECT series_id, n, unnest([{'panel': 'value', 'value': b}, {'panel': 'delta', 'value': abs(d - b)}]) AS p FROM next)""")
def stability_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = validation.expanding_fits(hourly(spark, sf_dir), Model((specs.linear_trend(),)), 180, 120)
    panels = reporting.stability_panels(validation.stability(fits, "trend").drop("next_n"), validation.history(fits, "trend_b"))
    return panels.withColumn("value", F.round("value", 6))


@_register(_LINES + """, f AS (SELECT series_id, arg_max(b, n) AS last FROM lines GROUP BY series_id),
o AS (SELECT series_id, max(n) FILTER (abs(b - last) > 0.02) AS bad FROM lines JOIN f USING (series_id) GROUP BY series_id)
SELECT series_id, min(n) FILTER (bad IS NULL OR n > bad) AS n FROM lines JOIN o USING (series_id) GROUP BY series_id""")
def slope_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _lines(spark, sf_dir).select("series_id", "n", F.col("trend_b").alias("value"))
    return validation.converged_at(path, 0.02)


_YEARS = """
WITH daily AS (
  SELECT o_orderpriority AS series_id, datediff('day', DATE '1995-01-01', o_orderdate::DATE)::BIGINT AS t, round(sum(o_totalprice), 2) AS y, date_trunc('year', o_orderdate)::DATE AS block
  FROM orders GROUP BY ALL),
f AS (SELECT a.series_id, b.block AS fold, a.t, a.y, a.block = b.block AS held FROM daily a JOIN (SELECT DISTINCT series_id, block FROM daily) b USING (series_id)),
s AS (SELECT series_id, fold, count(*) AS n, avg(t) FILTER (NOT held) AS mt, avg(y) FILTER (NOT held) AS my, regr_sxx(y, t) FILTER (NOT held) AS xx, regr_sxy(y, t) FILTER (NOT held) AS xy FROM f GROUP BY ALL),
w AS (SELECT *, xy / (xx + weight * n) AS b FROM s, (SELECT unnest([0.0, 100.0, 100000.0])::DOUBLE AS weight)),
scores AS (SELECT f.series_id, f.fold, weight, sqrt(avg((y - my - b * (t - mt)) ** 2)) AS score FROM f JOIN w ON w.series_id = f.series_id AND w.fold = f.fold WHERE held GROUP BY ALL)
"""


def _years(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.lit("1995-01-01").cast("date")
    dated = daily_orders(spark, sf_dir).withColumn("ts", F.date_add(first, F.col("t").cast("int")).cast("timestamp_ntz"))
    return validation.calendar_blocks(dated)


@_register(_YEARS + "SELECT series_id, fold::VARCHAR AS fold, weight, round(score, 2) AS score FROM scores")
def year_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.line_block_scores(_years(spark, sf_dir), (0.0, 100.0, 100000.0)).withColumns({"fold": F.col("fold").cast("string"), "score": F.round("score", 2)})


_HELD_LINES = """,
s AS (SELECT series_id, fold, count(*) AS n, avg(t) FILTER (NOT held AND y IS NOT NULL) AS mt, avg(y) FILTER (NOT held) AS my,
  regr_sxx(y, t) FILTER (NOT held) AS xx, regr_sxy(y, t) FILTER (NOT held) AS xy FROM f GROUP BY ALL),
w AS (SELECT *, xy / (xx + weight * n) AS b FROM s, (SELECT unnest([0, 100]) AS weight))
SELECT f.series_id, f.fold::VARCHAR AS fold, 'line_' || weight AS candidate, round(sqrt(avg((y - my - b * (t - mt)) ** 2)), 6) AS score
FROM f JOIN w ON w.series_id = f.series_id AND w.fold = f.fold WHERE held GROUP BY ALL"""
_CANDIDATES = [(f"line_{w:g}", Model((specs.linear_trend(slope_weight=w),))) for w in (0.0, 100.0)]


@_register(_HOURLY + """, weeks AS (SELECT *, date_trunc('week', ts)::DATE AS block FROM hours),
f AS (SELECT a.series_id, b.block AS fold, a.t, a.y, a.block = b.block AND a.y IS NOT NULL AS held FROM weeks a
  JOIN (SELECT DISTINCT series_id, block FROM weeks WHERE y IS NOT NULL) b USING (series_id))""" + _HELD_LINES)
def week_scores_refitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = validation.calendar_blocks(hourly(spark, sf_dir), "week")
    return validation.block_scores(blocks, _CANDIDATES).select("series_id", F.col("fold").cast("string").alias("fold"), "candidate", F.round("score", 6).alias("score"))


#: The same scores from one pass of sums, without refits.
@_register(ORACLE_SQL["week_scores_refitted"])
def week_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = validation.calendar_blocks(hourly(spark, sf_dir), "week")
    return gram.gram_block_scores(blocks, _CANDIDATES).select("series_id", F.col("fold").cast("string").alias("fold"), "candidate", F.round("score", 6).alias("score"))


@_register(_HOURLY + """, r AS (SELECT *, count(y) OVER (PARTITION BY series_id ORDER BY t) - 1 AS place, count(y) OVER (PARTITION BY series_id) AS m FROM hours),
f AS (SELECT *, 0 AS fold, y IS NOT NULL AND place >= (m - k) // 2 AND place < (m - k) // 2 + k AS held
  FROM (SELECT *, greatest(1, round_even(m * 0.2, 0))::BIGINT AS k FROM r))""" + _HELD_LINES.replace("f.fold::VARCHAR AS fold, ", ""))
def centre_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = validation.holdout_scores(validation.centre_block(hourly(spark, sf_dir)), _CANDIDATES)
    return scores.select("series_id", "candidate", F.round("score", 6).alias("score"))


@_register(_YEARS + """, m AS (SELECT series_id AS family, weight, median(score) AS score FROM scores GROUP BY ALL)
SELECT family, max(weight) AS weight FROM (SELECT *, min(score) OVER (PARTITION BY family) AS low FROM m) WHERE score <= low + 500 GROUP BY family""")
def near_minimum_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = validation.line_block_scores(_years(spark, sf_dir), (0.0, 100.0, 100000.0)).withColumnRenamed("series_id", "family")
    medians = validation.score_summary(scores, "family", "weight").withColumnRenamed("median", "score")
    return validation.near_minimum(medians, 500.0, absolute=True)


@_register("""
WITH s AS (SELECT l_returnflag AS family, l_quantity AS weight, avg(l_discount) * 100 AS gain, count(*) % 7 AS changes, max(l_tax) * 100 - l_quantity % 5 AS jump FROM lineitem GROUP BY l_returnflag, l_quantity)
SELECT family, coalesce(min(weight) FILTER (gain >= 5 AND changes BETWEEN 1 AND 3 AND jump >= 5), max(weight)) AS weight,
count(*) FILTER (gain >= 5 AND changes BETWEEN 1 AND 3 AND jump >= 5) > 0 AS found FROM s GROUP BY family
""")
def admissible_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("family"), F.col("l_quantity").alias("weight"))
    scans = by.agg((F.avg("l_discount") * 100).alias("gain"), (F.count("*") % 7).alias("changes"), (F.max("l_tax") * 100).alias("most"))
    return validation.admissible(scans.withColumn("jump", F.col("most") - F.col("weight") % 5), 5.0, 3, 5.0)


def _solved(model: Model) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fit.curves(fit.decompose(hourly(spark, sf_dir), model), model)

    return query


_DAY = specs.multiperiodic(24.0, 2, 0.05, "daily")
#: One query for each component and loss that needs the series solver.
MODELS = {
    "solve_smooth": Model((specs.smooth_trend(10.0),)),
    "solve_piecewise_linear": Model((specs.pwl_trend(5.0), _DAY)),
    "solve_piecewise_constant": Model((specs.pwc_trend(5.0),)),
    "solve_kinks": Model((specs.pwl_trend(50.0),)),
    "solve_monotone": Model((specs.monotone_trend(),)),
    "solve_four_way": Model((specs.smooth_trend(10.0), _DAY, specs.sparse(30.0))),
    "solve_bounded_huber": Model((specs.nonneg(specs.smooth_trend(10.0)),), "huber", 5.0),
    "solve_quantile": Model((specs.smooth_trend(10.0),), "quantile", 0.9),
    "solve_l1": Model((specs.linear_trend(), _DAY), "l1"),
    "solve_soiling": Model((specs.linear_trend(), specs.soiling(0.5, 0.01))),
}
QUERIES.update({name: _solved(model) for name, model in MODELS.items()})

#: The isotonic least squares of observed values: the least upper mean over starts of the largest mean over ends.
ORACLE_SQL["solve_monotone"] = _HOURLY + """, o AS (SELECT series_id, t, y, row_number() OVER w AS i, sum(y) OVER w AS s FROM hours WHERE y IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY t)),
m AS (SELECT a.series_id, a.i, b.i AS j, max((b.s - a.s + a.y) / (b.i - a.i + 1)) OVER (PARTITION BY a.series_id, a.i ORDER BY b.i DESC) AS g FROM o a JOIN o b ON a.series_id = b.series_id AND b.i >= a.i),
x AS (SELECT series_id, j, min(g) AS x FROM m GROUP BY ALL),
v AS (SELECT h.series_id, h.t, h.y, coalesce(max(o.i) OVER (PARTITION BY h.series_id ORDER BY h.t), 1) AS i FROM hours h LEFT JOIN o ON o.series_id = h.series_id AND o.t = h.t)
SELECT v.series_id, t::BIGINT AS t, y, round(x + 3e-8, 6) AS trend, round(coalesce(y - x, 0) + 3e-8, 6) AS residual, round(x + 3e-8, 6) AS reconstruction FROM v JOIN x ON x.series_id = v.series_id AND x.j = v.i"""


def solve_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = monotone.monotone_curves(hourly(spark, sf_dir), specs.monotone_trend(), size=64, band_rows=16)
    # pooled means often end in an exact half of the last digit; the shift rounds it alike on both sides
    return got.select("series_id", "t", "y", *[F.round(F.col(c) + 3e-8, 6).alias(c) for c in ("trend", "residual", "reconstruction")])


QUERIES["solve_monotone"] = solve_monotone


def solve_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smooth.smooth_curves(hourly(spark, sf_dir), MODELS["solve_smooth"], size=96).drop("ts")


def solve_piecewise_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.pwc_curves(hourly(spark, sf_dir), specs.pwc_trend(5.0), size=64).drop("ts")


QUERIES.update({f.__name__: f for f in (solve_smooth, solve_piecewise_constant)})

#: The system's factors and its solution point by point: each place's row of the factor from the two before, then back.
_SMOOTH = _HOURLY + """, RECURSIVE_n AS (SELECT series_id, max(t) + 1 AS n FROM hours GROUP BY series_id),
a AS (SELECT h.series_id, h.t, n, CASE WHEN y IS NULL THEN 0.0 ELSE 1.0 / n END + 10.0 * CASE WHEN t IN (0, n - 1) THEN 1 WHEN t IN (1, n - 2) THEN 5 ELSE 6 END AS d,
  -10.0 * CASE WHEN t IN (1, n - 1) THEN 2 ELSE 4 END AS e, coalesce(y, 0.0) / n AS b FROM hours h JOIN RECURSIVE_n USING (series_id)),
f AS (
  SELECT series_id, t, d::DOUBLE AS d, 0.0::DOUBLE AS l, b::DOUBLE AS z, 'infinity'::DOUBLE AS d1, 0.0::DOUBLE AS z1 FROM a WHERE t = 0
  UNION ALL
  SELECT a.series_id, a.t, a.d - 100.0 / f.d1 - ((a.e - 10.0 * f.l) / f.d) ** 2 * f.d, (a.e - 10.0 * f.l) / f.d, a.b - (a.e - 10.0 * f.l) / f.d * f.z - 10.0 / f.d1 * f.z1, f.d, f.z
  FROM f JOIN a ON a.series_id = f.series_id AND a.t = f.t + 1),
k AS (SELECT f.*, n FROM f JOIN RECURSIVE_n USING (series_id)),
x AS (
  SELECT series_id, t, z / d AS x, l, 0.0::DOUBLE AS l2, 0.0::DOUBLE AS x2 FROM k WHERE t = n - 1
  UNION ALL
  SELECT k.series_id, k.t, k.z / k.d - x.l * x.x - 10.0 / k.d * x.x2, k.l, x.l, x.x FROM x JOIN k ON k.series_id = x.series_id AND k.t = x.t - 1)
SELECT h.series_id, h.t::BIGINT AS t, round(x, 5) AS trend, round(coalesce(y - x, 0), 5) AS residual FROM hours h JOIN x ON x.series_id = h.series_id AND x.t = h.t"""


@_register(_SMOOTH.replace("WITH sums", "WITH RECURSIVE sums", 1).replace("RECURSIVE_n", "lengths"))
def smooth_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solve_smooth(spark, sf_dir).select("series_id", "t", F.round("trend", 5).alias("trend"), F.round("residual", 5).alias("residual"))


#: Two correlated atoms: of all signs of the two coefficients the ones that agree with their solution, and of these the best.
@_register("""
WITH r AS (SELECT l_returnflag AS series_id, l_extendedprice / 1000 AS y, l_quantity AS a, l_tax * l_quantity * 10 AS b FROM lineitem),
g AS (SELECT series_id, avg(a * a) AS aa, avg(a * b) AS ab, avg(b * b) AS bb, avg(a * y) AS ay, avg(b * y) AS yb, avg(y * y) AS yy FROM r GROUP BY series_id),
c AS (SELECT *, unnest([-1, 0, 1]) AS p FROM g), d AS (SELECT *, unnest([-1, 0, 1]) AS q FROM c),
s AS (SELECT *, CASE WHEN p = 0 THEN 0 WHEN q = 0 THEN (ay - 10.0 * p) / aa ELSE ((ay - 10.0 * p) * bb - (yb - 10.0 * q) * ab) / (aa * bb - ab * ab) END AS u,
  CASE WHEN q = 0 THEN 0 WHEN p = 0 THEN (yb - 10.0 * q) / bb ELSE ((yb - 10.0 * q) * aa - (ay - 10.0 * p) * ab) / (aa * bb - ab * ab) END AS v FROM d),
o AS (SELECT *, yy - 2 * u * ay - 2 * v * yb + u * u * aa + 2 * u * v * ab + v * v * bb + 20.0 * (abs(u) + abs(v)) AS cost FROM s WHERE sign(u) = p AND sign(v) = q)
SELECT series_id, round(arg_min(u, cost), 6) AS quantity, round(arg_min(v, cost), 6) AS taxed FROM o GROUP BY series_id
""")
def sparse_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("series_id"), F.lit(0).alias("t"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("a"), (F.col("l_tax") * F.col("l_quantity") * 10).alias("b")
    )
    got = gram.lasso_fit(rows, Model((specs.dictionary(["a", "b"], 20.0),)))
    return got.select("series_id", F.round(F.col("theta")[0], 6).alias("quantity"), F.round(F.col("theta")[1], 6).alias("taxed"))


#: A level alone explains nothing, a line what its correlation tells, and line and covariate what their curves leave.
@_register(_COVARIATE + """SELECT series_id, p.place::INTEGER AS place, p.role, round(p.v + 1e-12, 9) AS explained FROM (
  SELECT series_id, unnest([{'place': 1, 'role': 'level', 'v': 0.0}, {'place': 2, 'role': 'slope', 'v': regr_r2(y, t)}, {'place': 3, 'role': 'exog', 'v': 1 - var_pop(residual) / var_pop(y)}]) AS p FROM curves GROUP BY series_id)""")
def nested_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_orders(spark, sf_dir).withColumns({"one": F.lit(1.0), "x": F.col("t").cast("double")})
    model = Model((specs.exog_linear("one", role="level"), specs.exog_linear("x", role="slope"), specs.exog_linear("z")))
    return gram.nested_explained(rows, model).withColumn("explained", F.round(F.col("explained") + 1e-12, 9))


@_register(_DAILY + """, s AS (SELECT series_id, count(*) AS m, sum(t) AS sx, sum(t * t) AS sxx FROM daily GROUP BY series_id)
SELECT series_id, r.role, round((m * (sxx + 500.0 * m) - 2.0 * sx * sx + sxx * m) / (m * (sxx + 500.0 * m) - 1.0 * sx * sx), 9) AS dof FROM s, (SELECT unnest(['trend', 'total']) AS role) r""")
def ridge_line_dof(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = gram.effective_dof(daily_orders(spark, sf_dir), Model((specs.linear_trend(slope_weight=500.0),)))
    return got.withColumn("dof", F.round("dof", 9))


#: The hourly profile of events as a basis of 24 rows, along days whose number it does not divide.
@_register(_DAILY + """, w AS (SELECT hour(ts) AS h, round(avg(value), 6) AS u FROM events GROUP BY ALL)
SELECT series_id, round(sum(u * y) / count(*) / (sum(u * u) / count(*) + (0.5 * 2 * pi() / sqrt(24.0)) ** 2), 6) AS theta FROM daily JOIN w ON (t % 24 + 24) % 24 = h GROUP BY series_id""")
def custom_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = _table(spark, sf_dir, "events").groupBy(F.hour("ts").cast("bigint").alias("row")).agg(F.round(F.avg("value"), 6).alias("u"))
    rows = basis.with_custom_basis(daily_orders(spark, sf_dir), profile, ["u"])
    got = fit.gram_fit(rows, Model((specs.custom_periodic(["u"], 24.0, 0.5),)))
    return got.select("series_id", F.round(F.col("theta")[0], 6).alias("theta"))


#: Days of a number of orders that 5 divides have no covariate, and count as 0.
@_register(_COVARIATE.replace("count(*)::DOUBLE AS z", "CASE WHEN count(*) % 5 = 0 THEN 0.0 ELSE count(*)::DOUBLE END AS z") + "SELECT series_id, t, round(trend) AS trend, round(exog) AS exog, round(residual) AS residual FROM curves")
def covariate_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_orders(spark, sf_dir).withColumn("z", F.when(F.col("z") % 10 == 5, float("nan")).when(F.col("z") % 5 != 0, F.col("z")))
    got = fit.gram_curves(rows, COVARIATE)
    return got.select("series_id", "t", *[F.round(c, 0).alias(c) for c in ("trend", "exog", "residual")])


@_register(_HOURLY + """, b AS (SELECT DISTINCT t::BIGINT AS t, sin(pi() / 168 * (t % 168)) AS w1, sin(2 * pi() / 168 * (t % 168)) AS w2, cos(2 * pi() * t / 24) AS c, sin(2 * pi() * t / 24) AS s FROM hours)
SELECT t, round(w1, 9) AS c0, round(w2, 9) AS c1, round(c, 9) AS c2, round(s, 9) AS c3, round(w1 * c, 9) AS c4, round(w1 * s, 9) AS c5, round(w2 * c, 9) AS c6, round(w2 * s, 9) AS c7 FROM b""")
def seasonal_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns, _ = basis.seasonal_design(F.col("t").cast("double"), (168.0, 24.0), (2, 1), (True, False), 1)
    return hourly(spark, sf_dir).select("t").distinct().select("t", *[F.round(c, 9).alias(f"c{i}") for i, c in enumerate(columns)])


HUBER = Model((specs.linear_trend(), specs.exog_linear("z")), "huber", 50000.0)


@_register(_DAILY + "SELECT series_id, unnest(generate_series(1, 3))::INTEGER AS place, 0.0::DOUBLE AS gap FROM (SELECT DISTINCT series_id FROM daily)")
def huber_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_orders(spark, sf_dir)
    return certificates.slope_gaps(rows, HUBER, gram.robust_fit(rows, HUBER))


#: Draws by a stated rule, so that SQL can lay the same blocks and fit each replicate's line again.
@_register(_DAILY + """, l AS (SELECT series_id, regr_intercept(y, t) AS a, regr_slope(y, t) AS b, count(*) AS m FROM daily GROUP BY series_id),
r AS (SELECT series_id, t, m, a + b * t AS f, y - a - b * t AS r, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS q FROM daily JOIN l USING (series_id)),
s AS (SELECT x.series_id, g.rep, regr_slope(x.f + z.r, x.t) AS b, regr_intercept(x.f + z.r, x.t) AS a FROM r x CROSS JOIN (SELECT unnest(generate_series(1, 60)) AS rep) g
  JOIN r z ON z.series_id = x.series_id AND z.q = x.q % least(30, x.m) + (g.rep * 7919 + x.q // 30 * 104729) % (x.m - least(30, x.m) + 1) GROUP BY ALL),
v AS (SELECT series_id, 'level' AS scalar, a + 1000 * b AS value FROM s UNION ALL SELECT series_id, 'slope', 365.2425 * b FROM s),
p AS (SELECT series_id, 'level' AS scalar, a + 1000 * b AS point FROM l UNION ALL SELECT series_id, 'slope', 365.2425 * b FROM l)
SELECT series_id, scalar, round(any_value(point), 2) AS point, round(quantile_cont(value, 0.1), 2) AS low, round(quantile_cont(value, 0.9), 2) AS high, count(value) AS used FROM v JOIN p USING (series_id, scalar) GROUP BY ALL""")
def bootstrap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = Model((specs.linear_trend(),))
    thetas = resample.bootstrap_thetas(daily_orders(spark, sf_dir), line, 30, 60, start=lambda rep, number, many: F.pmod(rep * 7919 + number * 104729, many))
    got = resample.bootstrap_intervals(thetas, line, {"slope": "365.2425D * trend_b", "level": "trend_a + 1000 * trend_b"}, 80.0)
    return got.select("series_id", "scalar", *[F.round(c, 2).alias(c) for c in ("point", "low", "high")], "used")


@_register(_HOURLY + """, k AS (SELECT *, greatest(t - 300, 0) AS h FROM hours),
g AS (SELECT series_id, regr_slope(h, t) AS s, regr_intercept(h, t) AS i FROM k WHERE y IS NOT NULL GROUP BY series_id),
c AS (SELECT series_id, sum((h - i - s * t) * y) / sum((h - i - s * t) ** 2) AS c FROM k JOIN g USING (series_id) WHERE y IS NOT NULL GROUP BY series_id),
l AS (SELECT series_id, c, regr_slope(y - c * h, t) AS b, regr_intercept(y - c * h, t) AS a FROM k JOIN c USING (series_id) GROUP BY ALL)
SELECT series_id, t::BIGINT AS t, round(a + b * t + c * h, 4) AS refit FROM k JOIN l USING (series_id)""")
def kink_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    bent = F.greatest(F.col("t") - 300, F.lit(0)) * 0.5
    curves = hourly(spark, sf_dir).withColumn("trend", bent).withColumn("reconstruction", F.col("trend"))
    return diagnostics.refit_kinks(curves, "trend", 1e-6).select("series_id", "t", F.round("refit", 4).alias("refit"))


#: Ascending gaps join the last cluster while they lie within 5 % of its running median.
@_register(_VISITS.replace("WITH o", "WITH RECURSIVE o", 1) + """
i AS (SELECT series_id, gap, n, row_number() OVER (PARTITION BY series_id ORDER BY gap) AS i FROM c),
u AS (
  SELECT series_id, i, 1 AS cluster, list_transform(generate_series(1, n), lambda x: gap) AS l FROM i WHERE i = 1
  UNION ALL
  SELECT i.series_id, i.i, CASE WHEN abs(i.gap - list_median(l)) <= 0.05 * list_median(l) THEN cluster ELSE cluster + 1 END,
    CASE WHEN abs(i.gap - list_median(l)) <= 0.05 * list_median(l) THEN list_concat(l, list_transform(generate_series(1, i.n), lambda x: i.gap)) ELSE list_transform(generate_series(1, i.n), lambda x: i.gap) END
  FROM u JOIN i ON i.series_id = u.series_id AND i.i = u.i + 1),
e AS (SELECT series_id, cluster, arg_max(l, i) AS l FROM u GROUP BY ALL)
SELECT series_id, list_median(l)::DOUBLE AS rate, len(l) AS n, round(len(l) / sum(len(l)) OVER (PARTITION BY series_id), 9) AS share FROM e""")
def rate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeaxis.rates(_visits(spark, sf_dir), rel_tol=0.05).select("series_id", "rate", "n", F.round("share", 9).alias("share"))


_SERIES = "SELECT series_id, n, 0.0::DOUBLE AS gap, 0.0::DOUBLE AS excess, observed FROM (SELECT series_id, count(*) AS n, count(y) AS observed FROM hours GROUP BY series_id)"


def _optimal(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return certificates.dual_gaps(QUERIES[name](spark, sf_dir), MODELS[name])

    return query


#: For each of these models the distance from the optimality conditions, which are checked apart from the solver.
for _name in ("solve_smooth", "solve_piecewise_constant", "solve_kinks", "solve_quantile", "solve_bounded_huber"):
    QUERIES[f"{_name}_optimality"] = _optimal(_name)
    ORACLE_SQL[f"{_name}_optimality"] = _HOURLY + _SERIES


@_register()
def holdout_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = [(f"smooth_{w:g}", Model((specs.smooth_trend(w),))) for w in (1.0, 100.0)] + [("line", Model((specs.linear_trend(), _DAY)))]
    return validation.select_best(validation.holdout_scores(validation.centre_block(hourly(spark, sf_dir)), candidates))


@_register()
def expanding_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = validation.expanding_fits(hourly(spark, sf_dir), Model((specs.linear_trend(), _DAY)), 180, 120)
    return validation.stability(fits, "trend")


@_register()
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.bootstrap(hourly(spark, sf_dir), Model((specs.linear_trend(),)), "trend_b", 48, resamples=100)
