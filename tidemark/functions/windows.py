"""Window kernels: rolling, expanding and anchored statistics over one shared ordering per symbol.

Expressions built on the same WindowSpec share one shuffle and one sort. Undefined values are NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.frames import MULTI, bars_multi, rounded

UNBOUNDED = Window.unboundedPreceding


def W():
    """The ordering of a series: by time within its symbol."""
    return Window.partitionBy("symbol").orderBy("time")


def last_rows(n: int, w=None):
    return (w or W()).rowsBetween(-(n - 1), 0)


def full(value: Column, counted: Column | str, n: int, frame) -> Column:
    """value where the frame holds n values."""
    return F.when(F.count(counted).over(frame) >= n, value)


def rolling_mean(c, n: int, least: int | None = None, w=None) -> Column:
    return full(F.avg(c).over(last_rows(n, w)), c, least or n, last_rows(n, w))


def rolling_std(c, n: int, ddof: int = 1, least: int | None = None, w=None) -> Column:
    std = F.stddev_samp if ddof else F.stddev_pop
    return full(std(c).over(last_rows(n, w)), c, least or n, last_rows(n, w))


def rolling_max(c, n: int, least: int = 1, w=None) -> Column:
    return full(F.max(c).over(last_rows(n, w)), c, least, last_rows(n, w))


def running_max(c, w=None) -> Column:
    return F.max(c).over((w or W()).rowsBetween(UNBOUNDED, 0))


def running_min(c, w=None) -> Column:
    return F.min(c).over((w or W()).rowsBetween(UNBOUNDED, 0))


def running_sum(c, w=None) -> Column:
    return F.sum(c).over((w or W()).rowsBetween(UNBOUNDED, 0))


def anchored_sum(c, unit: str) -> Column:
    """Running sum that starts anew each day, week (Monday) or month."""
    return F.sum(c).over(Window.partitionBy("symbol", F.date_trunc(unit, "time")).orderBy("time").rowsBetween(UNBOUNDED, 0))


def previous(c, k: int = 1, w=None) -> Column:
    return F.lag(c, k).over(w or W())


def expanding_std(c, w=None) -> Column:
    return full(F.stddev_samp(c).over((w or W()).rowsBetween(UNBOUNDED, 0)), c, 2, (w or W()).rowsBetween(UNBOUNDED, 0))


def weighted_mean(c: str, n: int, w=None) -> Column:
    """Weights 1 (oldest) to n (newest)."""
    total = sum((F.lag(c, k).over(w or W()) * float(n - k) for k in range(n)), F.lit(0.0))
    return full(total / (n * (n + 1) / 2), c, n, last_rows(n, w))


def rolling_correlation(x: str, y: str, n: int, w=None) -> Column:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    frame = last_rows(n, w)
    spread = F.stddev_pop(a).over(frame) * F.stddev_pop(b).over(frame)
    return F.when(F.count(a).over(frame) >= 2, F.try_divide(F.covar_pop(a, b).over(frame), spread))


def rolling_z(c: str, n: int, w=None) -> Column:
    std = rolling_std(c, n, w=w)
    return F.when(std > 0, (F.col(c) - rolling_mean(c, n, w=w)) / std)


def log_return(c: str, w=None) -> Column:
    before = F.lag(c).over(w or W())
    return F.when((F.col(c) > 0) & (before > 0), F.log(F.try_divide(F.col(c), before)))


def simple_return(c: str, w=None) -> Column:
    return F.try_divide(F.col(c), F.lag(c).over(w or W())) - 1


@query("window_rolling", f"""WITH {MULTI} SELECT symbol, time, round(CASE WHEN row_number() OVER w >= 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) END, 4) AS mean20,
  round(CASE WHEN row_number() OVER w >= 20 THEN stddev_samp(close) OVER (w ROWS 19 PRECEDING) END, 3) AS std20, max(high) OVER (w ROWS 89 PRECEDING) AS max90,
  max(close) OVER (w ROWS UNBOUNDED PRECEDING) AS peak, min(close) OVER (w ROWS UNBOUNDED PRECEDING) AS trough, CAST(sum(volume) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_volume,
  lag(close) OVER w AS prev, round(close - lag(close) OVER w, 4) AS diff, round(CASE WHEN row_number() OVER w >= 2 THEN stddev_samp(close) OVER (w ROWS UNBOUNDED PRECEDING) END, 3) AS exp_std,
  coalesce(close >= max(close) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS breakout FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time)""")
def window_rolling(spark, sf_dir):
    b = bars_multi(spark, sf_dir)
    return rounded(b.select(
        "symbol", "time", rolling_mean("close", 20).alias("mean20"), rolling_std("close", 20).alias("std20"), rolling_max("high", 90).alias("max90"), running_max("close").alias("peak"),
        running_min("close").alias("trough"), running_sum("volume").alias("cum_volume"), previous("close").alias("prev"), (F.col("close") - previous("close")).alias("diff"),
        expanding_std("close").alias("exp_std"), F.coalesce(F.col("close") >= F.max("close").over(W().rowsBetween(UNBOUNDED, -1)), F.lit(True)).alias("breakout")), std20=3, exp_std=3)


@query("window_weighted_mean", f"""WITH {MULTI} SELECT symbol, time, round(CASE WHEN row_number() OVER w >= 10 THEN ({' + '.join(f'{10 - k}.0 * lag(close, {k}) OVER w' for k in range(10))}) / 55 END, 4) AS wma10
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time)""")
def window_weighted_mean(spark, sf_dir):
    return rounded(bars_multi(spark, sf_dir).select("symbol", "time", weighted_mean("close", 10).alias("wma10")))


@query("window_percentile", f"""WITH {MULTI}, p AS (SELECT symbol, time, close, list(close) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) AS before FROM bars)
  SELECT symbol, time, round(CASE WHEN len(before) > 0 THEN len(list_filter(before, lambda x: x < close)) / len(before) * 100 END, 6) AS pct90 FROM p""")
def window_percentile(spark, sf_dir):
    """Share of the 90 rows before that are strictly below, in percent."""
    from .ranks import percent_below

    return rounded(percent_below(bars_multi(spark, sf_dir), {"pct90": "close"}, 91, exclude_self=True).select("symbol", "time", "pct90"), 6)


@query("window_correlation", f"""WITH {MULTI}, r AS (SELECT symbol, time, close / lag(close) OVER w - 1 AS rc, volume / CAST(lag(volume) OVER w AS DOUBLE) - 1 AS rv FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time))
  SELECT symbol, time, round(CASE WHEN count(rc) OVER f >= 2 AND stddev_pop(rc) OVER f > 0 AND stddev_pop(rv) OVER f > 0 THEN corr(rc, rv) OVER f END, 5) AS corr30
  FROM r WINDOW f AS (PARTITION BY symbol ORDER BY time ROWS 29 PRECEDING)""")
def window_correlation(spark, sf_dir):
    b = bars_multi(spark, sf_dir).withColumn("v", F.col("volume").cast("double"))
    r = b.withColumn("rc", simple_return("close")).withColumn("rv", simple_return("v"))
    return rounded(r.select("symbol", "time", rolling_correlation("rc", "rv", 30).alias("corr30")), 5)


@query("window_z_score", f"""WITH {MULTI}, z AS (SELECT *, avg(close) OVER f AS m, stddev_samp(close) OVER f AS s, count(close) OVER f AS n FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY time ROWS 364 PRECEDING))
  SELECT symbol, time, round(CASE WHEN n >= 365 AND s > 0 THEN (close - m) / s END, 6) AS z365 FROM z""")
def window_z_score(spark, sf_dir):
    return rounded(bars_multi(spark, sf_dir).select("symbol", "time", rolling_z("close", 365).alias("z365")), 6)


@query("window_anchored_sum", f"""WITH {MULTI} SELECT symbol, time, CAST(sum(volume) OVER (PARTITION BY symbol, date_trunc('week', time) ORDER BY time) AS BIGINT) AS week,
  CAST(sum(volume) OVER (PARTITION BY symbol, date_trunc('month', time) ORDER BY time) AS BIGINT) AS month FROM bars""")
def window_anchored_sum(spark, sf_dir):
    return bars_multi(spark, sf_dir).select("symbol", "time", anchored_sum("volume", "week").alias("week"), anchored_sum("volume", "month").alias("month"))


@query("window_volatility", f"""WITH {MULTI}, r AS (SELECT symbol, time, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY time)) AS r FROM bars)
  SELECT symbol, time, round(CASE WHEN count(r) OVER f >= 30 THEN stddev_pop(r) OVER f * sqrt(365) END, 6) AS vol_pop, round(CASE WHEN count(r) OVER f >= 30 THEN stddev_samp(r) OVER f * sqrt(365) END, 6) AS vol_samp
  FROM r WINDOW f AS (PARTITION BY symbol ORDER BY time ROWS 29 PRECEDING)""")
def window_volatility(spark, sf_dir):
    """Annualised volatility in both conventions: population for the risk score, sample for the indicator."""
    r = bars_multi(spark, sf_dir).withColumn("r", log_return("close"))
    return rounded(r.select("symbol", "time", (rolling_std("r", 30, 0) * F.sqrt(F.lit(365.0))).alias("vol_pop"), (rolling_std("r", 30) * F.sqrt(F.lit(365.0))).alias("vol_samp")), 6)


@query("window_decayed_mean", f"""WITH {MULTI} SELECT symbol, time, round(list_sum(list_transform(list_reverse(l), lambda x, i: x * pow(0.95, i - 1))) / list_sum(list_transform(l, lambda x, i: pow(0.95, i - 1))), 4) AS decayed
  FROM (SELECT symbol, time, list(close) OVER (PARTITION BY symbol ORDER BY time ROWS 99 PRECEDING) AS l FROM bars)""")
def window_decayed_mean(spark, sf_dir):
    """Mean of the last 100 values, each older one weighing 5 % less."""
    return rounded(decayed_mean(bars_multi(spark, sf_dir), "close", 100, 0.95).select("symbol", "time", F.col("decayed")))


def decayed_mean(bars: DataFrame, value: str, n: int, factor: float, span: int = 1000) -> DataFrame:
    """bars with the mean of the last n values, weighing factor^age. Weights factor^-place make it two sums of one window frame;
    rows are cut into stretches of `span`, which carry the n - 1 rows before them along, so that no weight grows beyond measure."""
    from .scans import numbered as number_rows

    numbered = number_rows(bars)
    own = F.expr(f"_rn div {span}")
    dealt = numbered.withColumn("_b", F.explode(F.when(F.col("_rn") % span >= span - (n - 1), F.array(own, own + 1)).otherwise(F.array(own))))
    last = Window.partitionBy("symbol", "_b").orderBy("_rn").rowsBetween(-(n - 1), 0)
    weight = F.pow(F.lit(factor), -(F.col("_rn") - F.col("_b") * span))
    out = dealt.withColumn("decayed", F.sum(F.col(value) * weight).over(last) / F.sum(weight).over(last))
    return out.filter(F.col("_b") == own).drop("_rn", "_b")


@query("window_latest_two", f"""WITH {MULTI} SELECT symbol, arg_max(time, time) AS time, arg_max(close, time) AS current, arg_max(prev, time) AS previous, count(*) AS n FROM (
  SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY time) AS prev FROM bars) GROUP BY symbol""")
def window_latest_two(spark, sf_dir):
    """Current and previous value per key: each task keeps two rows of a key before the shuffle."""
    b = bars_multi(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("time")))
    two = b.select("symbol", "time", "close", place.alias("k")).filter("k <= 2").groupBy("symbol").agg(
        F.max(F.when(F.col("k") == 1, F.col("time"))).alias("time"), F.max(F.when(F.col("k") == 1, F.col("close"))).alias("current"), F.max(F.when(F.col("k") == 2, F.col("close"))).alias("previous"))
    return two.join(b.groupBy("symbol").agg(F.count("*").alias("n")), "symbol")
