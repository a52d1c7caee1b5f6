"""Aggregations over observations and flows: rollups, conditional sums, medians, regressions, compounding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.frames import DAILY, MULTI, PROVIDERS, bars_daily, bars_multi, provider_prices, rounded, table


@query("daily_rollup", """SELECT event_type, date_trunc('day', ts) AS day, round(avg(value), 6) AS mean, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS last, count(*) AS n FROM events GROUP BY 1, 2""")
def daily_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(
        F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", F.struct("ts", "event_id")).alias("last"), F.count("*").alias("n"))


@query("counts_and_latest", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, max(ts) AS latest FROM events GROUP BY event_type")
def counts_and_latest(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.max("ts").alias("latest"))


@query("distinct_users", "SELECT DISTINCT user_id FROM events")
def distinct_users(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id").distinct()


@query("source_statistics", f"WITH {PROVIDERS} SELECT time, round(avg(price), 6) AS mean, round(median(price), 6) AS median, round(stddev_samp(price), 5) AS std, count(*) AS n FROM prices GROUP BY time")
def source_statistics(spark, sf_dir):
    return rounded(provider_prices(spark, sf_dir).groupBy("time").agg(
        F.avg("price").alias("mean"), F.median("price").alias("median"), F.stddev_samp("price").alias("std"), F.count("*").alias("n")), 6, std=5)


@query("sums_by_side", """SELECT date_trunc('day', ts) AS day, sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,4)) END) AS bought, sum(CASE WHEN event_type = 'view' THEN CAST(value AS DECIMAL(18,4)) END) AS seen,
  coalesce(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,4)) END), 0) - coalesce(sum(CASE WHEN event_type = 'view' THEN CAST(value AS DECIMAL(18,4)) END), 0) AS net FROM events GROUP BY 1""")
def sums_by_side(spark, sf_dir):
    """Sums that skip nulls; a side without rows is NULL in its own column and 0 in the net."""
    v = F.col("value").cast("decimal(18,4)")
    side = lambda t: F.sum(F.when(F.col("event_type") == t, v))
    zero = F.lit(0).cast("decimal(28,4)")
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(
        side("purchase").alias("bought"), side("view").alias("seen"), (F.coalesce(side("purchase"), zero) - F.coalesce(side("view"), zero)).alias("net"))


@query("sums_as_map", """SELECT o_orderpriority AS symbol, count(*) AS n_years, CAST(sum(total) AS DECIMAL(38,2)) AS total, max(total) AS largest FROM (
  SELECT o_orderpriority, year(o_orderdate) AS y, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY 1, 2) GROUP BY 1""")
def sums_as_map(spark, sf_dir):
    """Group sums gathered into a map by the second key, then read back from it."""
    per = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    m = per.groupBy(F.col("o_orderpriority").alias("symbol")).agg(F.map_from_entries(F.collect_list(F.struct("y", "total"))).alias("m"))
    values = F.map_values("m")
    return m.select("symbol", F.size("m").cast("long").alias("n_years"), F.aggregate(values, F.lit(0).cast("decimal(38,2)"), lambda a, x: (a + x).cast("decimal(38,2)")).alias("total"), F.array_max(values).alias("largest"))


@query("net_flow_window", """WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,4)) ELSE -CAST(value AS DECIMAL(18,4)) END) AS flow FROM events GROUP BY 1)
  SELECT day, sum(flow) OVER (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS net7, sum(flow) OVER (ORDER BY day) AS cumulative, CAST(sum(CASE WHEN flow > 0 THEN 1 ELSE 0 END) OVER (ORDER BY day) AS BIGINT) AS inflow_days FROM d""")
def net_flow_window(spark, sf_dir):
    """Net flow of the last seven days, cumulative flow and inflow days, over one row per day."""
    v = F.col("value").cast("decimal(18,4)")
    d = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum(F.when(F.col("event_type") == "purchase", v).otherwise(-v)).alias("flow")).withColumn("n", F.datediff("day", F.lit("2000-01-01")))
    w = Window.orderBy("n")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return d.select("day", F.sum("flow").over(w.rangeBetween(-6, 0)).alias("net7"), F.sum("flow").over(run).alias("cumulative"), F.sum(F.when(F.col("flow") > 0, 1).otherwise(0)).over(run).alias("inflow_days"))


@query("weekly_performance", f"""WITH {MULTI} SELECT symbol, date_trunc('week', time) AS week, max(high) AS high, min(low) AS low, arg_min(close, time) AS first, arg_max(close, time) AS last,
  round(arg_max(close, time) / arg_min(close, time) - 1, 6) AS change FROM bars GROUP BY 1, 2""")
def weekly_performance(spark, sf_dir):
    return bars_multi(spark, sf_dir).groupBy("symbol", F.date_trunc("week", "time").alias("week")).agg(
        F.max("high").alias("high"), F.min("low").alias("low"), F.min_by("close", "time").alias("first"), F.max_by("close", "time").alias("last"),
        F.round(F.max_by("close", "time") / F.min_by("close", "time") - 1, 6).alias("change"))


@query("weighted_average", "SELECT l_returnflag, round(sum(CASE WHEN l_discount > 0 THEN l_extendedprice * l_discount END) / sum(CASE WHEN l_discount > 0 THEN l_discount END), 4) AS mean FROM lineitem GROUP BY 1")
def weighted_average(spark, sf_dir):
    """Non-positive, null and NaN weights take no part."""
    w = F.when((F.col("l_discount") > 0) & ~F.isnan("l_discount") & F.col("l_extendedprice").isNotNull(), F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.try_divide(F.sum(F.col("l_extendedprice") * w), F.sum(w)), 4).alias("mean"))


@query("log_trend", f"""WITH {MULTI}, n AS (SELECT symbol, time, close, CAST(row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS DOUBLE) AS x, ln(close) AS y FROM bars WHERE close > 0),
  f AS (SELECT symbol, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n FROM n GROUP BY symbol), r AS (SELECT n.*, y - (a + b * x) AS e, a, b, f.n FROM n JOIN f USING (symbol))
  SELECT symbol, round(any_value(b), 9) AS slope, round(any_value(a), 5) AS intercept, round(sqrt(avg(e * e)), 6) AS sigma, round(arg_max(e, time) / sqrt(avg(e * e)), 5) AS deviation FROM r GROUP BY symbol HAVING count(*) >= 200""")
def log_trend(spark, sf_dir):
    """Regression of the logarithm of the price on time, and where the last price stands in standard deviations."""
    b = bars_multi(spark, sf_dir).filter("close > 0").withColumn("x", (F.row_number().over(Window.partitionBy("symbol").orderBy("time")) - 1).cast("double")).withColumn("y", F.log("close"))
    fit = b.groupBy("symbol").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.count("*").alias("n")).filter("n >= 200")
    r = b.join(fit, "symbol").withColumn("e", F.col("y") - (F.col("a") + F.col("b") * F.col("x")))
    sigma = F.sqrt(F.avg(F.col("e") * F.col("e")))
    return r.groupBy("symbol").agg(F.round(F.first("b"), 9).alias("slope"), F.round(F.first("a"), 5).alias("intercept"), F.round(sigma, 6).alias("sigma"), F.round(F.try_divide(F.max_by("e", "time"), sigma), 5).alias("deviation"))


@query("peak_and_drawdown", f"WITH {MULTI} SELECT symbol, max(high) AS peak, arg_max(time, (high, -epoch(time))) AS peak_time, round(arg_max(close, time) / max(high) - 1, 6) AS drawdown FROM bars GROUP BY symbol")
def peak_and_drawdown(spark, sf_dir):
    first_peak = F.max_by("time", F.struct("high", -F.unix_micros(F.col("time").cast("timestamp"))))
    return bars_multi(spark, sf_dir).groupBy("symbol").agg(F.max("high").alias("peak"), first_peak.alias("peak_time"), F.round(F.max_by("close", "time") / F.max("high") - 1, 6).alias("drawdown"))


@query("compounded_return", f"""WITH {MULTI}, r AS (SELECT symbol, time, close / lag(close) OVER (PARTITION BY symbol ORDER BY time) AS g FROM bars) SELECT symbol, year(time) AS year, round(exp(sum(ln(g))), 6) AS growth FROM r WHERE g > 0 GROUP BY 1, 2""")
def compounded_return(spark, sf_dir):
    """The product of growth factors, as the exponential of the sum of their logarithms."""
    g = F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("time"))
    return bars_multi(spark, sf_dir).withColumn("g", g).filter("g > 0").groupBy("symbol", F.year("time").cast("long").alias("year")).agg(F.round(F.exp(F.sum(F.log("g"))), 6).alias("growth"))


@query("level_histogram", f"""WITH {DAILY} SELECT CASE WHEN close < 50000 THEN 'LOW' WHEN close < 200000 THEN 'MID' ELSE 'HIGH' END AS level, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM bars GROUP BY 1""")
def level_histogram(spark, sf_dir):
    """How often each level occurred: a prior over states."""
    band = F.when(F.col("close") < 50000, "LOW").when(F.col("close") < 200000, "MID").otherwise("HIGH")
    h = bars_daily(spark, sf_dir).groupBy(band.alias("level")).agg(F.count("*").alias("n"))
    return h.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))
