"""Bars, flows, fills and other series, derived from the orders, lineitem and events tables by one aggregation each.

Every open, close and latest value is picked by a total order (time, then key), so results do not depend on partitioning.
All partial aggregates combine map-side; the shuffle carries one row per (symbol, period) and task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ohlcv(df: DataFrame, keys: list, price: str, order: list[str], volume=None) -> DataFrame:
    """Open, high, low, close and volume per key; open and close by the first and last row in `order`."""
    by = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return df.groupBy(*keys).agg(
        F.min_by(price, by).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, by).alias("close"),
        (volume if volume is not None else F.count(F.lit(1))).alias("volume"))


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return ohlcv(orders, [F.lit("ALL").alias("symbol"), F.col("o_orderdate").alias("time")], "o_totalprice", ["o_orderkey"])


def bars_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per order priority."""
    orders = table(spark, sf_dir, "orders")
    return ohlcv(orders, [F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("time")], "o_totalprice", ["o_orderkey"])


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return ohlcv(events, [F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("time")], "value", ["ts", "event_id"])


def slow_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily value that becomes known three days later (two clocks)."""
    daily = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("time")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("value"))
    return daily.withColumn("fetch_time", F.col("time") + F.expr("INTERVAL 3 DAYS"))


def macro_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly observations with releases and revisions (three clocks)."""
    orders = table(spark, sf_dir, "orders").withColumn("observation_date", F.to_date(F.date_trunc("month", "o_orderdate")))
    revised = orders.groupBy("observation_date", (F.col("o_orderkey") % 3).cast("int").alias("revision_number")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))
    return revised.withColumn("release_date", F.date_add("observation_date", 40 + 5 * F.col("revision_number"))).withColumn("series_id", F.lit("M"))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions of users: purchases buy, views sell a part."""
    events = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "view"))
    money = F.col("value").cast("decimal(20,8)")
    price = (100 + F.col("event_id") % 37).cast("decimal(20,8)")
    return events.select("user_id", F.col("ts").alias("time"), "event_id", F.when(F.col("event_type") == "purchase", "BUY").otherwise("SELL").alias("side"),
                         F.when(F.col("event_type") == "purchase", money * 3).otherwise(money).cast("decimal(20,8)").alias("amount"), price.alias("price"), (money * F.lit("0.001").cast("decimal(4,3)")).cast("decimal(20,8)").alias("fee"))


def provider_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly mean values of five sources."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("provider"), F.date_trunc("hour", "ts").alias("time")).agg(F.avg("value").alias("price"))


# The same tables as common table expressions for DuckDB.
DAILY = """bars AS (SELECT 'ALL' AS symbol, o_orderdate AS time, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
  arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY o_orderdate)"""
MULTI = """bars AS (SELECT o_orderpriority AS symbol, o_orderdate AS time, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
  arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY 1, 2)"""
HOURLY = """hours AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS time, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2)"""
SLOW = """slow AS (SELECT l_shipdate AS time, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS value, l_shipdate + INTERVAL 3 DAY AS fetch_time FROM lineitem GROUP BY l_shipdate)"""
MACRO = """macro AS (SELECT 'M' AS series_id, observation_date, revision_number, value, CAST(observation_date + CAST(40 + 5 * revision_number AS INT) AS DATE) AS release_date FROM (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS observation_date, CAST(o_orderkey % 3 AS INT) AS revision_number, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders GROUP BY 1, 2))"""
FILLS = """fills AS (SELECT user_id, ts AS time, event_id, CASE WHEN event_type = 'purchase' THEN 'BUY' ELSE 'SELL' END AS side,
  CAST(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(20,8)) * 3 ELSE CAST(value AS DECIMAL(20,8)) END AS DECIMAL(20,8)) AS amount,
  CAST(100 + event_id % 37 AS DECIMAL(20,8)) AS price, CAST(CAST(value AS DECIMAL(20,8)) * 0.001 AS DECIMAL(20,8)) AS fee FROM events WHERE event_type IN ('purchase', 'view'))"""
PROVIDERS = """prices AS (SELECT event_type AS provider, date_trunc('hour', ts) AS time, avg(value) AS price FROM events GROUP BY 1, 2)"""


def rounded(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """Doubles rounded, for results that are compared by value."""
    return df.select(*[F.round(c, special.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


query("bars_daily", f"WITH {DAILY} SELECT * FROM bars")(bars_daily)
query("bars_multi", f"WITH {MULTI} SELECT * FROM bars")(bars_multi)
query("bars_hourly", f"WITH {HOURLY} SELECT * FROM hours")(bars_hourly)


@query("bars_resample_weekly", f"""WITH {MULTI} SELECT symbol, date_trunc('week', time) AS time, arg_min(open, time) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, time) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY 1, 2""")
def bars_resample_weekly(spark, sf_dir):
    """Bars of a longer period from shorter ones; weeks begin on Monday."""
    return resample(bars_multi(spark, sf_dir), "week")


def resample(bars: DataFrame, unit: str) -> DataFrame:
    return bars.groupBy("symbol", F.date_trunc(unit, "time").alias("period")).agg(
        F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), F.sum("volume").alias("volume"),
    ).withColumnRenamed("period", "time")


@query("range_scan", f"WITH {HOURLY} SELECT * FROM hours WHERE symbol = 'click' AND time >= TIMESTAMP '2024-01-05' AND time < TIMESTAMP '2024-01-12'")
def range_scan(spark, sf_dir):
    """Bars of one symbol in a range; both predicates reach the scan of events."""
    events = table(spark, sf_dir, "events").filter((F.col("event_type") == "click") & (F.col("ts") >= F.lit("2024-01-05").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-12").cast("timestamp")))
    return ohlcv(events, [F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("time")], "value", ["ts", "event_id"])


@query("latest_n", f"WITH {MULTI} SELECT symbol, time, close FROM bars WHERE symbol = '1-URGENT' ORDER BY time DESC LIMIT 120")
def latest_n(spark, sf_dir):
    """The last n bars, oldest first."""
    return bars_multi(spark, sf_dir).filter("symbol = '1-URGENT'").orderBy(F.desc("time")).limit(120).select("symbol", "time", "close").orderBy("time")
