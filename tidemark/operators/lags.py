"""What a series was some time ago: the last value at or before each row's time less a distance in seconds, several distances in one pass.

Rows are cut into blocks as long as the longest distance. A lookup of a row falls into its own block or the one before, so each row
is also sent, without its other columns, to the next block, and a block gets the last row of all earlier ones besides (from one row
per block). One shuffle by key and block, one sort, one range frame per distance; a key with most rows is as many tasks as blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.frames import HOURLY, bars_hourly, rounded

#: Labels of the usual distances, in hours.
CHANGE_HOURS = {"1h": 1, "24h": 24, "7d": 7 * 24, "30d": 30 * 24}


def values_before(df: DataFrame, value: str, seconds: dict[str, float], by: tuple[str, ...] = ("symbol",), time: str = "time") -> DataFrame:
    """df with a column per name of `seconds`: the value of the last row of the same keys at or before time less so many seconds (NULL if
    there is none). Rows without a value are passed over; of rows that tie in time the largest value counts; rows without a time find nothing.
    """
    by, micros = list(by), {n: round(s * 1_000_000) for n, s in seconds.items()}
    longest = max(1, *micros.values())
    at = F.unix_micros(F.col(time).cast("timestamp"))
    row = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], at.alias("_at"), F.floor(at / longest).alias("_block"), F.col(value).alias("_v"), F.struct(*df.columns).alias("_row"))
    keys = [f"_k{i}" for i in range(len(by))]
    point = F.when(F.col("_v").isNotNull(), F.struct("_at", "_v"))
    nothing = F.lit(None).cast(row.schema["_row"].dataType)
    echoes = row.filter("_v IS NOT NULL AND _at IS NOT NULL").select(*keys, "_at", (F.col("_block") + 1).alias("_block"), "_v", nothing.alias("_row"))
    ends = row.filter("_at IS NOT NULL").groupBy(*keys, "_block").agg(F.max(point).alias("_end"))
    # The window runs over one row per block. Blocks before the last are reached by no echo.
    earlier = Window.partitionBy(*keys).orderBy("_block").rangeBetween(Window.unboundedPreceding, -2)
    seeds = ends.withColumn("_end", F.max("_end").over(earlier)).filter("_end IS NOT NULL").select(*keys, F.col("_end._at").alias("_at"), "_block", F.col("_end._v").alias("_v"), nothing.alias("_row"))
    w = Window.partitionBy(*keys, "_block").orderBy("_at")
    found = row.unionByName(echoes).unionByName(seeds).select("_row", *[
        F.when(F.col("_at").isNotNull(), F.max(point).over(w.rangeBetween(Window.unboundedPreceding, -m))["_v"]).alias(n) for n, m in micros.items()])
    return found.filter("_row IS NOT NULL").select("_row.*", *micros)


def changes(df: DataFrame, value: str, hours: dict[str, float] | None = None, by: tuple[str, ...] = ("symbol",), time: str = "time", prefix: str = "change_") -> DataFrame:
    """df with the change in per cent over each of `hours` (label to number); unknown without a value then, or with 0."""
    hours = CHANGE_HOURS if hours is None else hours
    old = values_before(df, value, {f"_then_{n}": h * 3600 for n, h in hours.items()}, by, time)
    percent = lambda n: (F.try_divide(F.col(value), F.col(f"_then_{n}")) - 1) * 100
    return old.select(*df.columns, *[percent(n).alias(f"{prefix}{n}") for n in hours])


@query("change_over_hours", f"WITH {HOURLY}, " + ", ".join(
    f"h{k} AS (SELECT a.*, b.close AS c{k} FROM {'hours' if k == 0 else f'h{k - 1}'} a ASOF LEFT JOIN hours b ON a.symbol = b.symbol AND a.time - INTERVAL {h} HOUR >= b.time)" for k, h in enumerate(CHANGE_HOURS.values()))
    + "\n  SELECT symbol, time, close, " + ", ".join(f"round((close / c{k} - 1) * 100, 5) + 0.0 AS change_{n}" for k, n in enumerate(CHANGE_HOURS)) + f" FROM h{len(CHANGE_HOURS) - 1}")
def q_changes(spark, sf_dir):
    """Changes over an hour, a day, a week and thirty days of time, whatever rows there are."""
    c = changes(bars_hourly(spark, sf_dir).select("symbol", "time", "close"), "close")
    return c.select("symbol", "time", "close", *[(F.round(f"change_{n}", 5) + 0.0).alias(f"change_{n}") for n in CHANGE_HOURS])


@query("change_over_weeks", """WITH d AS (SELECT o_orderpriority AS symbol, o_orderdate AS time, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2), a AS (SELECT d.*, b.n AS b FROM d ASOF LEFT JOIN d b ON d.symbol = b.symbol AND d.time - INTERVAL 168 HOUR >= b.time),
  e AS (SELECT a.*, c.n AS c FROM a ASOF LEFT JOIN d c ON a.symbol = c.symbol AND a.time - INTERVAL 2160 HOUR >= c.time)
  SELECT symbol, time, round((n / b - 1) * 100, 5) + 0.0 AS change_week, round((n / c - 1) * 100, 5) + 0.0 AS change_quarter FROM e""")
def q_change_weeks(spark, sf_dir):
    """Any number of hours: a week and ninety days, over days with gaps."""
    d = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("time")).agg(F.count("*").cast("double").alias("n"))
    c = rounded(changes(d, "n", {"week": 168, "quarter": 2160}), 5)
    return c.select("symbol", "time", (F.col("change_week") + 0.0).alias("change_week"), (F.col("change_quarter") + 0.0).alias("change_quarter"))
