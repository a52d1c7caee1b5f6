"""As-of lookups: the latest row at or before a time, under one, two or three clocks.

Both sides are unioned, tagged, and the value is carried forward by one window: one shuffle on the symbol and one sort, with no
range join. A series too long for one task is first cut into buckets of time; each bucket starts with the last value before it,
so a hot symbol becomes many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.frames import DAILY, HOURLY, MACRO, MULTI, SLOW, bars_daily, bars_hourly, bars_multi, macro_series, slow_series


def _bucket(time: str, bucket: str | int):
    return F.date_trunc(bucket, time) if isinstance(bucket, str) else F.floor(F.col(time) / bucket)


def running_best(rows: DataFrame, time: str, value: str, by: list[str] = (), bucket: str = "year") -> DataFrame:
    """rows with value as the largest so far, in order of time. Inside a bucket by a window; what came before it from one row per bucket."""
    by = list(by)
    cut = rows.withColumn("_rb", _bucket(time, bucket))
    inside = Window.partitionBy(*by, "_rb").orderBy(time)
    over = Window.partitionBy(*by).orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy(*by, "_rb").agg(F.max(value).alias("_top")).withColumn("_carried", F.max("_top").over(over)).drop("_top")
    joined = cut.join(before, [*by, "_rb"]) if by else cut.join(before, "_rb")
    own = joined.withColumn(value, F.max(value).over(inside))
    return own.withColumn(value, F.when(F.col("_carried").isNull() | (F.col(value) >= F.col("_carried")), F.col(value)).otherwise(F.col("_carried"))).drop("_rb", "_carried")


def asof_backward(left: DataFrame, right: DataFrame, time: str, right_time: str, values: list[str], by: list[str] = (), bucket: str | int | None = None) -> DataFrame:
    """left with the values of the latest right row whose right_time is at or before time (NULL if none).

    by: equal keys. bucket: a date_trunc unit, or a length for times that are numbers; rows are then handled per (by, bucket), and
    each bucket is given the last right row of the earlier ones, found from one row per bucket. Of right rows that tie in time the largest values win.
    """
    by = list(by)
    payload = F.struct(*[F.col(v).alias(v) for v in values])
    lrow = F.struct(*[F.col(c).alias(c) for c in left.columns])
    null_left, null_value = F.lit(None).cast(left.schema.simpleString()), F.lit(None).cast(right.select(payload.alias("v")).schema["v"].dataType)
    a = left.select(*by, F.col(time).alias("_t"), F.lit(1).alias("_side"), null_value.alias("_v"), lrow.alias("_row"))
    b = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), payload.alias("_v"), null_left.alias("_row"))
    key = list(by)
    if bucket:
        # The last right row of each bucket, carried to the next buckets that exist on the left.
        a, b = (x.withColumn("_b", _bucket("_t", bucket)) for x in (a, b))
        ends = b.groupBy(*by, "_b").agg(F.max(F.struct("_t", "_v")).alias("_end"))
        begins = a.select(*by, "_b").distinct().withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType)).withColumn("_ask", F.lit(0))
        over = Window.partitionBy(*by).orderBy("_b", "_ask").rowsBetween(Window.unboundedPreceding, -1)
        seeds = (
            ends.withColumn("_ask", F.lit(1)).unionByName(begins).withColumn("_end", F.when(F.col("_ask") == 0, F.last("_end", True).over(over)).otherwise(F.col("_end")))
            .filter("_ask = 0 and _end is not null").select(*by, F.col("_end._t").alias("_t"), F.lit(0).alias("_side"), F.col("_end._v").alias("_v"), null_left.alias("_row"), "_b")
        )
        b, key = b.unionByName(seeds), [*by, "_b"]
    w = Window.partitionBy(*key).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    carried = a.unionByName(b).withColumn("_found", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    return carried.select("_row.*", *[F.col("_found")[v].alias(v) for v in values])


def asof_forward(left: DataFrame, right: DataFrame, time: str, right_time: str, value: str, by: list[str] = (), days: int = 31) -> DataFrame:
    """left with the value of the first right row at or after time, in buckets of so many days."""
    flipped = lambda df, c: df.withColumn("_neg", -F.unix_micros(F.col(c).cast("timestamp")))
    return asof_backward(flipped(left, time), flipped(right, right_time).select(*by, "_neg", value), "_neg", "_neg", [value], by, bucket=days * 86_400_000_000).drop("_neg")


def known_at(df: DataFrame, at, observed: str = "time", fetched: str = "fetch_time") -> DataFrame:
    """Rows observed, and if that is recorded learnt, by a time."""
    return df.filter((F.col(observed) <= at) & (F.col(fetched).isNull() | (F.col(fetched) <= at)))


def asof_two_clocks(left: DataFrame, right: DataFrame, time: str, values: list[str], observed: str = "time", fetched: str = "fetch_time", by: list[str] = (), bucket: str = "year") -> DataFrame:
    """The right row of equal keys with the latest observation among those known at the left time.

    At any moment the answer is the running maximum, in order of the moment a row becomes known, of (observation, row): so it is a
    running maximum, cut into buckets, and an as-of lookup in it, not a range join.
    """
    by = list(by)
    known = F.greatest(F.col(observed), F.coalesce(F.col(fetched), F.col(observed)))
    payload = F.struct(F.col(observed).alias("_observed"), *[F.col(v).alias(v) for v in values])
    best = running_best(right.select(*by, known.alias("_known"), payload.alias("_best")), "_known", "_best", by, bucket)
    return asof_backward(left, best, time, "_known", ["_best"], by, bucket).select(
        *left.columns, F.col("_best")["_observed"].alias("observed"), *[F.col("_best")[v].alias(v) for v in values])


def asof_release(left: DataFrame, right: DataFrame, time: str, by: list[str] = (), bucket: str = "year") -> DataFrame:
    """The latest observation, in its latest revision, among the rows of equal keys that are released at the left time."""
    by = list(by)
    rows = right.select(*by, F.col("release_date").cast("timestamp_ntz").alias("_known"), F.struct("observation_date", "revision_number", "value").alias("_best"))
    return asof_backward(left, running_best(rows, "_known", "_best", by, bucket), time, "_known", ["_best"], by, bucket).select(*left.columns, "_best.*")


def leaks(df: DataFrame, as_of: str, observed: str, fetched: str) -> DataFrame:
    """Rows that were not known at their as-of time (there should be none)."""
    return df.filter((F.col(observed) > F.col(as_of)) | (F.col(fetched) > F.col(as_of)))


@query("asof_backward", f"WITH {DAILY}, {SLOW} SELECT b.time, b.close, s.value FROM bars b ASOF LEFT JOIN slow s ON b.time >= s.time")
def q_asof(spark, sf_dir):
    return asof_backward(bars_daily(spark, sf_dir).select("time", "close"), slow_series(spark, sf_dir).select("time", "value"), "time", "time", ["value"], bucket="year")


@query("asof_backward_keyed", f"WITH {MULTI} SELECT a.symbol, a.at, b.close FROM (SELECT symbol, time - INTERVAL 30 DAY AS at FROM bars) a ASOF LEFT JOIN bars b ON a.symbol = b.symbol AND a.at >= b.time")
def q_asof_keyed(spark, sf_dir):
    """The close thirty days before each bar, cut by quarter."""
    b = bars_multi(spark, sf_dir)
    asked = b.select("symbol", (F.col("time") - F.expr("INTERVAL 30 DAYS")).alias("at"))
    return asof_backward(asked, b.select("symbol", "time", "close"), "at", "time", ["close"], ["symbol"], bucket="quarter")


@query("asof_forward", f"WITH {HOURLY} SELECT a.symbol, a.at, b.close FROM (SELECT symbol, time + INTERVAL 7 HOUR AS at FROM hours) a ASOF LEFT JOIN hours b ON a.symbol = b.symbol AND a.at <= b.time")
def q_asof_forward(spark, sf_dir):
    h = bars_hourly(spark, sf_dir)
    return asof_forward(h.select("symbol", (F.col("time") + F.expr("INTERVAL 7 HOURS")).alias("at")), h.select("symbol", "time", "close"), "at", "time", "close", ["symbol"])


@query("asof_two_clocks", f"WITH {DAILY}, {SLOW} SELECT b.time, max(s.time) AS observed, arg_max(s.value, s.time) AS value FROM bars b LEFT JOIN slow s ON s.time <= b.time AND s.fetch_time <= b.time GROUP BY b.time")
def q_two_clocks(spark, sf_dir):
    return asof_two_clocks(bars_daily(spark, sf_dir).select("time"), slow_series(spark, sf_dir), "time", ["value"])


@query("asof_release_revision", f"""WITH {DAILY}, {MACRO} SELECT b.time, arg_max(observation_date, (observation_date, revision_number)) AS observation_date, arg_max(revision_number, (observation_date, revision_number)) AS revision_number,
  arg_max(value, (observation_date, revision_number)) AS value FROM bars b LEFT JOIN macro m ON m.release_date <= b.time GROUP BY b.time""")
def q_release(spark, sf_dir):
    left = bars_daily(spark, sf_dir).select(F.col("time").cast("timestamp_ntz").alias("time"))
    return asof_release(left, macro_series(spark, sf_dir), "time")


_TWO_SLOW = "two AS (SELECT 'a' AS series_id, time, value, fetch_time FROM slow UNION ALL SELECT 'b', time, -value, fetch_time + INTERVAL 40 DAY FROM slow WHERE day(time) % 5 = 0), ask AS (SELECT k AS series_id, time FROM bars, (VALUES ('a'), ('b'), ('c')) t(k))"


@query("asof_two_clocks_keyed", f"WITH {DAILY}, {SLOW}, {_TWO_SLOW} SELECT q.series_id, q.time, max(s.time) AS observed, arg_max(s.value, s.time) AS value FROM ask q LEFT JOIN two s ON s.series_id = q.series_id AND s.time <= q.time AND s.fetch_time <= q.time GROUP BY 1, 2")
def q_two_clocks_keyed(spark, sf_dir):
    """Two series with clocks of their own, and one without any row."""
    s = slow_series(spark, sf_dir)
    two = s.select(F.lit("a").alias("series_id"), "time", "value", "fetch_time").unionByName(
        s.filter(F.dayofmonth("time") % 5 == 0).select(F.lit("b").alias("series_id"), "time", (-F.col("value")).alias("value"), (F.col("fetch_time") + F.expr("INTERVAL 40 DAYS")).alias("fetch_time")))
    ask = bars_daily(spark, sf_dir).select(F.explode(F.array(*map(F.lit, "abc"))).alias("series_id"), "time")
    return asof_two_clocks(ask, two, "time", ["value"], by=["series_id"])


@query("asof_release_keyed", f"""WITH {DAILY}, {MACRO}, two AS (SELECT observation_date, revision_number, value, release_date, 'M' AS series_id FROM macro UNION ALL SELECT observation_date, revision_number, -value, CAST(release_date + INTERVAL 90 DAY AS DATE), 'N' FROM macro WHERE revision_number < 2),
  ask AS (SELECT k AS series_id, time FROM bars, (VALUES ('M'), ('N')) t(k)) SELECT q.series_id, q.time, arg_max(observation_date, (observation_date, revision_number)) AS observation_date, arg_max(revision_number, (observation_date, revision_number)) AS revision_number,
  arg_max(value, (observation_date, revision_number)) AS value FROM ask q LEFT JOIN two m ON m.series_id = q.series_id AND m.release_date <= q.time GROUP BY 1, 2""")
def q_release_keyed(spark, sf_dir):
    """Two series released on different days; values of one never answer for the other."""
    m = macro_series(spark, sf_dir).select("series_id", "observation_date", "revision_number", "value", "release_date")
    two = m.unionByName(m.filter("revision_number < 2").select(F.lit("N").alias("series_id"), "observation_date", "revision_number", (-F.col("value")).alias("value"), F.date_add("release_date", 90).alias("release_date")))
    ask = bars_daily(spark, sf_dir).select(F.explode(F.array(F.lit("M"), F.lit("N"))).alias("series_id"), F.col("time").cast("timestamp_ntz").alias("time"))
    return asof_release(ask, two, "time", ["series_id"])


@query("asof_known_at", f"WITH {SLOW} SELECT time, value FROM slow WHERE time <= TIMESTAMP '1997-06-30' AND fetch_time <= TIMESTAMP '1997-06-30'")
def q_known_at(spark, sf_dir):
    return known_at(slow_series(spark, sf_dir), F.lit("1997-06-30").cast("timestamp")).select("time", "value")


@query("horizon_outcome", f"""WITH {MULTI}, o AS (SELECT a.symbol, a.time, a.close AS start, arg_max(b.close, b.time) AS price, min(b.low) AS lowest, max(b.high) AS highest, count(*) AS n
  FROM bars a JOIN bars b ON a.symbol = b.symbol AND b.time BETWEEN a.time AND a.time + INTERVAL 30 DAY GROUP BY ALL)
  SELECT symbol, time, price, lowest, highest, n, round(price / start - 1, 6) AS change FROM o""")
def q_horizon(spark, sf_dir):
    """All bars of the next thirty days, as a range frame of one window instead of a range join."""
    day = 86_400_000_000
    w = Window.partitionBy("symbol").orderBy("us").rangeBetween(0, 30 * day)
    b = bars_multi(spark, sf_dir).withColumn("us", F.unix_micros(F.col("time").cast("timestamp")))
    return b.select("symbol", "time", F.last("close").over(w).alias("price"), F.min("low").over(w).alias("lowest"), F.max("high").over(w).alias("highest"), F.count("*").over(w).alias("n"),
                    F.round(F.last("close").over(w) / F.col("close") - 1, 6).alias("change"))


@query("leakage_check", f"WITH {DAILY}, {SLOW} SELECT count(*) AS leaks FROM (SELECT b.time AS as_of, s.time, s.fetch_time FROM bars b ASOF LEFT JOIN slow s ON b.time >= s.time) WHERE time > as_of OR fetch_time > as_of")
def q_leaks(spark, sf_dir):
    """A lookup that ignores the second clock reads values before they were known; the assertion counts them."""
    s = slow_series(spark, sf_dir).select("time", "fetch_time", F.col("time").alias("observed"))
    found = asof_backward(bars_daily(spark, sf_dir).select(F.col("time").alias("as_of")), s, "as_of", "time", ["observed", "fetch_time"])
    return leaks(found, "as_of", "observed", "fetch_time").agg(F.count("*").alias("leaks"))
