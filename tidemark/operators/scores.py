"""Scores of data and of its providers: five-dimension quality, report levels, health by eight dimensions, gates, stale values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ramp
from ..registry import query
from ..sources.frames import HOURLY, MULTI, bars_hourly, bars_multi, rounded, table
from .relational import problems

# Weights of the dimensions, limits of levels and ages.
QUALITY_WEIGHTS = {"completeness": 0.30, "accuracy": 0.25, "consistency": 0.20, "timeliness": 0.15, "validity": 0.10}
HEALTH_WEIGHTS = {"accuracy": 0.15, "latency": 0.15, "stability": 0.20, "success_rate": 0.20, "completeness": 0.10, "reliability": 0.10, "timeliness": 0.05, "reachability": 0.05}
ALERT_BELOW, CRITICAL_UPTO = 70, 50
MAX_AGE = {"price": 300, "indicator": 172_800, "engine": 172_800}
QUALITY_RANK = {"VERIFIED": 3, "ESTIMATED": 2, "STALE": 1, "SUSPECT": 0}


def share_left(bad: Column, n: Column) -> Column:
    return F.when(n > 0, (1 - bad / n) * 100).otherwise(0.0)


def timeliness(age: Column, interval: Column) -> Column:
    """100 up to one interval, 50 at two, 5 at five and 0 beyond; without an update 0."""
    ratio = F.try_divide(age, interval)
    return F.when(ratio.isNull() | (ratio > 5), 0.0).otherwise(ramp(ratio, [(1.0, 100.0), (2.0, 50.0), (5.0, 5.0)]))


def quality_score(rows: DataFrame) -> DataFrame:
    """rows (found, expected, outliers, conflicts, invalid, age, interval) with the five dimensions, score, level and alert_level."""
    n = F.col("found")
    out = rows.withColumns({
        "completeness": F.when(F.col("expected") > 0, F.least(F.lit(100.0), n / F.col("expected") * 100)).otherwise(0.0), "accuracy": share_left(F.col("outliers"), n), "consistency": share_left(F.col("conflicts"), n),
        "timeliness": timeliness(F.col("age"), F.col("interval")), "validity": share_left(F.col("invalid"), n)})
    out = out.withColumn("score", sum((F.col(k) * w for k, w in QUALITY_WEIGHTS.items()), F.lit(0.0)))
    s = F.round("score", 9)
    return out.withColumn("level", F.when(s > 90, "EXCELLENT").when(s > 70, "GOOD").when(s > 50, "WARNING").otherwise("CRITICAL")).withColumn(
        "alert_level", F.when(s <= CRITICAL_UPTO, "CRITICAL").when(s < ALERT_BELOW, "WARNING").otherwise("INFO"))


def health_score(m: DataFrame) -> DataFrame:
    """m (accuracy, latency_ms, uptime_hours, requests, failures, completeness, delay_seconds, reachable) with eight scores s_*, score and state."""
    within = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0))
    scores = {
        "accuracy": within(F.col("accuracy") * 100), "latency": F.when(F.col("latency_ms") <= 0, 50.0).otherwise(within(100 - (F.col("latency_ms") - 100) / 50)), "stability": within(F.col("uptime_hours") / 168 * 100),
        "success_rate": F.when(F.col("requests") == 0, 100.0).otherwise((F.col("requests") - F.col("failures")) / F.col("requests") * 100), "completeness": within(F.col("completeness") * 100),
        "reliability": F.greatest(F.lit(0.0), 100.0 - F.col("failures") * 10), "timeliness": F.when(F.col("delay_seconds") <= 0, 100.0).otherwise(F.greatest(F.lit(0.0), 100 - F.col("delay_seconds") / 300 * 100)),
        "reachability": F.when(F.col("reachable"), 100.0).otherwise(0.0)}
    out = m.withColumns({f"s_{k}": v.cast("double") for k, v in scores.items()}).withColumn("score", within(sum((F.col(f"s_{k}") * w for k, w in HEALTH_WEIGHTS.items()), F.lit(0.0))))
    s = F.round("score", 9)
    state = F.when(~F.col("reachable"), F.when(F.col("streak") >= 3, "OFFLINE").otherwise("NETWORK_ERROR")).when(s < 20, "OFFLINE").when(s < 75, "DEGRADED").when(F.col("latency_ms") > 3000, "SLOW").when(F.col("streak") >= 3, "OFFLINE").otherwise("ONLINE")
    return out.withColumn("state", state)


def fresh(value: Column, age_seconds: Column, kind: str) -> Column:
    """The value, or NULL (unknown to conditions) if it is older than its kind may be."""
    return F.when(age_seconds <= MAX_AGE[kind], value)


def gates(status: Column, n_sources: Column, least_quality: str | None = None, several: bool = False) -> Column:
    """Whether a row's quality mark is at least the one asked for, and, if asked for, it has several sources."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in QUALITY_RANK.items() for x in kv]), status), F.lit(0))
    return (F.lit(True) if least_quality is None else rank >= QUALITY_RANK[least_quality]) & (n_sources >= 2 if several else F.lit(True))


def quality_inputs(bars: DataFrame, hours: int = 24 * 31) -> DataFrame:
    """What quality_score reads, of hourly bars: volumes far from the mean are outliers, bars that close at an edge conflicts."""
    from pyspark.sql import Window

    per = Window.partitionBy("symbol")
    z = F.abs(F.try_divide(F.col("volume") - F.avg("volume").over(per), F.stddev_samp("volume").over(per)))
    b = bars.withColumn("z", z).withColumn("high", F.when(F.hour("time") == 3, F.col("low") - 1).otherwise(F.col("high")))
    b = b.withColumn("bad", F.when(F.size(problems(b.drop("z").columns)) > 0, 1).otherwise(0))
    end = F.max(F.unix_timestamp(F.col("time").cast("timestamp")))
    newest = bars.agg(end.alias("newest"))
    per_symbol = b.groupBy("symbol").agg(
        F.count("*").alias("found"), F.sum(F.when(F.col("z") > 2, 1).otherwise(0)).alias("outliers"), F.sum(F.when(F.col("close") == F.col("low"), 1).otherwise(0)).alias("conflicts"), F.sum("bad").alias("invalid"), end.alias("last"))
    return per_symbol.join(F.broadcast(newest)).select("symbol", "found", F.lit(hours).alias("expected"), "outliers", "conflicts", "invalid", (F.col("newest") - F.col("last")).alias("age"), F.lit(3600).alias("interval"))


@query("quality_five_dimensions", f"""WITH {HOURLY}, z AS (SELECT *, abs((volume - avg(volume) OVER (PARTITION BY symbol)) / nullif(stddev_samp(volume) OVER (PARTITION BY symbol), 0)) AS z, CASE WHEN hour(time) = 3 THEN low - 1 ELSE high END AS h FROM hours),
  q AS (SELECT symbol, count(*) AS n, sum(CASE WHEN z > 2 THEN 1 ELSE 0 END) AS o, sum(CASE WHEN close = low THEN 1 ELSE 0 END) AS c, sum(CASE WHEN h < low OR open > h OR close > h OR least(open, close) < low OR least(open, close, h, low) <= 0 OR volume < 0 THEN 1 ELSE 0 END) AS i,
    (epoch((SELECT max(time) FROM hours)) - epoch(max(time))) / 3600 AS r FROM z GROUP BY 1),
  d AS (SELECT symbol, least(100, n / 744.0 * 100) AS completeness, (1 - o / n) * 100 AS accuracy, (1 - c / n) * 100 AS consistency, CASE WHEN r <= 1 THEN 100 WHEN r <= 2 THEN 100 - (r - 1) * 50 WHEN r <= 5 THEN 50 - (r - 2) * 15 ELSE 0 END AS timeliness, (1 - i / n) * 100 AS validity FROM q),
  s AS (SELECT *, completeness * 0.30 + accuracy * 0.25 + consistency * 0.20 + timeliness * 0.15 + validity * 0.10 AS score FROM d)
  SELECT symbol, round(completeness, 5) AS completeness, round(accuracy, 5) AS accuracy, round(consistency, 5) AS consistency, round(timeliness, 5) AS timeliness, round(validity, 5) AS validity, round(score, 5) AS score,
    CASE WHEN score > 90 THEN 'EXCELLENT' WHEN score > 70 THEN 'GOOD' WHEN score > 50 THEN 'WARNING' ELSE 'CRITICAL' END AS level, CASE WHEN score <= 50 THEN 'CRITICAL' WHEN score < 70 THEN 'WARNING' ELSE 'INFO' END AS alert_level FROM s""")
def q_five(spark, sf_dir):
    return rounded(quality_score(quality_inputs(bars_hourly(spark, sf_dir))).select("symbol", *QUALITY_WEIGHTS, "score", "level", "alert_level"), 5)


@query("provider_health_eight", """WITH e AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS latency, count(*) AS n, sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS failures, count(DISTINCT date_trunc('hour', ts)) AS hours, count(DISTINCT user_id) / count(*) AS acc, min(value) AS delay FROM events GROUP BY 1, 2),
  s AS (SELECT *, least(greatest(acc * 100, 0), 100) AS s1, least(greatest(100 - (latency - 100) / 50, 0), 100) AS s2, least(hours / 168 * 100, 100) AS s3, (n - failures) / n * 100 AS s4, least(hours / 24 * 100, 100) AS s5, greatest(0, 100 - failures * 10) AS s6,
    CASE WHEN delay <= 0 THEN 100 ELSE greatest(0, 100 - delay / 300 * 100) END AS s7, CASE WHEN n > 1 THEN 100 ELSE 0 END AS s8 FROM e),
  t AS (SELECT *, s1 * 0.15 + s2 * 0.15 + s3 * 0.20 + s4 * 0.20 + s5 * 0.10 + s6 * 0.10 + s7 * 0.05 + s8 * 0.05 AS score FROM s)
  SELECT event_type AS provider, day, round(score, 5) AS score, CASE WHEN n <= 1 THEN CASE WHEN failures >= 3 THEN 'OFFLINE' ELSE 'NETWORK_ERROR' END WHEN round(score, 9) < 20 THEN 'OFFLINE' WHEN round(score, 9) < 75 THEN 'DEGRADED' WHEN latency > 3000 THEN 'SLOW' WHEN failures >= 3 THEN 'OFFLINE' ELSE 'ONLINE' END AS state FROM t""")
def q_health_eight(spark, sf_dir):
    """Health of sources day by day, from stand-ins for their request records."""
    m = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("provider"), F.to_date("ts").alias("day")).agg(
        F.avg("value").alias("latency_ms"), F.count("*").alias("requests"), F.sum(F.when(F.col("value") > 100, 1).otherwise(0)).alias("failures"), F.count_distinct(F.date_trunc("hour", "ts")).cast("double").alias("uptime_hours"),
        (F.count_distinct("user_id") / F.count("*")).alias("accuracy"), F.min("value").alias("delay_seconds"))
    m = m.withColumns({"completeness": F.col("uptime_hours") / 24, "reachable": F.col("requests") > 1, "streak": F.col("failures")})
    return health_score(m).select("provider", "day", F.round("score", 5).alias("score"), "state")


def half_life_blend(rows: DataFrame, keys: list[str], time: str, value: str, minutes: float = 60.0, reach: int = 3) -> DataFrame:
    """rows with `blended`: b = d b' + (1 - d) value, with d halving per `minutes` since the row before; the first row's is its value.

    Written out, a row weighs (1 - d) 2^(t / minutes) in all later ones, so sums over a day's rows and over those of the `reach`
    days before it do: what is older weighs less than 2^-(24 * 60 * reach / minutes).
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(time)
    us = F.unix_micros(F.col(time).cast("timestamp")) / 60e6
    r = rows.withColumn("_m", us).withColumn("_gap", F.col("_m") - F.lag("_m").over(w)).withColumn("_own", F.when(F.col("_gap").isNull(), 1.0).otherwise(1 - F.pow(F.lit(2.0), -F.col("_gap") / minutes)))
    day = F.floor(F.col("_m") / 1440)
    spread = r.withColumn("_day", F.explode(F.sequence(day, day + reach))).withColumn("_weight", F.pow(F.lit(2.0), (F.col("_m") - F.col("_day") * 1440) / minutes))
    inside = Window.partitionBy(*keys, "_day").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    spread = spread.withColumn("_sum", F.sum(F.col("_own") * F.col(value) * F.col("_weight")).over(inside))
    return spread.filter(F.col("_day") == day).withColumn("blended", F.col("_sum") / F.col("_weight")).drop("_m", "_gap", "_own", "_day", "_weight", "_sum")


@query("provider_health_blended", f"""WITH RECURSIVE {HOURLY}, o AS (SELECT symbol, time, close, row_number() OVER (PARTITION BY symbol ORDER BY time) AS k, (epoch(time) - epoch(lag(time) OVER (PARTITION BY symbol ORDER BY time))) / 60 AS gap FROM hours),
  r AS (SELECT symbol, time, k, close AS b FROM o WHERE k = 1 UNION ALL SELECT o.symbol, o.time, o.k, r.b * pow(2, -gap / 60) + o.close * (1 - pow(2, -gap / 60)) FROM r JOIN o ON o.symbol = r.symbol AND o.k = r.k + 1) SELECT symbol, time, round(b, 5) AS blended FROM r""")
def q_blended(spark, sf_dir):
    return half_life_blend(bars_hourly(spark, sf_dir).select("symbol", "time", "close"), ["symbol"], "time", "close").select("symbol", "time", F.round("blended", 5).alias("blended"))


@query("alert_fresh_and_gated", f"""WITH {MULTI}, l AS (SELECT symbol, time, close, epoch(time) - epoch(lag(time) OVER (PARTITION BY symbol ORDER BY time)) AS age, CASE volume % 4 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'ESTIMATED' WHEN 2 THEN 'STALE' END AS mark, volume FROM bars)
  SELECT symbol, time, CASE WHEN age <= 172800 THEN close END > 100000 AS cond, coalesce(mark IN ('VERIFIED', 'ESTIMATED'), false) AND volume >= 2 AS passes FROM l""")
def q_gated(spark, sf_dir):
    """A condition on a value that may be too old (then it is unknown), and the gates of quality and of several sources."""
    from ..functions.windows import W

    b = bars_multi(spark, sf_dir)
    seconds = F.unix_timestamp(F.col("time").cast("timestamp"))
    mark = F.when(F.col("volume") % 4 == 0, "VERIFIED").when(F.col("volume") % 4 == 1, "ESTIMATED").when(F.col("volume") % 4 == 2, "STALE")
    value = fresh(F.col("close"), seconds - F.lag(seconds).over(W()), "indicator")
    return b.select("symbol", "time", (value > 100_000).alias("cond"), gates(mark, F.col("volume"), "ESTIMATED", True).alias("passes"))
