"""Replay of history: what was known at each date, and what followed each date.

Snapshots tag the rows of many series with the moment they became known, union them with the dates that are asked for and carry
the best row of every series along in one pass. Outcomes cut time into blocks as long as the horizon, so that every window is
the end of one block and the beginning of the next; the summaries of both are running ones, and two summaries merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import level
from ..functions.scans import bucket_of, running
from ..functions.windows import rolling_mean, running_max
from ..registry import query
from ..sources.frames import MACRO, MULTI, SLOW, bars_multi, macro_series, rounded, slow_series
from ..tables import written
from .asof import asof_backward

HORIZONS = (30, 90, 180, 365)
DAY = 86_400_000_000


def outcomes(prices: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """prices (symbol, time, close): per row and horizon in days the price at or before its end, the return, the smallest and largest
    price, the deepest fall from a peak (a positive share) and the rows within, both ends included."""
    us = F.unix_micros(F.col("time").cast("timestamp"))
    t = prices.select("symbol", "time", F.col("close").cast("double").alias("close"), us.alias("us"), F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    t = written(t.withColumn("_block", F.floor(F.col("us") / (F.col("horizon") * F.lit(DAY)))), "horizons")
    keys, p = ("symbol", "horizon", "_block"), F.col("close")
    ahead, upto = (Window.partitionBy(*keys).orderBy("us").rowsBetween(*x) for x in ((0, Window.unboundedFollowing), (Window.unboundedPreceding, 0)))

    def summary(name: str, w, fall):
        """least, most, last and n of a running frame, and then its deepest fall."""
        frame = t.withColumns({"_least": F.min(p).over(w), "_most": F.max(p).over(w), "_last": F.last(p).over(w), "_n": F.count("*").over(w)})
        frame = frame.withColumn("_fall", F.max(F.greatest(F.lit(0.0), fall)).over(w))
        return frame.select(*keys, "us", "time", "close", F.struct(*[F.col(f"_{c}").alias(c) for c in ("least", "most", "last", "n", "fall")]).alias(name))

    end = summary("end", ahead, 1 - F.try_divide(F.col("_least"), p))
    begin = summary("begin", upto, 1 - F.try_divide(p, F.col("_most")))
    asked = end.withColumn("_block", F.col("_block") + 1).withColumn("_due", F.col("us") + F.col("horizon") * F.lit(DAY))
    met = asof_backward(asked, begin.select(*keys, "us", "begin"), "_due", "us", ["begin"], list(keys))
    both = lambda f, c: f(F.col(f"end.{c}"), F.col(f"begin.{c}"))
    across = 1 - F.try_divide(F.col("begin.least"), F.col("end.most"))
    price = F.coalesce("begin.last", "end.last")
    return met.select(
        "symbol", "time", "horizon", price.alias("price"), (F.try_divide(price, F.col("close")) - 1).alias("return"), both(F.least, "least").alias("min_price"), both(F.greatest, "most").alias("max_price"),
        F.greatest("end.fall", "begin.fall", across).alias("max_drawdown"), (F.col("end.n") + F.coalesce("begin.n", F.lit(0))).alias("n"))


def snapshots(asks: DataFrame, series: dict[str, tuple[DataFrame, list, list[str]]], time: str = "time", by: tuple = (), bucket: str = "year") -> DataFrame:
    """asks with, per series, its best row among those known by each ask's time: NULL where there is none.

    series: name -> (rows with the columns of `by` and known (when a row became known), columns that rank a row, its values).
    Of the known rows the one that ranks highest counts (the latest observation, then the latest revision). One shuffle for all series.
    """
    by = list(by)
    none = {n: F.lit(None).cast(rows.select(F.struct(*[F.col(c) for c in (*rank, *values)]).alias("x")).schema["x"].dataType) for n, (rows, rank, values) in series.items()}
    row = F.struct(*[F.col(c).alias(c) for c in asks.columns])
    every = asks.select(*by, F.col(time).cast("timestamp_ntz").alias("_t"), F.lit(1).alias("_side"), row.alias("_row"), *[v.alias(f"_s_{n}") for n, v in none.items()])
    no_row = F.lit(None).cast(every.schema["_row"].dataType)
    for n, (rows, rank, values) in series.items():
        own = F.struct(*[F.col(c) for c in (*rank, *values)])
        every = every.unionByName(rows.select(*by, F.col("known").cast("timestamp_ntz").alias("_t"), F.lit(0).alias("_side"), no_row.alias("_row"), *[(own if m == n else none[m]).alias(f"_s_{m}") for m in series]))
    every = written(every.withColumn("_b", bucket_of("_t", bucket)), "known-rows")
    found = running(every, {f"_best_{n}": ("max", F.col(f"_s_{n}")) for n in series}, tuple(by), "_b", ("_t", "_side")).filter("_side = 1")
    return found.select("_row.*", *[F.col(f"_best_{n}")[c].alias(f"{n}_{c}") for n, (_, rank, values) in series.items() for c in (*rank, *values)])


OUTCOMES = f"""{MULTI}, h AS (SELECT unnest([{', '.join(map(str, HORIZONS))}]) AS horizon), p AS (SELECT a.symbol, a.time, a.close AS start, h.horizon, b.time AS later, b.close, max(b.close) OVER (PARTITION BY a.symbol, a.time, h.horizon ORDER BY b.time) AS peak
  FROM bars a, h JOIN bars b ON b.symbol = a.symbol AND b.time BETWEEN a.time AND a.time + to_days(h.horizon))"""


@query("replay_outcomes", f"""WITH {OUTCOMES} SELECT symbol, time, CAST(horizon AS INT) AS horizon, arg_max(close, later) AS price, round(arg_max(close, later) / any_value(start) - 1, 6) AS "return", min(close) AS min_price, max(close) AS max_price, round(max(1 - close / peak), 6) AS max_drawdown, count(*) AS n
  FROM p GROUP BY symbol, time, horizon""")
def q_outcomes(spark, sf_dir):
    """What followed every bar within 30, 90, 180 and 365 days."""
    return rounded(outcomes(bars_multi(spark, sf_dir)), 6)


#: Fixed values of the states in snapshots.
FALLS, STATES = (-50.0, -20.0), ["DEEP", "FALLEN", "NEAR_PEAK"]


@query("replay_snapshots", f"""WITH {MULTI}, {SLOW}, {MACRO}, m AS (SELECT symbol, time, close, CASE WHEN row_number() OVER w >= 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) END AS sma, (close / max(close) OVER w - 1) * 100 AS fall FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time)),
  d AS (SELECT *, CASE WHEN round(fall, 9) < -50 THEN 'DEEP' WHEN round(fall, 9) < -20 THEN 'FALLEN' ELSE 'NEAR_PEAK' END AS state FROM m),
  q AS (SELECT b.symbol, b.time, p.time AS price_time, p.close AS price_close FROM d b ASOF LEFT JOIN d p ON p.symbol = b.symbol AND p.time <= b.time),
  i AS (SELECT q.*, x.time AS indicator_time, round(x.sma, 4) AS indicator_sma FROM q ASOF LEFT JOIN (SELECT *, time + INTERVAL 1 DAY AS known FROM d WHERE sma IS NOT NULL) x ON x.symbol = q.symbol AND x.known <= q.time),
  s AS (SELECT i.*, x.time AS state_time, x.state AS state_state FROM i ASOF LEFT JOIN (SELECT *, time + INTERVAL 2 DAY AS known FROM d) x ON x.symbol = i.symbol AND x.known <= i.time),
  t AS (SELECT DISTINCT time FROM bars), o AS (SELECT t.time, max(x.time) AS onchain_time, arg_max(x.value, x.time) AS onchain_value FROM t LEFT JOIN slow x ON greatest(x.time, x.fetch_time) <= t.time GROUP BY 1),
  c AS (SELECT t.time, arg_max(observation_date, (observation_date, revision_number)) AS macro_observation_date, arg_max(revision_number, (observation_date, revision_number)) AS macro_revision_number, arg_max(value, (observation_date, revision_number)) AS macro_value FROM t LEFT JOIN macro x ON x.release_date <= t.time GROUP BY 1)
  SELECT s.*, onchain_time, onchain_value, macro_observation_date, macro_revision_number, macro_value FROM s JOIN o USING (time) JOIN c USING (time)""")
def q_snapshots(spark, sf_dir):
    """Of every date and symbol: price, indicator, state, an on-chain value and a macro value in its latest known revision, none from after the date."""
    bars = bars_multi(spark, sf_dir)
    after = lambda days: (F.col("time") + F.make_interval(days=F.lit(days))).alias("known")
    d = bars.select("symbol", "time", "close", rolling_mean("close", 20).alias("sma"), level(F.round((F.col("close") / running_max("close") - 1) * 100, 9), list(FALLS), STATES).alias("state"))
    own = {"price": (d.withColumn("known", F.col("time")), ["time"], ["close"]), "indicator": (d.filter("sma IS NOT NULL").select("*", after(1)), ["time"], ["sma"]), "state": (d.select("*", after(2)), ["time"], ["state"])}
    slow = slow_series(spark, sf_dir).withColumn("known", F.greatest("time", F.coalesce("fetch_time", "time")))
    common = {"onchain": (slow, ["time"], ["value"]), "macro": (macro_series(spark, sf_dir).withColumn("known", F.col("release_date")), ["observation_date", "revision_number"], ["value"])}
    dates = snapshots(bars.select("time").distinct(), common)
    return rounded(snapshots(bars.select("symbol", "time"), own, by=("symbol",)).join(dates, "time"), 4)
