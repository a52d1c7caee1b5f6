"""Streams: bars with a watermark, and rules with duration, consecutive and cooldown state per key."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scans import ROWS, numbered, running
from ..plans.alerts import passing
from ..registry import query
from ..sources.frames import rounded, table
from ..tables import written

STATE = "since long, n int, active boolean, sent long"
FIRED = "key string, time timestamp, action string"


def stream_bars(events: DataFrame, key: str, time: str, value: str, period: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling bars of a stream (or a table): events later than the watermark are dropped, closed bars leave the state."""
    order = F.struct(time, value)
    return events.withWatermark(time, late).groupBy(F.window(time, period), key).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count("*").alias("volume")).select(
        F.col(key).alias("symbol"), F.col("window.start").alias("time"), "open", "high", "low", "close", "volume")


def step(state: tuple, at: float, cond: bool | None, seconds: float, times: int, cooldown: float) -> tuple[tuple, str | None]:
    """One observation against (since, n, active, sent): the new state and trigger, recover or None.

    Unknown (None) leaves all as it is. A trigger needs the condition to have held for `seconds` and `times` observations, no
    active trigger, and `cooldown` seconds since the last one.
    """
    since, n, active, sent = state
    if cond is None:
        return state, None
    if not cond:
        return (-1, 0, False, sent), "recover" if active else None
    since, n = (at if since < 0 else since), n + 1
    if active or n < times or at - since < seconds or (sent >= 0 and at - sent < cooldown):
        return (since, n, active, sent), None
    return (since, n, True, at), "trigger"


def fired(observations: DataFrame, seconds: float = 0, times: int = 1, cooldown: float = 0, mode: str = "append") -> DataFrame:
    """Triggers and recoveries of observations (key, time, cond), on a stream: state per key survives batches and restarts."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, frames: Iterator, state: GroupState):
        import pandas as pd

        now = state.get if state.exists else (-1, 0, False, -1)
        rows = pd.concat(list(frames))
        rows = rows.assign(_c=rows.cond.astype(float)).sort_values(["time", "_c"])  # of one time: false, true, unknown
        out = []
        for time, cond in zip(rows.time, rows.cond, strict=True):
            now, action = step(now, int(time.timestamp()), None if pd.isna(cond) else bool(cond), seconds, times, cooldown)
            if action:
                out.append((key[0], time, action))
        state.update(tuple(int(x) if not isinstance(x, bool) else x for x in now))
        yield pd.DataFrame(out, columns=["key", "time", "action"])

    return observations.select("key", "time", "cond").groupBy("key").applyInPandasWithState(run, FIRED, STATE, mode, GroupStateTimeout.NoTimeout)


def fired_batch(observations: DataFrame, seconds: int = 0, times: int = 1, cooldown: int = 0, bucket: str = "day") -> DataFrame:
    """The same over a table, without a fold over a key: runs of TRUE and their age are running sums, which of the rows that are ready
    may trigger is a machine of composed maps, and each trigger recovers at the end of its run."""
    order = F.when(F.col("cond"), 1).otherwise(0)
    known = observations.select("key", "time", "cond").filter("cond IS NOT NULL").withColumn("_c", order)
    t = numbered(written(known, "observations"), by=("key",), bucket=bucket, lags=("cond",), then=("_c",)).withColumn("_stretch", F.floor(F.col("_rn") / ROWS))
    at = F.floor(F.unix_micros("time") / 1_000_000)
    begins = F.when(F.col("cond") & ~F.coalesce("_lag_cond", F.lit(False)), F.struct("_rn", at.alias("at")))
    t = running(t.withColumn("at", at), {"run": ("sum", F.when(F.col("cond"), 0).otherwise(1)), "_began": ("max", begins)}, ("key",), "_stretch", ("_rn",))
    t = written(t, "runs")
    ready = F.col("cond") & (F.col("_rn") - F.col("_began._rn") + 1 >= times) & (F.col("at") - F.col("_began.at") >= seconds)
    sent = passing(t.filter(ready).select("key", "time", "at", F.col("run").cast("long").alias("run"), "_rn"), int(cooldown), by="key")
    # The row that is not TRUE and ends run k is the first of run k + 1.
    ends = t.filter(~F.col("cond")).select("key", "time", (F.col("run") - 1).alias("run"))
    closed = ends.join(sent.select("key", "run"), ["key", "run"], "left_semi")
    return sent.select("key", "time", F.lit("trigger").alias("action")).unionByName(closed.select("key", "time", F.lit("recover").alias("action")))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("time"), F.when(F.col("value") < 1, None).otherwise(F.col("value") > 60).alias("cond"))


@query("stream_bars", """SELECT event_type AS symbol, date_trunc('hour', ts) AS time, arg_min(value, (ts, value)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, value)) AS close, count(*) AS volume FROM events GROUP BY 1, 2""")
def q_bars(spark, sf_dir):
    """The streaming plan run over a table."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream_bars(e, "event_type", "ts", "value").withColumn("time", F.col("time").cast("timestamp_ntz"))


@query("stream_alerts", """WITH RECURSIVE o AS (SELECT event_type AS key, ts AS time, epoch_us(ts) // 1000000 AS sec, value > 60 AS cond FROM events WHERE NOT value < 1),
  k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY time, cond) AS rn FROM o),
  r AS (SELECT key, time, rn, sec, cond, CASE WHEN cond THEN sec ELSE -1 END AS since, CASE WHEN cond THEN 1 ELSE 0 END AS n, FALSE AS active, CAST(-1 AS BIGINT) AS sent, CAST(NULL AS VARCHAR) AS action FROM k WHERE rn = 1
   UNION ALL SELECT key, time, rn, sec, cond, since, n, cond AND (active OR fires), CASE WHEN fires THEN sec ELSE sent END, CASE WHEN fires THEN 'trigger' WHEN active AND NOT cond THEN 'recover' END FROM (
    SELECT *, cond AND NOT active AND n >= 2 AND sec - since >= 600 AND (sent < 0 OR sec - sent >= 3600) AS fires FROM (
     SELECT k.key, k.time, k.rn, k.sec, k.cond, r.active, r.sent, CASE WHEN NOT k.cond THEN -1 WHEN r.since < 0 THEN k.sec ELSE r.since END AS since, CASE WHEN k.cond THEN r.n + 1 ELSE 0 END AS n FROM r JOIN k ON k.key = r.key AND k.rn = r.rn + 1)))
  SELECT key, time, action FROM r WHERE action IS NOT NULL""")
def q_alerts(spark, sf_dir):
    """Triggers and recoveries; tests hold the stream against the table and a loop."""
    return fired_batch(observations(spark, sf_dir), seconds=600, times=2, cooldown=3600).withColumn("time", F.col("time").cast("timestamp_ntz"))


@query("stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
  SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def q_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes 1 microsecond")).agg(F.min("ts").alias("start"), F.count("*").alias("n"))
    return rounded(s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n"))
