"""Alerts in which time itself acts: a held condition fires without a new row, and a value that nothing follows turns unknown.

An observation holds until the next one of its key, at most for `stale` seconds. A trigger comes once TRUE has held for `hold`
seconds; it ends with the observation that is not TRUE (recover), or when the last one has gone stale (unknown). On a stream a
timer stands at the next moment at which something can happen, and event time alone, moved on by other keys, sets it off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.scans import ROWS, numbered, running
from ..registry import query
from ..tables import written
from .alert_state import FIRED, observations


def moved_on(state: tuple, to: int, hold: int, stale: int) -> tuple[tuple, list[tuple[int, str]]]:
    """A state (since, last, active; -1: not TRUE) after time has gone on to `to` without a row, and what happened at which second.

    What is due at the very second of `to` is left to the row that may come there, but for a trigger, which is then due.
    """
    since, last, active = state
    out = []
    if since >= 0:
        if not active and since + hold <= min(to, last + stale):
            active = True
            out.append((since + hold, "trigger"))
        if last + stale < to:
            out += [(last + stale, "unknown")] if active else []
            since, last, active = -1, -1, False
    return (since, last, active), out


def observed(state: tuple, at: int, cond: bool) -> tuple[tuple, list[tuple[int, str]]]:
    """The state after an observation, to whose time it has been moved on."""
    since, _, active = state
    if cond:
        return (at if since < 0 else since, at, active), []
    return (-1, -1, False), [(at, "recover")] if active else []


class TimedAlerts(StatefulProcessor):
    """moved_on and observed for a stream: one value of state per key, and one timer."""

    def __init__(self, hold: int, stale: int):
        self.hold, self.stale = hold, stale

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("alert", "since bigint, last bigint, active boolean")

    def _now(self) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else (-1, -1, False)

    def _keep(self, state: tuple) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        since, last, active = state
        if since < 0:
            self.state.clear()
            return
        self.state.update(state)
        gone = last + self.stale + 1
        self.handle.registerTimer(1000 * (gone if active else min(gone, max(since + self.hold, last))))

    def _frame(self, key, found):
        import pandas as pd

        text = lambda x: pd.Series(x, dtype=object)
        return pd.DataFrame({"key": text([key[0]] * len(found)), "time": pd.Series(pd.to_datetime([t for t, _ in found], unit="s", utc=True)), "action": text([a for _, a in found])})

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        state, found = self._now(), []
        every = pd.concat(list(rows))
        every = every[every.cond.notna()]
        every = every.assign(at=[int(t.timestamp()) for t in every.time], c=every.cond.astype(int)).sort_values(["at", "c"])
        for at, cond in zip(every["at"], every.cond, strict=True):
            state, out = moved_on(state, int(at), self.hold, self.stale)
            state, more = observed(state, int(at), bool(cond))
            found += out + more
        self._keep(state)
        yield self._frame(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state, found = moved_on(self._now(), expiredTimerInfo.getExpiryTimeInMs() // 1000, self.hold, self.stale)
        self._keep(state)
        yield self._frame(key, found)

    def close(self):
        pass


def timed_stream(rows: DataFrame, hold: int, stale: int, late: str = "0 seconds") -> DataFrame:
    """Triggers, recoveries and losses of a stream of observations (key, time, cond); needs the RocksDB state store."""
    watched = rows.select("key", "time", "cond").withWatermark("time", late)
    return watched.groupBy("key").transformWithStateInPandas(TimedAlerts(hold, stale), FIRED, "append", "eventTime")


def timed_batch(rows: DataFrame, hold: int, stale: int, bucket: str = "day") -> DataFrame:
    """The same over a table, as if time went on for ever: runs of TRUE rows without a gap of more than `stale`, by running sums."""
    known = rows.select("key", "time", "cond").filter("cond IS NOT NULL").withColumns({"at": F.expr("unix_micros(time) div 1000000"), "_c": F.col("cond").cast("int")})
    t = numbered(written(known, "timed"), time="at", by=("key",), bucket=86_400, lags=("cond", "at"), then=("_c",)).withColumn("_stretch", F.floor(F.col("_rn") / ROWS))
    # A row continues the run before it if that is TRUE and not stale; a row that is not TRUE ends such a run.
    joins = F.coalesce(F.col("_lag_cond") & (F.col("at") - F.col("_lag_at") <= stale), F.lit(False))
    t = running(t.withColumn("_joins", joins), {"_run": ("sum", F.when(F.col("_joins"), 0).otherwise(1))}, ("key",), "_stretch", ("_rn",))
    on = F.col("cond")
    runs = t.groupBy("key", "_run").agg(F.min(F.when(on, F.col("at"))).alias("since"), F.max(F.when(on, F.col("at"))).alias("last"), F.min(F.when(~on, F.col("at"))).alias("off")).filter("since IS NOT NULL")
    end = F.coalesce("off", F.col("last") + stale)
    fired = runs.withColumn("_due", F.col("since") + hold).filter(F.col("_due") <= end)
    both = F.array(F.struct(F.col("_due").alias("at"), F.lit("trigger").alias("action")), F.struct(end.alias("at"), F.when(F.col("off").isNotNull(), "recover").otherwise("unknown").alias("action")))
    return fired.select("key", F.explode(both).alias("e")).select("key", F.timestamp_seconds("e.at").alias("time"), F.col("e.action").alias("action"))


@query("timed_alerts", """WITH o AS (SELECT event_type AS key, epoch_us(ts) // 1000000 AS sec, value > 60 AS cond FROM events WHERE NOT value < 1), k AS (SELECT *, lag(cond) OVER w AS was, sec - lag(sec) OVER w AS gap FROM o WINDOW w AS (PARTITION BY key ORDER BY sec, cond)),
  r AS (SELECT *, sum(CASE WHEN was AND gap <= 900 THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY sec, cond ROWS UNBOUNDED PRECEDING) AS run FROM k),
  g AS (SELECT key, run, min(sec) FILTER (WHERE cond) AS since, max(sec) FILTER (WHERE cond) AS last, min(sec) FILTER (WHERE NOT cond) AS off FROM r GROUP BY 1, 2),
  f AS (SELECT *, since + 300 AS due, coalesce(off, last + 900) AS done FROM g WHERE since IS NOT NULL AND since + 300 <= coalesce(off, last + 900))
  SELECT key, make_timestamp(due * 1000000) AS time, 'trigger' AS action FROM f UNION ALL SELECT key, make_timestamp(done * 1000000), CASE WHEN off IS NULL THEN 'unknown' ELSE 'recover' END FROM f""")
def q_timed(spark, sf_dir):
    """Held for five minutes, stale after fifteen.

    Rows of one second and one condition keep one order throughout. The SQL sorts them twice and leaves their order open: in one
    thread DuckDB sorts them alike and gives this result, in several it may not, and a run of TRUE loses the row that ends it.
    """
    return timed_batch(observations(spark, sf_dir), 300, 900).withColumn("time", F.col("time").cast("timestamp_ntz"))
