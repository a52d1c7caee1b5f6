"""Alert rules: condition trees compiled to nullable boolean columns, and their histories.

SQL's AND, OR and NOT over NULL are Kleene's logic, so an unknown input makes a condition unknown, and unknown never fires.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.machines import Gate, run_machine
from ..functions.scans import ROWS, numbered, running
from ..functions.windows import W, rolling_mean, running_max
from ..registry import query
from ..sources.frames import MULTI, bars_multi, rounded
from ..tables import written

DEPTH = 5
#: Ready rules (fixed values): name to tree.
TEMPLATES = {
    "price_below": {"type": "threshold", "metric": "price", "operator": "lt", "value": 90000},
    "price_above": {"type": "threshold", "metric": "price", "operator": "gt", "value": 120000},
    "major_drawdown": {"type": "threshold", "metric": "drawdown_pct", "operator": "lt", "value": -20},
    "golden_cross": {"type": "cross_above", "metric": "price", "metric_b": "ma20"},
    "fall_in_range": {"type": "AND", "children": [{"type": "change_pct", "metric": "price", "rows": 7, "operator": "lte", "value": -10}, {"type": "NOT", "children": [{"type": "range", "metric": "price", "min": 50000, "max": 80000}]}]},
}


def compare(v: Column, operator: str, t) -> Column:
    t = t if isinstance(t, Column) else F.lit(float(t))
    near = F.abs(v - t) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(t))
    return {"gt": v > t, "gte": v >= t, "lt": v < t, "lte": v <= t, "eq": near}[operator]


def compiled(tree: dict, metric=F.col, w=None, depth: int = 0) -> Column:
    """A condition tree as a column that is true, false or NULL. metric maps names to columns; w orders the rows."""
    if depth > DEPTH:
        return F.lit(None).cast("boolean")
    kind = tree["type"].lower()
    w = w or W()
    if kind in ("and", "or", "not"):
        parts = [compiled(x, metric, w, depth + 1) for x in tree["children"]]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if kind == "and" else out | p
        return ~out if kind == "not" else out
    v = metric(tree["metric"]) if "metric" in tree else None
    if kind in ("threshold", "percentile"):
        return compare(v, tree["operator"], tree["value"])
    if kind == "change_pct":
        before = F.lag(v, tree["rows"]).over(w)
        return compare(F.try_divide(v - before, before) * 100, tree["operator"], tree["value"])
    if kind in ("range", "range_exit"):
        inside = F.lit(True)
        if tree.get("min") is not None:
            inside = inside & (v >= tree["min"])
        if tree.get("max") is not None:
            inside = inside & (v <= tree["max"])
        return ~inside if kind == "range_exit" else inside
    if kind in ("cross_above", "cross_below"):
        line = metric(tree["metric_b"]) if "metric_b" in tree else F.lit(float(tree["value"]))
        before = F.lag(v).over(w)
        crossed = (before <= line) & (v > line) if kind == "cross_above" else (before >= line) & (v < line)
        return F.when(before.isNotNull() & v.isNotNull() & line.isNotNull(), crossed)
    if kind == "state_change":
        before = F.lag(v).over(w)
        changed = before != v
        if tree.get("from"):
            changed = changed & (before == tree["from"])
        if tree.get("to"):
            changed = changed & (v == tree["to"])
        return F.when(before.isNotNull() & v.isNotNull(), changed)
    raise ValueError(f"unknown condition {tree['type']}")


def describe(tree: dict) -> str:
    """A condition tree in words."""
    kind = tree["type"].upper()
    if kind in ("AND", "OR"):
        return "(" + f" {kind} ".join(describe(x) for x in tree["children"]) + ")"
    if kind == "NOT":
        return f"NOT {describe(tree['children'][0])}"
    return " ".join(str(v) for v in tree.values())


def metrics_frame(bars: DataFrame) -> DataFrame:
    peak = running_max("close")
    return bars.select("symbol", "time", F.col("close").alias("price"), rolling_mean("close", 20).alias("ma20"), ((F.col("close") / peak - 1) * 100).alias("drawdown_pct"))


def episodes(evaluated: DataFrame) -> DataFrame:
    """Rows with cond (true, false, NULL): fired at the first TRUE of a run; NULL keeps a run going."""
    w = W()
    known = F.last("cond", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return evaluated.withColumn("fired", F.coalesce(F.col("cond"), F.lit(False)) & ~F.coalesce(known, F.lit(False)))


def held(evaluated: DataFrame, seconds: int = 0, times: int = 1) -> DataFrame:
    """ready: cond has been TRUE for so many seconds, and so many rows, without a break."""
    w = W()
    broken = F.sum(F.when(F.coalesce(F.col("cond"), F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    run = Window.partitionBy("symbol", "_run").orderBy("time")
    e = evaluated.withColumn("_run", broken)
    ok = F.coalesce(F.col("cond"), F.lit(False))
    since = F.min(F.when(ok, F.col("time"))).over(run.rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum(F.when(ok, 1).otherwise(0)).over(run.rowsBetween(Window.unboundedPreceding, 0))
    age = (F.unix_micros(F.col("time").cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 1e6
    return e.withColumn("n", n).withColumn("ready", ok & (n >= times) & (F.coalesce(age, F.lit(0.0)) >= seconds)).drop("_run")


def rule_backtest(bars: DataFrame, tree: dict, horizons: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
    """When a rule would have fired, and the change to the first close at or after each horizon (in days)."""
    from ..operators.asof import asof_forward

    m = metrics_frame(bars).withColumn("cond", compiled(tree))
    fired = episodes(m).filter("fired").select("symbol", "time", "price")
    prices = bars.select("symbol", F.col("time").alias("_at"), "close")
    for h in horizons:
        asked = fired.withColumn("_due", F.col("time") + F.expr(f"INTERVAL {h} DAYS"))
        fired = asof_forward(asked, prices, "_due", "_at", "close", ["symbol"]).withColumn(f"change_{h}d", F.col("close") / F.col("price") - 1).drop("_due", "close")
    return fired


def passing(candidates: DataFrame, cooldown: int, by: str = "symbol") -> DataFrame:
    """Of candidates (key, at in whole seconds, run, _rn; at and run rising along _rn) those that pass, one after the other: none within
    `cooldown` seconds of the last that passed, and none of its run. Stretches of time of at least 64 cooldowns become maps, which are composed."""
    cut = candidates.withColumn("_stretch", F.floor((F.col("at") + 2**40) / max(64 * cooldown, 86_400)))
    return run_machine(cut, Gate(cooldown), ["at", "run"], by, "_stretch", ["_rn"], "_passes").filter("_passes = 1").drop("_passes", "_stretch")


def cooled_down(fired: DataFrame, cooldown_seconds: int, most_per_hour: int | None = None) -> DataFrame:
    """Of fired rows (symbol, time) those sent: a cooldown after each sent one and a limit per hour.

    With a limit the memory is a list of times; rows are then folded between quiet spells, in which nothing fired for as long as
    cooldown and limit look back, so that they do not depend on each other.
    """
    t = numbered(written(fired.select("symbol", "time"), "fired")).withColumns({"at": F.floor(F.unix_micros(F.col("time").cast("timestamp")) / 1_000_000), "run": F.col("_rn").cast("long")})
    if most_per_hour is None:
        return passing(t, cooldown_seconds).select("symbol", "time")
    quiet = max(cooldown_seconds, 3600)
    t = t.withColumn("_stretch", F.floor(F.col("_rn") / ROWS))
    t = running(t, {"_before": ("max", F.col("at"))}, ("symbol",), "_stretch", ("_rn",), before=True)
    t = running(t, {"_spell": ("sum", F.when(F.col("at") - F.col("_before") >= quiet, 1).otherwise(0))}, ("symbol",), "_stretch", ("_rn",))

    def run(frame):
        frame, sent, keep = frame.sort_values("at"), [], []
        for at in frame["at"]:
            sent = [s for s in sent if at - s < quiet]
            keep.append((not sent or at - sent[-1] >= cooldown_seconds) and sum(at - s < 3600 for s in sent) < most_per_hour)
            sent += [at] if keep[-1] else []
        return frame[keep][["symbol", "time"]]

    return t.select("symbol", "time", "at", "_spell").groupBy("symbol", "_spell").applyInPandas(run, "symbol string, time timestamp_ntz")


METRICS = f"{MULTI}, m AS (SELECT symbol, time, close AS price, CASE WHEN row_number() OVER w >= 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) END AS ma20, (close / max(close) OVER w - 1) * 100 AS drawdown_pct FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time))"
RULES = """c AS (SELECT *, price < 90000 AS price_below, price > 120000 AS price_above, drawdown_pct < -20 AS major_drawdown, lag(price) OVER w <= ma20 AND price > ma20 AS golden_cross,
  (price - lag(price, 7) OVER w) / lag(price, 7) OVER w * 100 <= -10 AND NOT (price >= 50000 AND price <= 80000) AS fall_in_range FROM m WINDOW w AS (PARTITION BY symbol ORDER BY time))"""


@query("alert_conditions", f"WITH {METRICS}, {RULES} SELECT symbol, time, {', '.join(TEMPLATES)} FROM c")
def q_conditions(spark, sf_dir):
    m = metrics_frame(bars_multi(spark, sf_dir))
    return m.select("symbol", "time", *[compiled(t).alias(n) for n, t in TEMPLATES.items()])


@query("alert_episodes", f"""WITH {METRICS}, {RULES}, e AS (SELECT symbol, time, golden_cross, fall_in_range AS cond, last_value(fall_in_range IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM c)
  SELECT symbol, time FROM e WHERE coalesce(cond, false) AND NOT coalesce(known, false)""")
def q_episodes(spark, sf_dir):
    m = metrics_frame(bars_multi(spark, sf_dir)).withColumn("cond", compiled(TEMPLATES["fall_in_range"]))
    return episodes(m).filter("fired").select("symbol", "time")


@query("alert_held", f"""WITH {METRICS}, b AS (SELECT symbol, time, price < 90000 AS ok, sum(CASE WHEN price < 90000 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY time) AS run FROM m),
  r AS (SELECT *, min(CASE WHEN ok THEN time END) OVER w AS since, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER w AS n FROM b WINDOW w AS (PARTITION BY symbol, run ORDER BY time))
  SELECT symbol, time, CAST(n AS BIGINT) AS n, ok AND n >= 2 AND coalesce(epoch(time) - epoch(since), 0) >= 172800 AS ready FROM r""")
def q_held(spark, sf_dir):
    m = metrics_frame(bars_multi(spark, sf_dir)).withColumn("cond", compiled(TEMPLATES["price_below"]))
    return held(m, seconds=172_800, times=2).select("symbol", "time", "n", "ready")


@query("alert_rule_backtest", f"""WITH {METRICS}, e AS (SELECT symbol, time, price, drawdown_pct < -20 AS cond, lag(drawdown_pct < -20) OVER (PARTITION BY symbol ORDER BY time) AS known FROM m), f AS (SELECT symbol, time, price FROM e WHERE cond AND NOT coalesce(known, false)),
  a AS (SELECT f.*, b.close AS c7 FROM f ASOF LEFT JOIN bars b ON f.symbol = b.symbol AND f.time + INTERVAL 7 DAY <= b.time), b2 AS (SELECT a.*, b.close AS c30 FROM a ASOF LEFT JOIN bars b ON a.symbol = b.symbol AND a.time + INTERVAL 30 DAY <= b.time),
  d AS (SELECT b2.*, b.close AS c90 FROM b2 ASOF LEFT JOIN bars b ON b2.symbol = b.symbol AND b2.time + INTERVAL 90 DAY <= b.time)
  SELECT symbol, time, price, round(c7 / price - 1, 6) AS change_7d, round(c30 / price - 1, 6) AS change_30d, round(c90 / price - 1, 6) AS change_90d FROM d""")
def q_rule_backtest(spark, sf_dir):
    return rounded(rule_backtest(bars_multi(spark, sf_dir), TEMPLATES["major_drawdown"]), 6)


@query("alert_cooldown", f"""WITH RECURSIVE {METRICS}, e AS (SELECT symbol, time, coalesce(drawdown_pct < -20, false) AS cond, coalesce(lag(drawdown_pct < -20) OVER (PARTITION BY symbol ORDER BY time), false) AS known FROM m),
  f AS (SELECT symbol, time, row_number() OVER (PARTITION BY symbol ORDER BY time) AS k FROM e WHERE cond AND NOT known),
  r AS (SELECT symbol, time, k, time AS sent FROM f WHERE k = 1 UNION ALL SELECT f.symbol, f.time, f.k, CASE WHEN f.time - r.sent >= INTERVAL 14 DAY THEN f.time ELSE r.sent END FROM r JOIN f ON f.symbol = r.symbol AND f.k = r.k + 1)
  SELECT symbol, time FROM r WHERE time = sent""")
def q_cooldown(spark, sf_dir):
    m = metrics_frame(bars_multi(spark, sf_dir)).withColumn("cond", compiled(TEMPLATES["major_drawdown"]))
    return cooled_down(episodes(m).filter("fired"), 14 * 86_400)


@query("alert_weekly_digest", f"""WITH {MULTI}, l AS (SELECT symbol, max(time) AS last FROM bars GROUP BY 1) SELECT b.symbol, max(high) AS high, min(low) AS low, round(arg_max(close, time) / arg_min(close, time) - 1, 6) AS change, count(*) AS days, CAST(sum(volume) AS BIGINT) AS volume
  FROM bars b JOIN l ON b.symbol = l.symbol WHERE b.time > l.last - INTERVAL 7 DAY GROUP BY 1""")
def q_digest(spark, sf_dir):
    b = bars_multi(spark, sf_dir)
    last = b.groupBy("symbol").agg(F.max("time").alias("last"))
    week = b.join(last, "symbol").filter(F.col("time") > F.col("last") - F.expr("INTERVAL 7 DAYS"))
    return week.groupBy("symbol").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.round(F.max_by("close", "time") / F.min_by("close", "time") - 1, 6).alias("change"), F.count("*").alias("days"), F.sum("volume").alias("volume"))


#: Conditions on a rank and on a state.
STATE_CONDITIONS = {
    "low_rank": {"type": "percentile", "metric": "rank", "operator": "lt", "value": 10}, "any_change": {"type": "state_change", "metric": "state"},
    "fell": {"type": "state_change", "metric": "state", "from": "NEAR_PEAK", "to": "FALLEN"}, "deep": {"type": "state_change", "metric": "state", "to": "DEEP"},
}


@query("alert_state_conditions", f"""WITH {METRICS}, l AS (SELECT *, list(price) OVER (PARTITION BY symbol ORDER BY time ROWS 364 PRECEDING) AS last, CASE WHEN round(drawdown_pct, 9) < -50 THEN 'DEEP' WHEN round(drawdown_pct, 9) < -20 THEN 'FALLEN' ELSE 'NEAR_PEAK' END AS state FROM m),
  s AS (SELECT symbol, time, state, lag(state) OVER (PARTITION BY symbol ORDER BY time) AS was, CASE WHEN len(last) >= 30 THEN 100.0 * len(list_filter(last, lambda x: x < price)) / len(last) END AS rank FROM l)
  SELECT symbol, time, rank < 10 AS low_rank, was <> state AS any_change, CASE WHEN was IS NOT NULL THEN was = 'NEAR_PEAK' AND state = 'FALLEN' END AS fell, CASE WHEN was IS NOT NULL THEN was <> state AND state = 'DEEP' END AS deep FROM s""")
def q_state_conditions(spark, sf_dir):
    """Low percentile ranks and changes of a state, from and to given ones."""
    from ..functions.ranks import percent_below
    from ..functions.scalars import level

    m = metrics_frame(bars_multi(spark, sf_dir)).withColumn("state", level(F.round("drawdown_pct", 9), [-50, -20], ["DEEP", "FALLEN", "NEAR_PEAK"]))
    m = percent_below(m, {"rank": "price"}, 365, 30)
    return m.select("symbol", "time", *[compiled(t).alias(n) for n, t in STATE_CONDITIONS.items()])
