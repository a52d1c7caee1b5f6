"""Scoring engines: cycle, valuation, risk and regime, for all dates at once.

Dates are rows of one wide frame of window features; scores are arithmetic on them, and the debounced phase is a state machine of composed maps.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.machines import Table, run_machine
from ..functions.ranks import percent_below
from ..functions.scalars import clamp, level, ramp
from ..functions.scans import ROWS, numbered, running
from ..functions.windows import W, full, last_rows, log_return, rolling_mean, running_max
from ..registry import query
from ..sources.frames import MULTI, bars_multi, rounded
from ..tables import written

# Thresholds, weights and transitions of the scores.
PHASE_LIMITS = [-0.70, -0.40, -0.15, 0.15, 0.45]
PHASES = ["DEEP_BEAR", "BEAR", "BOTTOM_BUILDING", "RECOVERY", "UPTREND", "ACCELERATION"]
PHASE_CENTERS = {"DEEP_BEAR": -0.85, "BEAR": -0.55, "BOTTOM_BUILDING": -0.28, "RECOVERY": 0.0, "UPTREND": 0.30, "ACCELERATION": 0.60, "DISTRIBUTION": 0.72, "TOP_RISK": 0.82, "DECLINE": -0.62}
LATE_PHASES, LATE_FACTOR, PHASE_SIGMA = ("DISTRIBUTION", "TOP_RISK", "DECLINE"), 0.15, 0.30
TRANSITIONS = {
    "DEEP_BEAR": {"DEEP_BEAR", "BEAR"}, "BEAR": {"BEAR", "DEEP_BEAR", "BOTTOM_BUILDING"}, "BOTTOM_BUILDING": {"BOTTOM_BUILDING", "BEAR", "RECOVERY"},
    "RECOVERY": {"RECOVERY", "BOTTOM_BUILDING", "UPTREND", "BEAR"}, "UPTREND": {"UPTREND", "ACCELERATION", "RECOVERY", "DECLINE"}, "ACCELERATION": {"ACCELERATION", "UPTREND", "DISTRIBUTION"},
    "DISTRIBUTION": {"DISTRIBUTION", "ACCELERATION", "TOP_RISK", "DECLINE"}, "TOP_RISK": {"TOP_RISK", "DISTRIBUTION", "DECLINE"}, "DECLINE": {"DECLINE", "DEEP_BEAR", "BEAR"},
}
LEAST_DAYS, TOP_RISK_DAYS, CONFIRMATIONS, FAST = 7, 3, 3, {"TOP_RISK", "DECLINE"}
VALUATION_LIMITS, VALUATION_LEVELS = [20, 40, 60, 80], ["DEEP_UNDERVALUED", "UNDERVALUED", "FAIR", "OVERVALUED", "EXTREME_OVERVALUED"]
RISK_LIMITS, RISK_LEVELS = [15, 30, 50, 70, 85], ["VERY_LOW", "LOW", "MODERATE", "HIGH", "VERY_HIGH", "EXTREME"]
RISK_WEIGHTS = {"trend_risk": 0.20, "valuation_risk": 0.15, "leverage_risk": 0.20, "liquidity_risk": 0.15, "macro_risk": 0.15, "onchain_risk": 0.15}
REGIME_LIMITS, REGIME_LABELS = [-0.55, -0.20, 0.20, 0.55], ["Capitulation", "Risk-Off Contraction", "Neutral", "Cautious Optimism", "Risk-On Expansion"]
RISK_SCALARS = {"VERY_LOW": 0.6, "LOW": 0.3, "MODERATE": 0.0, "HIGH": -0.4, "VERY_HIGH": -0.7, "EXTREME": -0.9}


def features(bars: DataFrame) -> DataFrame:
    """symbol, time and what the scores read, from one ordering of the bars."""
    w = W()
    f = bars.withColumns({
        "ma200": rolling_mean("close", 200), "peak": running_max("close"), "r": log_return("close"), "n": F.row_number().over(w)})
    f = f.withColumns({"ma_before": F.coalesce(F.lag("ma200", 29).over(w), F.col("ma200")), "dd": F.col("close") / F.col("peak") - 1, "vol": full(F.stddev_pop("r").over(last_rows(30)) * F.sqrt(F.lit(365.0)), "r", 30, last_rows(30))})
    f = percent_below(f, {"vol_pct": "vol"}, 365)
    return f.withColumn("dd_before", F.when(F.lag("close", 30).over(w).isNotNull(), F.lag("close", 30).over(w) / F.col("peak") - 1).otherwise(F.col("dd")))


def trend_score() -> Column:
    slope, place = F.col("ma200") / F.col("ma_before") - 1, F.col("close") / F.col("ma200") - 1
    return F.when(F.col("ma200").isNotNull(), clamp(clamp(slope * 8, -1, 1) * 0.4 + clamp(place * 2.5, -1, 1) * 0.35 + clamp(F.col("dd") * 2, -1, 1) * 0.25, -1, 1))


def drawdown_risk() -> Column:
    a, speed = -F.col("dd"), F.col("dd") - F.col("dd_before")
    depth = ramp(a, [(0.0, 10.0), (0.20, 35.0), (0.40, 60.0), (0.60, 80.0), (0.60 + 4 / 15, 100.0)])
    fall = ramp(-speed, [(0.0, 15.0), (0.10, 45.0), (0.25, 75.0), (0.40, 100.0)])
    return clamp(depth * 0.6 + fall * 0.4, 0, 100)


def fuse(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the scores that there are."""
    total = sum((F.when(s.isNotNull(), F.lit(w)).otherwise(0.0) for s, w in parts), F.lit(0.0))
    return F.try_divide(sum((F.coalesce(s, F.lit(0.0)) * w for s, w in parts), F.lit(0.0)), total)


def floored(score: Column, factors: list[Column], compat: bool = False) -> Column:
    """At least 50 if any factor is above 90, at least 70 if three are above 70 (compat: the first rule hides the second)."""
    extreme = F.greatest(*[F.coalesce(f, F.lit(0.0)) for f in factors]) > 90
    high = sum((F.when(f > 70, 1).otherwise(0) for f in factors), F.lit(0)) >= 3
    second = F.when(high, 70.0).otherwise(0.0)
    return F.greatest(score, F.when(extreme, F.lit(50.0) if compat else F.greatest(second, F.lit(50.0))).otherwise(second))


def phase_probabilities(score: Column) -> Column:
    """Map of phase to probability, Gaussian around the phases' centres."""
    raw = {p: F.exp(-F.pow(score - c, 2) / (2 * PHASE_SIGMA**2)) * (LATE_FACTOR if p in LATE_PHASES else 1.0) for p, c in PHASE_CENTERS.items()}
    total = sum(raw.values(), F.lit(0.0))
    return F.create_map(*[x for p, v in raw.items() for x in (F.lit(p), v / total)])


def scores(bars: DataFrame) -> DataFrame:
    """Per symbol and day: cycle, valuation, risk and regime with their levels."""
    f = features(bars)
    trend = trend_score()
    low = F.min("close").over(W().rowsBetween(-364, 0))
    high = F.max("close").over(W().rowsBetween(-364, 0))
    f = f.withColumn("trend", trend).withColumn("valuation", F.try_divide(F.col("close") - low, high - low) * 100).withColumn("volatility_risk", F.col("vol_pct")).withColumn("drawdown_risk", drawdown_risk())
    cycle = fuse([(F.col("trend"), 0.25), ((50 - F.col("valuation")) / 50, 0.10)])
    trend_risk = fuse([(F.col("volatility_risk"), 0.5), (F.col("drawdown_risk"), 0.5)])
    overall = fuse([(trend_risk, RISK_WEIGHTS["trend_risk"]), (F.col("valuation"), RISK_WEIGHTS["valuation_risk"])])
    f = f.withColumn("cycle", cycle).withColumn("risk", floored(overall, [F.col("volatility_risk"), F.col("drawdown_risk"), F.col("valuation")]))
    f = f.withColumn("phase", level(F.round("cycle", 9), PHASE_LIMITS, PHASES)).withColumn("valuation_level", level(F.round("valuation", 9), VALUATION_LIMITS, VALUATION_LEVELS)).withColumn("risk_level", level(F.round("risk", 9), RISK_LIMITS, RISK_LEVELS))
    scalar = F.create_map(*[F.lit(x) for kv in RISK_SCALARS.items() for x in kv])
    regime = fuse([(F.col("trend"), 0.6), (F.try_element_at(scalar, "risk_level"), 0.4)])
    f = f.withColumn("regime", regime)
    return f.select("symbol", "time", "trend", "valuation", "valuation_level", "volatility_risk", "drawdown_risk", "risk", "risk_level", "cycle", "phase", "regime", level(F.round("regime", 9), REGIME_LIMITS, REGIME_LABELS).alias("regime_label"))


#: What a target phase does in a state: nothing new, to be refused, or a move that needs age and confirmations.
ACTIONS = {state: {target: "stay" if target == state else "move" if target in TRANSITIONS[state] else "refuse" for target in PHASE_CENTERS} for state in PHASE_CENTERS}


class Memory(NamedTuple):
    state: str
    days: int = 0
    wanted: str | None = None
    times: int = 0


def advanced(m: Memory, target: str, elapsed: int) -> Memory:
    """The memory after a target phase that came so many days after the last one."""
    action = ACTIONS[m.state][target]
    older = m._replace(days=m.days + elapsed)
    if action == "stay":
        return older._replace(wanted=None, times=0)
    if action == "refuse":  # remembered as wanted, but it confirms nothing
        return older._replace(wanted=target)
    least = TOP_RISK_DAYS if m.state == "TOP_RISK" else LEAST_DAYS
    if max(m.days, elapsed) < least:  # too early: it counts, whatever was wanted before
        return older._replace(wanted=target, times=m.times + 1)
    times = 1 + (m.times if m.wanted == target else 0)
    return Memory(target) if times >= (1 if target in FAST else CONFIRMATIONS) else older._replace(wanted=target, times=times)


@cache
def debouncer() -> Table:
    """The state machine as a table. A memory is nothing yet, or state, days (capped, as only LEAST_DAYS matters), wanted phase and count
    (capped at CONFIRMATIONS); an input is a target phase and the days since the last one."""
    names = list(TRANSITIONS)
    days = LEAST_DAYS + 1
    memories = [None, *[Memory(s, d, w, n) for s in names for d in range(days) for w in (None, *names) for n in range(CONFIRMATIONS + 1)]]
    place = {m: k for k, m in enumerate(memories)}
    capped = lambda m: m._replace(days=min(m.days, LEAST_DAYS), times=min(m.times, CONFIRMATIONS))
    table = [[place[Memory(t) if m is None else capped(advanced(m, t, d))] for m in memories] for t in names for d in range(days)]
    return Table(np.array(table, np.int32), 0)


def debounced(phases: DataFrame, rows: int = ROWS) -> DataFrame:
    """The state machine over daily target phases: legal transitions, least age, confirmations. Maps of stretches of rows are composed, no task folds a symbol."""
    day = 86_400_000_000
    t = numbered(written(phases.select("symbol", "time", "phase"), "phases")).withColumn("_stretch", F.floor(F.col("_rn") / rows))
    known = F.col("phase").isNotNull()
    by, place = ("symbol",), ("_rn",)
    t = running(t.withColumn("_us", F.unix_micros(F.col("time").cast("timestamp"))), {"_last": ("max", F.when(known, F.col("_us")))}, by, "_stretch", place, before=True)
    t = t.withColumn("_gap", F.when(known, F.greatest(F.lit(0), F.coalesce(F.floor((F.col("_us") - F.col("_last")) / day), F.lit(0)))).otherwise(0).cast("long"))
    names = list(TRANSITIONS)
    number = F.array_position(F.array(*map(F.lit, names)), F.col("phase")) - 1
    t = t.withColumn("_input", F.when(known, number * (LEAST_DAYS + 1) + F.least(F.col("_gap"), F.lit(LEAST_DAYS))).otherwise(-1).cast("long"))
    t = written(t.select("symbol", "time", "phase", "_rn", "_stretch", "_gap", "_input"), "phase-inputs")
    t = written(run_machine(t, debouncer(), ["_input"], "symbol", "_stretch", ["_rn"], "_memory"), "phase-memories")
    per_state = (LEAST_DAYS + 1) * (len(names) + 1) * (CONFIRMATIONS + 1)
    state = lambda m: F.when(F.col(m) > 0, F.get(F.array(*map(F.lit, names)), F.expr(f"CAST(({m} - 1) div {per_state} AS INT)")))
    t = t.withColumns({"state": state("_memory"), "_was": state("_memory_before")})
    # Days of a state: the days that have gone by less those that had at its beginning.
    t = running(t, {"_gone": ("sum", F.col("_gap"))}, by, "_stretch", place)
    began = F.when(F.col("state").isNotNull() & ~F.col("state").eqNullSafe(F.col("_was")), F.col("_gone"))
    out = running(t, {"_began": ("max", began)}, by, "_stretch", place)
    days = F.when(F.col("state").isNull(), 0).otherwise(F.col("_gone") - F.col("_began"))
    return out.select("symbol", "time", "phase", "state", days.cast("int").alias("days"))


def state_changes(df: DataFrame, state: str) -> DataFrame:
    before = F.lag(state).over(W())
    return df.withColumn("before", before).filter(F.col("before").isNotNull() & ~F.col("before").eqNullSafe(F.col(state)))


_RAMP_DEPTH = "CASE WHEN -dd <= 0 THEN 10.0 WHEN -dd < 0.20 THEN 10 + -dd * 125 WHEN -dd < 0.40 THEN 35 + (-dd - 0.2) * 125 WHEN -dd < 0.60 THEN 60 + (-dd - 0.4) * 100 WHEN -dd < 0.60 + 4.0/15 THEN 80 + (-dd - 0.6) * 75 ELSE 100 END"
_RAMP_FALL = "CASE WHEN v <= 0 THEN 15.0 WHEN v < 0.10 THEN 15 + v * 300 WHEN v < 0.25 THEN 45 + (v - 0.1) * 200 WHEN v < 0.40 THEN 75 + (v - 0.25) * (25 / 0.15) ELSE 100 END"
FEATURES = f"""{MULTI}, f0 AS (SELECT *, row_number() OVER w AS n, CASE WHEN row_number() OVER w >= 200 THEN avg(close) OVER (w ROWS 199 PRECEDING) END AS ma200, max(close) OVER w AS peak, ln(close / lag(close) OVER w) AS r, lag(close, 30) OVER w AS c30,
    min(close) OVER (w ROWS 364 PRECEDING) AS lo, max(close) OVER (w ROWS 364 PRECEDING) AS hi FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time)),
  f1 AS (SELECT *, coalesce(lag(ma200, 29) OVER w, ma200) AS ma_before, close / peak - 1 AS dd, CASE WHEN count(r) OVER (w ROWS 29 PRECEDING) >= 30 THEN stddev_pop(r) OVER (w ROWS 29 PRECEDING) * sqrt(365) END AS vol FROM f0 WINDOW w AS (PARTITION BY symbol ORDER BY time)),
  f2 AS (SELECT *, list(vol) FILTER (WHERE vol IS NOT NULL) OVER (PARTITION BY symbol ORDER BY time ROWS 364 PRECEDING) AS vols, dd - coalesce(c30 / peak - 1, dd) AS speed FROM f1),
  f3 AS (SELECT *, CASE WHEN vol IS NOT NULL THEN len(list_filter(vols, lambda x: x < vol)) / len(vols) * 100 END AS volatility_risk, -speed AS v,
    CASE WHEN ma200 IS NOT NULL THEN least(greatest(least(greatest((ma200 / ma_before - 1) * 8, -1), 1) * 0.4 + least(greatest((close / ma200 - 1) * 2.5, -1), 1) * 0.35 + least(greatest(dd * 2, -1), 1) * 0.25, -1), 1) END AS trend, (close - lo) / nullif(hi - lo, 0) * 100 AS valuation FROM f2),
  f4 AS (SELECT *, least(greatest(({_RAMP_DEPTH}) * 0.6 + ({_RAMP_FALL}) * 0.4, 0), 100) AS drawdown_risk FROM f3)"""


@query("engine_features", f"WITH {FEATURES} SELECT symbol, time, round(trend, 5) AS trend, round(valuation, 5) AS valuation, round(drawdown_risk, 5) AS drawdown_risk FROM f4")
def q_features(spark, sf_dir):
    return rounded(scores(bars_multi(spark, sf_dir)).select("symbol", "time", "trend", "valuation", "drawdown_risk"), 5)


def _level_sql(c, limits, names):
    return f"CASE WHEN {c} IS NULL THEN NULL {' '.join(f'WHEN {c} < {x} THEN ' + chr(39) + n + chr(39) for x, n in zip(limits, names, strict=False))} ELSE '{names[-1]}' END"


@query("engine_levels", f"""WITH {FEATURES}, l AS (SELECT symbol, time, {_level_sql('round(valuation, 9)', VALUATION_LIMITS, VALUATION_LEVELS)} AS valuation_level,
  (coalesce(trend, 0) * 0.25 + coalesce((50 - valuation) / 50, 0) * 0.10) / nullif(CASE WHEN trend IS NULL THEN 0 ELSE 0.25 END + CASE WHEN valuation IS NULL THEN 0 ELSE 0.10 END, 0) AS cycle FROM f4)
  SELECT symbol, time, valuation_level, round(cycle, 5) AS cycle, {_level_sql('round(cycle, 9)', PHASE_LIMITS, PHASES)} AS phase FROM l""")
def q_levels(spark, sf_dir):
    s = scores(bars_multi(spark, sf_dir)).withColumn("valuation_level", level(F.round("valuation", 9), VALUATION_LIMITS, VALUATION_LEVELS))
    return rounded(s.select("symbol", "time", "valuation_level", "cycle", "phase"), 5)


_RISK_SQL = """, s0 AS (SELECT *, (coalesce(volatility_risk * 0.5, 0) + drawdown_risk * 0.5) / (CASE WHEN volatility_risk IS NULL THEN 0.5 ELSE 1 END) AS tr, greatest(coalesce(volatility_risk, 0), drawdown_risk, coalesce(valuation, 0)) AS worst,
    CASE WHEN volatility_risk > 70 AND drawdown_risk > 70 AND valuation > 70 THEN 70 ELSE 0 END AS three FROM f4),
  s1 AS (SELECT *, greatest((tr * 0.20 + coalesce(valuation * 0.15, 0)) / (CASE WHEN valuation IS NULL THEN 0.20 ELSE 0.35 END), CASE WHEN worst > 90 THEN greatest(50, three) ELSE three END) AS risk,
    (coalesce(trend, 0) * 0.25 + coalesce((50 - valuation) / 50, 0) * 0.10) / nullif(CASE WHEN trend IS NULL THEN 0 ELSE 0.25 END + CASE WHEN valuation IS NULL THEN 0 ELSE 0.10 END, 0) AS cycle FROM s0)"""
_SCALAR_SQL = f"CASE risk_level {' '.join(f'WHEN {k!r} THEN {v}' for k, v in RISK_SCALARS.items())} END"


@query("engine_scores", f"""WITH {FEATURES}{_RISK_SQL}, s2 AS (SELECT *, {_level_sql('round(risk, 9)', RISK_LIMITS, RISK_LEVELS)} AS risk_level FROM s1), s3 AS (SELECT *, (coalesce(trend * 0.6, 0) + {_SCALAR_SQL} * 0.4) / (CASE WHEN trend IS NULL THEN 0.4 ELSE 1 END) AS regime FROM s2)
  SELECT symbol, time, round(trend, 5) + 0.0 AS trend, round(valuation, 5) + 0.0 AS valuation, {_level_sql('round(valuation, 9)', VALUATION_LIMITS, VALUATION_LEVELS)} AS valuation_level, round(volatility_risk, 5) + 0.0 AS volatility_risk, round(drawdown_risk, 5) + 0.0 AS drawdown_risk, round(risk, 5) + 0.0 AS risk,
   risk_level, round(cycle, 5) + 0.0 AS cycle, {_level_sql('round(cycle, 9)', PHASE_LIMITS, PHASES)} AS phase, round(regime, 5) + 0.0 AS regime, {_level_sql('round(regime, 9)', REGIME_LIMITS, REGIME_LABELS)} AS regime_label FROM s3""")
def q_scores(spark, sf_dir):
    """The scores from prices alone, with their levels; plans.factors has those from all metrics."""
    s = rounded(scores(bars_multi(spark, sf_dir)), 5)
    return s.withColumns({c: F.col(c) + 0.0 for c, t in s.dtypes if t == "double"})


@query("engine_phase_probabilities", f"""WITH {FEATURES}, p AS (SELECT symbol, time, {', '.join(f'exp(-pow(trend - ({c}), 2) / (2 * 0.09)) * {0.15 if p in LATE_PHASES else 1.0} AS {p}' for p, c in PHASE_CENTERS.items())} FROM f4 WHERE trend IS NOT NULL)
  SELECT symbol, time, {', '.join(f"round({p} / ({' + '.join(PHASE_CENTERS)}), 6) AS p_{p.lower()}" for p in PHASE_CENTERS)} FROM p""")
def q_probabilities(spark, sf_dir):
    s = scores(bars_multi(spark, sf_dir)).filter("trend is not null").withColumn("p", phase_probabilities(F.col("trend")))
    return rounded(s.select("symbol", "time", *[F.col("p")[p].alias(f"p_{p.lower()}") for p in PHASE_CENTERS]), 6)


@query("engine_similar_periods", f"""WITH {FEATURES}, v AS (SELECT symbol, time, trend, dd, vol, close FROM f4 WHERE trend IS NOT NULL AND vol IS NOT NULL), q AS (SELECT symbol, max(time) AS t, arg_max([trend, dd, vol], time) AS qv FROM v GROUP BY symbol),
  s AS (SELECT v.symbol, v.time, list_cosine_similarity([trend, dd, vol], qv) AS c, list_distance([trend, dd, vol], qv) AS d FROM v JOIN q ON v.symbol = q.symbol AND v.time < q.t - INTERVAL 180 DAY)
  SELECT symbol, time, round(0.6 * (c + 1) / 2 + 0.4 * greatest(0, 1 - d / sqrt(6)), 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(0.6 * (c + 1) / 2 + 0.4 * greatest(0, 1 - d / sqrt(6)), 9) DESC, time) <= 3""")
def q_similar(spark, sf_dir):
    """The three earlier days most like the last one, per symbol: one row per symbol joins its own history."""
    from ..functions.scalars import similarity

    v = features(bars_multi(spark, sf_dir)).withColumn("trend", trend_score()).filter("trend is not null and vol is not null").select("symbol", "time", F.array("trend", "dd", "vol").alias("v"))
    q = v.groupBy("symbol").agg(F.max("time").alias("t"), F.max_by("v", "time").alias("q"))
    s = v.join(q, "symbol").filter(F.col("time") < F.col("t") - F.expr("INTERVAL 180 DAYS")).withColumn("similarity", similarity("v", "q"))
    best = F.row_number().over(Window.partitionBy("symbol").orderBy(F.round("similarity", 9).desc(), "time"))
    return s.withColumn("k", best).filter("k <= 3").select("symbol", "time", F.round("similarity", 6).alias("similarity"))


@query("engine_state_changes", f"""WITH {FEATURES}, l AS (SELECT symbol, time, {_level_sql('round(valuation, 9)', VALUATION_LIMITS, VALUATION_LEVELS)} AS state FROM f4), b AS (SELECT *, lag(state) OVER (PARTITION BY symbol ORDER BY time) AS before FROM l)
  SELECT symbol, time, state, before FROM b WHERE before IS NOT NULL AND before IS DISTINCT FROM state""")
def q_changes(spark, sf_dir):
    s = scores(bars_multi(spark, sf_dir)).select("symbol", "time", level(F.round("valuation", 9), VALUATION_LIMITS, VALUATION_LEVELS).alias("state"))
    return state_changes(s, "state")
