"""Investment strategies that read the engines: by valuation and by risk, in the backtest and in the plan simulator, and similar periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import similarity
from ..operators.asof import asof_backward
from ..registry import query
from ..sources.frames import bars_multi, rounded
from .backtest import RISK_FACTORS, vectorized
from .engines import RISK_LEVELS, RISK_LIMITS
from .factors import SQL_CYCLE, SQL_RISK, SQL_VALUATION, cycle_scores, metrics, research, valuation_dimensions
from .portfolio import simulate

SIMILAR, LEAST_HISTORY, HORIZONS = 0.55, 30, (30, 90, 180)

_LEVEL = f"CASE {' '.join(f'WHEN round(risk, 9) < {t} THEN {RISK_FACTORS[n]}' for t, n in zip(RISK_LIMITS, RISK_LEVELS, strict=False))} ELSE {RISK_FACTORS['EXTREME']} END"
_PLACE = "CASE WHEN pm <= 15 THEN {a} WHEN pm <= 30 THEN {b} {high} ELSE 1.0 END"


def _valued(a, b, high=""):
    place = _PLACE.format(a=a, b=b, high=high)
    return f"CASE WHEN nupl < 0.25 THEN greatest({place}, 1.3) ELSE {place} END"


def _simulated(frame, table, factor):
    return f"""WITH {frame}, s AS (SELECT symbol, time, close, CAST(CASE WHEN isodow(time) = 1 THEN 100.0 * {factor} ELSE 0.0 END AS DOUBLE) AS spent FROM {table})
  SELECT symbol, time, round(spent, 4) AS spent, round(sum(spent * 0.999 / close) OVER w, 8) AS held, round(sum(spent) OVER w, 4) AS invested FROM s WINDOW w AS (PARTITION BY symbol ORDER BY time)"""


def _tested(frame, table, factor):
    return f"""WITH {frame}, s AS (SELECT symbol, time, open, close, CAST(CASE WHEN day(time) = 1 THEN 100.0 * {factor} ELSE 0.0 END AS DOUBLE) AS signal FROM {table}), a AS (SELECT *, coalesce(lag(signal) OVER (PARTITION BY symbol ORDER BY time), 0) AS amount FROM s)
  SELECT symbol, time, round(amount, 4) AS amount, round(sum(CASE WHEN amount > 0 THEN (amount - amount * 0.001) / (open * 1.0005) ELSE 0 END) OVER w, 9) AS btc FROM a WINDOW w AS (PARTITION BY symbol ORDER BY time)"""


@query("portfolio_simulation_valuation", _simulated(SQL_VALUATION, "v", _valued(2.0, 1.5)))
def q_simulation_valuation(spark, sf_dir):
    s = simulate(valuation_dimensions(metrics(bars_multi(spark, sf_dir))), "VALUATION_BUY")
    return rounded(s.select("symbol", "time", "spent", "held", "invested"), 4, held=8)


@query("portfolio_simulation_risk", _simulated(SQL_RISK, "rk", _LEVEL))
def q_simulation_risk(spark, sf_dir):
    return rounded(simulate(research(bars_multi(spark, sf_dir)), "RISK_ADJUSTED").select("symbol", "time", "spent", "held", "invested"), 4, held=8)


@query("backtest_valuation", _tested(SQL_VALUATION, "v", _valued(3.0, 2.0, "WHEN pm >= 85 THEN 0.5")))
def q_backtest_valuation(spark, sf_dir):
    return rounded(vectorized(valuation_dimensions(metrics(bars_multi(spark, sf_dir))), "valuation_buy").select("symbol", "time", "amount", "btc"), 4, btc=9)


@query("backtest_risk", _tested(SQL_RISK, "rk", _LEVEL))
def q_backtest_risk(spark, sf_dir):
    return rounded(vectorized(research(bars_multi(spark, sf_dir)), "risk_adjusted").select("symbol", "time", "amount", "btc"), 4, btc=9)


def similar_periods(scored: DataFrame, bars: DataFrame, columns: list[str], top: int = 3, least: float = SIMILAR, gap_days: int = 180) -> DataFrame:
    """Per symbol, the days before the last one by at least gap_days whose scores are most like its: symbol, time, similarity and the
    returns after 30, 90 and 180 days (by the close at or before then). Symbols with too little history have none."""
    v = scored.select("symbol", "time", "close", F.array(*columns).alias("v")).withColumn("ok", F.forall("v", lambda x: x.isNotNull()))
    of_symbol, ok = Window.partitionBy("symbol"), F.col("ok")
    v = v.withColumns({
        "t": F.max(F.when(ok, F.col("time"))).over(of_symbol), "q": F.max_by(F.when(ok, F.col("v")), F.when(ok, F.col("time"))).over(of_symbol), "n": F.sum(F.when(ok, 1).otherwise(0)).over(of_symbol)})
    s = v.filter(ok & (F.col("n") >= LEAST_HISTORY) & (F.col("time") < F.col("t") - F.make_interval(days=F.lit(gap_days)))).withColumn("similarity", F.round(similarity("v", "q"), 9)).filter(F.col("similarity") >= least)
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("similarity"), "time"))
    out = s.withColumn("k", place).filter(F.col("k") <= top).select("symbol", "time", "close", "similarity")
    prices = bars.select("symbol", F.col("time").alias("_at"), F.col("close").alias("_then"))
    for days in HORIZONS:
        asked = out.withColumn("_when", F.col("time") + F.make_interval(days=F.lit(days)))
        out = asof_backward(asked, prices, "_when", "_at", ["_then"], ["symbol"], bucket="year").withColumn(f"return_{days}d", F.col("_then") / F.col("close") - 1).drop("_when", "_then")
    return out.drop("close")


_V = "[cyc_onchain, cyc_capital_flow, cyc_derivative, cyc_macro, cyc_sentiment]"


@query("engine_similar_cycles", f"""WITH {SQL_CYCLE}, u AS (SELECT symbol, time, close, {_V} AS v FROM c WHERE cyc_onchain IS NOT NULL AND cyc_capital_flow IS NOT NULL AND cyc_derivative IS NOT NULL AND cyc_macro IS NOT NULL AND cyc_sentiment IS NOT NULL),
  q AS (SELECT symbol, max(time) AS t, arg_max(v, time) AS qv FROM u GROUP BY 1 HAVING count(*) >= 30), s AS (SELECT u.*, round(0.6 * (list_cosine_similarity(v, qv) + 1) / 2 + 0.4 * greatest(0, 1 - list_distance(v, qv) / sqrt(10)), 9) AS similarity FROM u JOIN q ON u.symbol = q.symbol AND u.time < q.t - INTERVAL 180 DAY),
  k AS (SELECT symbol, time, close, similarity FROM s WHERE similarity >= 0.55 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY similarity DESC, time) <= 3),
  a AS (SELECT k.*, b.close AS c30 FROM k ASOF LEFT JOIN bars b ON k.symbol = b.symbol AND k.time + INTERVAL 30 DAY >= b.time), b2 AS (SELECT a.*, b.close AS c90 FROM a ASOF LEFT JOIN bars b ON a.symbol = b.symbol AND a.time + INTERVAL 90 DAY >= b.time),
  d AS (SELECT b2.*, b.close AS c180 FROM b2 ASOF LEFT JOIN bars b ON b2.symbol = b.symbol AND b2.time + INTERVAL 180 DAY >= b.time)
  SELECT symbol, time, round(similarity, 6) AS similarity, round(c30 / close - 1, 6) AS return_30d, round(c90 / close - 1, 6) AS return_90d, round(c180 / close - 1, 6) AS return_180d FROM d""")
def q_similar_cycles(spark, sf_dir):
    """Periods whose factors of the cycle engine were most like the last day's, and what followed."""
    bars = bars_multi(spark, sf_dir)
    return rounded(similar_periods(cycle_scores(valuation_dimensions(metrics(bars))), bars, [f"cyc_{k}" for k in ("onchain", "capital_flow", "derivative", "macro", "sentiment")]), 6)
