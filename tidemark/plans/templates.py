"""Ready alert rules over a market's whole context, and the data of the daily digest.

A template is a condition tree (plans.alerts) over metrics of the context: price and its changes, indicators, states of the engines,
and what a portfolio has gained. The context is one frame with a row per symbol and time, so all rules of all users read one scan.
"""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import W, last_rows
from ..operators.lags import CHANGE_HOURS, changes
from ..registry import query
from ..sources.frames import bars_multi
from ..tables import written
from .alerts import compiled
from .factors import SQL_REGIME, full, metrics
from .recursive import _CORE, scanned

# The templates' limits, severities and the fields that users may change.
TEMPLATES = {
    "price_below": ("HIGH", {"type": "threshold", "metric": "price", "operator": "lt", "value": 90000}, ("value",)),
    "price_above": ("HIGH", {"type": "threshold", "metric": "price", "operator": "gt", "value": 120000}, ("value",)),
    "major_drawdown": ("CRITICAL", {"type": "threshold", "metric": "drawdown_pct", "operator": "lt", "value": -20}, ("value",)),
    "extreme_fear": ("MEDIUM", {"type": "threshold", "metric": "fear_greed", "operator": "lt", "value": 20}, ("value",)),
    "mvrv_low": ("MEDIUM", {"type": "threshold", "metric": "mvrv", "operator": "lt", "value": 1.0}, ("value",)),
    "mvrv_high": ("MEDIUM", {"type": "threshold", "metric": "mvrv", "operator": "gt", "value": 3.0}, ("value",)),
    "leverage_risk": ("HIGH", {"type": "AND", "children": [
        {"type": "threshold", "metric": "funding_rate", "operator": "gt", "value": 0.0005}, {"type": "threshold", "metric": "open_interest_change_24h", "operator": "gt", "value": 15}]}, ("value",)),
    "etf_anomaly": ("MEDIUM", {"type": "threshold", "metric": "etf_flow_1d", "operator": "gt", "value": 5}, ("value",)),
    "cycle_change": ("INFO", {"type": "state_change", "metric": "cycle"}, ("engine",)),
    "risk_high": ("HIGH", {"type": "threshold", "metric": "risk_score", "operator": "gt", "value": 70}, ("value",)),
    "rsi_oversold": ("LOW", {"type": "threshold", "metric": "rsi", "operator": "lt", "value": 30}, ("value",)),
    "portfolio_loss": ("HIGH", {"type": "threshold", "metric": "portfolio_pnl_pct", "operator": "lt", "value": -20}, ("value",)),
}
HUNDRED_MILLION = 1e8


def from_template(name: str, **changed) -> dict:
    """A template's condition tree with a user's own value (of its first part, if it has several) or engine."""
    _, tree, editable = TEMPLATES[name]
    tree = copy.deepcopy(tree)
    part = tree["children"][0] if "children" in tree else tree
    for field, v in changed.items():
        if field not in editable:
            raise ValueError(f"{name} has no field {field} to change")
        part["metric" if field == "engine" else field] = v
    return tree


def context(bars: DataFrame) -> DataFrame:
    """Per symbol and time all that the templates ask for. Changes are over hours of time, whatever rows there are; the portfolio buys one unit at every close."""
    f = full(bars).select("symbol", "time", "close", "dd", "fear_greed", "mvrv", "funding", "oi_usd", "flow", "ruled_phase", "risk", "rn", "valuation_level", "label")
    f = changes(written(f, "market"), "oi_usd", {"24h": 24}, prefix="open_interest_change_")
    f = f.join(scanned(bars, "tech.rsi").select("symbol", "time", F.col("value").alias("rsi")), ["symbol", "time"], "left")
    r9 = lambda x: F.round(x, 9)
    paid = F.sum("close").over(W().rowsBetween(Window.unboundedPreceding, 0))
    return f.select(
        "symbol", "time", F.col("close").alias("price"), r9(F.col("dd") * 100).alias("drawdown_pct"), r9("fear_greed").alias("fear_greed"), r9("mvrv").alias("mvrv"), r9("funding").alias("funding_rate"), r9("open_interest_change_24h").alias("open_interest_change_24h"),
        r9(F.col("flow") / HUNDRED_MILLION).alias("etf_flow_1d"), F.col("ruled_phase").alias("cycle"), r9("risk").alias("risk_score"), F.round("rsi", 4).alias("rsi"), r9((F.col("close") * F.col("rn") / paid - 1) * 100).alias("portfolio_pnl_pct"), "valuation_level", "label")


_TOLD = {
    "price_below": "close < 90000", "price_above": "close > 120000", "major_drawdown": "round(dd * 100, 9) < -20", "extreme_fear": "round(fg, 9) < 20", "mvrv_low": "round(mvrv, 9) < 1", "mvrv_high": "round(mvrv, 9) > 3",
    "leverage_risk": "round(funding, 9) > 0.0005 AND round(oi_change, 9) > 15", "etf_anomaly": "round((close - open) * volume * 1000 / 1e8, 9) > 5", "cycle_change": "CASE WHEN before IS NOT NULL THEN before <> ruled_phase END",
    "risk_high": "round(risk, 9) > 70", "rsi_oversold": "round(rsi, 4) < 30", "portfolio_loss": "round((close * rn / paid - 1) * 100, 9) < -20",
}
_CONTEXT = f"""y0 AS (SELECT *, lag(ruled_phase) OVER w AS before, sum(close) OVER w AS paid FROM g WINDOW w AS (PARTITION BY symbol ORDER BY time)),
  y1 AS (SELECT a.*, (a.oi_usd / b.oi_usd - 1) * 100 AS oi_change FROM y0 a ASOF LEFT JOIN m b ON a.symbol = b.symbol AND a.time - INTERVAL 24 HOUR >= b.time),
  y2 AS (SELECT y1.*, rsi FROM y1 LEFT JOIN (SELECT r.symbol, r.time, CASE WHEN ag + al > 0 THEN 100 * ag / (ag + al) WHEN ag IS NOT NULL THEN 100 END AS rsi FROM smooth r) q ON y1.symbol = q.symbol AND y1.time = q.time)"""
# The smoothing's tables are renamed, so that they can stand beside the engines'.
_BESIDE = _CORE.replace("WITH RECURSIVE ", "").split(", l AS (", 1)[1]
for _old, _new in (("  x AS (", "  sx_ AS ("), (" FROM l),", " FROM sl_),"), ("  b AS (", "  sb_ AS ("), (" FROM x WINDOW", " FROM sx_ WINDOW"), ("  r AS (", "  smooth AS ("), (" FROM b WHERE rn = 1", " FROM sb_ WHERE rn = 1"), (" FROM r JOIN b ON", " FROM smooth r JOIN sb_ b ON")):
    _BESIDE = _BESIDE.replace(_old, _new)


@query("alert_templates", f"WITH RECURSIVE {SQL_REGIME}, sl_ AS ({_BESIDE.strip()}, {_CONTEXT}\n  SELECT symbol, time, {', '.join(f'{sql} AS {n}' for n, sql in _TOLD.items())} FROM y2")
def q_templates(spark, sf_dir):
    """All twelve templates on every day."""
    return context(bars_multi(spark, sf_dir)).select("symbol", "time", *[compiled(tree).alias(n) for n, (_, tree, _) in TEMPLATES.items()])


def daily_digest(c: DataFrame, flows: DataFrame) -> DataFrame:
    """Per symbol and day of a context (symbol, time, price, cycle, valuation_level, label, risk_score, mvrv) what a day's digest says: price, its changes over a day and a week, the
    states with what they were the day before, which of them changed, flows (symbol, time, flow) of the day and the last seven rows, and how many of those were positive."""
    w = W()
    hours = {n: CHANGE_HOURS[n] for n in ("24h", "7d")}
    d = changes(written(c, "told"), "price", hours)
    states = ("cycle", "valuation_level", "label")
    d = d.withColumns({f"{s}_before": F.lag(s).over(w) for s in states})
    moved = F.array(*[F.when(F.col(s) != F.col(f"{s}_before"), F.lit(s)) for s in states])
    f = flows.withColumns({"flow_7d": F.sum("flow").over(last_rows(7)), "inflow_days": F.sum(F.when(F.col("flow") > 0, 1).otherwise(0)).over(last_rows(7)), "flow_days": F.count("flow").over(last_rows(7))})
    return d.withColumn("moved", F.filter(moved, lambda x: x.isNotNull())).join(f, ["symbol", "time"], "left")


@query("alert_daily_digest", f"""WITH {SQL_REGIME}, z0 AS (SELECT *, lag(ruled_phase) OVER w AS before, (close - open) * volume * 1000 AS flow FROM g WINDOW w AS (PARTITION BY symbol ORDER BY time)),
  z1 AS (SELECT a.*, b.close AS c1 FROM z0 a ASOF LEFT JOIN bars b ON a.symbol = b.symbol AND a.time - INTERVAL 24 HOUR >= b.time), z2 AS (SELECT a.*, b.close AS c7 FROM z1 a ASOF LEFT JOIN bars b ON a.symbol = b.symbol AND a.time - INTERVAL 168 HOUR >= b.time)
  SELECT symbol, time, close AS price, round((close / c1 - 1) * 100, 5) + 0.0 AS change_24h, round((close / c7 - 1) * 100, 5) + 0.0 AS change_7d, ruled_phase AS cycle, before AS cycle_before, coalesce(ruled_phase <> before, false) AS cycle_moved, round(risk, 4) AS risk_score,
    round(flow / 1e6, 5) + 0.0 AS flow, round(sum(flow) OVER f / 1e6, 5) + 0.0 AS flow_7d, CAST(sum(CASE WHEN flow > 0 THEN 1 ELSE 0 END) OVER f AS BIGINT) AS inflow_days, count(flow) OVER f AS flow_days FROM z2 WINDOW f AS (PARTITION BY symbol ORDER BY time ROWS 6 PRECEDING)""")
def q_daily_digest(spark, sf_dir):
    """Each day's digest: prices, changes, phases and flows (in millions)."""
    bars = bars_multi(spark, sf_dir)
    c = full(bars).select("symbol", "time", F.col("close").alias("price"), F.col("ruled_phase").alias("cycle"), "valuation_level", "label", F.col("risk").alias("risk_score"))
    d = daily_digest(c, metrics(bars).select("symbol", "time", "flow"))
    whole = lambda x, digits: (F.round(x, digits) + 0.0)
    return d.select(
        "symbol", "time", "price", whole("change_24h", 5).alias("change_24h"), whole("change_7d", 5).alias("change_7d"), "cycle", "cycle_before", F.array_contains("moved", "cycle").alias("cycle_moved"), F.round("risk_score", 4).alias("risk_score"),
        whole(F.col("flow") / 1e6, 5).alias("flow"), whole(F.col("flow_7d") / 1e6, 5).alias("flow_7d"), "inflow_days", "flow_days")
