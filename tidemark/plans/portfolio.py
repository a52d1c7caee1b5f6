"""Portfolios: holdings by moving average cost, running totals, plan simulation, and the rule engine of investment plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import first_at_most
from ..functions.scans import LIMIT, affine
from ..registry import query
from ..sources.frames import FILLS, MULTI, bars_multi, fills, rounded
from .alerts import compiled
from .backtest import SIMULATOR_DIP_STEPS, SIMULATOR_VALUATION_STEPS, is_investment_day, risk_multiplier, valuation_multiplier

def positions(transactions: DataFrame) -> DataFrame:
    """Per transaction: coins held and average cost after it, coins sold by it, and what it realized. All by running sums.

    Coins never go below zero: they are the running sum of what comes and goes, lifted by the deepest point it reached below zero.
    Between two times at which nothing is held, every sale leaves a share of coins and of cost, and every purchase adds its own: the
    cost is a scan of affine maps, cut where the shares left multiply to less than a number can hold.
    """
    w = Window.partitionBy("user_id").orderBy("time", "event_id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    buy = F.col("side") == "BUY"
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    t = transactions.withColumns({"_amount": number("amount"), "_fee": number("fee"), "_price": number("price")})
    t = t.withColumn("_qty", F.when(F.col("_price") > 0, F.col("_amount") / F.col("_price")).otherwise(0.0))
    t = t.withColumn("_net", F.sum(F.when(buy, F.col("_qty")).otherwise(-F.col("_qty"))).over(upto))
    left = F.col("_net") - F.least(F.lit(0.0), F.min("_net").over(upto))
    t = t.withColumn("coins", F.when(left < 5e-9, 0.0).otherwise(left)).withColumn("_before", F.coalesce(F.lag("coins").over(w), F.lit(0.0)))
    t = t.withColumn("sold", F.when(buy, 0.0).otherwise(F.col("_before") - F.col("coins")))
    t = t.withColumn("_run", F.coalesce(F.sum(F.when(F.col("coins") <= 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    share = F.when(~buy & (F.col("coins") > 0), F.log(F.col("_before") / F.col("coins"))).otherwise(0.0)
    inside = Window.partitionBy("user_id", "_run").orderBy("time", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_sold", share).withColumn("_stretch", F.floor(F.sum("_sold").over(inside) / LIMIT))
    t = affine(t, {"_cost": (F.col("_sold"), F.when(buy, F.col("_amount") + F.col("_fee")).otherwise(0.0))}, ("user_id", "_run"), "_stretch", ("time", "event_id"))
    t = t.withColumn("avg_cost", F.when(F.col("coins") > 0, F.col("_cost") / F.col("coins")).otherwise(0.0))
    earlier = F.coalesce(F.lag("avg_cost").over(w), F.lit(0.0))
    return t.withColumn("realized", F.when(buy, 0.0).otherwise(F.col("_amount") - F.col("_fee") - F.col("sold") * earlier))


def holdings(transactions: DataFrame) -> DataFrame:
    """Per user: what is held, at what cost, and what was realized."""
    buy, last = F.col("side") == "BUY", F.struct("time", "event_id")
    return positions(transactions).groupBy("user_id").agg(
        F.count("*").alias("n"), F.max_by("coins", last).alias("coins"), F.max_by("avg_cost", last).alias("avg_cost"), F.max_by(F.col("coins") * F.col("avg_cost"), last).alias("total_cost"), F.sum("realized").alias("realized_pnl"),
        F.sum(F.when(buy, F.col("_amount") + F.col("_fee")).otherwise(0.0)).alias("total_buy"), F.sum(F.when(buy, 0.0).otherwise(F.col("_amount") - F.col("_fee"))).alias("total_sell"), F.sum("_fee").alias("fees"))


def running_totals(transactions: DataFrame) -> DataFrame:
    """Per transaction: coins and money put in so far (sales do not reduce the money)."""
    run = Window.partitionBy("user_id").orderBy("time", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    buy = F.col("side") == "BUY"
    qty = (F.col("amount") / F.col("price")).cast("decimal(20,8)")
    return transactions.select("user_id", "event_id", "time", F.sum(F.when(buy, F.col("amount") + F.col("fee")).otherwise(0)).over(run).alias("invested"),
                               F.sum(F.when(buy, qty).otherwise(-qty)).over(run).alias("net_coins"), F.sum(F.when(buy, 1).otherwise(0)).over(run).alias("n_buys"))


def simulate(bars: DataFrame, strategy: str = "DIP_BUY", amount: float = 100.0, frequency: str = "WEEKLY", day: int = 1, fee: float = 0.001, condition: dict | None = None, factor: float = 2.0) -> DataFrame:
    """A recurring plan bought at the close: symbol, time, spent, coins, held, value. Strategies without feedback are windows;
    CUSTOM multiplies by factor where a compiled condition is true. VALUATION_BUY reads pct_mvrv and nupl, RISK_ADJUSTED risk_level."""
    w = Window.partitionBy("symbol").orderBy("time")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.col("close") / F.max("close").over(run if strategy == "DIP_BUY" else w.rowsBetween(-89, 0)) - 1
    times = {"DIP_BUY": first_at_most(gap, SIMULATOR_DIP_STEPS), "DRAWDOWN_BUY": first_at_most(gap, SIMULATOR_DIP_STEPS), "RISK_ADJUSTED": risk_multiplier(F.col("risk_level")),
             "VALUATION_BUY": valuation_multiplier(F.col("pct_mvrv"), F.col("nupl"), SIMULATOR_VALUATION_STEPS)}.get(strategy, F.lit(1.0))
    if condition:
        times = F.when(F.coalesce(compiled(condition, lambda m: F.col({"price": "close"}.get(m, m)), w), F.lit(False)), factor).otherwise(1.0)
    s = bars.withColumn("spent", F.when(is_investment_day(F.col("time"), frequency, "1995-01-01", day), F.lit(amount) * times).otherwise(0.0))
    s = s.withColumn("coins", F.col("spent") * (1 - fee) / F.col("close")).withColumn("held", F.sum("coins").over(run)).withColumn("invested", F.sum("spent").over(run))
    return s.select("symbol", "time", "spent", "coins", "held", "invested", (F.col("held") * F.col("close")).alias("value"))


def plan_amount(base: float, rules: list[dict], columns=F.col) -> Column:
    """What a plan spends on a row, by the rules that hold there: nothing if one of them is a skip, else the fixed amount of the
    last priority that fixes one, else the base times all multipliers.

    A rule has priority, condition and action (multiply, fix or skip, with value). Of rules of one priority that disagree the
    smaller amount or multiplier stands. Unknown conditions do not hold.
    """
    holds = lambda r: F.coalesce(compiled(r["condition"], columns), F.lit(False))
    of = lambda action: [r for r in rules if r["action"] == action]
    smallest = lambda same: F.least(*v) if len(v := [F.when(holds(r), F.lit(float(r.get("value", 1.0)))) for r in same]) > 1 else v[0]
    by_priority = lambda action: [smallest([r for r in of(action) if r["priority"] == p]) for p in sorted({r["priority"] for r in of(action)})]
    out = F.lit(float(base))
    for factor in by_priority("multiply"):
        out = out * F.coalesce(factor, F.lit(1.0))
    if of("fix"):
        out = F.coalesce(*reversed(by_priority("fix")), out)
    for r in of("skip"):
        out = F.when(holds(r), 0.0).otherwise(out)
    return out


SKIPPING = [
    {"priority": 1, "condition": {"type": "threshold", "metric": "price", "operator": "lt", "value": 150000}, "action": "skip"},
    {"priority": 2, "condition": {"type": "threshold", "metric": "price", "operator": "lt", "value": 200000}, "action": "fix", "value": 25.0},
    {"priority": 3, "condition": {"type": "threshold", "metric": "drawdown_pct", "operator": "lt", "value": -50}, "action": "multiply", "value": 2.0},
    {"priority": 3, "condition": {"type": "threshold", "metric": "drawdown_pct", "operator": "lt", "value": -60}, "action": "multiply", "value": 1.5},
]
PLAN = [
    {"priority": 1, "condition": {"type": "threshold", "metric": "drawdown_pct", "operator": "lt", "value": -50}, "action": "multiply", "value": 2.0},
    {"priority": 2, "condition": {"type": "threshold", "metric": "price", "operator": "gt", "value": 300000}, "action": "multiply", "value": 0.5},
    {"priority": 2, "condition": {"type": "threshold", "metric": "price", "operator": "gt", "value": 350000}, "action": "fix", "value": 10.0},
    {"priority": 3, "condition": {"type": "AND", "children": [{"type": "threshold", "metric": "price", "operator": "lt", "value": 20000}, {"type": "threshold", "metric": "price", "operator": "lt", "value": 0}]}, "action": "skip"},
]


@query("portfolio_running_totals", f"""WITH {FILLS} SELECT user_id, event_id, time, sum(CASE WHEN side = 'BUY' THEN amount + fee ELSE 0 END) OVER w AS invested, CAST(sum(CAST(round(CASE WHEN side = 'BUY' THEN 1 ELSE -1 END * CAST(amount AS DOUBLE) / CAST(price AS DOUBLE), 8) AS DECIMAL(20,8))) OVER w AS DOUBLE) AS net_coins,
  CAST(sum(CASE WHEN side = 'BUY' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n_buys FROM fills WINDOW w AS (PARTITION BY user_id ORDER BY time, event_id)""")
def q_totals(spark, sf_dir):
    return running_totals(fills(spark, sf_dir)).withColumn("net_coins", F.col("net_coins").cast("double"))


@query("portfolio_dca_cost", f"WITH {FILLS} SELECT user_id, sum(amount + fee) AS spent, count(*) AS n, min(time) AS first, max(time) AS last FROM fills WHERE side = 'BUY' GROUP BY 1")
def q_cost(spark, sf_dir):
    return fills(spark, sf_dir).filter("side = 'BUY'").groupBy("user_id").agg(F.sum(F.col("amount") + F.col("fee")).alias("spent"), F.count("*").alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))


HELD = f"""RECURSIVE {FILLS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY time, event_id) AS k, CAST(amount AS DOUBLE) AS a, CAST(fee AS DOUBLE) AS f, CAST(amount AS DOUBLE) / CAST(price AS DOUBLE) AS q FROM fills),
  h AS (SELECT user_id, CAST(0 AS BIGINT) AS k, 0.0::DOUBLE AS coins, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS pnl, 0.0::DOUBLE AS bought, 0.0::DOUBLE AS sold, 0.0::DOUBLE AS fees FROM o GROUP BY user_id
   UNION ALL SELECT o.user_id, o.k, CASE WHEN side = 'BUY' THEN coins + q ELSE coins - least(q, coins) END, CASE WHEN side = 'BUY' THEN cost + a + f WHEN coins - least(q, coins) < 5e-9 THEN 0 ELSE cost * (1 - least(q, coins) / coins) END,
    CASE WHEN side = 'BUY' THEN pnl ELSE pnl + a - f - CASE WHEN coins > 5e-9 THEN least(q, coins) * cost / coins ELSE 0 END END, CASE WHEN side = 'BUY' THEN bought + a + f ELSE bought END, CASE WHEN side = 'BUY' THEN sold ELSE sold + a - f END, h.fees + f
   FROM h JOIN o ON h.user_id = o.user_id AND o.k = h.k + 1)"""


@query("portfolio_holdings", f"""WITH {HELD} SELECT user_id, k AS n, round(coins, 6) AS coins, round(CASE WHEN coins > 5e-9 THEN cost / coins ELSE 0 END, 3) AS avg_cost, round(cost, 3) AS total_cost, round(pnl, 3) + 0.0 AS realized_pnl, round(bought, 6) AS total_buy, round(sold, 6) AS total_sell,
  round(fees, 6) AS fees FROM h WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""")
def q_holdings(spark, sf_dir):
    h = rounded(holdings(fills(spark, sf_dir)), 3, coins=6, total_buy=6, total_sell=6, fees=6)
    return h.withColumn("realized_pnl", F.col("realized_pnl") + 0.0)


SIMULATED = f"""{MULTI}, s AS (SELECT *, CASE WHEN isodow(time) = 1 THEN 100.0 * CASE WHEN close / max(close) OVER w - 1 <= -0.4 THEN 2.5 WHEN close / max(close) OVER w - 1 <= -0.3 THEN 2.0 WHEN close / max(close) OVER w - 1 <= -0.2 THEN 1.5
    WHEN close / max(close) OVER w - 1 <= -0.1 THEN 1.2 ELSE 1.0 END ELSE 0.0 END AS spent FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time)), c AS (SELECT *, spent * 0.999 / close AS coins FROM s)"""


@query("portfolio_simulation", f"WITH {SIMULATED} SELECT symbol, time, CAST(spent AS DOUBLE) AS spent, round(sum(coins) OVER w, 8) AS held, round(sum(CAST(spent AS DOUBLE)) OVER w, 4) AS invested, round(sum(coins) OVER w * close, 4) AS value FROM c WINDOW w AS (PARTITION BY symbol ORDER BY time)")
def q_simulation(spark, sf_dir):
    return rounded(simulate(bars_multi(spark, sf_dir)).select("symbol", "time", "spent", "held", "invested", "value"), 4, held=8)


@query("portfolio_plan_rules", f"""WITH {MULTI}, m AS (SELECT symbol, time, close AS price, (close / max(close) OVER w - 1) * 100 AS drawdown_pct FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time)), a AS (SELECT *, CASE WHEN drawdown_pct < -50 THEN 200.0 ELSE 100.0 END AS x FROM m)
  SELECT symbol, time, CAST(CASE WHEN price > 350000 THEN least(x * 0.5, 10) WHEN price > 300000 THEN x * 0.5 ELSE x END AS DOUBLE) AS amount FROM a""")
def q_plan(spark, sf_dir):
    from .alerts import metrics_frame

    return metrics_frame(bars_multi(spark, sf_dir)).select("symbol", "time", plan_amount(100.0, PLAN).alias("amount"))


@query("portfolio_plan_skips", f"""WITH {MULTI}, m AS (SELECT symbol, time, close AS price, (close / max(close) OVER w - 1) * 100 AS d FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time))
  SELECT symbol, time, CAST(CASE WHEN price < 150000 THEN 0 WHEN price < 200000 THEN 25 WHEN d < -60 THEN 150 WHEN d < -50 THEN 200 ELSE 100 END AS DOUBLE) AS amount FROM m""")
def q_skips(spark, sf_dir):
    """A skip stands whatever later rules say, and a fixed amount whatever is multiplied."""
    from .alerts import metrics_frame

    return metrics_frame(bars_multi(spark, sf_dir)).select("symbol", "time", plan_amount(100.0, SKIPPING).alias("amount"))


@query("portfolio_snapshots", f"""WITH {FILLS} SELECT user_id, CAST(time AS DATE) AS day, sum(CASE WHEN side = 'BUY' THEN amount ELSE -amount END) AS net, arg_max(price, (time, event_id)) AS last_price FROM fills GROUP BY 1, 2""")
def q_snapshots(spark, sf_dir):
    """One row per user and day, so a day's partition can be overwritten on its own."""
    signed = F.when(F.col("side") == "BUY", F.col("amount")).otherwise(-F.col("amount"))
    return fills(spark, sf_dir).groupBy("user_id", F.to_date("time").alias("day")).agg(F.sum(signed).alias("net"), F.max_by("price", F.struct("time", "event_id")).alias("last_price"))
