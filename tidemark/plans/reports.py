"""Reports of portfolios and trades: trade statistics, performance, daily risk measures, option and futures analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import interpolated
from ..functions.scalars import option_parts
from ..registry import query
from ..sources.frames import MULTI, bars_multi, fills, rounded, table
from .portfolio import HELD, positions

YEAR_DAYS, RISK_FREE = 365.0, 0.02


def trade_statistics(closed: DataFrame, keys: list[str], pnl: str = "pnl", fee: str = "fee") -> DataFrame:
    """Per key: trades, win rate, profit factor (infinite without a loss, NULL without a gain), mean result and fees."""
    p = F.col(pnl)
    gain, loss = F.sum(F.when(p > 0, p).otherwise(0.0)), -F.sum(F.when(p < 0, p).otherwise(0.0))
    factor = F.when(loss > 1e-12, gain / loss).when(gain > 0, float("inf"))
    return closed.groupBy(*keys).agg(F.count(pnl).alias("n_trades"), F.avg(F.when(p.isNotNull(), F.when(p > 0, 1.0).otherwise(0.0))).alias("win_rate"), factor.alias("profit_factor"), F.avg(pnl).alias("avg_trade_pnl"), F.sum(fee).cast("double").alias("fees"))


@query("portfolio_trade_statistics", f"""WITH {HELD}, s AS (
  SELECT o.user_id, o.k, o.side, o.f, h.pnl - b.pnl AS pnl FROM o JOIN h ON h.user_id = o.user_id AND h.k = o.k JOIN h b ON b.user_id = o.user_id AND b.k = o.k - 1 WHERE o.side = 'SELL')
  SELECT user_id, count(*) AS n_trades, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(CASE WHEN -sum(least(pnl, 0)) > 1e-12 THEN sum(greatest(pnl, 0)) / -sum(least(pnl, 0)) WHEN sum(greatest(pnl, 0)) > 0 THEN 'Infinity'::DOUBLE END, 4) AS profit_factor,
    round(avg(pnl), 4) + 0.0 AS avg_trade_pnl, round(sum(f), 6) AS fees FROM s GROUP BY 1""")
def q_trade_statistics(spark, sf_dir):
    """Of every user's sales, each against the average cost before it."""
    sales = positions(fills(spark, sf_dir)).filter("side = 'SELL'").select("user_id", F.col("realized").alias("pnl"), F.col("fee").cast("double").alias("fee"))
    return rounded(trade_statistics(sales, ["user_id"]), 4, win_rate=6, fees=6).withColumn("avg_trade_pnl", F.col("avg_trade_pnl") + 0.0)


def performance(transactions: DataFrame) -> DataFrame:
    """Per user: value at the last price, unrealized and realized result, their share of what was bought, and the deepest fall of value."""
    w = Window.partitionBy("user_id").orderBy("time", "event_id")
    p = positions(transactions).withColumn("value", F.col("coins") * F.col("_price"))
    p = p.withColumn("fall", 1 - F.try_divide(F.col("value"), F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    last, buy = F.struct("time", "event_id"), F.col("side") == "BUY"
    out = p.groupBy("user_id").agg(
        F.max_by("value", last).alias("value"), F.max_by(F.col("coins") * F.col("avg_cost"), last).alias("_cost"), F.sum("realized").alias("realized"), F.sum(F.when(buy, F.col("_amount") + F.col("_fee")).otherwise(0.0)).alias("_bought"), F.max("fall").alias("max_drawdown"))
    out = out.withColumn("unrealized", F.col("value") - F.col("_cost"))
    return out.withColumn("pnl_percent", F.try_divide(F.col("unrealized") + F.col("realized"), F.col("_bought")) * 100).drop("_cost", "_bought")


@query("portfolio_performance", f"""WITH {HELD}, v AS (SELECT h.*, h.coins * CAST(o.price AS DOUBLE) AS value FROM h JOIN o ON h.user_id = o.user_id AND h.k = o.k), f AS (SELECT *, CASE WHEN max(value) OVER w > 0 THEN 1 - value / max(value) OVER w END AS fall FROM v WINDOW w AS (PARTITION BY user_id ORDER BY k)),
  m AS (SELECT user_id, max(fall) AS max_drawdown FROM f GROUP BY 1)
  SELECT user_id, round(value, 3) AS value, round(value - cost, 3) + 0.0 AS unrealized, round(pnl, 3) + 0.0 AS realized, round((value - cost + pnl) / nullif(bought, 0) * 100, 5) + 0.0 AS pnl_percent, round(max_drawdown, 6) AS max_drawdown FROM v JOIN m USING (user_id)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""")
def q_performance(spark, sf_dir):
    p = performance(fills(spark, sf_dir))
    return p.select("user_id", F.round("value", 3).alias("value"), *[(F.round(c, d) + 0.0).alias(c) for c, d in (("unrealized", 3), ("realized", 3), ("pnl_percent", 5))], F.round("max_drawdown", 6).alias("max_drawdown"))


def daily_measures(curve: DataFrame) -> DataFrame:
    """Per day of a value curve (symbol, time, value): yearly volatility of the last 30 returns, Sharpe ratio of all returns so far, deepest fall so far."""
    w = Window.partitionBy("symbol").orderBy("time")
    upto, last = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(-29, 0)
    r = curve.withColumn("ret", F.try_divide("value", F.lag("value").over(w)) - 1).withColumn("fall", 1 - F.try_divide("value", F.max("value").over(upto)))
    sharpe = F.when(F.count("ret").over(upto) >= 2, F.try_divide(F.avg("ret").over(upto) - RISK_FREE / YEAR_DAYS, F.stddev_samp("ret").over(upto)) * F.sqrt(F.lit(YEAR_DAYS)))
    return r.select("symbol", "time", F.when(F.count("ret").over(last) >= 30, F.stddev_samp("ret").over(last) * F.sqrt(F.lit(YEAR_DAYS))).alias("volatility"), sharpe.alias("sharpe"), F.max("fall").over(upto).alias("max_drawdown"))


@query("portfolio_daily_measures", f"""WITH {MULTI}, r AS (SELECT symbol, time, close / lag(close) OVER w - 1 AS ret, 1 - close / max(close) OVER w AS fall FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time))
  SELECT symbol, time, round(CASE WHEN count(ret) OVER (w ROWS 29 PRECEDING) >= 30 THEN stddev_samp(ret) OVER (w ROWS 29 PRECEDING) * sqrt(365) END, 5) AS volatility, round(CASE WHEN count(ret) OVER w >= 2 THEN (avg(ret) OVER w - 0.02 / 365) / stddev_samp(ret) OVER w * sqrt(365) END, 5) AS sharpe,
   round(max(fall) OVER w, 6) AS max_drawdown FROM r WINDOW w AS (PARTITION BY symbol ORDER BY time)""")
def q_daily(spark, sf_dir):
    return rounded(daily_measures(bars_multi(spark, sf_dir).select("symbol", "time", F.col("close").alias("value"))), 5, max_drawdown=6)


def contracts(quotes: DataFrame) -> DataFrame:
    """One row per contract from all its quotes: open interest and volume summed, volatility and delta as means, gamma weighted by open interest."""
    return quotes.groupBy("underlying", "kind", "strike", "expiry").agg(
        F.sum("open_interest").alias("open_interest"), F.sum("volume").alias("volume"), F.avg("iv").alias("iv"), F.avg("delta").alias("delta"),
        F.try_divide(F.sum(F.col("gamma") * F.col("open_interest")), F.sum("open_interest")).alias("gamma"), F.max("spot").alias("spot"))


def option_analytics(options: DataFrame) -> DataFrame:
    """options (kind C or P, strike, expiry, open_interest, volume, iv, delta, gamma, spot), per underlying: open interest and volume, put/call ratio,
    at-the-money volatility (mean of the two nearest strikes of the nearest expiry), 25-delta skew there, gamma exposure and number of expiries."""
    o = options.withColumn("_first", F.min("expiry").over(Window.partitionBy("underlying")))
    near = F.col("expiry") == F.col("_first")
    o = o.withColumn("_near", F.when(near, F.row_number().over(Window.partitionBy("underlying", near).orderBy(F.abs(F.col("strike") - F.col("spot")), "strike", "kind"))))
    side = lambda k, c: F.sum(F.when(F.col("kind") == k, F.col(c)).otherwise(0.0))
    # Strikes of one expiry are few, so its curve of volatility over delta is an array.
    curve = lambda k: F.collect_list(F.when(near & (F.col("kind") == k), F.struct(F.abs("delta").alias("d"), F.col("iv"))))
    exposure = F.when(F.col("kind") == "C", 1).otherwise(-1) * F.col("gamma") * F.col("open_interest") * F.col("spot") * F.col("spot") * 0.01
    m = o.groupBy("underlying").agg(
        F.sum("open_interest").alias("open_interest"), F.sum("volume").alias("volume"), F.try_divide(side("P", "open_interest"), side("C", "open_interest")).alias("put_call_ratio"), F.avg(F.when(F.col("_near") <= 2, F.col("iv"))).alias("atm_iv"),
        curve("P").alias("_p"), curve("C").alias("_c"), F.sum(exposure).alias("gamma_exposure"), F.count_distinct("expiry").alias("expiries"))
    at = F.lit(0.25)
    return m.withColumn("skew_25", interpolated(F.col("_p"), at, "d", "iv") - interpolated(F.col("_c"), at, "d", "iv")).drop("_p", "_c")


OPTIONS = """quotes AS (SELECT 'BTC' AS underlying, CASE WHEN (p_partkey // 4) % 2 = 0 THEN 'C' ELSE 'P' END AS kind, 50000.0 + (p_partkey % 41) * 2500 AS strike, make_timestamp(2025, CAST(3 * (p_partkey % 4) + 3 AS BIGINT), 27, 8, 0, 0.0) AS expiry, p_retailprice AS oi, p_size AS volume,
  0.4 + (p_partkey % 41) * 0.01 + CASE WHEN (p_partkey // 4) % 2 = 0 THEN 0 ELSE 0.03 END AS iv, ((p_partkey % 41) + 1) / 42.0 AS delta, 1e-6 * (1 + p_partkey % 7) AS gamma, 100000.0 AS spot FROM part),
  opts AS (SELECT underlying, kind, strike, expiry, sum(oi) AS oi, sum(volume) AS volume, avg(iv) AS iv, avg(delta) AS delta, sum(gamma * oi) / sum(oi) AS gamma, max(spot) AS spot FROM quotes GROUP BY 1, 2, 3, 4)"""


@query("option_analytics", f"""WITH {OPTIONS}, n AS (SELECT *, row_number() OVER (ORDER BY abs(strike - spot), strike, kind) AS r FROM opts WHERE expiry = (SELECT min(expiry) FROM opts)), k AS (SELECT kind, delta, any_value(iv) AS iv FROM n GROUP BY 1, 2),
  lo AS (SELECT kind, max(delta) AS d, arg_max(iv, delta) AS v FROM k WHERE delta <= 0.25 GROUP BY 1), hi AS (SELECT kind, min(delta) AS d, arg_min(iv, delta) AS v FROM k WHERE delta >= 0.25 GROUP BY 1), i AS (SELECT lo.kind, lo.v + CASE WHEN hi.d = lo.d THEN 0 ELSE (0.25 - lo.d) * (hi.v - lo.v) / (hi.d - lo.d) END AS v FROM lo JOIN hi USING (kind))
  SELECT underlying, round(sum(oi), 3) AS open_interest, CAST(sum(volume) AS BIGINT) AS volume, round(sum(CASE WHEN kind = 'P' THEN oi ELSE 0 END) / sum(CASE WHEN kind = 'C' THEN oi ELSE 0 END), 6) AS put_call_ratio, round((SELECT avg(iv) FROM n WHERE r <= 2), 6) AS atm_iv,
    round((SELECT v FROM i WHERE kind = 'P') - (SELECT v FROM i WHERE kind = 'C'), 6) AS skew_25, round(sum(CASE WHEN kind = 'C' THEN 1 ELSE -1 END * gamma * oi * spot * spot * 0.01), 3) AS gamma_exposure, count(DISTINCT expiry) AS expiries FROM opts GROUP BY 1""")
def q_options(spark, sf_dir):
    """Names such as BTC-27JUN25-100000-C are taken apart; sizes and volatilities are stand-ins from the parts table."""
    k = F.col("p_partkey")
    months = F.element_at(F.array(*[F.lit(m) for m in ("27MAR25", "27JUN25", "27SEP25", "27DEC25")]), (k % 4 + 1).cast("int"))
    name = F.concat(F.lit("BTC-"), months, F.lit("-"), (50000 + (k % 41) * 2500).cast("string"), F.when(F.floor(k / 4) % 2 == 0, "-C").otherwise("-P"))
    p = table(spark, sf_dir, "part").withColumn("name", name)
    o = p.select(*[c.alias(n) for n, c in option_parts(F.col("name")).items()], F.col("p_retailprice").alias("open_interest"), F.col("p_size").cast("long").alias("volume"), (0.4 + (k % 41) * 0.01 + F.when(F.floor(k / 4) % 2 == 0, 0.0).otherwise(0.03)).alias("iv"), (((k % 41) + 1) / 42.0).alias("delta"),
                 (1e-6 * (1 + k % 7)).alias("gamma"), F.lit(100000.0).alias("spot"))
    return rounded(option_analytics(contracts(o)).select("underlying", "open_interest", "volume", "put_call_ratio", "atm_iv", "skew_25", "gamma_exposure", "expiries"), 6, open_interest=3, gamma_exposure=3)


@query("futures_analytics", """WITH e AS (SELECT date_trunc('day', ts) AS day, sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS longs, sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) AS shorts, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS buys, sum(value) AS total, arg_max(value, (ts, event_id)) AS mark, arg_min(value, (ts, event_id)) AS spot FROM events GROUP BY 1)
  SELECT day, round(longs, 4) AS liquidated_long, round(shorts, 4) AS liquidated_short, round(longs / nullif(shorts, 0), 6) AS long_short, round((mark - spot) / spot * 100, 5) AS premium, round(mark - spot, 5) AS basis, round(buys / nullif(total - buys, 0), 6) AS taker_ratio,
    round(sum(2 * buys - total) OVER (ORDER BY day ROWS 6 PRECEDING), 3) AS cvd_7 FROM e""")
def q_futures(spark, sf_dir):
    """Sides of liquidations, their ratio, premium and basis, taker ratio, and the volume delta of seven days. Days are few, so that window has no key."""
    at, side = F.struct("ts", "event_id"), lambda t: F.sum(F.when(F.col("event_type") == t, F.col("value")).otherwise(0.0))
    e = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(side("purchase").alias("longs"), side("view").alias("shorts"), side("click").alias("buys"), F.sum("value").alias("total"), F.max_by("value", at).alias("mark"), F.min_by("value", at).alias("spot"))
    return e.select(
        "day", F.round("longs", 4).alias("liquidated_long"), F.round("shorts", 4).alias("liquidated_short"), F.round(F.try_divide("longs", "shorts"), 6).alias("long_short"), F.round((F.col("mark") - F.col("spot")) / F.col("spot") * 100, 5).alias("premium"),
        F.round(F.col("mark") - F.col("spot"), 5).alias("basis"), F.round(F.try_divide(F.col("buys"), F.col("total") - F.col("buys")), 6).alias("taker_ratio"), F.round(F.sum(2 * F.col("buys") - F.col("total")).over(Window.orderBy("day").rowsBetween(-6, 0)), 3).alias("cvd_7"))


