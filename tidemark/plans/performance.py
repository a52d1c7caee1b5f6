"""The full report of a backtest in one row per run, and what a portfolio is worth on every day with its measures so far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.frames import bars_multi, fills, rounded
from ..tables import written
from .backtest import DIP_SQL, RETURNS_SQL, RISK_FREE, YEAR_DAYS, _curve_sql, drawdown_episodes, run_irr, vectorized
from .backtest import metrics as run_metrics
from .portfolio import HELD, positions

DEEP = 0.20  # falls from here on are asked how long they took to recover
LEAST_RATE, MOST_RATE = -0.9999, 10.0  # yearly rates are looked for between these


def yearly_returns(curve: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Per run and calendar year the growth of the value since the end of the last year (of the first: since its first value); years that begin from nothing have none."""
    y = curve.groupBy(*keys, F.year("time").alias("year")).agg(F.min_by("value", "time").alias("_first"), F.max_by("value", "time").alias("_last"))
    before = F.lag("_last").over(Window.partitionBy(*keys).orderBy("year"))
    base = F.when(before > 0, before).otherwise(F.col("_first"))
    return y.select(*keys, "year", F.when(base > 0, F.col("_last") / base - 1).alias("ret")).filter("ret IS NOT NULL")


def report(curve: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """All measures of a run in a row: those of metrics(), the money-weighted yearly rate and the Calmar ratio by it, the longest fall in days, how long each deep fall took to
    recover (NULL if it has not), the years' returns with the best and the worst, coins and mean cost at the end. The curve is written down once and read by four aggregations."""
    c = written(curve, "curve")
    keep = list(keys)
    falls = drawdown_episodes(c, keys).groupBy(*keep).agg(
        F.max("duration_days").alias("max_drawdown_days"),
        F.array_sort(F.collect_list(F.when(F.round("depth", 9) >= DEEP, F.struct("peak_date", "recovery_days")))).alias("_deep"))  # deep falls follow one another, a run has few
    years = yearly_returns(c, keys).groupBy(*keep).agg(
        F.array_sort(F.collect_list(F.struct("year", "ret"))).alias("yearly"), F.max_by(F.struct("year", "ret"), F.struct("ret", -F.col("year"))).alias("best"), F.min_by(F.struct("year", "ret"), F.struct("ret", "year")).alias("worst"))
    end = c.groupBy(*keep).agg(F.max_by("btc", "time").alias("final_coins"), F.max_by("avg_cost", F.when(F.col("avg_cost") > 0, F.col("time"))).alias("avg_cost"))
    m = run_metrics(c, keys).withColumnRenamed("calmar", "_calmar")
    for part in (run_irr(c, keys), falls, years, end):
        m = m.join(part, keep, "left")
    calmar = F.when(F.col("max_drawdown") > 0, F.col("irr") / F.col("max_drawdown"))
    return m.withColumns({"calmar": calmar, "max_drawdown_days": F.coalesce("max_drawdown_days", F.lit(0)), "recovery_days": F.transform("_deep", lambda e: e["recovery_days"])}).drop("_calmar", "_deep")


# Halving the bracket of the rate, in SQL: dated flows per run as lists, then 90 halvings.
_RATE = """ends AS (SELECT symbol, max(time) AS t1 FROM curve GROUP BY 1), flows AS (SELECT c.symbol, c.time, CASE WHEN c.time = t1 THEN value ELSE 0 END - amount AS f FROM curve c JOIN ends USING (symbol) WHERE amount > 0 OR c.time = t1),
  dated AS (SELECT symbol, f, date_diff('day', min(time) OVER (PARTITION BY symbol), time) / 365.0 AS y FROM flows), fl AS (SELECT symbol, list({'f': f, 'y': y}) AS l, min(f) < 0 AND max(f) > 0 AS ok FROM dated GROUP BY 1),
  halved AS (SELECT symbol, l, CAST(-0.9999 AS DOUBLE) AS lo, CAST(10 AS DOUBLE) AS hi, 0 AS k FROM fl WHERE ok
   UNION ALL SELECT symbol, l, CASE WHEN v > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN v > 0 THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM (SELECT *, list_sum(list_transform(l, lambda x: x.f / pow(1 + (lo + hi) / 2, x.y))) AS v FROM halved WHERE k < 90)),
  rates AS (SELECT fl.symbol, (lo + hi) / 2 AS irr FROM fl LEFT JOIN halved ON halved.symbol = fl.symbol AND k = 90)"""


@query("backtest_irr", f"WITH RECURSIVE {_curve_sql()}, {_RATE} SELECT symbol, round(irr, 6) AS irr FROM rates")
def q_irr(spark, sf_dir):
    """The money-weighted yearly return of each run."""
    return rounded(run_irr(vectorized(bars_multi(spark, sf_dir))), 6)


@query("backtest_report", f"""WITH RECURSIVE {_curve_sql(DIP_SQL)}, {RETURNS_SQL}, {_RATE}, m AS (SELECT symbol, arg_max(value, time) AS final_value, max(invested) AS total_invested, sum(fee) AS fees, CAST(sum(CASE WHEN qty > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_trades,
   CAST(date_diff('day', min(time), max(time)) AS INT) AS days, max(drawdown) AS mdd, (avg(ret) - 0.02/365) / stddev_samp(ret) AS sh, (avg(ret) - 0.02/365) / sqrt(avg(pow(least(ret - 0.02/365, 0), 2))) AS so, exp(sum(CASE WHEN ret > -1 THEN ln(1 + ret) END)) AS growth,
   arg_max(btc, time) AS final_coins, arg_max(invested / btc, time) FILTER (WHERE btc > 0) AS avg_cost FROM r GROUP BY symbol),
  t AS (SELECT symbol, time, value, coalesce(value >= max(value) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS top FROM curve), e AS (SELECT *, sum(CASE WHEN top THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY time) AS ep FROM t),
  g AS (SELECT symbol, ep, min(time) AS peak_date, max(value) AS peak, arg_min(time, (value, time)) FILTER (WHERE NOT top) AS low_date, min(value) FILTER (WHERE NOT top) AS low, count(*) AS n FROM e GROUP BY 1, 2), n AS (SELECT *, lead(peak_date) OVER (PARTITION BY symbol ORDER BY ep) AS back FROM g),
  d AS (SELECT symbol, max(date_diff('day', peak_date, coalesce(back, t1))) AS longest, string_agg(coalesce(CAST(date_diff('day', low_date, back) AS VARCHAR), 'open'), ',' ORDER BY peak_date) FILTER (WHERE round(1 - low / peak, 9) >= 0.2) AS recovery FROM n JOIN ends USING (symbol) WHERE n.n > 1 GROUP BY 1),
  y0 AS (SELECT symbol, year(time) AS year, arg_min(value, time) AS f, arg_max(value, time) AS l FROM curve GROUP BY 1, 2), y1 AS (SELECT *, lag(l) OVER (PARTITION BY symbol ORDER BY year) AS b FROM y0),
  y2 AS (SELECT symbol, year, l / CASE WHEN b > 0 THEN b ELSE f END - 1 AS ret FROM y1 WHERE coalesce(b, 0) > 0 OR f > 0),
  y AS (SELECT symbol, count(*) AS n_years, CAST(arg_max(year, (ret, -year)) AS INT) AS best_year, max(ret) AS best, CAST(arg_min(year, (ret, year)) AS INT) AS worst_year, min(ret) AS worst, string_agg(year || ':' || CAST(CAST(round(ret * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY year) AS yearly FROM y2 GROUP BY 1)
  SELECT symbol, round(final_value, 4) AS final_value, round(total_invested, 4) AS total_invested, round(fees, 4) AS fees, n_trades, days, round(mdd, 6) AS max_drawdown, round(final_value / total_invested - 1, 6) AS total_return, round(sh * sqrt(365), 6) AS sharpe, round(so * sqrt(365), 6) AS sortino,
    round(pow(growth, 365.0 / days) - 1, 6) AS twrr, round(irr, 6) AS irr, round(irr / mdd, 6) AS calmar, CAST(longest AS INT) AS max_drawdown_days, coalesce(recovery, '') AS recovery_days, yearly, best_year, round(best, 6) AS best_return, worst_year, round(worst, 6) AS worst_return, round(final_coins, 8) AS final_coins, round(avg_cost, 4) AS avg_cost
  FROM m JOIN rates USING (symbol) JOIN d USING (symbol) JOIN y USING (symbol)""")
def q_report(spark, sf_dir):
    """Every measure of five runs that buy more in falls."""
    r = report(vectorized(bars_multi(spark, sf_dir), "dip_buy"))
    yearly = F.array_join(F.transform("yearly", lambda y: F.concat(y["year"].cast("string"), F.lit(":"), F.round(y["ret"] * 100).cast("long").cast("string"))), ",")
    recovery = F.array_join(F.transform("recovery_days", lambda d: F.coalesce(d.cast("string"), F.lit("open"))), ",")
    out = r.select(
        "symbol", "final_value", "total_invested", "fees", "n_trades", "days", "max_drawdown", "total_return", "sharpe", "sortino", "twrr", "irr", "calmar", "max_drawdown_days", recovery.alias("recovery_days"), yearly.alias("yearly"),
        F.col("best.year").alias("best_year"), F.col("best.ret").alias("best_return"), F.col("worst.year").alias("worst_year"), F.col("worst.ret").alias("worst_return"), "final_coins", "avg_cost")
    return rounded(out, 6, final_value=4, total_invested=4, fees=4, final_coins=8, avg_cost=4)


def one_payment_rate(value: Column, paid: Column, days: Column) -> Column:
    """The yearly rate that turns one payment into value after so many days; NULL where there is none within LEAST_RATE and MOST_RATE."""
    rate = F.when((value > 0) & (paid > 0) & (days > 0), F.pow(value / paid, YEAR_DAYS / days) - 1)
    return F.when((rate > LEAST_RATE) & (rate < MOST_RATE), rate)


def daily_snapshots(transactions: DataFrame, prices: DataFrame, cash: float = 0.0) -> DataFrame:
    """Per user and day (invested: what was paid in less what was taken out, not below nothing), from the user's first transaction to the last day of prices (day, price; a day without one has the last before it): what is held and worth, and the
    measures of the user's snapshots so far: returns of the day and in all, yearly rate (all money in it now taken as paid on the first day), volatility of the last 30 returns, Sharpe ratio, falls."""
    last = F.struct("time", "event_id")
    upto_tx = Window.partitionBy("user_id").orderBy("time", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    buy = F.col("side") == "BUY"
    p = positions(transactions).withColumns({"_paid": F.greatest(F.lit(0.0), F.round(F.sum(F.when(buy, F.col("_amount") + F.col("_fee")).otherwise(F.col("_fee") - F.col("_amount"))).over(upto_tx), 8)), "_gain": F.sum("realized").over(upto_tx)})
    state = F.struct("coins", (F.col("coins") * F.col("avg_cost")).alias("cost"), F.col("_paid").alias("invested"), F.col("_gain").alias("realized"))
    ends = p.groupBy("user_id", F.to_date("time").alias("day")).agg(F.max_by(state, last).alias("_state"))
    # Prices are one row per day; of them the last day is one row, so that join is a broadcast of one row.
    prices = prices.select("day", "price")
    until = prices.agg(F.max("day").alias("_until"))
    begun = ends.groupBy("user_id").agg(F.min("day").alias("_begin")).join(F.broadcast(until))
    calendar = begun.select("user_id", F.explode(F.sequence("_begin", "_until")).alias("day"))
    w = Window.partitionBy("user_id").orderBy("day")
    upto, month = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(-29, 0)
    s = calendar.join(ends, ["user_id", "day"], "left").join(prices, "day", "left")
    s = s.withColumns({"_state": F.last("_state", ignorenulls=True).over(upto), "price": F.last("price", ignorenulls=True).over(upto)}).select("user_id", "day", "price", "_state.*")
    s = s.withColumn("value", F.col("coins") * F.col("price") + cash)
    before = F.lag("value").over(w)
    s = s.withColumns({"daily_return": F.when(before > 0, F.col("value") / before - 1), "drawdown": F.coalesce(1 - F.try_divide(F.col("value"), F.max("value").over(upto)), F.lit(0.0)), "_days": F.datediff("day", F.min("day").over(upto))})
    spread, deviation = F.stddev_samp("daily_return").over(month), F.stddev_samp("daily_return").over(upto)
    sharpe = F.when((F.count("daily_return").over(upto) >= 2) & (deviation >= 1e-15), (F.avg("daily_return").over(upto) - RISK_FREE / YEAR_DAYS) / deviation * F.sqrt(F.lit(YEAR_DAYS)))
    return s.select(
        "user_id", "day", "price", "coins", "cost", "invested", "realized", "value", (F.col("value") - cash - F.col("cost")).alias("unrealized"), "daily_return", F.when(F.col("invested") > 0, F.col("value") / F.col("invested") - 1).alias("cumulative_return"),
        one_payment_rate(F.col("value"), F.col("invested"), F.col("_days")).alias("annualized_return"), F.max("drawdown").over(upto).alias("max_drawdown"), "drawdown",
        F.when(F.count("daily_return").over(month) >= 2, spread * F.sqrt(F.lit(YEAR_DAYS))).alias("volatility_30d"), sharpe.alias("sharpe"))


@query("portfolio_daily_snapshots", f"""WITH {HELD}, px AS (SELECT CAST(time AS DATE) AS day, CAST(arg_max(price, (time, event_id)) AS DOUBLE) AS price FROM fills GROUP BY 1), st AS (SELECT h.*, CAST(o.time AS DATE) AS day FROM h JOIN o ON h.user_id = o.user_id AND h.k = o.k),
  en AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY k DESC) = 1), cal AS (SELECT user_id, CAST(unnest(generate_series(min(day), (SELECT max(day) FROM px), INTERVAL 1 DAY)) AS DATE) AS day FROM en GROUP BY 1),
  s0 AS (SELECT cal.user_id, cal.day, en.coins, en.cost, greatest(0, round(en.bought - en.sold, 8)) AS bought, en.pnl, px.price FROM cal ASOF JOIN en ON cal.user_id = en.user_id AND cal.day >= en.day ASOF JOIN px ON cal.day >= px.day), s1 AS (SELECT *, CASE WHEN coins < 5e-9 THEN 0 ELSE coins END * price AS value FROM s0),
  s2 AS (SELECT *, CASE WHEN lag(value) OVER w > 0 THEN value / lag(value) OVER w - 1 END AS ret, coalesce(1 - value / nullif(max(value) OVER w, 0), 0) AS dd, date_diff('day', min(day) OVER w, day) AS d FROM s1 WINDOW w AS (PARTITION BY user_id ORDER BY day)),
  s3 AS (SELECT *, CASE WHEN value > 0 AND bought > 0 AND d > 0 THEN CASE WHEN 365.0 / d * ln(value / bought) < 50 THEN pow(value / bought, 365.0 / d) - 1 END END AS rate, stddev_samp(ret) OVER w AS sd, avg(ret) OVER w AS mean, count(ret) OVER w AS n, max(dd) OVER w AS mdd, stddev_samp(ret) OVER m AS sd30, count(ret) OVER m AS n30
    FROM s2 WINDOW w AS (PARTITION BY user_id ORDER BY day), m AS (PARTITION BY user_id ORDER BY day ROWS 29 PRECEDING))
  SELECT user_id, day, round(value, 3) AS value, round(bought, 6) AS invested, round(pnl, 3) + 0.0 AS realized, round(value - cost, 3) + 0.0 AS unrealized, round(ret, 5) + 0.0 AS daily_return, round(value / nullif(bought, 0) - 1, 6) + 0.0 AS cumulative_return,
    round(CASE WHEN rate > -0.9999 AND rate < 10 THEN rate END, 4) + 0.0 AS annualized_return, round(mdd, 6) AS max_drawdown, round(dd, 6) + 0.0 AS drawdown, round(CASE WHEN n30 >= 2 THEN sd30 * sqrt(365) END, 4) AS volatility_30d, round(CASE WHEN n >= 2 AND sd >= 1e-15 THEN (mean - 0.02 / 365) / sd * sqrt(365) END, 4) + 0.0 AS sharpe FROM s3""")
def q_snapshots(spark, sf_dir):
    """What every user's coins are worth on every day, with the measures so far."""
    t = fills(spark, sf_dir)
    prices = t.groupBy(F.to_date("time").alias("day")).agg(F.max_by("price", F.struct("time", "event_id")).cast("double").alias("price"))
    s = daily_snapshots(t, prices)
    digits = {"value": 3, "invested": 6, "realized": 3, "unrealized": 3, "daily_return": 5, "cumulative_return": 6, "annualized_return": 4, "max_drawdown": 6, "drawdown": 6, "volatility_30d": 4, "sharpe": 4}
    return s.select("user_id", "day", *[(F.round(c, d) + 0.0).alias(c) for c, d in digits.items()])
