"""Recurring-investment backtests: schedules, multipliers, the vectorized engine, equity curves and their metrics.

The vectorized engine has no loop: signals, fills and positions are window expressions, grouped by run, so a thousand parameter
sets are a thousand groups of one plan. The event engine folds bar by bar in decimals, one run a group.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import first_at_most, two_sided
from ..functions.scans import ROWS, numbered, running
from ..registry import query
from ..sources.frames import DAILY, MULTI, bars_daily, bars_multi, rounded
from ..tables import written

#: Drawdown thresholds and multipliers (fixed values): of the backtest, and of the portfolio simulator.
DIP_STEPS = [(-0.40, 2.0), (-0.30, 1.5), (-0.20, 1.2), (-0.10, 1.0)]
SIMULATOR_DIP_STEPS = [(-0.40, 2.5), (-0.30, 2.0), (-0.20, 1.5), (-0.10, 1.2)]
YEAR_DAYS, RISK_FREE = 365.0, 0.02


def is_investment_day(day: Column, frequency: str, start: str, dca_day: int = 1) -> Column:
    """DAILY, WEEKLY (ISO weekday), BIWEEKLY (from the start) or MONTHLY (day of month, at most 28)."""
    if frequency == "DAILY":
        return F.lit(True)
    if frequency == "WEEKLY":
        return F.weekday(day) + 1 == min(max(dca_day, 1), 7)
    if frequency == "BIWEEKLY":
        return F.datediff(day, F.lit(start)) % 14 == 0
    return F.dayofmonth(day) == min(max(dca_day, 1), 28)


#: Percentile of mvrv -> factor, in backtests and in the simulator; what low unrealized profit gives; factor by risk level.
VALUATION_STEPS, SIMULATOR_VALUATION_STEPS = [(15.0, 3.0), (30.0, 2.0), (85.0, 0.5)], [(15.0, 2.0), (30.0, 1.5)]
LOW_NUPL, NUPL_FACTOR = 0.25, 1.3
RISK_FACTORS = {"VERY_LOW": 1.3, "LOW": 1.2, "MODERATE": 1.0, "HIGH": 0.5, "VERY_HIGH": 0.3, "EXTREME": 0.2}


def valuation_multiplier(percentile: Column, nupl: Column, steps: list[tuple[float, float]] = VALUATION_STEPS) -> Column:
    """By the percentile of mvrv, and at least NUPL_FACTOR while unrealized profit is low; unknown values say nothing."""
    by_place = F.when(percentile.isNull(), 1.0).otherwise(two_sided(percentile, steps))
    return F.when(nupl < LOW_NUPL, F.greatest(by_place, F.lit(NUPL_FACTOR))).otherwise(by_place)


def risk_multiplier(risk_level: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RISK_FACTORS.items() for x in kv]), risk_level), F.lit(1.0))


def multiplier(strategy: str, close: Column, high: Column, w) -> Column:
    peak, recent = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.max(high).over(w.rowsBetween(-89, 0))
    return {"dip_buy": first_at_most(close / peak - 1, DIP_STEPS), "drawdown_buy": first_at_most(close / recent - 1, DIP_STEPS),
            "valuation_buy": valuation_multiplier(F.col("pct_mvrv"), F.col("nupl")), "risk_adjusted": risk_multiplier(F.col("risk_level")), "rule_based": F.col("rule_multiplier")}.get(strategy, F.lit(1.0))


def vectorized(bars: DataFrame, strategy: str = "fixed_dca", frequency: str = "MONTHLY", amount: float = 100.0, initial: float = 0.0, fee: float = 0.001, slippage: float = 0.0005, next_open: bool = True,
               dca_day: int = 1, start: str = "1995-01-01", keys: tuple[str, ...] = ("symbol",), max_single: float | None = None, capital: float | None = None, deposit: Column | None = None, reserve: float = 0.0) -> DataFrame:
    """Equity curve per key: keys, time, price, signal, amount, qty, fee, btc, invested, cash, avg_cost, value.

    capital: cash at hand before the first bar (None: as much as is asked for); deposit: what each bar adds; reserve: cash that no
    purchase may touch. A signal is then cut to what is left above the reserve.
    """
    w = Window.partitionBy(*keys).orderBy("time")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    due = is_investment_day(F.col("time"), frequency, start, dca_day)
    row = F.row_number().over(w)
    signal = F.when((row == 1) & F.lit(initial > 0), F.lit(initial)).when(due, F.lit(amount) * multiplier(strategy, F.col("close"), F.col("high"), w)).otherwise(0.0)
    signal = F.least(signal, F.lit(max_single)) if max_single else signal
    b = bars.withColumn("signal", signal).withColumn("_row", row)
    if capital is not None:
        b = affordable(b, keys, capital, F.lit(0.0) if deposit is None else deposit, reserve)
    b = b.withColumn("amount", F.coalesce(F.lag("signal").over(w), F.lit(0.0)) if next_open else F.col("signal")).withColumn("_ref", F.col("open") if next_open else F.col("close"))
    fill = F.col("_ref") * (1 + slippage)
    b = b.withColumn("fee", F.when((F.col("amount") > 0) & (F.col("_ref") > 0), F.col("amount") * fee).otherwise(0.0))
    b = b.withColumn("qty", F.when((F.col("amount") > 0) & (F.col("_ref") > 0), (F.col("amount") - F.col("fee")) / fill).otherwise(0.0))
    cash = F.when((F.col("_row") < (2 if next_open else 1)) & F.lit(initial > 0), F.lit(initial)).otherwise(0.0)
    if capital is not None:
        cash = F.col("_paid_in") - F.coalesce(F.sum("amount").over(run), F.lit(0.0))
    b = b.withColumn("btc", F.sum("qty").over(run)).withColumn("invested", F.sum("amount").over(run)).withColumn("cash", cash)
    return b.select(*keys, "time", F.col("close").alias("price"), "signal", "amount", "qty", "fee", "btc", "invested", "cash",
                    F.when(F.col("btc") > 0, F.col("invested") / F.col("btc")).otherwise(0.0).alias("avg_cost"), (F.col("cash") + F.col("btc") * F.col("close")).alias("value"))


def affordable(b: DataFrame, keys: tuple[str, ...], capital: float, deposit: Column, reserve: float) -> DataFrame:
    """b with signal cut to the cash above the reserve, and _paid_in, capital and deposits so far.

    In whole cents, with W the sum of what is wanted and J that of what may be spent (never below 0), both so far, the sum spent is
    W less the largest lead of W over J up to the row: running sums and a running maximum, no row waits for another's result.
    """
    cents = lambda c: F.floor(c * 100 + 0.5).cast("long")
    t = numbered(b, by=keys).withColumns({"_stretch": F.floor(F.col("_rn") / ROWS), "_want": cents(F.col("signal")), "_add": cents(deposit)})
    t = written(t, "signals")
    t = running(t, {"_w": ("sum", F.col("_want")), "_j": ("sum", F.col("_add"))}, keys, "_stretch", ("_rn",))
    paid = F.col("_j") + F.lit(round(capital * 100))
    lead = F.col("_w") - F.greatest(F.lit(0), paid - F.lit(round(reserve * 100)))
    t = running(t.withColumn("_lead", lead), {"_top": ("max", F.col("_lead"))}, keys, "_stretch", ("_rn",))
    t = running(t, {"_top0": ("max", F.col("_lead"))}, keys, "_stretch", ("_rn",), before=True)
    over = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(0)))
    spent = F.col("_want") - over("_top") + over("_top0")
    return t.withColumns({"signal": spent / 100.0, "_paid_in": paid / 100.0}).select(*b.columns, "_paid_in")


def trades(curve: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return curve.filter("qty > 0").select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("time")).alias("seq"), "time", "amount", "qty", "fee", "btc", "invested", "avg_cost")


def curve_returns(curve: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """curve with ret (flow-adjusted daily return), drawdown (positive fraction of the running peak) and cumulative return."""
    w = Window.partitionBy(*keys).orderBy("time")
    flow = F.col("invested") - F.lag("invested").over(w)
    before = F.lag("value").over(w)
    peak = F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return curve.withColumn("ret", F.when(before > 0, (F.col("value") - flow) / before - 1)).withColumn("drawdown", F.coalesce(1 - F.try_divide(F.col("value"), peak), F.lit(0.0))).withColumn(
        "cum_return", F.try_divide(F.col("value"), F.col("invested")) - 1)


def metrics(curve: DataFrame, keys: tuple[str, ...] = ("symbol",), risk_free: float = RISK_FREE) -> DataFrame:
    """One row of performance metrics per run."""
    r = curve_returns(curve, keys)
    daily = risk_free / YEAR_DAYS
    days = F.datediff(F.max("time"), F.min("time"))
    down = F.sqrt(F.avg(F.pow(F.least(F.col("ret") - daily, F.lit(0.0)), 2)))
    growth = F.exp(F.sum(F.when(F.col("ret") > -1, F.log1p("ret"))))
    m = r.groupBy(*keys).agg(
        F.max_by("value", "time").alias("final_value"), F.max("invested").alias("total_invested"), F.sum("fee").alias("fees"), F.sum(F.when(F.col("qty") > 0, 1).otherwise(0)).alias("n_trades"),
        days.alias("days"), F.max("drawdown").alias("max_drawdown"), F.try_divide(F.avg("ret") - daily, F.stddev_samp("ret")).alias("_sharpe"), F.try_divide(F.avg("ret") - daily, down).alias("_sortino"), growth.alias("_growth"))
    year = F.pow("_growth", YEAR_DAYS / F.col("days")) - 1
    return m.select(*keys, "final_value", "total_invested", "fees", "n_trades", "days", "max_drawdown", (F.try_divide("final_value", "total_invested") - 1).alias("total_return"),
                    (F.col("_sharpe") * F.sqrt(F.lit(YEAR_DAYS))).alias("sharpe"), (F.col("_sortino") * F.sqrt(F.lit(YEAR_DAYS))).alias("sortino"), year.alias("twrr"), F.try_divide(year, F.col("max_drawdown")).alias("calmar"))


def drawdown_episodes(curve: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Per fall from a peak: its date, the trough's, the recovery's (NULL if none), depth and days."""
    w = Window.partitionBy(*keys).orderBy("time")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    top = F.coalesce(F.col("value") >= F.max("value").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    p = curve.withColumn("_top", top).withColumn("_episode", F.sum(F.col("_top").cast("int")).over(run)).withColumn("_last", F.max("time").over(Window.partitionBy(*keys)))
    low = F.struct("value", "time")
    e = p.groupBy(*keys, "_episode").agg(
        F.min("time").alias("peak_date"), F.max_by("value", F.col("_top").cast("int")).alias("_peak"), F.min(F.when(~F.col("_top"), low)).alias("_low"), F.count("*").alias("n"), F.first("_last").alias("_last"))
    e = e.withColumn("recovery_date", F.lead("peak_date").over(Window.partitionBy(*keys).orderBy("_episode"))).filter("n > 1")
    return e.select(*keys, "peak_date", F.col("_low.time").alias("trough_date"), "recovery_date", (1 - F.col("_low.value") / F.col("_peak")).alias("depth"),
                    F.datediff(F.coalesce("recovery_date", "_last"), "peak_date").alias("duration_days"), F.datediff("recovery_date", F.col("_low.time")).alias("recovery_days"))


def irr(dates_days, flows, tolerance: float = 1e-10) -> float | None:
    """Yearly rate at which dated flows (days, amounts) have value zero: Newton, then bisection on a bracket whose ends differ in sign."""
    if not len(flows) or not (min(flows) < 0 < max(flows)):
        return None
    years = [(d - dates_days[0]) / YEAR_DAYS for d in dates_days]
    value = lambda r: sum(f / (1 + r) ** t for f, t in zip(flows, years, strict=True))
    rate = 0.1
    for _ in range(200):
        slope = sum(-t * f / (1 + rate) ** (t + 1) for f, t in zip(flows, years, strict=True))
        if abs(slope) < 1e-14:
            break
        new = rate - value(rate) / slope
        if new <= -0.999999:
            break
        if abs(new - rate) < tolerance:
            return new
        rate = new
    lo, hi = -0.9999, 10.0
    if value(lo) * value(hi) > 0:
        return None
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(lo) * value(mid) > 0 else (lo, mid)
    return (lo + hi) / 2


def run_irr(curve: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Money-weighted yearly return per run; only days with flows are gathered."""
    flows = curve.withColumn("_end", F.max("time").over(Window.partitionBy(*keys))).filter((F.col("amount") > 0) | (F.col("time") == F.col("_end")))
    flows = flows.select(*keys, F.datediff("time", F.lit("1970-01-01")).alias("day"), (F.when(F.col("time") == F.col("_end"), F.col("value")).otherwise(0.0) - F.col("amount")).alias("flow"))

    def one(frame):
        frame = frame.sort_values("day")
        out = frame.iloc[:1][list(keys)].copy()
        out["irr"] = irr(frame.day.tolist(), frame.flow.tolist())
        return out

    return flows.groupBy(*keys).applyInPandas(one, ", ".join(f"{k} {dict(curve.dtypes)[k]}" for k in keys) + ", irr double")


EVENT = "symbol string, time timestamp_ntz, amount double, qty double, fee double, btc double, invested double, value double"


def event_driven(bars: DataFrame, strategy: str = "fixed_dca", frequency: str = "MONTHLY", amount: str = "100", fee: str = "0.001", slippage: str = "0.0005", next_open: bool = True, dca_day: int = 1) -> DataFrame:
    """The same backtest, folded bar by bar in decimals that round half up (money to cents, coins to 1e-8).

    The orders of a bar are filled at the next open (or its own close); one still open at the end is filled at the last close.
    """
    due = is_investment_day(F.col("time"), frequency, "1995-01-01", dca_day)
    rows = bars.select("symbol", "time", "open", "high", "close", due.alias("due"))

    def run(frame):
        import pandas as pd

        cent, coin = Decimal("0.01"), Decimal("0.00000001")
        btc = invested = Decimal(0)
        peak, recent, pending, out = Decimal(0), [], None, []
        frame = frame.sort_values("time")
        steps = [(Decimal(str(a)), Decimal(str(b))) for a, b in DIP_STEPS]

        def buy(money, price):
            nonlocal btc, invested
            cost = (money * Decimal(fee)).quantize(cent, ROUND_HALF_UP)
            qty = ((money - cost) / (price * (1 + Decimal(slippage)))).quantize(coin, ROUND_HALF_UP)
            btc, invested = btc + qty, invested + money
            return money, qty, cost

        for i, bar in enumerate(frame.itertuples()):
            open_, high, close = (Decimal(str(v)) for v in (bar.open, bar.high, bar.close))
            done = (Decimal(0),) * 3
            if pending is not None:
                done = buy(pending, open_)
                pending = None
            peak = max(peak, high)
            recent = [*recent[-89:], high]
            if bar.due:
                gap = close / (peak if strategy == "dip_buy" else max(recent)) - 1
                factor = next((f for t, f in steps if gap <= t), Decimal(1)) if strategy in ("dip_buy", "drawdown_buy") else Decimal(1)
                order = (Decimal(amount) * factor).quantize(cent, ROUND_HALF_UP)
                if next_open and i < len(frame) - 1:
                    pending = order
                else:
                    extra = buy(order, close)
                    done = tuple(a + b for a, b in zip(done, extra, strict=True))
            out.append((bar.symbol, bar.time, *map(float, (*done, btc, invested, btc * close))))
        return pd.DataFrame(out, columns=["symbol", "time", "amount", "qty", "fee", "btc", "invested", "value"])

    return rows.groupBy("symbol").applyInPandas(run, EVENT)


def sweep(bars: DataFrame, runs: list[dict]) -> DataFrame:
    """metrics() of many parameter sets, each a group of one plan per set of non-numeric options."""
    out = None
    for k, p in enumerate(runs):
        m = vectorized(bars.withColumn("run", F.lit(k)), keys=("run", "symbol"), **p)
        out = m if out is None else out.unionByName(m)
    return metrics(out, ("run", "symbol"))


def _curve_sql(factor: str = "1.0", source: str = MULTI) -> str:
    return f"""{source}, k AS (SELECT *, row_number() OVER w AS rn, max(high) OVER w AS ath FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time)),
  s AS (SELECT *, CASE WHEN day(time) = 1 THEN 100.0 * {factor} ELSE 0.0 END AS signal FROM k), a AS (SELECT *, CAST(coalesce(lag(signal) OVER (PARTITION BY symbol ORDER BY time), 0) AS DOUBLE) AS amount FROM s),
  q AS (SELECT *, amount * 0.001 AS fee, (amount - amount * 0.001) / (open * 1.0005) AS qty FROM a), curve AS (SELECT *, sum(qty) OVER w AS btc, sum(amount) OVER w AS invested, sum(qty) OVER w * close AS value FROM q WINDOW w AS (PARTITION BY symbol ORDER BY time))"""


DIP_SQL = "CASE WHEN close / ath - 1 <= -0.4 THEN 2.0 WHEN close / ath - 1 <= -0.3 THEN 1.5 WHEN close / ath - 1 <= -0.2 THEN 1.2 ELSE 1.0 END"
RETURNS_SQL = """r AS (SELECT *, CASE WHEN lag(value) OVER w > 0 THEN (value - (invested - lag(invested) OVER w)) / lag(value) OVER w - 1 END AS ret, coalesce(1 - value / nullif(max(value) OVER w, 0), 0) AS drawdown FROM curve WINDOW w AS (PARTITION BY symbol ORDER BY time))"""


@query("backtest_vectorized", f"WITH {_curve_sql(DIP_SQL)} SELECT symbol, time, round(amount, 4) AS amount, round(qty, 9) AS qty, round(btc, 8) AS btc, round(invested, 4) AS invested, round(value, 4) AS value FROM curve")
def q_vectorized(spark, sf_dir):
    return rounded(vectorized(bars_multi(spark, sf_dir), "dip_buy").select("symbol", "time", "amount", "qty", "btc", "invested", "value"), 4, qty=9, btc=8)


def _month_deposit(bars: DataFrame, amount: float) -> DataFrame:
    """bars with deposit: the amount on a symbol's first bar of each month."""
    first = bars.groupBy("symbol", F.date_trunc("month", "time").alias("_month")).agg(F.min("time").alias("_first"))
    t = bars.withColumn("_month", F.date_trunc("month", "time")).join(first, ["symbol", "_month"])
    return t.withColumn("deposit", F.when(F.col("time") == F.col("_first"), amount).otherwise(0.0)).drop("_month", "_first")


@query("backtest_cash_floor", f"""WITH RECURSIVE {MULTI}, k AS (SELECT *, row_number() OVER w AS rn, max(high) OVER w AS ath, CASE WHEN lag(date_trunc('month', time)) OVER w IS DISTINCT FROM date_trunc('month', time) THEN 45000 ELSE 0 END AS paid FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time)),
  s AS (SELECT *, CAST(CASE WHEN isodow(time) = 1 THEN least(round(10000 * {{dip}}), 18000) ELSE 0 END AS BIGINT) AS wanted FROM k),
  r AS (SELECT symbol, time, rn, close, greatest(0, least(wanted, 300000 + paid - 100000)) AS spent, 300000 + paid - greatest(0, least(wanted, 300000 + paid - 100000)) AS cash FROM s WHERE rn = 1
   UNION ALL SELECT s.symbol, s.time, s.rn, s.close, greatest(0, least(s.wanted, r.cash + s.paid - 100000)), r.cash + s.paid - greatest(0, least(s.wanted, r.cash + s.paid - 100000)) FROM r JOIN s ON s.symbol = r.symbol AND s.rn = r.rn + 1),
  q AS (SELECT *, spent / 100.0 * 0.999 / (close * 1.0005) AS qty FROM r)
  SELECT symbol, time, round(spent / 100.0, 2) AS amount, round(cash / 100.0, 2) AS cash, round(sum(qty) OVER (PARTITION BY symbol ORDER BY time), 8) AS btc FROM q""".replace("{dip}", DIP_SQL))
def q_cash_floor(spark, sf_dir):
    """Weekly purchases that grow with the fall, at most 180 each, from 3000 and 450 a month, of which 1000 stay untouched."""
    bars = _month_deposit(bars_multi(spark, sf_dir), 450.0)
    curve = vectorized(bars, "dip_buy", "WEEKLY", next_open=False, max_single=180.0, capital=3000.0, deposit=F.col("deposit"), reserve=1000.0)
    return curve.select("symbol", "time", F.round("amount", 2).alias("amount"), F.round("cash", 2).alias("cash"), F.round("btc", 8).alias("btc"))


@query("backtest_trades", f"WITH {_curve_sql()} SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY time) AS INT) AS seq, time, round(amount, 4) AS amount, round(qty, 9) AS qty, round(fee, 6) AS fee FROM curve WHERE qty > 0")
def q_trades(spark, sf_dir):
    return rounded(trades(vectorized(bars_multi(spark, sf_dir))).select("symbol", "seq", "time", "amount", "qty", "fee"), 4, qty=9, fee=6)


@query("backtest_metrics", f"""WITH {_curve_sql(DIP_SQL)}, {RETURNS_SQL}, m AS (SELECT symbol, arg_max(value, time) AS final_value, max(invested) AS total_invested, sum(fee) AS fees, CAST(sum(CASE WHEN qty > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_trades,
  CAST(date_diff('day', min(time), max(time)) AS INT) AS days, max(drawdown) AS max_drawdown, (avg(ret) - 0.02/365) / stddev_samp(ret) AS sh, (avg(ret) - 0.02/365) / sqrt(avg(pow(least(ret - 0.02/365, 0), 2))) AS so, exp(sum(CASE WHEN ret > -1 THEN ln(1 + ret) END)) AS growth FROM r GROUP BY symbol)
  SELECT symbol, round(final_value, 4) AS final_value, round(total_invested, 4) AS total_invested, round(fees, 4) AS fees, n_trades, days, round(max_drawdown, 6) AS max_drawdown, round(final_value / total_invested - 1, 6) AS total_return,
   round(sh * sqrt(365), 6) AS sharpe, round(so * sqrt(365), 6) AS sortino, round(pow(growth, 365.0 / days) - 1, 6) AS twrr, round((pow(growth, 365.0 / days) - 1) / max_drawdown, 6) AS calmar FROM m""")
def q_metrics(spark, sf_dir):
    return rounded(metrics(vectorized(bars_multi(spark, sf_dir), "dip_buy")), 6, final_value=4, total_invested=4, fees=4)


@query("backtest_drawdown_episodes", f"""WITH {DAILY}, t AS (SELECT symbol, time, close AS value, coalesce(close >= max(close) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS top FROM bars),
  e AS (SELECT *, sum(CASE WHEN top THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY time) AS ep FROM t), g AS (SELECT symbol, ep, min(time) AS peak_date, max(value) AS peak, arg_min(time, (value, time)) FILTER (WHERE NOT top) AS trough_date, min(value) AS low, count(*) AS n FROM e GROUP BY 1, 2),
  n AS (SELECT *, lead(peak_date) OVER (PARTITION BY symbol ORDER BY ep) AS recovery_date FROM g)
  SELECT symbol, peak_date, trough_date, recovery_date, round(1 - low / peak, 6) AS depth, CAST(date_diff('day', peak_date, coalesce(recovery_date, (SELECT max(time) FROM bars))) AS INT) AS duration_days, CAST(date_diff('day', trough_date, recovery_date) AS INT) AS recovery_days FROM n WHERE n > 1""")
def q_episodes(spark, sf_dir):
    return rounded(drawdown_episodes(bars_daily(spark, sf_dir).select("symbol", "time", F.col("close").alias("value"))), 6)


@query("backtest_yearly", f"""WITH {_curve_sql()}, y AS (SELECT symbol, year(time) AS year, arg_min(value, time) AS first, arg_max(value, time) AS last FROM curve WHERE value > 0 GROUP BY 1, 2)
  SELECT symbol, year, round(last / coalesce(lag(last) OVER (PARTITION BY symbol ORDER BY year), first) - 1, 6) AS ret FROM y""")
def q_yearly(spark, sf_dir):
    """Growth of the value per year, against the end of the year before."""
    y = vectorized(bars_multi(spark, sf_dir)).filter("value > 0").groupBy("symbol", F.year("time").cast("long").alias("year")).agg(F.min_by("value", "time").alias("first"), F.max_by("value", "time").alias("last"))
    base = F.coalesce(F.lag("last").over(Window.partitionBy("symbol").orderBy("year")), F.col("first"))
    return rounded(y.select("symbol", "year", (F.col("last") / base - 1).alias("ret")), 6)


@query("backtest_event_driven")
def q_event(spark, sf_dir):
    """Tests hold it against the vectorized engine (half a percent)."""
    return rounded(event_driven(bars_multi(spark, sf_dir), "dip_buy"), 6)


@query("backtest_compare", f"""WITH {_curve_sql(DIP_SQL)}, d AS (SELECT symbol, arg_max(value, time) / max(invested) - 1 AS ret FROM curve GROUP BY 1), f AS (SELECT symbol, sum(CASE WHEN day(p) = 1 THEN 1 ELSE 0 END) AS n FROM (SELECT symbol, lag(time) OVER (PARTITION BY symbol ORDER BY time) AS p FROM bars) GROUP BY 1)
  SELECT symbol, round(ret, 6) AS total_return, CAST(rank() OVER (ORDER BY ret DESC) AS INT) AS place FROM d""")
def q_compare(spark, sf_dir):
    m = metrics(vectorized(bars_multi(spark, sf_dir), "dip_buy"))
    return m.select("symbol", F.round("total_return", 6).alias("total_return"), F.rank().over(Window.orderBy(F.desc("total_return"))).alias("place"))


@query("backtest_lump_sum", f"WITH {MULTI} SELECT symbol, round(arg_max(close, time) / arg_min(close, time) - 1, 6) AS ret FROM bars GROUP BY symbol")
def q_lump(spark, sf_dir):
    return bars_multi(spark, sf_dir).groupBy("symbol").agg(F.round(F.max_by("close", "time") / F.min_by("close", "time") - 1, 6).alias("ret"))


@query("backtest_calendar", f"""WITH {DAILY} SELECT time, isodow(time) = 3 AS weekly, date_diff('day', DATE '1995-01-01', CAST(time AS DATE)) % 14 = 0 AS biweekly, day(time) = 15 AS monthly FROM bars""")
def q_calendar(spark, sf_dir):
    t = F.col("time")
    return bars_daily(spark, sf_dir).select("time", is_investment_day(t, "WEEKLY", "1995-01-01", 3).alias("weekly"), is_investment_day(t, "BIWEEKLY", "1995-01-01").alias("biweekly"), is_investment_day(t, "MONTHLY", "1995-01-01", 15).alias("monthly"))
