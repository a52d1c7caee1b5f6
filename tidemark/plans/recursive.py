"""Indicators with feedback: exponential and Wilder smoothing, MACD, RSI, ATR, ADX.

y[t] = (1 - a) y[t-1] + a x[t] has no fixed window frame; it is a scan of composed maps (functions.scans). All smoothings of
one stage share their stretches; MACD's signal line and ADX smooth what a first stage gives, so they are a second one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scans import ROWS, numbered, smoothed, sound, with_keys
from ..registry import query
from ..sources.frames import MULTI, bars_multi, rounded
from ..tables import written

COLUMNS = ("ema50", "rsi14", "macd_line", "signal_line", "histogram", "atr", "atr_percent", "plus_di", "minus_di", "adx")


def ema(c: str, span: int) -> tuple:
    """Seeded with the first value; the first span - 1 results stay hidden."""
    return c, 2 / (span + 1), 1, span


def wilder(c: str, period: int) -> tuple:
    """Seeded with the mean of the first `period` values, which are hidden before."""
    return c, 1 / period, period, period


def moves(bars: DataFrame, bucket: str = "year") -> DataFrame:
    """Numbered bars with what the smoothings read: gain, loss, spread, and the moves up and down."""
    t = numbered(bars, bucket=bucket, lags=("high", "low", "close"))
    high, low, close, before = (F.col(c) for c in ("high", "low", "close", "_lag_close"))
    up, down, delta = high - F.col("_lag_high"), F.col("_lag_low") - low, close - before
    known = lambda x, on: F.when(on.isNotNull(), x)
    return t.withColumns({
        "_gain": known(F.greatest(delta, F.lit(0.0)), delta), "_loss": known(F.greatest(-delta, F.lit(0.0)), delta), "_spread": F.greatest(high - low, F.abs(high - before), F.abs(low - before)),
        "_up": known(F.when((up > down) & (up > 0), up).otherwise(0.0), up), "_down": known(F.when((down > up) & (down > 0), down).otherwise(0.0), up)})


def _rsi() -> Column:
    gain, both = F.col("_rsi_gain"), F.col("_rsi_gain") + F.col("_rsi_loss")
    return F.when(both > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * gain / both))).when(gain.isNotNull(), 100.0)


def with_rsi(t: DataFrame, period: int, rows: int = ROWS) -> DataFrame:
    return smoothed(t, {"_rsi_gain": wilder("_gain", period), "_rsi_loss": wilder("_loss", period)}, rows=rows).withColumn("value", _rsi())


def with_atr(t: DataFrame, period: int, rows: int = ROWS) -> DataFrame:
    return smoothed(t, {"value": wilder("_spread", period)}, rows=rows).withColumn("atr_percent", F.when(F.col("close") > 0, F.col("value") / F.col("close") * 100))


def with_macd(t: DataFrame, fast: int, slow: int, signal: int, rows: int = ROWS) -> DataFrame:
    t = smoothed(t, {"_fast": ema("close", fast), "_slow": ema("close", slow)}, rows=rows)
    t = written(t.select("symbol", "time", "_rn", (F.col("_fast") - F.col("_slow")).alias("value")), "lines")
    return smoothed(t, {"signal": ema("value", signal)}, rows=rows).withColumn("histogram", F.col("value") - F.col("signal"))


def _directions() -> dict[str, Column]:
    return {c: F.when(F.col("_atr") > 0, 100 * F.col(s) / F.col("_atr")) for c, s in (("plus_di", "_plus"), ("minus_di", "_minus"))}


def _with_dx(t: DataFrame) -> DataFrame:
    total = F.col("plus_di") + F.col("minus_di")
    return t.withColumn("_dx", sound(F.when(total > 0, 100 * F.abs(F.col("plus_di") - F.col("minus_di")) / total)))


def _where_unbroken(smooth: DataFrame, t: DataFrame, period: int, out: str) -> DataFrame:
    """ADX is null throughout where the values that seed it have a gap: `period` values of t's _dx from its first on."""
    first = t.filter("_dx IS NOT NULL").groupBy("symbol").agg(F.min("_rn").alias("_first"))
    seeds = with_keys(t, first, ["symbol"]).filter(F.col("_rn") < F.col("_first") + period).groupBy("symbol").agg((F.count("_dx") == period).alias("_unbroken"))
    return with_keys(smooth, seeds, ["symbol"]).withColumn(out, F.when(F.col("_unbroken"), F.col(out))).drop("_unbroken")


def with_adx(t: DataFrame, period: int, rows: int = ROWS) -> DataFrame:
    t = smoothed(t, {"_atr": wilder("_spread", period), "_plus": wilder("_up", period), "_minus": wilder("_down", period)}, rows=rows).withColumns(_directions())
    t = written(_with_dx(t).select("symbol", "time", "_rn", "plus_di", "minus_di", "_dx"), "directions")
    return _where_unbroken(smoothed(t, {"value": wilder("_dx", period)}, rows=rows), t, period, "value")


#: code -> (function of moves() and the parameters, parameters, columns)
SCANS = {
    "tech.ema": (lambda t, period: smoothed(t, {"value": ema("close", period)}), {"period": 50}, ("value",)),
    "tech.rsi": (with_rsi, {"period": 14}, ("value",)),
    "tech.macd": (with_macd, {"fast": 12, "slow": 26, "signal": 9}, ("value", "signal", "histogram")),
    "tech.atr": (with_atr, {"period": 14}, ("value", "atr_percent")),
    "tech.adx": (with_adx, {"period": 14}, ("value", "plus_di", "minus_di")),
}


def scanned(bars: DataFrame, name: str, **params) -> DataFrame:
    """One recursive indicator with its parameters: symbol, time and its columns."""
    f, defaults, columns = SCANS[name]
    used = defaults | {k: v for k, v in params.items() if v is not None}
    read = [c for c in ("high", "low", "close") if c in bars.columns]
    if name in ("tech.ema", "tech.macd"):
        t = numbered(bars.select("symbol", "time", "close"))
    else:
        t = moves(bars.select("symbol", "time", *read))
    return f(written(t, "moves"), **used).select("symbol", "time", *columns)


def recursive_frame(bars: DataFrame, period: int = 14, rows: int = ROWS) -> DataFrame:
    """symbol, time and all recursive indicators; undefined values are NULL. Two stages, whatever the number of indicators."""
    t = written(moves(bars.select("symbol", "time", "high", "low", "close")), "moves")
    first = {"ema50": ema("close", 50), "_fast": ema("close", 12), "_slow": ema("close", 26)}
    first |= {"_rsi_gain": wilder("_gain", period), "_rsi_loss": wilder("_loss", period), "_atr": wilder("_spread", period), "_plus": wilder("_up", period), "_minus": wilder("_down", period)}
    t = smoothed(t, first, rows=rows).withColumns({"rsi14": _rsi(), "macd_line": F.col("_fast") - F.col("_slow"), "atr": F.col("_atr"), "atr_percent": F.when(F.col("close") > 0, F.col("_atr") / F.col("close") * 100)} | _directions())
    t = written(_with_dx(t).select("symbol", "time", "_rn", "ema50", "rsi14", "macd_line", "atr", "atr_percent", "plus_di", "minus_di", "_dx"), "smoothed")
    second = smoothed(t, {"signal_line": ema("macd_line", 9), "adx": wilder("_dx", period)}, rows=rows).withColumn("histogram", F.col("macd_line") - F.col("signal_line"))
    return _where_unbroken(second, t, period, "adx").select("symbol", "time", *COLUMNS)


def _w(x, prev, n, at):
    """Wilder smoothing in SQL: null before row `at`, the seed there, then the recursion."""
    return f"CASE WHEN b.rn < {at} THEN NULL WHEN b.rn = {at} THEN b.{x}_seed ELSE r.{prev} * (1 - 1.0/{n}) + b.{x} * (1.0/{n}) END"


SQL = f"""WITH RECURSIVE {MULTI}, l AS (SELECT *, row_number() OVER w AS rn, close - lag(close) OVER w AS d, lag(close) OVER w AS pc, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time)),
  x AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS g, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS lo, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr,
    CASE WHEN up IS NOT NULL THEN CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END END AS pdm, CASE WHEN up IS NOT NULL THEN CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END END AS mdm FROM l),
  b AS (SELECT *, avg(g) OVER f AS g_seed, avg(lo) OVER f AS lo_seed, avg(tr) OVER f AS tr_seed, avg(pdm) OVER f AS pdm_seed, avg(mdm) OVER f AS mdm_seed FROM x WINDOW f AS (PARTITION BY symbol ORDER BY time ROWS 13 PRECEDING)),
  r AS (SELECT symbol, time, rn, close, close AS e12, close AS e26, close AS e50, CAST(NULL AS DOUBLE) AS sig, CAST(NULL AS DOUBLE) AS ag, CAST(NULL AS DOUBLE) AS al, CAST(NULL AS DOUBLE) AS atr, CAST(NULL AS DOUBLE) AS p, CAST(NULL AS DOUBLE) AS m FROM b WHERE rn = 1
   UNION ALL SELECT symbol, time, rn, close, e12, e26, e50, CASE WHEN rn < 26 THEN NULL WHEN rn = 26 THEN e12 - e26 ELSE s * 0.8 + (e12 - e26) * 0.2 END, ag, al, atr, p, m FROM (
    SELECT b.symbol, b.time, b.rn, b.close, r.e12 * (11.0/13) + b.close * (2.0/13) AS e12, r.e26 * (25.0/27) + b.close * (2.0/27) AS e26, r.e50 * (49.0/51) + b.close * (2.0/51) AS e50, r.sig AS s,
     {_w('g', 'ag', 14, 15)} AS ag, {_w('lo', 'al', 14, 15)} AS al, {_w('tr', 'atr', 14, 14)} AS atr, {_w('pdm', 'p', 14, 15)} AS p, {_w('mdm', 'm', 14, 15)} AS m FROM r JOIN b ON b.symbol = r.symbol AND b.rn = r.rn + 1))
"""
_CORE = SQL


def _selected(prices: int, shares: int) -> str:
    """The SQL of all but ADX with so many digits of prices and of shares."""
    return _CORE + f"""  SELECT symbol, time, round(CASE WHEN rn >= 50 THEN e50 END, {prices}) AS ema50, round(CASE WHEN ag + al > 0 THEN 100 * ag / (ag + al) WHEN ag IS NOT NULL THEN 100 END, {shares}) AS rsi14, round(CASE WHEN rn >= 26 THEN e12 - e26 END, {prices}) AS macd_line,
   round(CASE WHEN rn >= 34 THEN sig END, {prices}) AS signal_line, round(CASE WHEN rn >= 34 THEN e12 - e26 - sig END, {prices}) AS histogram, round(atr, {prices}) AS atr, round(atr / close * 100, {shares}) AS atr_percent, round(100 * p / atr, {shares}) AS plus_di, round(100 * m / atr, {shares}) AS minus_di FROM r"""


# Sums in another order differ in their last digits, so prices are compared to three digits and shares to four.
SQL = _selected(3, 4)


@query("indicator_recursive", SQL)
def indicator_recursive(spark, sf_dir):
    return rounded(recursive_frame(bars_multi(spark, sf_dir)).drop("adx"), 3, rsi14=4, atr_percent=4, plus_di=4, minus_di=4)


_ADX = """, d AS (SELECT symbol, time, rn, 100 * p / atr AS pdi, 100 * m / atr AS mdi, CASE WHEN p + m > 0 THEN 100 * abs(p - m) / (p + m) END AS dx FROM r),
  e AS (SELECT *, avg(dx) OVER f AS seed, count(dx) OVER f AS n FROM d WINDOW f AS (PARTITION BY symbol ORDER BY rn ROWS 13 PRECEDING)),
  z AS (SELECT symbol, rn, CASE WHEN n = 14 THEN seed END AS adx FROM e WHERE rn = 28 UNION ALL SELECT e.symbol, e.rn, CASE WHEN e.dx IS NULL THEN z.adx ELSE z.adx * (13.0 / 14) + e.dx / 14 END FROM z JOIN e ON e.symbol = z.symbol AND e.rn = z.rn + 1)"""


@query("indicator_tech_adx", _CORE + _ADX + "\n  SELECT e.symbol, e.time, round(pdi, 4) AS plus_di, round(mdi, 4) AS minus_di, round(adx, 4) AS adx FROM e LEFT JOIN z ON e.symbol = z.symbol AND e.rn = z.rn")
def indicator_adx(spark, sf_dir):
    """Trend strength, smoothed from the mean of the first unbroken run."""
    return rounded(scanned(bars_multi(spark, sf_dir), "tech.adx").withColumnRenamed("value", "adx"), 4)


def _register():
    # No gain or loss is negative, so nothing cancels in sums of them: RSI keeps six digits.
    for name, digits, select, sql in (
        ("tech.ema", {"value": 3}, "ema50 AS value", SQL), ("tech.rsi", {"value": 6}, "rsi14 AS value", _selected(4, 6)), ("tech.macd", {"value": 3, "signal": 3, "histogram": 3}, "macd_line AS value, signal_line AS signal, histogram", SQL),
        ("tech.atr", {"value": 3, "atr_percent": 4}, "atr AS value, atr_percent", SQL)):
        query(f"indicator_{name.replace('.', '_')}", f"SELECT symbol, time, {select} FROM ({sql}) x")(lambda spark, sf_dir, name=name, digits=digits: rounded(scanned(bars_multi(spark, sf_dir), name), 4, **digits))


_register()
