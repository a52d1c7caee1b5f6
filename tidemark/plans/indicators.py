"""Indicators that are window expressions. An indicator takes a bar table and gives symbol, time and its columns.

All of a frame's indicators are built on one WindowSpec, so a batch is one shuffle and one sort however many are asked for.
Missing input columns give NULL columns; an undefined ratio is NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_divide
from ..functions.windows import (
    UNBOUNDED, W, anchored_sum, expanding_std, log_return, previous, rolling_correlation, rolling_max, rolling_mean, rolling_std, running_max, running_sum, simple_return, weighted_mean,
)
from ..functions.ranks import expanding_percent_below, percent_below
from ..registry import query
from ..sources.frames import DAILY, MULTI, bars_daily, bars_multi, rounded
from .recursive import SCANS, scanned

INDICATORS: dict[str, Callable[..., dict[str, Column]]] = {}


def indicator(name: str, *needs: str, **defaults):
    """Register f(**params) -> columns; needs: input columns; defaults: parameters (None overrides are ignored)."""

    def put(f):
        if name in INDICATORS:
            raise ValueError(f"indicator {name} is registered twice")
        f.needs, f.defaults = needs, defaults
        INDICATORS[name] = f
        return f

    return put


#: Inputs that are made of others where they are missing themselves: product or ratio of two columns.
DERIVED = {
    "market_cap": ("close", "supply", "product"), "realized_cap": ("realized_price", "supply", "product"), "sopr": ("realized_value", "created_value", "ratio"),
    "asopr": ("adjusted_realized_value", "adjusted_created_value", "ratio"), "lth_sopr": ("lth_realized_value", "lth_created_value", "ratio"), "hodl_bank": ("close", "hodl_days", "product"),
}


def with_derived(bars: DataFrame, needs: list[str]) -> DataFrame:
    """bars with the needed columns that can be derived."""
    made = {}
    for c in needs:
        if c not in bars.columns and c in DERIVED and set(DERIVED[c][:2]) <= set(bars.columns):
            a, b, how = DERIVED[c]
            made[c] = F.col(a) * F.col(b) if how == "product" else F.try_divide(a, b)
    return bars.withColumns(made)


def framed_rank(bars: DataFrame, lookback: int | None = None, column: str | None = None) -> DataFrame:
    """Percentile rank of a column (close) among all earlier values, or among the `lookback` before."""
    c = column or "close"
    if lookback is None:
        return expanding_percent_below(bars, "value", c).select("symbol", "time", "value")
    return percent_below(bars, {"value": c}, lookback + 1, exclude_self=True).select("symbol", "time", "value")


#: Indicators that are no column expressions: code -> f(bars, **params) -> symbol, time and the columns.
FRAMED = {"tech.percentile_rank": framed_rank} | {name: (lambda bars, name=name, **params: scanned(bars, name, **params)) for name in SCANS}


def codes() -> list[str]:
    """All indicators that calculate() knows."""
    return sorted({*INDICATORS, *FRAMED})


def calculate(bars: DataFrame, name: str, **params) -> DataFrame:
    """One indicator's frame."""
    if name in FRAMED:
        return FRAMED[name](bars, **params)
    f = INDICATORS[name]
    bars = with_derived(bars, f.needs)
    used = f.defaults | {k: v for k, v in params.items() if v is not None}
    missing = [c for c in f.needs if c not in bars.columns]
    base = bars.withColumns({c: F.lit(None).cast("double") for c in missing})
    return base.select("symbol", "time", *[c.alias(k) for k, c in f(**used).items()])


def calculate_batch(bars: DataFrame, names: list[str], params: dict | None = None) -> DataFrame:
    """Several indicators side by side, as columns named code.column; unknown names are skipped."""
    bars = with_derived(bars, sorted({c for n in names if n in INDICATORS for c in INDICATORS[n].needs}))
    columns, missing = [], {c for n in names if n in INDICATORS for c in INDICATORS[n].needs if c not in bars.columns}
    base = bars.withColumns({c: F.lit(None).cast("double") for c in sorted(missing)})
    for n in names:
        if n in INDICATORS:
            f = INDICATORS[n]
            columns += [c.alias(f"{n.split('.', 1)[1].replace('.', '_')}_{k}") for k, c in f(**(f.defaults | (params or {}).get(n, {}))).items()]
    out = base.select("symbol", "time", *columns)
    for n in names:
        if n in FRAMED:
            own = calculate(bars, n, **(params or {}).get(n, {}))
            out = out.join(own.select("symbol", "time", *[F.col(c).alias(f"{n.split('.', 1)[1].replace('.', '_')}_{c}") for c in own.columns[2:]]), ["symbol", "time"], "left")
    return out


@indicator("tech.sma", "close", period=50)
def sma(period):
    return {"value": rolling_mean("close", period)}


@indicator("tech.wma", "close", period=50)
def wma(period):
    return {"value": weighted_mean("close", period)}


@indicator("tech.bollinger", "close", period=20, std_dev=2.0)
def bollinger(period, std_dev):
    mid, std = rolling_mean("close", period), rolling_std("close", period)
    up, low = mid + std_dev * std, mid - std_dev * std
    return {"upper": up, "middle": mid, "lower": low, "bandwidth": F.try_divide(up - low, mid), "percent_b": F.when(up - low > 0, F.try_divide(F.col("close") - low, up - low))}


@indicator("tech.vwap", "high", "low", "close", "volume", anchor="none")
def vwap(anchor):
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    total = running_sum if anchor == "none" else (lambda c: anchored_sum(c, "day" if anchor == "session" else anchor))
    value = F.try_divide(total(typical * F.col("volume")), total(F.col("volume").cast("double")))
    return {"value": value, "vwap_deviation": F.try_divide(F.col("close"), value) - 1}


@indicator("tech.hv", "_log_return", period=30, days=365)
def hv(period, days):
    value = rolling_std("_log_return", period) * F.sqrt(F.lit(float(days)))
    return {"value": value, "hv_percent": value * 100}


@indicator("onchain.mvrv", "market_cap", "realized_cap", z_window=0)
def mvrv(z_window):
    cap, realized = F.col("market_cap"), F.col("realized_cap")
    std = rolling_std("market_cap", z_window) if z_window else expanding_std("market_cap")
    return {"value": safe_divide(cap, realized), "mvrv_z": F.when(std > 0, (cap - realized) / std)}


def _sopr(c):
    return lambda smooth: {"value": F.col(c), "sma7": rolling_mean(c, smooth, least=1)}


indicator("onchain.sopr", "sopr", smooth=7)(_sopr("sopr"))
indicator("onchain.sopr.adjusted", "asopr", smooth=7)(_sopr("asopr"))
indicator("onchain.sopr.lth", "lth_sopr", smooth=7)(_sopr("lth_sopr"))


@indicator("onchain.nupl", "market_cap", "realized_cap")
def nupl():
    return {"value": safe_divide(F.col("market_cap") - F.col("realized_cap"), "market_cap")}


@indicator("onchain.puell_multiple", "miner_revenue", window=365, least=365)
def puell(window, least):
    return {"value": F.try_divide(F.col("miner_revenue"), rolling_mean("miner_revenue", window, least))}


@indicator("onchain.rhodl", "sth_value", "lth_value")
def rhodl():
    return {"value": safe_divide("sth_value", "lth_value")}


@indicator("onchain.reserve_risk", "close", "hodl_bank")
def reserve_risk():
    value = safe_divide("close", "hodl_bank")
    return {"value": value, "log10": F.when(value > 0, F.log10(value))}


@indicator("deriv.funding_rate", "funding_rate", per_day=3, per_year=365, window=30, long=0.30, short=-0.20)
def funding(per_day, per_year, window, long, short):
    year = F.col("funding_rate") * per_day * per_year
    return {"value": F.col("funding_rate"), "annualized": year, "annualized_percent": year * 100, "rolling_mean": rolling_mean("funding_rate", window, least=1), "extreme": F.when(year > long, 1.0).when(year < short, -1.0).when(year.isNotNull(), 0.0)}


@indicator("deriv.open_interest", "open_interest", "market_cap", "_oi_return", "_price_return", change=1, window=30)
def open_interest(change, window):
    before = previous("open_interest", change)
    return {"value": F.col("open_interest"), "oi_change": F.when(before > 0, F.col("open_interest") / before - 1), "price_corr": rolling_correlation("_oi_return", "_price_return", window), "oi_mcap_ratio": F.when(F.col("market_cap") > 0, F.col("open_interest") / F.col("market_cap"))}


@indicator("deriv.cvd", "buy_volume", "sell_volume", anchor="none")
def cvd(anchor):
    delta = F.col("buy_volume") - F.col("sell_volume")
    return {"value": running_sum(delta) if anchor == "none" else anchored_sum(delta, anchor), "volume_delta": delta}


@indicator("composite.ath", "high")
def ath():
    return {"value": running_max("high")}


@indicator("composite.distance_from_ath", "high")
def distance():
    d = F.try_divide(F.col("high"), running_max("high")) - 1
    return {"value": d, "distance_percent": d * 100}


@indicator("composite.ath_breakout", "high")
def breakout():
    return {"value": F.when(F.coalesce(F.col("high") >= F.max("high").over(W().rowsBetween(UNBOUNDED, -1)), F.lit(True)), 1.0).otherwise(0.0)}


@indicator("composite.drawdown", "close", rolling=90)
def drawdown(rolling):
    d = F.try_divide(F.col("close"), running_max("close")) - 1
    out = {"value": d, "dd_percent": d * 100}
    return out | ({"dd_rolling": F.try_divide(F.col("close"), rolling_max("close", rolling)) - 1} if rolling else {})


@indicator("composite.max_drawdown", "_drawdown")
def max_drawdown():
    return {"value": F.min("_drawdown").over(W().rowsBetween(UNBOUNDED, 0))}


@indicator("composite.drawdown_duration", "_row", "_peak_row")
def duration():
    return {"value": (F.col("_row") - F.max("_peak_row").over(W().rowsBetween(UNBOUNDED, 0))).cast("double")}


def prepared(bars: DataFrame) -> DataFrame:
    """bars with the columns that nested window expressions need, over the same ordering."""
    peak = running_max("close")
    out = bars.withColumn("_log_return", log_return("close")).withColumn("_price_return", simple_return("close")).withColumn("_drawdown", F.try_divide(F.col("close"), peak) - 1)
    out = out.withColumn("_row", F.row_number().over(W())).withColumn("_peak_row", F.when(F.col("close") >= peak, F.col("_row")))
    return out.withColumn("_oi_return", simple_return("open_interest")) if "open_interest" in bars.columns else out


def research_frame(spark, sf_dir) -> DataFrame:
    """Bars with stand-ins for capitalizations, revenues, rates and volumes by side, derived from their prices."""
    b = bars_multi(spark, sf_dir)
    v = F.col("volume").cast("double")
    return prepared(b.withColumns({
        "market_cap": F.col("close") * 19e6, "realized_cap": (F.col("open") + F.col("low")) / 2 * 19e6, "miner_revenue": F.col("high") * 900, "sth_value": F.col("high") - F.col("low"), "lth_value": F.col("close"),
        "hodl_bank": F.col("open") * 50, "sopr": F.try_divide("close", "open"), "asopr": F.try_divide("close", "low"), "lth_sopr": F.try_divide("high", "low"), "funding_rate": (F.col("close") - F.col("open")) / F.col("open") / 1000,
        "open_interest": v * F.col("close"), "buy_volume": v * 0.6, "sell_volume": F.col("close") / 1e5}))


FRAME = MULTI + """, f AS (SELECT *, close * 19e6 AS market_cap, (open + low) / 2 * 19e6 AS realized_cap, high * 900 AS miner_revenue, high - low AS sth_value, close AS lth_value, open * 50 AS hodl_bank, close / open AS sopr, close / low AS asopr,
  high / low AS lth_sopr, (close - open) / open / 1000 AS funding_rate, CAST(volume AS DOUBLE) * close AS open_interest, CAST(volume AS DOUBLE) * 0.6 AS buy_volume, close / 1e5 AS sell_volume, row_number() OVER w AS rn,
  ln(close / lag(close) OVER w) AS lr, close / lag(close) OVER w - 1 AS pr, max(close) OVER w AS peak, max(high) OVER w AS ath FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time)),
g AS (SELECT *, open_interest / lag(open_interest) OVER w - 1 AS oir, CASE WHEN close >= peak THEN rn END AS peak_row, close / peak - 1 AS dd FROM f WINDOW w AS (PARTITION BY symbol ORDER BY time))"""
OVER = "WINDOW w AS (PARTITION BY symbol ORDER BY time)"


def _mean(c, n, least=None):
    return f"CASE WHEN count({c}) OVER (w ROWS {n - 1} PRECEDING) >= {least or n} THEN avg({c}) OVER (w ROWS {n - 1} PRECEDING) END"


def _std(c, n):
    return f"CASE WHEN count({c}) OVER (w ROWS {n - 1} PRECEDING) >= {n} THEN stddev_samp({c}) OVER (w ROWS {n - 1} PRECEDING) END"


#: Select lists for DuckDB: indicator -> column -> (expression, digits).
_SQL = {
    "tech.sma": {"value": (_mean("close", 50), 4)},
    "tech.bollinger": {"upper": (f"{_mean('close', 20)} + 2 * {_std('close', 20)}", 3), "middle": (_mean("close", 20), 4), "lower": (f"{_mean('close', 20)} - 2 * {_std('close', 20)}", 3),
                       "bandwidth": (f"4 * {_std('close', 20)} / ({_mean('close', 20)})", 6), "percent_b": (f"(close - ({_mean('close', 20)} - 2 * {_std('close', 20)})) / (4 * {_std('close', 20)})", 6)},
    "tech.vwap": {"value": ("sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w", 4), "vwap_deviation": ("close / (sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w) - 1", 6)},
    "tech.hv": {"value": (f"{_std('lr', 30)} * sqrt(365)", 6), "hv_percent": (f"{_std('lr', 30)} * sqrt(365) * 100", 4)},
    "onchain.mvrv": {"value": ("market_cap / realized_cap", 6), "mvrv_z": ("CASE WHEN rn >= 2 THEN (market_cap - realized_cap) / stddev_samp(market_cap) OVER w END", 5)},
    "onchain.sopr": {"value": ("sopr", 6), "sma7": (_mean("sopr", 7, 1), 6)}, "onchain.sopr.adjusted": {"value": ("asopr", 6), "sma7": (_mean("asopr", 7, 1), 5)}, "onchain.sopr.lth": {"value": ("lth_sopr", 6), "sma7": (_mean("lth_sopr", 7, 1), 5)},
    "onchain.nupl": {"value": ("(market_cap - realized_cap) / market_cap", 6)}, "onchain.puell_multiple": {"value": (f"miner_revenue / ({_mean('miner_revenue', 365)})", 6)}, "onchain.rhodl": {"value": ("sth_value / lth_value", 6)},
    "onchain.reserve_risk": {"value": ("close / hodl_bank", 6), "log10": ("log10(close / hodl_bank)", 6)},
    "deriv.funding_rate": {"value": ("funding_rate", 9), "annualized": ("funding_rate * 3 * 365", 6), "annualized_percent": ("funding_rate * 3 * 365 * 100", 5), "rolling_mean": (_mean("funding_rate", 30, 1), 8),
                           "extreme": ("CASE WHEN funding_rate * 3 * 365 > 0.3 THEN 1.0 WHEN funding_rate * 3 * 365 < -0.2 THEN -1.0 ELSE 0.0 END", 1)},
    "deriv.open_interest": {"value": ("open_interest", 3), "oi_change": ("oir", 6), "price_corr": ("CASE WHEN count(oir) OVER (w ROWS 29 PRECEDING) >= 2 THEN corr(oir, pr) OVER (w ROWS 29 PRECEDING) END", 4), "oi_mcap_ratio": ("open_interest / market_cap", 9)},
    "deriv.cvd": {"value": ("sum(buy_volume - sell_volume) OVER w", 9), "volume_delta": ("buy_volume - sell_volume", 9)},
    "composite.ath": {"value": ("ath", 4)}, "composite.distance_from_ath": {"value": ("high / ath - 1", 6), "distance_percent": ("(high / ath - 1) * 100", 5)},
    "composite.ath_breakout": {"value": ("CASE WHEN coalesce(high >= max(high) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN 1.0 ELSE 0.0 END", 1)},
    "composite.drawdown": {"value": ("dd", 6), "dd_percent": ("dd * 100", 5), "dd_rolling": ("close / max(close) OVER (w ROWS 89 PRECEDING) - 1", 6)},
    "composite.max_drawdown": {"value": ("min(dd) OVER w", 6)}, "composite.drawdown_duration": {"value": ("rn - max(peak_row) OVER w", 1)},
}


def _register():
    for name, columns in _SQL.items():
        digits = {k: d for k, (_, d) in columns.items()}
        select = ", ".join(f"round(CAST({e} AS DOUBLE), {d}) AS {k}" for k, (e, d) in columns.items())
        sql = f"WITH {FRAME} SELECT symbol, time, {select} FROM g {OVER}"
        query(f"indicator_{name.replace('.', '_')}", sql)(lambda spark, sf_dir, name=name, digits=digits: rounded(calculate(research_frame(spark, sf_dir), name), 6, **digits))


_register()


@query("indicator_frame", f"""WITH {DAILY}, p AS (SELECT *, row_number() OVER w AS rn, avg(close) OVER f AS m, stddev_samp(close) OVER f AS s, max(close) OVER w AS peak FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time), f AS (PARTITION BY symbol ORDER BY time ROWS 19 PRECEDING))
  SELECT symbol, time, close, round(CASE WHEN rn >= 20 THEN m END, 4) AS sma20, round(CASE WHEN rn >= 20 THEN m + 2 * s END, 3) AS upper, round(CASE WHEN rn >= 20 THEN m - 2 * s END, 3) AS lower, round(close / peak - 1, 6) AS drawdown FROM p""")
def indicator_frame(spark, sf_dir):
    """Daily bars with moving average, bands and drawdown: the flagship."""
    b = bars_daily(spark, sf_dir)
    bands = bollinger(20, 2.0)
    return rounded(b.select("symbol", "time", "close", bands["middle"].alias("sma20"), bands["upper"].alias("upper"), bands["lower"].alias("lower"), drawdown(0)["value"].alias("drawdown")), 4, upper=3, lower=3, drawdown=6).orderBy("time")


_BATCH = {f"{n.split('.', 1)[1].replace('.', '_')}_{k}": (e, d) for n, columns in sorted(_SQL.items()) for k, (e, d) in columns.items()}


@query("indicator_batch", f"WITH {FRAME} SELECT symbol, time, {', '.join(f'round(CAST({e} AS DOUBLE), {d}) AS {k}' for k, (e, d) in _BATCH.items())} FROM g {OVER}")
def indicator_batch(spark, sf_dir):
    """All window indicators at once: one shuffle and one sort of the bars."""
    found = calculate_batch(research_frame(spark, sf_dir), sorted(_SQL))
    return found.select("symbol", "time", *[F.round(k, d).alias(k) for k, (_, d) in _BATCH.items()])


@query("indicator_tech_percentile_rank", f"""WITH {MULTI}, l AS (SELECT symbol, time, close, list(close) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, list(close) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) AS b FROM bars)
  SELECT symbol, time, round(CASE WHEN len(a) >= 2 THEN 100.0 * len(list_filter(a, lambda x: x < close)) / len(a) END, 6) AS value, round(CASE WHEN len(b) >= 1 THEN 100.0 * len(list_filter(b, lambda x: x < close)) / len(b) END, 6) AS last_90 FROM l""")
def q_percentile_rank(spark, sf_dir):
    """With its default, all earlier rows, and with a window."""
    b = bars_multi(spark, sf_dir)
    whole, part = calculate(b, "tech.percentile_rank"), calculate(b, "tech.percentile_rank", lookback=90).withColumnRenamed("value", "last_90")
    return rounded(whole.join(part, ["symbol", "time"]), 6)


@query("indicator_tech_wma", f"""WITH {MULTI} SELECT symbol, time, round(CASE WHEN row_number() OVER w >= 50 THEN ({' + '.join(f'{50 - k}.0 * lag(close, {k}) OVER w' for k in range(50))}) / 1275 END, 4) AS value
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time)""")
def q_wma(spark, sf_dir):
    return rounded(calculate(bars_multi(spark, sf_dir), "tech.wma").select("symbol", "time", "value"))
