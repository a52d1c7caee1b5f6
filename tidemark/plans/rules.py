"""Investment rules as data: conditions over prices, indicators, ranks, states and dates, and what a plan does where they hold.

A rule is a dictionary: id, priority, if (a condition), then (an action), and optionally enabled and description. Conditions compile
to nullable boolean columns, so that a value that is not known makes a condition unknown, by SQL's own logic, and an unknown rule
does nothing but is named. All rules of a plan are one projection over all rows: no row waits for another.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import full as full_window
from ..functions.windows import last_rows
from ..registry import query
from ..sources.frames import bars_multi, rounded
from .backtest import vectorized
from .engines import REGIME_LABELS, REGIME_LIMITS, RISK_LEVELS, RISK_LIMITS, VALUATION_LEVELS, VALUATION_LIMITS
from .factors import SQL_METRICS, SQL_REGIME, _named, full, metrics

DEPTH = 3  # of conditions inside conditions
BOUNDS: dict[str, Callable] = {"gt": lambda v, t: v > t, "gte": lambda v, t: v >= t, "lt": lambda v, t: v < t, "lte": lambda v, t: v <= t}


def columns_of(names: dict[str, str | Column]) -> Callable[[str], Column]:
    """Looks up what conditions speak of, such as price, indicators.mvrv, percentiles.mvrv, ma.sma200d, risk_level or date; what is not there is unknown."""
    known = {k: F.col(v) if isinstance(v, str) else v for k, v in names.items()}
    return lambda name: known.get(name, F.lit(None))


def _within(v: Column, spec: dict) -> Column:
    """True where v keeps all bounds of the spec, unknown where v is NULL or NaN."""
    number = F.nanvl(v.cast("double"), F.lit(None).cast("double"))
    kept = reduce(lambda a, b: a & b, [test(number, F.lit(float(spec[k]))) for k, test in BOUNDS.items() if spec.get(k) is not None], F.lit(True))
    return F.when(number.isNotNull(), kept)


def _among(v: Column, wanted: list) -> Column:
    return F.when(v.isNotNull(), v.isin(*wanted) if wanted else F.lit(False))


def _leveled(v: Column, spec: dict) -> Column:
    if spec.get("in") is not None:
        return _among(v, spec["in"])
    place = F.array_position(F.array(*map(F.lit, RISK_LEVELS)), v) - 1
    asked = {k: RISK_LEVELS.index(spec[k]) for k in ("gte", "lte") if spec.get(k) is not None}
    return _within(F.when(place >= 0, place), asked)


def _to_average(metric, spec: dict) -> Column:
    price, average = metric("price").cast("double"), metric(f"ma.{spec.get('ma', 'sma200d')}").cast("double")
    return price < average if spec.get("side", "above") == "below" else price > average


def _dated(day: Column, spec: dict) -> Column:
    text = F.date_format(day, "yyyy-MM-dd")
    kept = (text >= spec["from"] if spec.get("from") else F.lit(True)) & (text <= spec["to"] if spec.get("to") else F.lit(True))
    return F.when(text.isNotNull(), kept)


#: How each kind of condition reads the columns.
KINDS: dict[str, Callable[[Callable, dict], Column]] = {
    "price_below": lambda m, s: _within(m(s.get("field", "price")), {"lte": s["value"]}),
    "price_above": lambda m, s: _within(m(s.get("field", "price")), {"gte": s["value"]}),
    "price_vs_ma": _to_average,
    "drawdown_from_ath": lambda m, s: _within(m("distance_from_ath"), {k: s.get(k) for k in ("lte", "gt")}),
    "drawdown_from_recent_high": lambda m, s: _within(m("drawdown_from_recent"), {"lte": -abs(float(s.get("lte", s.get("threshold", 0))))}),
    "indicator_value": lambda m, s: _within(m(f"indicators.{s['code']}"), s),
    "indicator_percentile": lambda m, s: _within(m(f"percentiles.{s['code']}"), s),
    "funding_annualized": lambda m, s: _within(m("indicators.funding_annualized"), {k: s.get(k) for k in ("lte", "gte")}),
    "risk_level": lambda m, s: _leveled(m("risk_level"), s),
    "valuation_state": lambda m, s: _among(m("valuation_state"), s.get("in", [])),
    "cycle_stage": lambda m, s: _among(m("cycle_stage"), s.get("in", [])),
    "regime_label": lambda m, s: _among(m("regime_label"), s.get("in", [])),
    "date_range": lambda m, s: _dated(m("date"), s),
    "day_of_month": lambda m, s: F.dayofmonth(m("date")) == int(s["eq"]),
    "day_of_week": lambda m, s: F.weekday(m("date")) + 1 == int(s["eq"]),
}


def condition(spec: dict, metric: Callable[[str], Column], depth: int = 1) -> Column:
    """A condition (op and its arguments, or all, any, not of others) as a column that is true, false or NULL. price_vs_ma has side, above or below (above if none is given)."""
    if depth > DEPTH:
        raise ValueError(f"conditions are nested deeper than {DEPTH}")
    if "not" in spec:
        inner = spec["not"] if isinstance(spec["not"], list) else [spec["not"]]
        if len(inner) != 1:
            raise ValueError("not takes one condition")
        return ~condition(inner[0], metric, depth + 1)
    for joiner, join in (("all", lambda a, b: a & b), ("any", lambda a, b: a | b)):
        if joiner in spec:
            return reduce(join, [condition(s, metric, depth + 1) for s in spec[joiner]], F.lit(joiner == "all"))
    if spec.get("op") not in KINDS:
        raise ValueError(f"unknown condition {spec.get('op')!r}")
    return KINDS[spec["op"]](metric, spec).cast("boolean")


ACTIONS = ("multiply_amount", "fixed_amount", "extra_buy", "skip", "pause", "notify_only")


def decided(df: DataFrame, rules: list[dict], base: float | Column, metric: Callable[[str], Column]) -> DataFrame:
    """df and what its rules decide for every row: multiplier, fixed, extra, skip, pause_days, triggered, unknown, messages (arrays), conflict and amount.

    Rules act in order of priority, then of the list: multipliers compound, the last fixed amount stands in for them, extra amounts
    add up, of pauses the longest counts, a skip makes the amount nothing. Inside one priority a fixed amount keeps multipliers
    after it from acting; the two together are a conflict.
    """
    active = sorted((r for r in rules if r.get("enabled", True)), key=lambda r: int(r.get("priority", 50)))
    for r in active:
        if r["then"].get("op") not in ACTIONS:
            raise ValueError(f"unknown action {r['then'].get('op')!r}")
    hit = {k: F.coalesce(F.col(f"_rule{k}"), F.lit(False)) for k in range(len(active))}
    of = lambda *ops: [k for k, r in enumerate(active) if r["then"]["op"] in ops]
    level_of = lambda k: int(active[k].get("priority", 50))
    argument = lambda k, name, otherwise: float(active[k]["then"].get(name) or otherwise)
    any_of = lambda ks: reduce(lambda a, b: a | b, [hit[k] for k in ks], F.lit(False))
    total = lambda parts, start, join: reduce(join, parts, F.lit(start))

    multiplier = F.lit(1.0)
    for k in of("multiply_amount"):
        held_back = any_of([j for j in of("fixed_amount") if j < k and level_of(j) == level_of(k)])
        multiplier = multiplier * F.when(hit[k] & ~held_back, argument(k, "factor", 1)).otherwise(1.0)
    fixed = F.coalesce(*[F.when(hit[k], argument(k, "value", 0)) for k in reversed(of("fixed_amount"))], F.lit(None).cast("double"))
    both = [any_of([k for k in of("multiply_amount") if level_of(k) == p]) & any_of([k for k in of("fixed_amount") if level_of(k) == p]) for p in sorted({level_of(k) for k in of("fixed_amount")})]
    pauses = [F.when(hit[k], int(active[k]["then"].get("days") or 0)) for k in of("pause")]
    present = lambda parts: F.filter(F.array(*parts), lambda x: x.isNotNull()) if parts else F.array().cast("array<string>")
    name = lambda k: str(active[k].get("id", active[k].get("name", "rule")))
    message = lambda k: active[k].get("description") or active[k]["then"].get("message") or " ".join(str(v) for v in active[k]["then"].values())

    out = df.withColumns({f"_rule{k}": condition(r["if"], metric) for k, r in enumerate(active)}) if active else df
    out = out.withColumns({
        "multiplier": multiplier, "fixed": fixed, "extra": total([F.when(hit[k], argument(k, "value", 0)).otherwise(0.0) for k in of("extra_buy")], 0.0, lambda a, b: a + b), "skip": any_of(of("skip")),
        "pause_days": F.array_max(F.array(*pauses)).cast("int") if pauses else F.lit(None).cast("int"), "conflict": total(both, False, lambda a, b: a | b),
        "triggered": present([F.when(hit[k], name(k)) for k in hit]), "unknown": present([F.when(F.col(f"_rule{k}").isNull(), name(k)) for k in hit]),
        "messages": present([F.when(hit[k], message(k)) for k in of("skip", "pause", "notify_only")])})
    amount = F.when(F.col("skip"), 0.0).otherwise(F.coalesce(F.col("fixed"), F.lit(base) * F.col("multiplier")) + F.col("extra"))
    return out.withColumn("amount", amount).drop(*[f"_rule{k}" for k in hit])


def rule_multiplier(df: DataFrame, rules: list[dict], base: float, metric: Callable[[str], Column]) -> DataFrame:
    """df with rule_multiplier, by which the strategy rule_based of a backtest scales its base: 0 by a skip, a fixed amount's share of the base, else the multipliers. Extra amounts are no part of it."""
    told = decided(df, rules, base, metric)
    by_fixed = F.col("fixed") / base if base > 0 else F.when(F.col("fixed").isNotNull(), 1.0)
    times = F.when(F.col("skip"), 0.0).otherwise(F.coalesce(by_fixed, F.col("multiplier")))
    return told.select(*df.columns, times.alias("rule_multiplier"))


#: A plan whose rules use every kind of condition and action.
PLAN_RULES = [
    {"id": "deep_value", "priority": 10, "if": {"all": [{"op": "drawdown_from_ath", "lte": -0.5, "gt": -0.9}, {"op": "indicator_value", "code": "mvrv", "lte": 0.8}]}, "then": {"op": "multiply_amount", "factor": 2}},
    {"id": "cheap", "priority": 10, "if": {"any": [{"op": "indicator_percentile", "code": "mvrv", "lte": 20}, {"op": "valuation_state", "in": ["DEEP_UNDERVALUED", "UNDERVALUED"]}]}, "then": {"op": "multiply_amount", "factor": 1.5}},
    {"id": "over_average", "priority": 20, "if": {"op": "price_vs_ma", "ma": "sma200d", "side": "above"}, "then": {"op": "multiply_amount", "factor": 0.8}},
    {"id": "hot_funding", "priority": 20, "if": {"op": "funding_annualized", "gte": 0.5}, "then": {"op": "fixed_amount", "value": 40}},
    {"id": "dear", "priority": 20, "if": {"op": "price_above", "value": 200000}, "then": {"op": "multiply_amount", "factor": 0.5}},
    {"id": "risky", "priority": 30, "if": {"all": [{"op": "risk_level", "gte": "HIGH"}, {"not": {"op": "cycle_stage", "in": ["BEAR", "DEEP_BEAR", "BOTTOM_BUILDING"]}}]}, "then": {"op": "skip"}},
    {"id": "first_of_month", "priority": 40, "if": {"op": "day_of_month", "eq": 1}, "then": {"op": "extra_buy", "value": 25}},
    {"id": "monday", "priority": 50, "if": {"all": [{"op": "day_of_week", "eq": 1}, {"op": "date_range", "from": "1996-01-01", "to": "1999-12-31"}]}, "then": {"op": "notify_only", "message": "week begins"}},
    {"id": "euphoric", "priority": 50, "if": {"op": "regime_label", "in": ["Euphoria", REGIME_LABELS[-1]]}, "then": {"op": "pause", "days": 14}},
    {"id": "panic", "priority": 60, "if": {"op": "price_below", "value": 20000}, "then": {"op": "pause", "days": 30}},
    {"id": "off", "priority": 1, "enabled": False, "if": {"op": "price_above", "value": 0}, "then": {"op": "skip"}},
    {"id": "fallen", "priority": 5, "if": {"op": "drawdown_from_recent_high", "threshold": 0.3}, "then": {"op": "extra_buy", "value": 10}},
]


def market(bars: DataFrame, engines: bool = True) -> tuple[DataFrame, Callable[[str], Column]]:
    """Bars with all that rules ask for, and the names by which they ask; without the engines' states those are unknown."""
    f = (full if engines else metrics)(bars)
    f = f.withColumns({"_sma": full_window(F.avg("close").over(last_rows(200)), "close", 200, last_rows(200)), "_recent": F.col("close") / F.max("high").over(last_rows(90)) - 1, "_annual": F.round(F.col("funding") * 3 * 365, 9)})
    names = {"price": "close", "date": "time", "distance_from_ath": "dd", "drawdown_from_recent": "_recent", "ma.sma200d": "_sma", "indicators.mvrv": "mvrv", "indicators.nupl": "nupl", "indicators.funding_annualized": "_annual"}
    if engines:
        names |= {"percentiles.mvrv": F.round("pct_mvrv", 9), "risk_level": "risk_level", "valuation_state": "valuation_level", "cycle_stage": "ruled_phase", "regime_label": "label"}
    return f, columns_of(names)


_LABEL = f"CASE WHEN ruled_phase = 'TOP_RISK' AND regime > 0 THEN 'Euphoria' ELSE {_named('round(regime, 9)', REGIME_LIMITS, REGIME_LABELS)} END"
_HITS = {
    "fallen": "recent <= -0.3", "deep_value": "dd <= -0.5 AND dd > -0.9 AND mvrv <= 0.8", "cheap": "round(pm, 9) <= 20 OR valuation_level IN ('DEEP_UNDERVALUED', 'UNDERVALUED')", "over_average": "close > sma", "hot_funding": "round(a, 9) >= 0.5",
    "dear": "close >= 200000", "risky": "risk_level IN ('HIGH', 'VERY_HIGH', 'EXTREME') AND NOT ruled_phase IN ('BEAR', 'DEEP_BEAR', 'BOTTOM_BUILDING')", "first_of_month": "day(time) = 1",
    "monday": "isodow(time) = 1 AND time >= TIMESTAMP '1996-01-01' AND time < TIMESTAMP '2000-01-01'", "euphoric": f"label IN ('Euphoria', '{REGIME_LABELS[-1]}')", "panic": "close <= 20000",
}


@query("portfolio_rule_decisions", f"""WITH {SQL_REGIME}, x0 AS (SELECT *, CASE WHEN count(close) OVER (w ROWS 199 PRECEDING) >= 200 THEN avg(close) OVER (w ROWS 199 PRECEDING) END AS sma, close / max(high) OVER (w ROWS 89 PRECEDING) - 1 AS recent,
    {_named('round(risk, 9)', RISK_LIMITS, RISK_LEVELS)} AS risk_level, {_named('round(valuation, 9)', VALUATION_LIMITS, VALUATION_LEVELS)} AS valuation_level, {_LABEL} AS label FROM g WINDOW w AS (PARTITION BY symbol ORDER BY time)),
  h0 AS (SELECT symbol, time, {', '.join(f'{sql} AS {n}' for n, sql in _HITS.items())} FROM x0), h AS (SELECT symbol, time, {', '.join(f'coalesce({n}, false) AS {n}' for n in _HITS)}, {', '.join(f'{n} IS NULL AS {n}_u' for n in _HITS)} FROM h0),
  d AS (SELECT *, CASE WHEN deep_value THEN 2.0 ELSE 1 END * CASE WHEN cheap THEN 1.5 ELSE 1 END * CASE WHEN over_average THEN 0.8 ELSE 1 END * CASE WHEN dear AND NOT hot_funding THEN 0.5 ELSE 1 END AS multiplier,
    CASE WHEN fallen THEN 10.0 ELSE 0 END + CASE WHEN first_of_month THEN 25 ELSE 0 END AS extra FROM h)
  SELECT symbol, time, CAST(multiplier AS DOUBLE) AS multiplier, CAST(CASE WHEN hot_funding THEN 40 END AS DOUBLE) AS fixed, CAST(extra AS DOUBLE) AS extra, risky AS skip, CAST(CASE WHEN panic THEN 30 WHEN euphoric THEN 14 END AS INT) AS pause_days,
    hot_funding AND (over_average OR dear) AS conflict, concat_ws(',', {', '.join(f"CASE WHEN {n} THEN '{n}' END" for n in _HITS)}) AS triggered, concat_ws(',', {', '.join(f"CASE WHEN {n}_u THEN '{n}' END" for n in _HITS)}) AS unknown,
    concat_ws(';', CASE WHEN risky THEN 'skip' END, CASE WHEN monday THEN 'week begins' END, CASE WHEN euphoric THEN 'pause 14' END, CASE WHEN panic THEN 'pause 30' END) AS messages,
    CAST(round(CASE WHEN risky THEN 0 WHEN hot_funding THEN 40 + extra ELSE 100 * multiplier + extra END, 6) AS DOUBLE) AS amount FROM d""")
def q_decisions(spark, sf_dir):
    """What a plan of eleven rules does on every day: 15 kinds of conditions, six kinds of actions."""
    f, names = market(bars_multi(spark, sf_dir))
    joined = lambda c, sep=",": F.array_join(c, sep).alias(c)
    d = decided(f, PLAN_RULES, 100.0, names)
    return rounded(d.select("symbol", "time", "multiplier", "fixed", "extra", "skip", "pause_days", "conflict", joined("triggered"), joined("unknown"), joined("messages", ";"), "amount"), 6)


BACKTEST_RULES = [
    {"id": "cheap", "priority": 10, "if": {"op": "indicator_value", "code": "mvrv", "lt": 0.7}, "then": {"op": "multiply_amount", "factor": 2.5}},
    {"id": "fallen", "priority": 20, "if": {"op": "drawdown_from_ath", "lte": -0.6}, "then": {"op": "multiply_amount", "factor": 1.2}},
    {"id": "risen", "priority": 30, "if": {"all": [{"op": "indicator_value", "code": "mvrv", "gte": 1.5}, {"op": "price_vs_ma", "side": "above"}]}, "then": {"op": "fixed_amount", "value": 30}},
    {"id": "dear", "priority": 40, "if": {"op": "price_above", "value": 350000}, "then": {"op": "skip"}},
]


@query("backtest_rule_based", f"""WITH {SQL_METRICS}, x AS (SELECT *, CASE WHEN count(close) OVER (w ROWS 199 PRECEDING) >= 200 THEN avg(close) OVER (w ROWS 199 PRECEDING) END AS sma FROM m WINDOW w AS (PARTITION BY symbol ORDER BY time)),
  s AS (SELECT symbol, time, open, close, CAST(CASE WHEN day(time) = 1 THEN 100.0 * CASE WHEN close >= 350000 THEN 0 WHEN mvrv >= 1.5 AND close > sma THEN 0.3 ELSE CASE WHEN mvrv < 0.7 THEN 2.5 ELSE 1 END * CASE WHEN dd <= -0.6 THEN 1.2 ELSE 1 END END ELSE 0 END AS DOUBLE) AS signal FROM x),
  a AS (SELECT *, coalesce(lag(signal) OVER (PARTITION BY symbol ORDER BY time), 0) AS amount FROM s)
  SELECT symbol, time, round(amount, 4) AS amount, round(sum(CASE WHEN amount > 0 THEN (amount - amount * 0.001) / (open * 1.0005) ELSE 0 END) OVER w, 9) AS btc FROM a WINDOW w AS (PARTITION BY symbol ORDER BY time)""")
def q_rule_based(spark, sf_dir):
    """A backtest whose amounts a plan's rules decide."""
    f, names = market(bars_multi(spark, sf_dir), engines=False)
    curve = vectorized(rule_multiplier(f, BACKTEST_RULES, 100.0, names), "rule_based")
    return rounded(curve.select("symbol", "time", "amount", "btc"), 4, btc=9)
