"""Factors of the scoring engines over a frame of metrics: cycle, valuation, risk and regime, all dates at once.

Every factor is a column of arithmetic on a row's metrics, NULL where its inputs are missing; fusions leave missing factors out.
The metrics themselves are stand-ins made from bars (`metrics`), as no such series are at hand; a table with the same columns
takes their place. Percentiles come from functions.ranks, what was known N days ago from lag() on the same ordering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import percent_below
from ..functions.scalars import level, ramp
from ..functions.windows import W, last_rows, running_max
from ..registry import query
from ..sources.frames import MULTI, bars_multi, rounded
from .engines import CONFIRMATIONS, FAST, LEAST_DAYS, TOP_RISK_DAYS, TRANSITIONS, debounced, PHASE_CENTERS, PHASE_LIMITS, PHASES, REGIME_LABELS, REGIME_LIMITS, RISK_LEVELS, RISK_LIMITS, RISK_WEIGHTS, VALUATION_LEVELS, VALUATION_LIMITS, floored, fuse, phase_probabilities, trend_score

# Weights of factors and dimensions, and the scalars of the regime's states.
CYCLE_WEIGHTS = {"price_trend": 0.25, "onchain": 0.20, "capital_flow": 0.15, "derivative": 0.12, "macro": 0.10, "sentiment": 0.08, "valuation_anchor": 0.10}
VALUATION_WEIGHTS = {"mvrv": 0.25, "realized_cap": 0.25, "cost_basis": 0.20, "trend": 0.15, "drawdown": 0.15}
RISK_DIMENSIONS = {
    "trend_risk": ("volatility_risk", "drawdown_risk"), "valuation_risk": ("valuation_risk_factor",), "leverage_risk": ("leverage_factor", "funding_risk", "oi_risk"),
    "liquidity_risk": ("liquidation_risk", "liquidity_factor", "crowding_risk"), "macro_risk": ("macro_factor",), "onchain_risk": ("onchain_factor",),
}
REGIME_WEIGHTS = {"trend": 0.15, "valuation": 0.10, "capital_flow": 0.15, "onchain": 0.15, "derivative": 0.10, "macro": 0.10, "sentiment": 0.10, "risk": 0.10, "cycle": 0.05}
STATES = {
    "trend": {"STRONG_UP": 0.9, "UP": 0.5, "NEUTRAL": 0.0, "DOWN": -0.5, "STRONG_DOWN": -0.9},
    "valuation": {"DEEP_UNDERVALUED": 0.9, "UNDERVALUED": 0.5, "FAIR": 0.0, "OVERVALUED": -0.5, "EXTREME_OVERVALUED": -0.9},
    "capital_flow": {"STRONG_INFLOW": 0.9, "INFLOW": 0.4, "NEUTRAL": 0.0, "OUTFLOW": -0.4, "STRONG_OUTFLOW": -0.9},
    "onchain": {"ACCUMULATION": 0.8, "NEUTRAL_ACC": 0.4, "NEUTRAL": 0.0, "NEUTRAL_DIST": -0.4, "DISTRIBUTION": -0.8},
    "derivative": {"MILD_BULL": 0.4, "CALM": 0.0, "MILD_BEAR": -0.4, "OVERHEATED": -0.2, "STRESSED": -0.7},
    "macro": {"SUPPORTIVE": 0.7, "NEUTRAL": 0.0, "HEADWIND": -0.5, "CRISIS": -0.9},
    "sentiment": {"EXTREME_FEAR": -0.9, "FEAR": -0.4, "NEUTRAL": 0.0, "GREED": 0.4, "EXTREME_GREED": 0.9},
    "risk": {"VERY_LOW": 0.6, "LOW": 0.3, "MODERATE": 0.0, "HIGH": -0.4, "VERY_HIGH": -0.7, "EXTREME": -0.9},
    "cycle": {"DEEP_BEAR": -1.0, "BEAR": -0.7, "BOTTOM_BUILDING": -0.4, "RECOVERY": -0.1, "UPTREND": 0.4, "ACCELERATION": 0.7, "DISTRIBUTION": 0.85, "TOP_RISK": 1.0, "DECLINE": -0.5},
}
DIVERGENCE, SHIFT, PRIOR_WEIGHT = 0.55, 0.3, 0.2
MARKET_CAP = 1.2e12
c = F.col


def metrics(bars: DataFrame) -> DataFrame:
    """Bars with stand-ins for on-chain, flow, derivative, macro and sentiment series."""
    w = W()
    f = bars.withColumns({
        "rp": F.avg("close").over(last_rows(200)), "v7": F.avg("volume").over(last_rows(7)), "v90": F.max("volume").over(last_rows(90)), "lo": F.min("close").over(last_rows(365)), "hi": F.max("close").over(last_rows(365)),
        "peak": running_max("close"), "rn": F.row_number().over(w), "flow": (c("close") - c("open")) * c("volume") * 1000})
    place = F.try_divide(c("close") - c("lo"), c("hi") - c("lo"))
    return f.withColumns({
        "mvrv": c("close") / c("rp"), "nupl": 1 - c("rp") / c("close"), "sopr": c("close") / c("open"), "lth_sth": 1.5 + 2 * c("volume") / c("v90"), "netflow": (c("volume") - c("v7")) * 1000,
        "etf_7d": F.sum("flow").over(last_rows(7)), "funding": (c("close") - c("open")) / c("open") / 1000, "oi_usd": c("volume") * 2e9, "dxy": 102 + 20 * (c("close") / c("rp") - 1), "fed_rate": 3.5 + 3 * (place - 0.5),
        "m2": F.lit(1.0), "fear_greed": 100 * place, "realized_cap": c("rp") * 19e6, "liquidation_usd": F.abs(c("close") - c("open")) * 3000, "long_short": 0.5 + 2.5 * place,
        "book_spread": (c("high") - c("low")) / c("close") / 1000, "book_depth": c("volume") * c("close") * 50, "whale": 0.5 + 2 * c("volume") / c("v90"), "dd": c("close") / c("peak") - 1})


def known_before(name: str, rows: int) -> Column:
    return F.lag(name, rows).over(W())


# Cycle: -1 (bottom) to 1 (top).

def parts_of(*parts: tuple[Column, float]) -> tuple[Column, Column]:
    """Weighted mean of the parts that there are, and the weight that they cover."""
    cover = sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in parts), F.lit(0.0))
    return fuse(list(parts)), cover


def bounded(x: Column) -> Column:
    """Within -1 and 1; NULL stays NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)))


def steps(x: Column, *pieces: tuple[float | None, Column]) -> Column:
    """The first piece whose limit x is below; the last one has no limit."""
    out = pieces[-1][1]
    for limit, value in reversed(pieces[:-1]):
        out = F.when(x < limit, value).otherwise(out)
    return F.when(x.isNotNull(), out)


def cycle_onchain():
    m, n = c("mvrv"), c("nupl")
    by_mvrv = steps(m, (1.0, 0.5 + (1 - m) * 1.5), (2.0, 0.5 - (m - 1) * 0.5), (3.5, (2 - m) * 0.4), (None, -0.6 - (m - 3.5) * 0.4))
    by_nupl = steps(n, (0.0, 0.5 - n * 2), (0.5, 0.5 - n * 0.8), (0.75, 0.1 - (n - 0.5) * 1.6), (None, -0.3 - (n - 0.75) * 2.8))
    return parts_of((bounded(by_mvrv), 0.35), (bounded(by_nupl), 0.25), (bounded((c("sopr") - 1) * 4), 0.20), (bounded((c("lth_sth") - 2.5) * 0.6), 0.20))


def cycle_capital_flow():
    return parts_of((bounded(-c("netflow") / 3000), 0.5), (bounded(c("etf_7d") / 5e8), 0.5))


def cycle_derivative():
    a, oi = c("funding") * 3 * 365, c("oi_usd")
    by_funding = steps(a, (-0.10, 0.3 - a * 2), (0.05, F.lit(0.1)), (0.20, 0.2 + (a - 0.05) * 3), (0.40, 0.65 - (a - 0.20) * 3), (None, 0.05 - (a - 0.40) * 2))
    by_interest = F.when(oi > 3e10, -0.4).when(oi > 2e10, -0.1).when(oi > 1e10, 0.1).when(oi.isNotNull(), 0.2)
    return parts_of((bounded(by_funding), 0.55), (by_interest, 0.45))


def cycle_macro():
    return parts_of((bounded((102 - c("dxy")) * 0.08), 0.40), (bounded((3.5 - c("fed_rate")) * 0.25), 0.35), (F.when(c("m2").isNotNull(), 0.15), 0.25))


def cycle_sentiment():
    return bounded((50 - c("fear_greed")) / 40)


def valuation_anchor(score: Column, compat: bool = False) -> Column:
    """A valuation of 0..100 on the scale of the cycle; compat: taken as if it were -1..1 already, which saturates."""
    return bounded(-score) if compat else bounded((50 - score) / 50)


# Valuation: 0 (low) to 100 (high).

def within(x: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def valuation_dimensions(f: DataFrame, years: int = 1800) -> DataFrame:
    """f with val_mvrv, val_realized_cap, val_cost_basis, val_trend, val_drawdown, valuation and valuation_level."""
    cost = F.when(c("nupl") < 1, 1 / (1 - c("nupl"))).when(c("nupl").isNotNull(), 10.0)
    ranked = percent_below(f.withColumn("cost", cost), {"pct_mvrv": "mvrv", "pct_cost": "cost", "pct_dd": "dd"}, years, 1)
    w, n = W(), c("rn").cast("double")
    enough = c("rn") >= 30
    m = c("mvrv")
    mvrv = steps(m, (1.0, m * 50), (2.0, (m - 1) * 50), (3.5, 50 + (m - 2) / 1.5 * 35), (None, F.least(F.lit(100.0), 85 + (m - 3.5) * 10)))  # falls at 1, as given
    growth = F.when(known_before("realized_cap", 90) > 0, c("realized_cap") / known_before("realized_cap", 90) - 1)
    by_growth = F.when(growth < -0.05, within(30 + (growth + 0.05) / 0.15 * 30, 0, 30)).when(growth <= 0.10, within(30 + growth / 0.10 * 30, 0, 60)).otherwise(ramp(growth, [(0.10, 60.0), (0.25, 85.0), (0.40, 100.0)]))
    by_cost = ramp(c("cost"), [(0.0, 0.0), (1.0, 15.0), (1.5, 40.0), (2.5, 65.0), (3.5, 85.0), (5.0, 100.0)])
    depth = ramp(-c("dd"), [(0.0, 90.0), (0.20, 65.0), (0.40, 45.0), (0.60, 25.0), (0.85, 0.0)])
    # Line through ln(close) of all rows so far, by running sums.
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = {"sx": F.sum(n).over(upto), "sy": F.sum(F.log("close")).over(upto), "sxx": F.sum(n * n).over(upto), "sxy": F.sum(n * F.log("close")).over(upto), "syy": F.sum(F.log("close") * F.log("close")).over(upto)}
    slope = (c("sxy") - c("sx") * c("sy") / n) / (c("sxx") - c("sx") * c("sx") / n)
    residual = F.log("close") - c("sy") / n - slope * (n - c("sx") / n)
    variance = (c("syy") - c("sy") * c("sy") / n) / n - slope * slope * (c("sxx") - c("sx") * c("sx") / n) / n
    deviation = F.when(c("rn") >= 200, residual / F.sqrt(F.greatest(variance, F.lit(1e-18))))
    scored = ranked.withColumns(sums).withColumns({
        "val_mvrv": within(F.when(enough, c("pct_mvrv") * 0.7 + mvrv * 0.3).otherwise(mvrv)), "val_realized_cap": F.when(growth.isNotNull(), by_growth),
        "val_cost_basis": within(F.when(enough, by_cost * 0.6 + c("pct_cost") * 0.4).otherwise(by_cost)), "val_trend": within(50 + deviation / 2 * 50),
        "val_drawdown": F.when(c("rn") >= 90, within(c("pct_dd") * 0.6 + depth * 0.4))}).drop(*sums)
    confidence = {"mvrv": F.when(enough, 1.0).otherwise(0.6), "realized_cap": F.lit(0.75), "cost_basis": F.when(enough, 0.8).otherwise(0.65), "trend": F.least(F.lit(1.0), n / 730), "drawdown": F.least(F.lit(1.0), n / 365)}
    weighed = [(c(f"val_{k}"), weight * F.greatest(confidence[k], F.lit(0.1))) for k, weight in VALUATION_WEIGHTS.items()]
    total = sum((F.when(s.isNotNull(), v).otherwise(0.0) for s, v in weighed), F.lit(0.0))
    scored = scored.withColumn("valuation", F.try_divide(sum((F.coalesce(s * v, F.lit(0.0)) for s, v in weighed), F.lit(0.0)), total))
    return scored.withColumn("valuation_level", level(F.round("valuation", 9), VALUATION_LIMITS, VALUATION_LEVELS))





# Risk: 0 to 100.

def risk_factors(f: DataFrame) -> DataFrame:
    """f (with valuation) and the eleven factors."""
    w = W()
    f = f.withColumn("_r", F.log(c("close") / F.lag("close").over(w)))
    f = f.withColumn("_vol", F.when(F.count("_r").over(last_rows(30)) >= 30, F.stddev_pop("_r").over(last_rows(30)) * F.sqrt(F.lit(365.0))))
    f = percent_below(f, {"_vol_pct": "_vol"}, 365, 1)
    a = F.abs(c("funding") * 3 * 365)
    oi_change = F.abs(c("oi_usd") / F.nullif(known_before("oi_usd", 7), F.lit(0)) - 1)
    spread = ramp(c("book_spread") * 100, [(0.01, 10.0), (0.05, 35.0), (0.2, 65.0), (0.5, 90.0)])
    million = c("book_depth") / 1e6
    depth = F.when(million < 1, 90.0).otherwise(ramp(million, [(1.0, 90.0), (5.0, 60.0), (20.0, 30.0), (50.0, 10.0)]))
    dxy_before, rate_before = known_before("dxy", 30), known_before("fed_rate", 90)
    momentum = F.when(c("dxy").isNotNull(), F.coalesce((c("dxy") - dxy_before) / dxy_before, F.lit(0.0)))
    by_rate = within((c("fed_rate") - 3.5) / 2 * 50 + 25)
    by_rate = within(by_rate + F.when(c("fed_rate") > rate_before + 0.01, 20.0).when(c("fed_rate") < rate_before - 0.01, -15.0).otherwise(0.0))
    ls, fg = c("long_short"), c("fear_greed")
    by_side = F.when(ls <= 0, None).when(ls.between(0.8, 2.0), 20.0).when(ls > 2, within(30 + (ls - 2) / 1.5 * 55)).otherwise(within(30 + (0.8 - ls) / 0.5 * 55))
    by_mood = F.when(fg >= 90, within(70 + (fg - 90) * 3)).when(fg >= 75, 40 + (fg - 75) * 2).when(fg <= 10, within(70 + (10 - fg) * 3)).when(fg <= 25, 40 + (25 - fg) * 2).when(fg.isNotNull(), 20.0)
    dd_before = F.when(F.lag("close", 30).over(w).isNotNull(), F.lag("close", 30).over(w) / c("peak") - 1).otherwise(c("dd"))
    depth_of_fall = ramp(-c("dd"), [(0.0, 10.0), (0.20, 35.0), (0.40, 60.0), (0.60, 80.0), (0.60 + 4 / 15, 100.0)])
    speed_of_fall = ramp(dd_before - c("dd"), [(0.0, 15.0), (0.10, 45.0), (0.25, 75.0), (0.40, 100.0)])
    return f.withColumns({
        "valuation_risk_factor": within(c("valuation")), "volatility_risk": c("_vol_pct"),
        "leverage_factor": within(fuse([(ramp(a, [(0.0, 20.0), (0.10, 40.0), (0.30, 65.0), (0.60, 85.0), (1.0, 100.0)]), 0.5), (ramp(c("oi_usd") / MARKET_CAP, [(0.0, 0.0), (0.01, 20.0), (0.02, 45.0), (0.04, 70.0), (0.064, 100.0)]), 0.5)])),
        "funding_risk": ramp(a, [(0.0, 10.0), (0.11, 25.0), (0.30, 50.0), (0.60, 75.0), (1.0, 100.0)]),
        "oi_risk": ramp(oi_change, [(0.0, 15.0), (0.05, 30.0), (0.15, 50.0), (0.30, 75.0), (0.55, 100.0)]),
        "liquidation_risk": ramp(c("liquidation_usd") / 1e6, [(0.0, 10.0), (50.0, 25.0), (100.0, 50.0), (300.0, 75.0), (700.0, 95.0)]),
        "liquidity_factor": within(spread * 0.4 + depth * 0.6),
        "macro_factor": within(fuse([(ramp(momentum, [(-0.03, 0.0), (0.0, 20.0), (0.03, 60.0), (0.06, 100.0)]), 0.5), (by_rate, 0.5)])),
        "onchain_factor": within(fuse([(ramp(c("netflow"), [(-7500.0, 0.0), (0.0, 30.0), (3000.0, 60.0), (8000.0, 85.0), (8000 + 15 / 13 * 7000, 100.0)]), 0.65), (within((c("whale") - 1) / 1.5 * 60 + 20), 0.35)])),
        "crowding_risk": within(fuse([(by_side, 0.55), (by_mood, 0.45)])),
        "drawdown_risk": within(depth_of_fall * 0.6 + speed_of_fall * 0.4)}).drop("_r", "_vol", "_vol_pct")


RISK_FACTORS = [x for parts in RISK_DIMENSIONS.values() for x in parts]


def risk_dimensions(f: DataFrame, compat: bool = False) -> DataFrame:
    """The six dimensions (means of their factors, 50 without any), the floored overall risk, its level, and the three worst factors."""
    out = f.withColumns({d: F.coalesce(fuse([(c(x), 1.0) for x in parts]), F.lit(50.0)) for d, parts in RISK_DIMENSIONS.items()})
    overall = sum((c(d) * w for d, w in RISK_WEIGHTS.items()), F.lit(0.0))
    out = out.withColumn("risk", floored(overall, [c(x) for x in RISK_FACTORS], compat))
    # Worst first; of equal ones the first by name.
    ordered = F.array_sort(F.filter(F.array(*[F.struct((-F.round(c(x), 6)).alias("s"), F.lit(x).alias("name")) for x in RISK_FACTORS]), lambda p: p["s"].isNotNull()))
    return out.withColumn("risk_level", level(F.round("risk", 9), RISK_LIMITS, RISK_LEVELS)).withColumn("worst", F.array_join(F.transform(F.slice(ordered, 1, 3), lambda p: p["name"]), ","))


# The cycle's score, its phase and the rules about it.

def cycle_scores(f: DataFrame) -> DataFrame:
    """f (with valuation) and the seven factors cyc_*, their fusion `cycle` (weight times coverage) and the phase of that score."""
    w = W()
    f = f.withColumn("ma200", F.when(c("rn") >= 200, c("rp")))
    f = f.withColumn("ma_before", F.coalesce(F.lag("ma200", 29).over(w), c("ma200")))
    onchain, flow, derivative, macro = cycle_onchain(), cycle_capital_flow(), cycle_derivative(), cycle_macro()
    scores = {"price_trend": trend_score(), "onchain": onchain[0], "capital_flow": flow[0], "derivative": derivative[0], "macro": macro[0], "sentiment": cycle_sentiment(), "valuation_anchor": valuation_anchor(c("valuation"))}
    cover = {"onchain": onchain[1], "capital_flow": flow[1], "derivative": derivative[1], "macro": macro[1]}
    f = f.withColumns({f"cyc_{k}": s for k, s in scores.items()} | {f"_w_{k}": F.lit(w_) * cover.get(k, F.lit(1.0)) for k, w_ in CYCLE_WEIGHTS.items()})
    total = sum((F.when(c(f"cyc_{k}").isNotNull(), c(f"_w_{k}")).otherwise(0.0) for k in scores), F.lit(0.0))
    f = f.withColumn("cycle", F.try_divide(sum((F.coalesce(c(f"cyc_{k}") * c(f"_w_{k}"), F.lit(0.0)) for k in scores), F.lit(0.0)), total)).drop(*[f"_w_{k}" for k in scores])
    return f.withColumn("base_phase", level(F.round("cycle", 9), PHASE_LIMITS, PHASES))


def ruled_phase(f: DataFrame) -> DataFrame:
    """f (with cycle_scores) and the phase after the rules, which are asked in this order: top risk or distribution, decline, veto."""
    score = lambda k: F.coalesce(c(f"cyc_{k}"), F.lit(0.0))
    trend, anchor = score("price_trend"), score("valuation_anchor")
    promoted = (
        F.when((anchor <= -0.6) & (score("derivative") >= 0.4), "TOP_RISK")
        .when((anchor <= -0.35) & (trend < 0.1) & (score("sentiment") <= -0.3) & c("base_phase").isin("UPTREND", "ACCELERATION"), "DISTRIBUTION").otherwise(c("base_phase")))
    declined = F.when((trend <= -0.5) & (phase_probabilities(c("cycle"))["DECLINE"] > 0.05) & c("_promoted").isin("DISTRIBUTION", "TOP_RISK", "ACCELERATION", "UPTREND"), "DECLINE").otherwise(c("_promoted"))
    vetoed = F.when((trend <= -0.45) & c("_declined").isin("UPTREND", "ACCELERATION", "DISTRIBUTION", "TOP_RISK"), "BEAR").otherwise(c("_declined"))
    return f.withColumn("_promoted", promoted).withColumn("_declined", declined).withColumn("ruled_phase", vetoed).drop("_promoted", "_declined")


def posterior_phase(probabilities: Column, prior: Column, phase: Column, weight: float = PRIOR_WEIGHT) -> Column:
    """The phase of the largest mixture of its probability and its prior (map of phase to share; NULL: the phase stays)."""
    mixed = F.transform(F.map_entries(probabilities), lambda e: F.struct((F.round((1 - weight) * e["value"] + weight * F.coalesce(F.try_element_at(prior, e["key"]), F.lit(0.0)), 9)).alias("p"), e["key"].alias("phase")))
    return F.when(prior.isNull(), phase).otherwise(F.array_max(mixed)["phase"])


# Regime.

def banded(x: Column, strong: float, some: float, names: tuple[str, str, str, str, str]) -> Column:
    """names for x >= strong, >= some, <= -strong, <= -some, and between."""
    return F.when(x >= strong, names[0]).when(x >= some, names[1]).when(x <= -strong, names[2]).when(x <= -some, names[3]).when(x.isNotNull(), names[4])


def regime_states() -> dict[str, Column]:
    a = c("funding") * 3 * 365
    fg = c("fear_greed")
    return {
        "trend": banded(c("cyc_price_trend"), 0.5, 0.15, ("STRONG_UP", "UP", "STRONG_DOWN", "DOWN", "NEUTRAL")), "valuation": c("valuation_level"),
        "capital_flow": banded(c("cyc_capital_flow"), 0.5, 0.15, ("STRONG_INFLOW", "INFLOW", "STRONG_OUTFLOW", "OUTFLOW", "NEUTRAL")),
        "onchain": banded(c("cyc_onchain"), 0.4, 0.12, ("ACCUMULATION", "NEUTRAL_ACC", "DISTRIBUTION", "NEUTRAL_DIST", "NEUTRAL")),
        "derivative": F.when((c("liquidation_usd") > 3e8) & (F.abs(a) > 0.3), "STRESSED").when(F.abs(a) > 0.5, "OVERHEATED").when(a > 0.1, "MILD_BULL").when(a < -0.1, "MILD_BEAR").when(a.isNotNull(), "CALM"),
        "macro": F.when(c("cyc_macro") >= 0.35, "SUPPORTIVE").when(c("cyc_macro") <= -0.6, "CRISIS").when(c("cyc_macro") <= -0.25, "HEADWIND").when(c("cyc_macro").isNotNull(), "NEUTRAL"),
        "sentiment": F.when(fg >= 75, "EXTREME_GREED").when(fg >= 55, "GREED").when(fg <= 25, "EXTREME_FEAR").when(fg <= 45, "FEAR").when(fg.isNotNull(), "NEUTRAL"),
        "risk": c("risk_level"), "cycle": c("ruled_phase"),
    }


def scalar_of(dimension: str, state: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in STATES[dimension].items() for x in kv]), state)


def nearest_state(dimension: str, value: Column) -> Column:
    """The state whose scalar is nearest; of two equally near ones the first listed."""
    return F.array_min(F.array(*[F.struct(F.round(F.abs(value - v), 9).alias("gap"), F.lit(k).alias("at"), F.lit(s).alias("state")) for k, (s, v) in enumerate(STATES[dimension].items())]))["state"]


def regime(f: DataFrame) -> DataFrame:
    """f (with risk and phases) and per dimension state_* and scalar_*, regime, label, consistency, divergence, shifted."""
    out = f.withColumns({f"state_{d}": s for d, s in regime_states().items()}).withColumns({f"scalar_{d}": scalar_of(d, c(f"state_{d}")) for d in STATES})
    parts = [(c(f"scalar_{d}"), w) for d, w in REGIME_WEIGHTS.items()]
    out = out.withColumn("regime", F.coalesce(fuse(parts), F.lit(0.0)))
    sign = F.when(F.round("regime", 9) >= 0, 1.0).otherwise(-1.0)
    total = sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in parts), F.lit(0.0))
    aligned = sum((F.when(s * sign >= -0.05, w).otherwise(0.0) for s, w in parts), F.lit(0.0))
    label = F.when((c("ruled_phase") == "TOP_RISK") & (c("regime") > 0), "Euphoria").otherwise(level(F.round("regime", 9), REGIME_LIMITS, REGIME_LABELS))
    # REGIME_LABELS go up with the score; a score on a limit belongs above it.
    out = out.withColumn("consistency", F.when(total > 0, 0.3 + 0.7 * aligned / total).otherwise(0.3)).withColumn("label", label).withColumn("divergence", F.round("consistency", 9) < DIVERGENCE)
    shifted = F.filter(F.array(*[F.when(F.round(F.abs(c(f"scalar_{d}") - F.lag(f"scalar_{d}").over(W())), 9) > SHIFT, d) for d in STATES]), lambda x: x.isNotNull())
    return out.withColumn("shifted", F.array_join(shifted, ","))


def research(bars: DataFrame) -> DataFrame:
    return risk_dimensions(risk_factors(cycle_scores(valuation_dimensions(metrics(bars)))))


def full(bars: DataFrame) -> DataFrame:
    return regime(ruled_phase(research(bars)))


# The same in SQL for DuckDB, written out formula by formula.

_W = "WINDOW w AS (PARTITION BY symbol ORDER BY time)"
_B = lambda x, lo=-1, hi=1: f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {lo}), {hi}) END"
_H = lambda x: _B(x, 0, 100)


def _mean(parts):
    there = " + ".join(f"CASE WHEN ({x}) IS NULL THEN 0 ELSE {w} END" for x, w in parts)
    return f"(({' + '.join(f'coalesce(({x}) * {w}, 0)' for x, w in parts)}) / nullif({there}, 0))", f"({there})"


def _rank(x, n):
    return f"100.0 * len(list_filter(list({x}) FILTER (WHERE {x} IS NOT NULL) OVER (PARTITION BY symbol ORDER BY time ROWS {n - 1} PRECEDING), lambda v: v < {x})) / nullif(count({x}) OVER (PARTITION BY symbol ORDER BY time ROWS {n - 1} PRECEDING), 0)"


def _named(x, limits, names):
    return f"CASE WHEN {x} IS NULL THEN NULL {' '.join(f'WHEN {x} < {t} THEN ' + repr(n) for t, n in zip(limits, names, strict=False))} ELSE {names[-1]!r} END"


SQL_METRICS = f"""{MULTI}, m0 AS (SELECT *, avg(close) OVER (w ROWS 199 PRECEDING) AS rp, avg(volume) OVER (w ROWS 6 PRECEDING) AS v7, max(volume) OVER (w ROWS 89 PRECEDING) AS v90, min(close) OVER (w ROWS 364 PRECEDING) AS lo,
    max(close) OVER (w ROWS 364 PRECEDING) AS hi, max(close) OVER w AS peak, row_number() OVER w AS rn, sum((close - open) * volume * 1000) OVER (w ROWS 6 PRECEDING) AS etf_7d, ln(close) AS y FROM bars {_W}),
  m AS (SELECT *, close / rp AS mvrv, 1 - rp / close AS nupl, close / open AS sopr, 1.5 + 2.0 * volume / v90 AS lth_sth, (volume - v7) * 1000 AS netflow, (close - open) / open / 1000 AS funding, volume * 2e9 AS oi_usd, 102 + 20 * (close / rp - 1) AS dxy,
    3.5 + 3 * ((close - lo) / nullif(hi - lo, 0) - 0.5) AS fed_rate, 100 * ((close - lo) / nullif(hi - lo, 0)) AS fg, rp * 19e6 AS realized_cap, abs(close - open) * 3000 AS liq, 0.5 + 2.5 * ((close - lo) / nullif(hi - lo, 0)) AS ls,
    (high - low) / close / 1000 AS spread, volume * close * 50 AS depth, 0.5 + 2.0 * volume / v90 AS whale, close / peak - 1 AS dd, (close - open) / open / 1000 * 3 * 365 AS a FROM m0)"""
_ON, _ON_W = _mean([
    (_B("CASE WHEN mvrv < 1 THEN 0.5 + (1 - mvrv) * 1.5 WHEN mvrv < 2 THEN 0.5 - (mvrv - 1) * 0.5 WHEN mvrv < 3.5 THEN 0 - (mvrv - 2) * 0.4 ELSE -0.6 - (mvrv - 3.5) * 0.4 END"), 0.35),
    (_B("CASE WHEN nupl < 0 THEN 0.5 + abs(nupl) * 2 WHEN nupl < 0.5 THEN 0.5 - nupl * 0.8 WHEN nupl < 0.75 THEN 0.1 - (nupl - 0.5) * 1.6 ELSE -0.3 - (nupl - 0.75) * 2.8 END"), 0.25),
    (_B("(sopr - 1) * 4"), 0.20), (_B("(lth_sth - 2.5) * 0.6"), 0.20)])
_FL, _FL_W = _mean([(_B("-netflow / 3000"), 0.5), (_B("etf_7d / 5e8"), 0.5)])
_DE, _DE_W = _mean([
    (_B("CASE WHEN a < -0.10 THEN 0.3 + abs(a) * 2 WHEN a < 0.05 THEN 0.1 WHEN a < 0.20 THEN 0.2 + (a - 0.05) * 3 WHEN a < 0.40 THEN 0.65 - (a - 0.20) * 3 ELSE 0.05 - (a - 0.40) * 2 END"), 0.55),
    ("CASE WHEN oi_usd > 3e10 THEN -0.4 WHEN oi_usd > 2e10 THEN -0.1 WHEN oi_usd > 1e10 THEN 0.1 ELSE 0.2 END", 0.45)])
_MA, _MA_W = _mean([(_B("(102 - dxy) * 0.08"), 0.40), (_B("(3.5 - fed_rate) * 0.25"), 0.35), ("0.15", 0.25)])
_SXX, _SXY = "(sxx - sx * sx / rn)", "(sxy - sx * sy / rn)"
SQL_VALUATION = f"""{SQL_METRICS}, v0 AS (SELECT *, 1 / (1 - nupl) AS cost, realized_cap / lag(realized_cap, 90) OVER w - 1 AS growth, CAST(sum(CAST(rn AS DOUBLE)) OVER w AS DOUBLE) AS sx, sum(y) OVER w AS sy, sum(CAST(rn AS DOUBLE) * rn) OVER w AS sxx,
    sum(rn * y) OVER w AS sxy, sum(y * y) OVER w AS syy, {_rank("mvrv", 1800)} AS pm, {_rank("dd", 1800)} AS pd FROM m {_W}),
  v1 AS (SELECT *, {_rank("cost", 1800)} AS pc, CASE WHEN rn >= 200 THEN (y - sy / rn - {_SXY} / {_SXX} * (rn - sx / rn)) / sqrt(greatest((syy - sy * sy / rn) / rn - pow({_SXY} / {_SXX}, 2) * {_SXX} / rn, 1e-18)) END AS dev,
    CASE WHEN mvrv < 1 THEN mvrv * 50 WHEN mvrv < 2 THEN (mvrv - 1) * 50 WHEN mvrv < 3.5 THEN 50 + (mvrv - 2) / 1.5 * 35 ELSE least(100, 85 + (mvrv - 3.5) * 10) END AS am,
    CASE WHEN cost <= 1 THEN cost * 15 WHEN cost <= 1.5 THEN 15 + (cost - 1) / 0.5 * 25 WHEN cost <= 2.5 THEN 40 + (cost - 1.5) * 25 WHEN cost <= 3.5 THEN 65 + (cost - 2.5) * 20 ELSE least(100, 85 + (cost - 3.5) / 1.5 * 15) END AS ac,
    CASE WHEN -dd <= 0.2 THEN 90 + dd / 0.2 * 25 WHEN -dd <= 0.4 THEN 65 - (-dd - 0.2) / 0.2 * 20 WHEN -dd <= 0.6 THEN 45 - (-dd - 0.4) / 0.2 * 20 ELSE greatest(0, 25 - (-dd - 0.6) / 0.2 * 20) END AS ad FROM v0),
  v2 AS (SELECT *, {_H("CASE WHEN rn >= 30 THEN pm * 0.7 + am * 0.3 ELSE am END")} AS val_mvrv, CASE WHEN growth IS NULL THEN NULL WHEN growth < -0.05 THEN {_B("30 + (growth + 0.05) / 0.15 * 30", 0, 30)} WHEN growth <= 0.10 THEN {_B("30 + growth / 0.10 * 30", 0, 60)}
      WHEN growth <= 0.25 THEN 60 + (growth - 0.10) / 0.15 * 25 ELSE least(100, 85 + (growth - 0.25) / 0.15 * 15) END AS val_realized_cap, {_H("CASE WHEN rn >= 30 THEN ac * 0.6 + pc * 0.4 ELSE ac END")} AS val_cost_basis, {_H("50 + dev / 2 * 50")} AS val_trend,
      CASE WHEN rn >= 90 THEN {_H("pd * 0.6 + ad * 0.4")} END AS val_drawdown FROM v1),
  v AS (SELECT *, {_mean([("val_mvrv", "(0.25 * CASE WHEN rn >= 30 THEN 1 ELSE 0.6 END)"), ("val_realized_cap", "(0.25 * 0.75)"), ("val_cost_basis", "(0.20 * CASE WHEN rn >= 30 THEN 0.8 ELSE 0.65 END)"),
      ("val_trend", "(0.15 * greatest(least(1, rn / 730), 0.1))"), ("val_drawdown", "(0.15 * greatest(least(1, rn / 365), 0.1))")])[0]} AS valuation FROM v2)"""
_CYC = ("price_trend", "onchain", "capital_flow", "derivative", "macro", "sentiment", "valuation_anchor")
SQL_CYCLE = f"""{SQL_VALUATION}, c0 AS (SELECT *, CASE WHEN rn >= 200 THEN rp END AS ma FROM v), c1 AS (SELECT *, coalesce(lag(ma, 29) OVER w, ma) AS mab FROM c0 {_W}),
  c2 AS (SELECT *, CASE WHEN ma IS NOT NULL THEN {_B(f"({_B('(ma / mab - 1) * 8')}) * 0.4 + ({_B('(close / ma - 1) * 2.5')}) * 0.35 + ({_B('dd * 2')}) * 0.25")} END AS cyc_price_trend, {_ON} AS cyc_onchain, {_ON_W} AS on_w, {_FL} AS cyc_capital_flow, {_FL_W} AS fl_w,
    {_DE} AS cyc_derivative, {_DE_W} AS de_w, {_MA} AS cyc_macro, {_MA_W} AS ma_w, {_B("(50 - fg) / 40")} AS cyc_sentiment, {_B("(50 - valuation) / 50")} AS cyc_valuation_anchor FROM c1),
  c AS (SELECT *, {_mean([("cyc_price_trend", "0.25"), ("cyc_onchain", "(0.20 * on_w)"), ("cyc_capital_flow", "(0.15 * fl_w)"), ("cyc_derivative", "(0.12 * de_w)"), ("cyc_macro", "(0.10 * ma_w)"), ("cyc_sentiment", "0.08"), ("cyc_valuation_anchor", "0.10")])[0]} AS cycle FROM c2)"""
_PROB = " + ".join(f"exp(-pow(cycle - ({x}), 2) / 0.18) * {0.15 if p in ('DISTRIBUTION', 'TOP_RISK', 'DECLINE') else 1.0}" for p, x in PHASE_CENTERS.items())
SQL_PHASES = f"""{SQL_CYCLE}, p0 AS (SELECT *, {_named("round(cycle, 9)", PHASE_LIMITS, PHASES)} AS base_phase, coalesce(cyc_price_trend, 0) AS t, coalesce(cyc_valuation_anchor, 0) AS va FROM c),
  p1 AS (SELECT *, CASE WHEN va <= -0.6 AND coalesce(cyc_derivative, 0) >= 0.4 THEN 'TOP_RISK' WHEN va <= -0.35 AND t < 0.1 AND coalesce(cyc_sentiment, 0) <= -0.3 AND base_phase IN ('UPTREND', 'ACCELERATION') THEN 'DISTRIBUTION' ELSE base_phase END AS p1_,
    exp(-pow(cycle + 0.62, 2) / 0.18) * 0.15 / ({_PROB}) AS decline FROM p0),
  p2 AS (SELECT *, CASE WHEN t <= -0.5 AND decline > 0.05 AND p1_ IN ('DISTRIBUTION', 'TOP_RISK', 'ACCELERATION', 'UPTREND') THEN 'DECLINE' ELSE p1_ END AS p2_ FROM p1),
  ph AS (SELECT *, CASE WHEN t <= -0.45 AND p2_ IN ('UPTREND', 'ACCELERATION', 'DISTRIBUTION', 'TOP_RISK') THEN 'BEAR' ELSE p2_ END AS ruled_phase FROM p2)"""
_LEV, _MAC, _OCF, _CRO = (f"({_mean(p)[0]})" for p in (
    [("least(100, CASE WHEN f <= 0.10 THEN 20 + f / 0.10 * 20 WHEN f <= 0.30 THEN 40 + (f - 0.10) / 0.20 * 25 WHEN f <= 0.60 THEN 65 + (f - 0.30) / 0.30 * 20 ELSE 85 + (f - 0.60) / 0.40 * 15 END)", 0.5),
     ("least(100, CASE WHEN oir <= 0.01 THEN oir / 0.01 * 20 WHEN oir <= 0.02 THEN 20 + (oir - 0.01) / 0.01 * 25 WHEN oir <= 0.04 THEN 45 + (oir - 0.02) / 0.02 * 25 ELSE 70 + (oir - 0.04) / 0.02 * 25 END)", 0.5)],
    [("CASE WHEN mom <= 0 THEN greatest(0, 20 + mom / 0.03 * 20) WHEN mom <= 0.03 THEN 20 + mom / 0.03 * 40 ELSE least(100, 60 + (mom - 0.03) / 0.03 * 40) END", 0.5), ("rs", 0.5)],
    [("CASE WHEN netflow <= 0 THEN greatest(0, 30 + netflow / 5000 * 20) WHEN netflow <= 3000 THEN 30 + netflow / 3000 * 30 WHEN netflow <= 8000 THEN 60 + (netflow - 3000) / 5000 * 25 ELSE least(100, 85 + (netflow - 8000) / 7000 * 13) END", 0.65),
     (_H("(whale - 1) / 1.5 * 60 + 20"), 0.35)],
    [("CASE WHEN ls IS NULL OR ls <= 0 THEN NULL WHEN ls BETWEEN 0.8 AND 2 THEN 20 WHEN ls > 2 THEN least(100, 30 + (ls - 2) / 1.5 * 55) ELSE least(100, 30 + (0.8 - ls) / 0.5 * 55) END", 0.55),
     ("CASE WHEN fg >= 90 THEN least(100, 70 + (fg - 90) / 10 * 30) WHEN fg >= 75 THEN 40 + (fg - 75) / 15 * 30 WHEN fg <= 10 THEN least(100, 70 + (10 - fg) / 10 * 30) WHEN fg <= 25 THEN 40 + (25 - fg) / 15 * 30 WHEN fg IS NOT NULL THEN 20 END", 0.45)]))
SQL_RISK = f"""{SQL_PHASES}, r0 AS (SELECT *, abs(a) AS f, oi_usd / 1.2e12 AS oir, abs(oi_usd / nullif(lag(oi_usd, 7) OVER w, 0) - 1) AS oic, ln(close / lag(close) OVER w) AS r, coalesce((dxy - lag(dxy, 30) OVER w) / lag(dxy, 30) OVER w, 0) AS mom, lag(fed_rate, 90) OVER w AS rb,
    coalesce(lag(close, 30) OVER w / peak - 1, dd) AS ddb, spread * 100 AS sp, depth / 1e6 AS dm FROM ph {_W}),
  r1 AS (SELECT *, CASE WHEN count(r) OVER (w ROWS 29 PRECEDING) >= 30 THEN stddev_pop(r) OVER (w ROWS 29 PRECEDING) * sqrt(365) END AS vol, {_H("(fed_rate - 3.5) / 2 * 50 + 25")} AS rs0, ddb - dd AS sd FROM r0 {_W}),
  r2 AS (SELECT *, {_H("rs0 + CASE WHEN fed_rate > rb + 0.01 THEN 20 WHEN fed_rate < rb - 0.01 THEN -15 ELSE 0 END")} AS rs FROM r1),
  r3 AS (SELECT *, {_H("valuation")} AS valuation_risk_factor, CASE WHEN vol IS NOT NULL THEN {_rank("vol", 365)} END AS volatility_risk, {_H(_LEV)} AS leverage_factor,
    least(100, CASE WHEN f <= 0.11 THEN 10 + f / 0.11 * 15 WHEN f <= 0.30 THEN 25 + (f - 0.11) / 0.19 * 25 WHEN f <= 0.60 THEN 50 + (f - 0.30) / 0.30 * 25 ELSE 75 + (f - 0.60) / 0.40 * 25 END) AS funding_risk,
    CASE WHEN oic IS NOT NULL THEN least(100, CASE WHEN oic <= 0.05 THEN 15 + oic / 0.05 * 15 WHEN oic <= 0.15 THEN 30 + (oic - 0.05) / 0.10 * 20 WHEN oic <= 0.30 THEN 50 + (oic - 0.15) / 0.15 * 25 ELSE 75 + (oic - 0.30) / 0.20 * 20 END) END AS oi_risk,
    CASE WHEN liq / 1e6 <= 50 THEN 10 + liq / 1e6 / 50 * 15 WHEN liq / 1e6 <= 100 THEN 25 + (liq / 1e6 - 50) / 50 * 25 WHEN liq / 1e6 <= 300 THEN 50 + (liq / 1e6 - 100) / 200 * 25 WHEN liq / 1e6 <= 700 THEN 75 + (liq / 1e6 - 300) / 400 * 20 ELSE 95 END AS liquidation_risk,
    (CASE WHEN sp <= 0.01 THEN 10 WHEN sp <= 0.05 THEN 10 + (sp - 0.01) / 0.04 * 25 WHEN sp <= 0.2 THEN 35 + (sp - 0.05) / 0.15 * 30 ELSE least(90, 65 + (sp - 0.2) / 0.3 * 25) END) * 0.4
      + (CASE WHEN dm >= 50 THEN 10 WHEN dm >= 20 THEN 10 + (50 - dm) / 30 * 20 WHEN dm >= 5 THEN 30 + (20 - dm) / 15 * 30 WHEN dm >= 1 THEN 60 + (5 - dm) / 4 * 30 ELSE 90 END) * 0.6 AS liquidity_factor,
    {_H(_MAC)} AS macro_factor, {_H(_OCF)} AS onchain_factor, {_H(_CRO)} AS crowding_risk,
    least(100, (CASE WHEN -dd <= 0.2 THEN 10 - dd / 0.2 * 25 WHEN -dd <= 0.4 THEN 35 + (-dd - 0.2) / 0.2 * 25 WHEN -dd <= 0.6 THEN 60 + (-dd - 0.4) / 0.2 * 20 ELSE least(100, 80 + (-dd - 0.6) / 0.2 * 15) END) * 0.6
      + (CASE WHEN sd <= 0 THEN 15 WHEN sd <= 0.10 THEN 15 + sd / 0.10 * 30 WHEN sd <= 0.25 THEN 45 + (sd - 0.10) / 0.15 * 30 ELSE least(100, 75 + (sd - 0.25) / 0.15 * 25) END) * 0.4) AS drawdown_risk FROM r2),
  r4 AS (SELECT *, {', '.join(f"coalesce({_mean([(x, 1) for x in parts])[0]}, 50) AS {d}" for d, parts in RISK_DIMENSIONS.items())} FROM r3),
  r5 AS (SELECT *, {' + '.join(f'{d} * {w}' for d, w in RISK_WEIGHTS.items())} AS overall, greatest({', '.join(f'coalesce({x}, 0)' for x in RISK_FACTORS)}) AS worst_score, {' + '.join(f'CASE WHEN {x} > 70 THEN 1 ELSE 0 END' for x in RISK_FACTORS)} AS n_high FROM r4),
  rk AS (SELECT *, greatest(overall, CASE WHEN n_high >= 3 THEN 70 WHEN worst_score > 90 THEN 50 ELSE 0 END) AS risk FROM r5)"""
_ST = lambda d, x: f"CASE {x} {' '.join(f'WHEN {k!r} THEN {v}' for k, v in STATES[d].items())} END"
_BAND = lambda x, hi, lo, n: f"CASE WHEN {x} >= {hi} THEN '{n[0]}' WHEN {x} >= {lo} THEN '{n[1]}' WHEN {x} <= -{hi} THEN '{n[2]}' WHEN {x} <= -{lo} THEN '{n[3]}' WHEN {x} IS NOT NULL THEN 'NEUTRAL' END"
_STATE_SQL = {
    "trend": _BAND("cyc_price_trend", 0.5, 0.15, ("STRONG_UP", "UP", "STRONG_DOWN", "DOWN")), "valuation": _named("round(valuation, 9)", VALUATION_LIMITS, VALUATION_LEVELS),
    "capital_flow": _BAND("cyc_capital_flow", 0.5, 0.15, ("STRONG_INFLOW", "INFLOW", "STRONG_OUTFLOW", "OUTFLOW")), "onchain": _BAND("cyc_onchain", 0.4, 0.12, ("ACCUMULATION", "NEUTRAL_ACC", "DISTRIBUTION", "NEUTRAL_DIST")),
    "derivative": "CASE WHEN liq > 3e8 AND f > 0.3 THEN 'STRESSED' WHEN f > 0.5 THEN 'OVERHEATED' WHEN a > 0.1 THEN 'MILD_BULL' WHEN a < -0.1 THEN 'MILD_BEAR' ELSE 'CALM' END",
    "macro": "CASE WHEN cyc_macro >= 0.35 THEN 'SUPPORTIVE' WHEN cyc_macro <= -0.6 THEN 'CRISIS' WHEN cyc_macro <= -0.25 THEN 'HEADWIND' ELSE 'NEUTRAL' END",
    "sentiment": "CASE WHEN fg >= 75 THEN 'EXTREME_GREED' WHEN fg >= 55 THEN 'GREED' WHEN fg <= 25 THEN 'EXTREME_FEAR' WHEN fg <= 45 THEN 'FEAR' WHEN fg IS NOT NULL THEN 'NEUTRAL' END",
    "risk": _named("round(risk, 9)", RISK_LIMITS, RISK_LEVELS), "cycle": "ruled_phase"}
_REGIME = _mean([(f"scalar_{d}", w) for d, w in REGIME_WEIGHTS.items()])
SQL_REGIME = f"""{SQL_RISK}, g0 AS (SELECT *, {', '.join(f'{x} AS state_{d}' for d, x in _STATE_SQL.items())} FROM rk), g1 AS (SELECT *, {', '.join(f'CAST({_ST(d, f"state_{d}")} AS DOUBLE) AS scalar_{d}' for d in STATES)} FROM g0),
  g2 AS (SELECT *, coalesce({_REGIME[0]}, 0) AS regime, {_REGIME[1]} AS tw FROM g1),
  g AS (SELECT *, 0.3 + 0.7 * ({' + '.join(f"CASE WHEN scalar_{d} * CASE WHEN round(regime, 9) >= 0 THEN 1 ELSE -1 END >= -0.05 THEN {w} ELSE 0 END" for d, w in REGIME_WEIGHTS.items())}) / tw AS consistency FROM g2)"""


@query("engine_cycle_factors", f"WITH {SQL_CYCLE} SELECT symbol, time, {', '.join(f'round(cyc_{k}, 4) + 0.0 AS {k}' for k in _CYC)}, round(cycle, 4) + 0.0 AS cycle FROM c")
def q_cycle_factors(spark, sf_dir):
    f = cycle_scores(valuation_dimensions(metrics(bars_multi(spark, sf_dir))))
    return f.select("symbol", "time", *[(F.round(f"cyc_{k}", 4) + 0.0).alias(k) for k in _CYC], (F.round("cycle", 4) + 0.0).alias("cycle"))


@query("engine_valuation_dimensions", f"WITH {SQL_VALUATION} SELECT symbol, time, {', '.join(f'round(val_{k}, 3) AS {k}' for k in VALUATION_WEIGHTS)}, round(valuation, 3) AS valuation, {_named('round(valuation, 9)', VALUATION_LIMITS, VALUATION_LEVELS)} AS valuation_level FROM v")
def q_valuation_dimensions(spark, sf_dir):
    f = valuation_dimensions(metrics(bars_multi(spark, sf_dir)))
    return rounded(f.select("symbol", "time", *[c(f"val_{k}").alias(k) for k in VALUATION_WEIGHTS], "valuation", "valuation_level"), 3)


@query("engine_risk_factors", f"WITH {SQL_RISK} SELECT symbol, time, {', '.join(f'round({x}, 3) AS {x}' for x in RISK_FACTORS)} FROM rk")
def q_risk_factors(spark, sf_dir):
    return rounded(research(bars_multi(spark, sf_dir)).select("symbol", "time", *RISK_FACTORS), 3)


@query("engine_risk_dimensions", f"""WITH {SQL_RISK}, k AS (SELECT symbol, time, unnest([{', '.join(f"{{'s': round({x}, 6), 'n': '{x}'}}" for x in RISK_FACTORS)}], recursive := true) FROM rk),
  t AS (SELECT symbol, time, string_agg(n, ',' ORDER BY s DESC, n) AS worst FROM (SELECT * FROM k WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, time ORDER BY s DESC, n) <= 3) GROUP BY 1, 2)
  SELECT symbol, time, {', '.join(f'round({d}, 3) AS {d}' for d in RISK_DIMENSIONS)}, round(risk, 3) AS risk, {_named('round(risk, 9)', RISK_LIMITS, RISK_LEVELS)} AS risk_level, worst FROM rk LEFT JOIN t USING (symbol, time)""")
def q_risk_dimensions(spark, sf_dir):
    return rounded(research(bars_multi(spark, sf_dir)).select("symbol", "time", *RISK_DIMENSIONS, "risk", "risk_level", "worst"), 3)


@query("engine_phase_rules", f"WITH {SQL_PHASES} SELECT symbol, time, base_phase, ruled_phase FROM ph")
def q_phase_rules(spark, sf_dir):
    return ruled_phase(cycle_scores(valuation_dimensions(metrics(bars_multi(spark, sf_dir))))).select("symbol", "time", "base_phase", "ruled_phase")


_LEGAL = ", ".join(f"'{a}>{b}'" for a, to in TRANSITIONS.items() for b in sorted(to))
_OLD = f"(greatest(r.days, n.gap) >= CASE WHEN r.state = 'TOP_RISK' THEN {TOP_RISK_DAYS} ELSE {LEAST_DAYS} END)"
_MOVES = f"(n.phase <> r.state AND n.legal AND {_OLD} AND CASE WHEN r.wanted = n.phase THEN r.times + 1 ELSE 1 END >= CASE WHEN n.phase IN ({', '.join(map(repr, sorted(FAST)))}) THEN 1 ELSE {CONFIRMATIONS} END)"


@query("engine_debounced_phase", f"""WITH RECURSIVE {SQL_PHASES}, t AS (SELECT symbol, time, ruled_phase AS phase, row_number() OVER (PARTITION BY symbol ORDER BY time) AS k, date_diff('day', lag(time) OVER (PARTITION BY symbol ORDER BY time), time) AS gap FROM ph WHERE ruled_phase IS NOT NULL),
  r AS (SELECT symbol, time, phase, k, phase AS state, CAST(0 AS BIGINT) AS days, CAST(NULL AS VARCHAR) AS wanted, CAST(0 AS BIGINT) AS times FROM t WHERE k = 1
   UNION ALL SELECT n.symbol, n.time, n.phase, n.k, CASE WHEN {_MOVES} THEN n.phase ELSE r.state END, CASE WHEN {_MOVES} THEN 0 ELSE r.days + n.gap END, CASE WHEN n.phase = r.state OR {_MOVES} THEN NULL ELSE n.phase END,
     CASE WHEN n.phase = r.state OR {_MOVES} THEN 0 WHEN NOT n.legal THEN r.times WHEN NOT {_OLD} THEN r.times + 1 WHEN r.wanted = n.phase THEN r.times + 1 ELSE 1 END
   FROM r JOIN (SELECT t.*, p.state AS s_, concat(p.state, '>', t.phase) IN ({_LEGAL}) AS legal FROM t, (SELECT unnest([{', '.join(repr(x) for x in TRANSITIONS)}]) AS state) p) n ON n.symbol = r.symbol AND n.k = r.k + 1 AND n.s_ = r.state)
  SELECT symbol, time, phase, state, CAST(days AS INT) AS days FROM r""")
def q_debounced(spark, sf_dir):
    """The debounced phases of the whole cycle engine."""
    f = ruled_phase(cycle_scores(valuation_dimensions(metrics(bars_multi(spark, sf_dir)))))
    return debounced(f.select("symbol", "time", c("ruled_phase").alias("phase")))


@query("engine_regime", f"""WITH {SQL_REGIME}, b AS (SELECT *, {', '.join(f'lag(scalar_{d}) OVER w AS b_{d}' for d in STATES)} FROM g {_W})
  SELECT symbol, time, {', '.join(f'state_{d}' for d in STATES)}, round(regime, 4) + 0.0 AS regime, CASE WHEN ruled_phase = 'TOP_RISK' AND regime > 0 THEN 'Euphoria' ELSE {_named('round(regime, 9)', REGIME_LIMITS, REGIME_LABELS)} END AS label, round(consistency, 4) AS consistency,
  round(consistency, 9) < 0.55 AS divergence, concat_ws(',', {', '.join(f"CASE WHEN round(abs(scalar_{d} - b_{d}), 9) > 0.3 THEN '{d}' END" for d in STATES)}) AS shifted FROM b""")
def q_regime(spark, sf_dir):
    f = rounded(full(bars_multi(spark, sf_dir)).select("symbol", "time", *[f"state_{d}" for d in STATES], "regime", "label", "consistency", "divergence", "shifted"), 4)
    return f.withColumn("regime", c("regime") + 0.0)  # no negative zero


@query("engine_nearest_state", f"""WITH {SQL_CYCLE}, k AS (SELECT symbol, time, unnest([{', '.join(f"{{'gap': round(abs(cyc_price_trend - ({v})), 9), 'k': {k}, 's': '{s}'}}" for k, (s, v) in enumerate(STATES['trend'].items()))}], recursive := true) FROM c WHERE cyc_price_trend IS NOT NULL)
  SELECT symbol, time, arg_min(s, (gap, k)) AS state FROM k GROUP BY 1, 2""")
def q_nearest_state(spark, sf_dir):
    f = cycle_scores(valuation_dimensions(metrics(bars_multi(spark, sf_dir)))).filter("cyc_price_trend is not null")
    return f.select("symbol", "time", nearest_state("trend", c("cyc_price_trend")).alias("state"))


@query("engine_at_date", f"""WITH {SQL_RISK}, d AS (SELECT symbol, time, round(valuation, 3) AS valuation, round(risk, 3) AS risk, ruled_phase FROM rk WHERE time <= TIMESTAMP '1995-06-30') SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) = 1""")
def q_at_date(spark, sf_dir):
    """All engines as of a date: the last row at or before it, per symbol. Later bars never enter, as the filter is on the bars."""
    f = ruled_phase(research(bars_multi(spark, sf_dir).filter("time <= timestamp_ntz '1995-06-30'")))
    last = f.groupBy("symbol").agg(F.max_by(F.struct("time", "valuation", "risk", "ruled_phase"), "time").alias("r")).select("symbol", "r.*")
    return rounded(last, 3)
