"""Similar periods of every date, and the prior that they give to the phase.

Nearest neighbours under a constraint of time: a date's neighbours lie between `lookback` and `gap` days before it. Rows are cut
into blocks along time; a block keeps the box around its vectors and around their directions. A first pass compares each block
with the latest block that it may look at in full, which gives every block a bound: the least third similarity of its rows.
Then only those pairs of blocks meet whose boxes allow a similarity as large as that; boxes are compared, not rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scans import numbered, running, with_keys
from ..registry import query
from ..sources.frames import bars_multi, rounded
from ..tables import written
from .engines import PHASE_CENTERS, phase_probabilities
from .factors import SQL_PHASES, cycle_scores, metrics, posterior_phase, ruled_phase, valuation_dimensions
from ..operators.asof import asof_backward

# Neighbours, least similarity, least history, days; bands of the return that followed and the phases they speak for.
TOP, SIMILAR, LEAST_HISTORY, LOOKBACK, GAP = 3, 0.55, 30, 1800, 90
BANDS = ((0.3, "UPTREND"), (0.05, "RECOVERY"), (-0.05, "BOTTOM_BUILDING"), (-0.3, "BEAR"), (None, "DEEP_BEAR"))
ROWS = 256
DAY = 86_400_000_000
_FOUND = "array<struct<similarity:double,us:bigint>>"


def _directions(v: np.ndarray) -> np.ndarray:
    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def _similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0.6 of the cosine on 0..1 and 0.4 of the closeness by distance, of all rows of a to all of b."""
    gap = np.sqrt(np.maximum(0, ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)))
    return np.round(0.6 * (_directions(a) @ _directions(b).T + 1) / 2 + 0.4 * np.maximum(0, 1 - gap / np.sqrt(2 * a.shape[1])), 9)


def _best(similar: np.ndarray, times: np.ndarray, allowed: np.ndarray, top: int) -> list[list[dict]]:
    """Per row the `top` largest similarities among the allowed, ties to the earlier time."""
    out = []
    for row, ok in zip(similar, allowed, strict=True):
        at = np.flatnonzero(ok)
        order = at[np.lexsort((times[at], -row[at]))[:top]]
        out.append([{"similarity": float(row[k]), "us": int(times[k])} for k in order])
    return out


def most_like(vectors: DataFrame, lookback: int = LOOKBACK, gap: int = GAP, top: int = TOP, least: float = SIMILAR, rows: int = ROWS) -> DataFrame:
    """vectors (symbol, time, v): per row `found`, the at most `top` rows most like it in its window with a similarity of `least` or more, and
    `history`, the number of rows in the window."""
    import pandas as pd

    size = len(vectors.select("v").first()["v"]) if vectors.limit(1).count() else 1
    t = numbered(vectors).withColumns({"us": F.unix_micros(F.col("time").cast("timestamp")), "_block": F.expr(f"_rn div {rows}")})
    t = written(t.select("symbol", "_block", "us", "v"), "pattern-rows")
    far, near = lookback * DAY, gap * DAY
    schema = f"symbol string, _block long, us long, found {_FOUND}, history long"

    def compared(key, asked, given):
        a, b = (np.array(f.v.tolist(), float).reshape(len(f), -1) for f in (asked, given))
        ask, held = asked.us.to_numpy(), given.us.to_numpy()
        age = ask[:, None] - held[None, :]
        inside = (age > near) & (age <= far)
        similar = _similarity(a, b) if len(a) and len(b) else np.zeros((len(a), len(b)))
        return pd.DataFrame({"symbol": [key[0]] * len(ask), "_block": key[1], "us": ask, "found": _best(similar, held, inside & (similar >= least), top), "history": inside.sum(axis=1)})

    lows, highs = ([f(F.get("v", F.lit(k))).alias(f"{n}{k}") for k in range(size)] for n, f in (("lo", F.min), ("hi", F.max)))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda k: F.when(length > 0, F.get("v", F.lit(k)) / length).otherwise(0.0)
    boxes = t.groupBy("symbol", "_block").agg(F.min("us").alias("from"), F.max("us").alias("to"), *lows, *highs, *[F.min(unit(k)).alias(f"ulo{k}") for k in range(size)], *[F.max(unit(k)).alias(f"uhi{k}") for k in range(size)])
    boxes = written(boxes, "pattern-boxes")
    # The latest block that lies in every window of a block as a whole, or as nearly as there is.
    g = boxes.select("symbol", F.col("_block").alias("_given"), *[F.col(c).alias(f"g_{c}") for c in boxes.columns if c not in ("symbol", "_block")])
    asked = boxes.withColumns({"_till": F.col("to") - near - 1, "_since": F.col("from") - far - 1})
    asked = asof_backward(asked, g.select("symbol", "g_from", F.col("_given").alias("_last")), "_till", "g_from", ["_last"], ["symbol"], bucket=far + DAY)
    asked = asof_backward(asked, g.select("symbol", "g_to", F.col("_given").alias("_gone")), "_since", "g_to", ["_gone"], ["symbol"], bucket=far + DAY)
    # The blocks that a window can reach are consecutive ones.
    begin = F.coalesce(F.col("_gone") + 1, F.lit(0))
    pairs = asked.filter(F.col("_last") >= begin).withColumn("_given", F.explode(F.sequence(begin, F.col("_last")))).join(g, ["symbol", "_given"])
    gap2 = lambda a, b: sum((F.pow(F.greatest(F.lit(0.0), F.col(f"g_{a}{k}") - F.col(f"{b}{k}"), F.col(f"{a}{k}") - F.col(f"g_{b}{k}")), 2) for k in range(size)), F.lit(0.0))
    upper = 0.6 * (1 - gap2("ulo", "uhi") / 4) + 0.4 * F.greatest(F.lit(0.0), 1 - F.sqrt(gap2("lo", "hi")) / (2 * size) ** 0.5) + 1e-9
    pairs = written(pairs.select("symbol", "_block", "_given", upper.alias("upper"), ((F.col("g_from") >= F.col("to") - far) & (F.col("g_to") < F.col("from") - near)).alias("whole"), F.least(F.col("to") - near, F.col("g_to")).alias("reach"), F.col("g_from"), F.col("g_to")), "pattern-pairs")
    first = F.row_number().over(Window.partitionBy("symbol", "_block").orderBy(F.desc("whole"), F.desc("_given")))
    chosen = pairs.withColumn("_k", first).filter("_k = 1").select("symbol", "_block", "_given")

    def met(which: DataFrame) -> DataFrame:
        names = {"symbol": "g0", "_block": "g1", "_given": "g2", "us": "us", "v": "v"}
        given = which.join(t.select("symbol", F.col("_block").alias("_given"), "us", "v"), ["symbol", "_given"]).select(*[F.col(a).alias(b) for a, b in names.items()])
        asked = which.join(t, ["symbol", "_block"]).select(*names)
        return asked.groupBy("symbol", "_block", "_given").cogroup(given.groupBy("g0", "g1", "g2")).applyInPandas(compared, schema)

    begun = written(met(chosen), "pattern-first")
    third = F.when(F.size("found") >= top, F.get("found", F.lit(top - 1))["similarity"]).otherwise(F.lit(least))
    bounds = begun.groupBy("symbol", "_block").agg(F.min(third).alias("bound"))
    # A block is met if its box allows what counts; of the others only the rows in the windows are counted.
    rest = pairs.join(chosen, ["symbol", "_block", "_given"], "left_anti").join(bounds, ["symbol", "_block"])
    every = begun.unionByName(met(rest.filter(F.col("upper") >= F.greatest("bound", F.lit(least))).select("symbol", "_block", "_given")))
    merged = every.groupBy("symbol", "us").agg(F.flatten(F.collect_list("found")).alias("found"))
    ordered = F.transform(F.slice(F.array_sort(F.transform("found", lambda x: F.struct((-x["similarity"]).alias("less"), x["us"].alias("us")))), 1, top), lambda x: F.struct((-x["less"]).alias("similarity"), x["us"].alias("us")))
    history = _in_window(t, far, near)
    return with_keys(history, merged, ["symbol", "us"]).select("symbol", F.timestamp_micros("us").cast("timestamp_ntz").alias("time"), F.coalesce(ordered, F.lit(None).cast(_FOUND)).alias("found"), "history")


def _in_window(t: DataFrame, far: int, near: int) -> DataFrame:
    """Rows of each symbol with an age of more than `near` and at most `far`: rows up to one end less rows before the other."""
    marks = t.select("symbol", "us", F.explode(F.array(F.struct(F.col("us").alias("at"), F.lit(2).alias("kind")), F.struct((F.col("us") - near).alias("at"), F.lit(0).alias("kind")), F.struct((F.col("us") - far).alias("at"), F.lit(1).alias("kind")))).alias("m"))
    # At one moment: first the ends that leave a row of that moment out, then rows.
    marks = marks.select("symbol", "us", "m.*").withColumn("_b", F.floor(F.col("at") / (365 * DAY)))
    counted = running(marks, {"_n": ("count", F.when(F.col("kind") == 2, 1))}, ("symbol",), "_b", ("at", "kind"))
    n = lambda k: F.max(F.when(F.col("kind") == k, F.col("_n")))
    return counted.groupBy("symbol", "us").agg((n(0) - n(1)).alias("history"))


def phase_prior(rows: DataFrame, bars: DataFrame, days: int = GAP, top: int = TOP) -> DataFrame:
    """rows (symbol, time, found, history) with prior, a map of phase to share: of the returns after the similar periods, by bands. NULL
    with fewer than `top` of them, or less than LEAST_HISTORY rows of history. Returns end before the row's time, so nothing leaks."""
    each = rows.filter((F.col("history") >= LEAST_HISTORY) & (F.size("found") >= top)).select("symbol", "time", F.explode("found").alias("f"))
    each = each.select("symbol", "time", F.timestamp_micros("f.us").cast("timestamp_ntz").alias("then"))
    prices = bars.select("symbol", F.col("time").cast("timestamp_ntz").alias("_at"), "close")
    asked = asof_backward(each.withColumn("_due", F.col("then")), prices, "_due", "_at", ["close"], ["symbol"], bucket="year").withColumnRenamed("close", "_from").drop("_due")
    asked = asof_backward(asked.withColumn("_due", F.col("then") + F.make_interval(days=F.lit(days))), prices, "_due", "_at", ["close"], ["symbol"], bucket="year")
    change = F.try_divide(F.col("close"), F.col("_from")) - 1
    phase: Column = F.lit(BANDS[-1][1])
    for limit, name in reversed(BANDS[:-1]):
        phase = F.when(change > limit, name).otherwise(phase)
    counted = asked.filter(change.isNotNull()).groupBy("symbol", "time", phase.alias("phase")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("symbol", "time"))
    priors = counted.withColumn("_share", share).groupBy("symbol", "time").agg(F.map_from_entries(F.collect_list(F.struct("phase", "_share"))).alias("prior"))
    return with_keys(rows, priors, ["symbol", "time"])


FACTORS = ("onchain", "capital_flow", "derivative", "macro", "sentiment")
_V = f"[{', '.join(f'cyc_{k}' for k in FACTORS)}]"
SQL_FOUND = f"""{SQL_PHASES}, u AS MATERIALIZED (SELECT symbol, time, close, {_V} AS v FROM ph WHERE {' AND '.join(f'cyc_{k} IS NOT NULL' for k in FACTORS)}),
  s AS (SELECT a.symbol, a.time, b.time AS later, b.close AS c0, round(0.6 * (CASE WHEN list_dot_product(a.v, a.v) = 0 OR list_dot_product(b.v, b.v) = 0 THEN 0 ELSE list_cosine_similarity(a.v, b.v) END + 1) / 2 + 0.4 * greatest(0, 1 - list_distance(a.v, b.v) / sqrt(2 * {len(FACTORS)})), 9) AS similarity
    FROM u a JOIN u b ON a.symbol = b.symbol AND b.time < a.time - INTERVAL {GAP} DAY AND b.time >= a.time - INTERVAL {LOOKBACK} DAY),
  k AS (SELECT *, row_number() OVER (PARTITION BY symbol, time ORDER BY similarity DESC, later) AS place, count(*) OVER (PARTITION BY symbol, time) AS history FROM s),
  f AS MATERIALIZED (SELECT * FROM k WHERE place <= {TOP} AND similarity >= {SIMILAR} AND history >= {LEAST_HISTORY})"""


def _scored(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    bars = bars_multi(spark, sf_dir)
    f = ruled_phase(cycle_scores(valuation_dimensions(metrics(bars))))
    return written(f.select("symbol", F.col("time").cast("timestamp_ntz").alias("time"), "close", "cycle", "ruled_phase", *[f"cyc_{k}" for k in FACTORS]), "cycle-scores"), bars


def _vectors(scored: DataFrame) -> DataFrame:
    v = F.array(*[F.col(f"cyc_{k}").cast("double") for k in FACTORS])
    return scored.select("symbol", "time", v.alias("v")).filter(F.forall("v", lambda x: x.isNotNull()))


@query("engine_similar_periods_all", f"WITH {SQL_FOUND} SELECT symbol, time, CAST(place AS INT) AS place, later, round(similarity, 6) AS similarity FROM f")
def q_similar_all(spark, sf_dir):
    """Of every date: the three earlier days most like it by the factors of the cycle engine."""
    found = most_like(_vectors(_scored(spark, sf_dir)[0])).filter(F.col("history") >= LEAST_HISTORY)
    each = found.select("symbol", "time", F.posexplode("found").alias("k", "f"))
    return rounded(each.select("symbol", "time", (F.col("k") + 1).alias("place"), F.timestamp_micros("f.us").cast("timestamp_ntz").alias("later"), F.col("f.similarity").alias("similarity")), 6)


_CHANCE = lambda p, x: f"exp(-pow(cycle - ({x}), 2) / 0.18) * {0.15 if p in ('DISTRIBUTION', 'TOP_RISK', 'DECLINE') else 1.0}"
_TOTAL = " + ".join(_CHANCE(p, x) for p, x in PHASE_CENTERS.items())
_BAND_SQL = f"CASE {' '.join(f'WHEN change > {x} THEN {n!r}' for x, n in BANDS[:-1])} WHEN change IS NOT NULL THEN {BANDS[-1][1]!r} END"


@query("engine_posterior_phase", f"""WITH {SQL_FOUND}, x_e AS (SELECT f.*, b.close / f.c0 - 1 AS change FROM f ASOF LEFT JOIN bars b ON b.symbol = f.symbol AND b.time <= f.later + INTERVAL {GAP} DAY),
  x_g AS (SELECT symbol, time, {_BAND_SQL} AS phase, count(*) OVER (PARTITION BY symbol, time) AS n_found FROM x_e), x_r AS (SELECT symbol, time, phase, count(*) AS n, sum(count(*)) OVER (PARTITION BY symbol, time) AS total FROM x_g WHERE n_found >= {TOP} AND phase IS NOT NULL GROUP BY 1, 2, 3),
  x_z AS (SELECT symbol, time, ruled_phase, unnest([{', '.join(f"{{'name': '{p}', 'p': ({_CHANCE(p, x)}) / ({_TOTAL})}}" for p, x in PHASE_CENTERS.items())}], recursive := true) FROM ph),
  x_m AS (SELECT x_z.symbol, x_z.time, x_z.ruled_phase, x_z.name, round(0.8 * x_z.p + 0.2 * coalesce(x_r.n / x_r.total, 0), 9) AS p, count(x_r.n) OVER (PARTITION BY x_z.symbol, x_z.time) AS known FROM x_z LEFT JOIN x_r ON x_r.symbol = x_z.symbol AND x_r.time = x_z.time AND x_r.phase = x_z.name)
  SELECT symbol, time, CASE WHEN any_value(known) = 0 THEN any_value(ruled_phase) ELSE arg_max(name, (p, name)) END AS posterior FROM x_m GROUP BY symbol, time""")
def q_posterior_phase(spark, sf_dir):
    """The phase after the prior of similar periods: 0.8 of its probability and 0.2 of what followed the three days most like it."""
    scored, bars = _scored(spark, sf_dir)
    priors = phase_prior(written(most_like(_vectors(scored)), "patterns"), bars).select("symbol", "time", "prior")
    f = with_keys(scored, priors, ["symbol", "time"])
    return f.select("symbol", "time", posterior_phase(phase_probabilities(F.col("cycle")), F.col("prior"), F.col("ruled_phase")).alias("posterior"))
