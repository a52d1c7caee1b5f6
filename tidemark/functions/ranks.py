"""Percentile ranks over the rows up to each row, by Arrow kernels over stretches of a series.

A rank among the last n rows needs an ordered set that rows enter and leave, which no window function keeps. Series are cut into
stretches of SPAN rows that carry the n - 1 rows before them along, so a task holds one stretch whatever the series' length.
An expanding rank needs all rows before: a tree by value counts the smaller ones of a row level by level.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.frames import MULTI, bars_multi, rounded
from ..tables import written
from .scans import numbered as number_rows
from .scans import running, with_keys

SPAN, PARTS = 20_000, 32


def percent_below(df: DataFrame, ranks: dict[str, str], n: int, least: int = 1, exclude_self: bool = False) -> DataFrame:
    """df (symbol, time, ...) with, per name in ranks, the share (0..100) of the last n values of its column that are strictly below the row's.

    Null values count nowhere and have no rank; fewer than `least` values give null. exclude_self: the row's own value is no sample.
    """
    halo, outs = n - 1, list(ranks)
    if halo > SPAN:
        raise ValueError(f"a window has at most {SPAN + 1} rows")
    numbered = written(number_rows(df), "numbered")
    values = numbered.select("symbol", F.col("_rn").cast("int").alias("_rn"), *[F.col(c).cast("double").alias(o) for o, c in ranks.items()])
    own = F.expr(f"_rn div {SPAN}")
    stretches = F.when(F.col("_rn") % SPAN >= SPAN - halo, F.array(own, own + 1)).otherwise(F.array(own)) if halo else F.array(own)
    dealt = values.withColumn("_b", F.explode(stretches))

    def run(key, frame):
        import pandas as pd

        frame = frame.sort_values("_rn")
        first = int(key[1]) * SPAN
        mine = frame._rn.to_numpy() >= first
        result = {"symbol": key[0], "_rn": frame._rn.to_numpy()[mine]}
        for o in outs:
            held, found = [], []
            x = frame[o].to_numpy(dtype=float)
            for k, v in enumerate(x):
                if k >= n:
                    gone = x[k - n]
                    if gone == gone:
                        held.pop(bisect_left(held, gone))
                if v != v:
                    found.append(None)
                    continue
                below, size = bisect_left(held, v), len(held)
                insort(held, v)
                size += 0 if exclude_self else 1
                found.append(100.0 * below / size if size >= max(1, least) else None)
            result[o] = pd.array([f for f, m in zip(found, mine, strict=True) if m], dtype="Float64")
        return pd.DataFrame(result)

    ranked = dealt.groupBy("symbol", "_b").applyInPandas(run, "symbol string, _rn int, " + ", ".join(f"{o} double" for o in outs))
    return with_keys(numbered, ranked, ["symbol", "_rn"]).drop("_rn")


def _smaller_before(x: np.ndarray, part: int = 256) -> np.ndarray:
    """Per value, how many earlier ones are smaller: those of the parts before by their sorted values, those of the own part one by one."""
    out, held = np.zeros(len(x), np.int64), np.empty(0, x.dtype)
    for a in range(0, len(x), part):
        own = x[a : a + part]
        out[a : a + part] = np.searchsorted(held, own) + np.tril(own[None, :] < own[:, None], -1).sum(axis=1)
        held = np.sort(np.concatenate([held, own]), kind="stable")
    return out


def _counted(groups, column: str) -> DataFrame:
    """symbol, _rn, below: earlier rows of the same group whose column is smaller."""

    def run(frame):
        import pandas as pd

        frame = frame.sort_values("_rn")
        return pd.DataFrame({"symbol": frame.symbol, "_rn": frame._rn, "below": _smaller_before(frame[column].to_numpy())})

    return groups.applyInPandas(run, "symbol string, _rn long, below long")


def smaller_before(values: DataFrame, span: int = SPAN, parts: int = PARTS) -> DataFrame:
    """values (symbol, _rn, x; x no null): symbol, _rn, below, how many earlier values of the symbol are strictly smaller.

    A tree by value. A node of more than `span` rows is cut at quantiles, each cut being a part of its own, so that a value that
    repeats is never cut again. Of a row's smaller ones those in lower parts of its node are counted at the node: per part and
    stretch of time by running sums, in the own stretch by a kernel; those in its own part further down. A row takes part once per
    level, and levels are as few as the logarithm of the rows to the base `parts`.
    """
    values, found, level = values.withColumn("_node", F.lit("")), [], 0
    keys = ["symbol", "_node"]
    while True:
        cuts = F.percentile_approx("x", [k / parts for k in range(1, parts)], 10 * parts).alias("_cuts")
        large = values.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("x").alias("_lo"), F.max("x").alias("_hi"), cuts).filter((F.col("_n") > span) & (F.col("_lo") < F.col("_hi")))
        large = written(large.select(*keys, "_cuts"), "rank-nodes")
        if not large.limit(1).count():
            break
        cut = with_keys(values, large, keys)
        found.append(_counted(cut.filter("_cuts IS NULL").groupBy(*keys), "x"))
        part = F.size(F.filter("_cuts", lambda c: c < F.col("x"))) + F.size(F.filter("_cuts", lambda c: c <= F.col("x")))
        rows = cut.filter("_cuts IS NOT NULL").withColumn("_part", part).withColumn("_s", F.expr(f"_rn div {span * parts**level}"))
        rows = written(rows.drop("_cuts"), "rank-rows")
        found.append(_counted(rows.groupBy(*keys, "_s"), "_part"))
        # Per stretch and part: rows of lower parts in all earlier stretches. Every stretch has a row for each part of its node.
        counts = rows.groupBy(*keys, "_s", "_part").agg(F.count("*").alias("_n"))
        grid = counts.select(*keys, "_s").distinct().select(*keys, "_s", F.explode(F.sequence(F.lit(0), F.lit(2 * parts))).alias("_part"))
        grid = with_keys(grid, counts, [*keys, "_s", "_part"]).withColumn("_n", F.coalesce("_n", F.lit(0)))
        grid = grid.withColumn("_n", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        grid = grid.withColumn("below", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "_s").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        found.append(with_keys(rows, grid.select(*keys, "_s", "_part", "below"), [*keys, "_s", "_part"]).select("symbol", "_rn", "below"))
        values, level = rows.select("symbol", "_rn", "x", F.concat_ws("/", "_node", F.col("_part").cast("string")).alias("_node")), level + 1
    found.append(_counted(values.groupBy(*keys), "x") if not level else _counted(with_keys(values, values.groupBy(*keys).agg((F.min("x") < F.max("x")).alias("_differ")), keys).filter("_differ").groupBy(*keys), "x"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.groupBy("symbol", "_rn").agg(F.sum("below").alias("below"))


def expanding_percent_below(df: DataFrame, out: str, column: str, least: int = 2, span: int = SPAN, parts: int = PARTS) -> DataFrame:
    """df with the share (0..100) of all earlier values of the column that are strictly below the row's; null before `least` of them."""
    x = F.col(column).cast("double")
    numbered = written(number_rows(df).withColumn("_x", F.when(~F.isnan(x), x)), "numbered")
    below = smaller_before(numbered.filter("_x IS NOT NULL").select("symbol", "_rn", F.col("_x").alias("x")), span, parts)
    t = running(numbered.withColumn("_s", F.expr(f"_rn div {span}")), {"_size": ("count", F.col("_x"))}, ("symbol",), "_s", ("_rn",), before=True)
    rank = F.when(F.col("_x").isNotNull() & (F.col("_size") >= least), 100.0 * F.coalesce("below", F.lit(0)) / F.col("_size"))
    return with_keys(t, below, ["symbol", "_rn"]).withColumn(out, rank).drop("_rn", "_x", "_s", "_size", "below")


@query("rank_expanding", f"""WITH {MULTI}, l AS (SELECT symbol, time, close, list(close) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM bars)
  SELECT symbol, time, round(CASE WHEN len(earlier) >= 2 THEN 100.0 * len(list_filter(earlier, lambda x: x < close)) / len(earlier) END, 6) AS rank FROM l""")
def rank_expanding(spark, sf_dir):
    """Expanding percentile rank: strictly below, at least two earlier samples."""
    return rounded(expanding_percent_below(bars_multi(spark, sf_dir), "rank", "close").select("symbol", "time", "rank"), 6)


@query("rank_rolling", f"""WITH {MULTI}, l AS (SELECT symbol, time, close, list(close) OVER (PARTITION BY symbol ORDER BY time ROWS 364 PRECEDING) AS last FROM bars)
  SELECT symbol, time, round(CASE WHEN len(last) >= 30 THEN 100.0 * len(list_filter(last, lambda x: x < close)) / len(last) END, 6) AS rank FROM l""")
def rank_rolling(spark, sf_dir):
    return rounded(percent_below(bars_multi(spark, sf_dir), {"rank": "close"}, 365, 30).select("symbol", "time", "rank"), 6)
