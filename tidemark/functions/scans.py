"""Recurrences over ordered rows as scans: y becomes a y + b, row by row, without a fold over a key.

The maps y -> a y + b compose to maps of the same form, so a stretch of rows is one map. Rows are numbered from counts per
bucket of time, cut into stretches, composed inside each stretch by two running sums, and each stretch is given the value that
the maps of the stretches before it lead to. A key of any length becomes many tasks, all of them window functions.

a is given as fade = -ln(a) >= 0. Inside a stretch the sum of b's is weighed by exp(fades so far), so the fades after a
stretch's first row should add up to less than LIMIT; beyond that a number would overflow. What lies two cuts of LIMIT back
weighs less than 1e-130 and is left out where stretches are chained.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 300.0
EXACT = 40.0  # sum of fades of a stretch in smoothed(): the larger, the more digits its weights cost
ROWS = 8192  # of a stretch, at most
UNBOUNDED = Window.unboundedPreceding


def bucket_of(time: str, bucket: str | int) -> Column:
    """A date_trunc unit, or a length for times that are numbers."""
    return F.date_trunc(bucket, time) if isinstance(bucket, str) else F.floor(F.col(time) / bucket)


def with_keys(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of facts, one row per keys, null keys being equal."""
    right = facts.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        on = same if on is None else on & same
    return rows.join(right, on, "left").drop(*[f"_k_{k}" for k in keys])


def numbered(df: DataFrame, time: str = "time", by: tuple = ("symbol",), bucket: str | int = "year", lags: tuple = (), then: tuple = ()) -> DataFrame:
    """df with _rn, the number of rows before it in its key, and _lag_<c>, the value of the row before, for c in lags.

    Counts and last rows per bucket of time go before the rows inside it, so a key is sorted bucket by bucket. Rows of one time
    stand in the order of the columns `then`.
    """
    keys = [*by, "_tb"]
    cut = df.withColumn("_tb", bucket_of(time, bucket))
    last = F.max_by(F.struct(*lags), F.struct(time, *then)) if lags else F.lit(None).cast("struct<x:int>")
    over = Window.partitionBy(*by).orderBy("_tb")
    ends = cut.groupBy(*keys).agg(F.count("*").alias("_n"), last.alias("_last"))
    ends = ends.select(*keys, F.coalesce(F.sum("_n").over(over.rowsBetween(UNBOUNDED, -1)), F.lit(0)).alias("_before"), F.lag("_last").over(over).alias("_last"))
    inside = Window.partitionBy(*keys).orderBy(time, *then)
    out = with_keys(cut, ends, keys).withColumn("_in", F.row_number().over(inside))
    out = out.withColumns({"_rn": F.col("_before") + F.col("_in") - 1} | {f"_lag_{c}": F.when(F.col("_in") == 1, F.col("_last")[c]).otherwise(F.lag(c).over(inside)) for c in lags})
    return out.drop("_tb", "_in", "_before", "_last")


def affine(df: DataFrame, terms: dict[str, tuple[Column, Column]], by: tuple, stretch: str, place: tuple) -> DataFrame:
    """df with, per name in terms, y after each row: y <- exp(-fade) y + add, from 0 at a key's first row.

    by: keys; stretch: a column that rises along a key and cuts it; place: the order inside a stretch.
    """
    inside = Window.partitionBy(*by, stretch).orderBy(*place).rowsBetween(UNBOUNDED, 0)
    t = df.withColumns({f"_f_{n}": fade for n, (fade, _) in terms.items()} | {f"_b_{n}": add for n, (_, add) in terms.items()})
    t = t.withColumns({f"_t_{n}": F.sum(f"_f_{n}").over(inside) for n in terms} | {f"_o_{n}": F.first(f"_f_{n}").over(inside) for n in terms})
    t = t.withColumns({f"_y_{n}": F.exp(F.col(f"_o_{n}") - F.col(f"_t_{n}")) * F.sum(F.col(f"_b_{n}") * F.exp(F.col(f"_t_{n}") - F.col(f"_o_{n}"))).over(inside) for n in terms})
    one = lambda n: F.struct(F.lit(n).alias("term"), F.col(f"_t_{n}").alias("fade"), F.col(f"_y_{n}").alias("add"))
    ends = t.groupBy(*by, stretch).agg(F.max_by(F.array(*map(one, terms)), F.struct(*place)).alias("_ends"))
    carried = _carried(ends.select(*by, stretch, F.explode("_ends").alias("e")).select(*by, stretch, "e.*"), (*by, "term"), stretch)
    carried = carried.groupBy(*by, stretch).agg(*[F.max(F.when(F.col("term") == n, F.col("_carry"))).alias(f"_c_{n}") for n in terms])
    out = with_keys(t, carried, [*by, stretch]).withColumns({n: F.col(f"_y_{n}") + F.exp(-F.col(f"_t_{n}")) * F.coalesce(f"_c_{n}", F.lit(0.0)) for n in terms})
    return out.drop(*[f"_{x}_{n}" for x in "fbtoyc" for n in terms])


def _carried(maps: DataFrame, by: tuple, stretch: str) -> DataFrame:
    """maps (by, stretch, fade, add: one map per stretch) with _carry, the value before each stretch."""
    along = Window.partitionBy(*by).orderBy(stretch)
    m = maps.withColumn("_l", F.sum("fade").over(along.rowsBetween(UNBOUNDED, 0))).withColumn("_z", F.floor(F.col("_l") / LIMIT))
    inside = Window.partitionBy(*by, "_z").orderBy(stretch).rowsBetween(UNBOUNDED, 0)
    m = m.withColumns({"_l0": F.first("_l").over(inside), "_lp": F.lag("_l").over(along)}).withColumn("_lp", F.first("_lp").over(inside))
    m = m.withColumn("_v", F.exp(F.col("_l0") - F.col("_l")) * F.sum(F.col("add") * F.exp(F.col("_l") - F.col("_l0"))).over(inside)).withColumn("_u", F.col("_v"))
    for _ in range(2):  # the end of the cut before, then that with the end of the one before it
        m = m.withColumn("_p", F.lag("_u").over(along)).withColumn("_p", F.first("_p").over(inside))
        m = m.withColumn("_u", F.col("_v") + F.coalesce(F.exp(F.col("_lp") - F.col("_l")) * F.col("_p"), F.lit(0.0)))
    return m.withColumn("_carry", F.lag("_u").over(along)).select(*by, stretch, "_carry")


def running(df: DataFrame, columns: dict[str, tuple[str, Column]], by: tuple, stretch: str, place: tuple, before: bool = False) -> DataFrame:
    """df with running sums, counts or largest values: name -> ("sum", "count" or "max", column), over all stretches of a key.

    before: without the row itself. Totals of the stretches before and a window inside the own one, so no key is one task.
    """
    kinds = {"sum": F.sum, "count": F.count, "max": F.max}
    inside = Window.partitionBy(*by, stretch).orderBy(*place).rowsBetween(UNBOUNDED, -1 if before else 0)
    earlier = Window.partitionBy(*by).orderBy(stretch).rowsBetween(UNBOUNDED, -1)
    df = df.withColumns({f"_v_{n}": c for n, (_, c) in columns.items()})
    totals = df.groupBy(*by, stretch).agg(*[kinds[k](f"_v_{n}").alias(f"_t_{n}") for n, (k, _) in columns.items()])
    totals = totals.select(*by, stretch, *[(F.max if k == "max" else F.sum)(f"_t_{n}").over(earlier).alias(f"_t_{n}") for n, (k, _) in columns.items()])
    both = lambda n, k: F.greatest(f"_t_{n}", kinds[k](f"_v_{n}").over(inside)) if k == "max" else F.coalesce(f"_t_{n}", F.lit(0)) + F.coalesce(kinds[k](f"_v_{n}").over(inside), F.lit(0))
    out = with_keys(df, totals, [*by, stretch]).withColumns({n: both(n, k) for n, (k, _) in columns.items()})
    return out.drop(*[f"_{x}_{n}" for x in "tv" for n in columns])


def sound(x: Column) -> Column:
    """x, or null where it is no finite number."""
    return F.when(F.abs(x) < float("inf"), x)


def smoothed(df: DataFrame, series: dict[str, tuple[str, float, int, int]], by: tuple = ("symbol",), rows: int = ROWS) -> DataFrame:
    """df (numbered) with, per name: column c smoothed as y <- (1 - alpha) y + alpha c, null before the `shown`-th value of c.

    series: name -> (c, alpha, seed, shown); the first y is the mean of the first `seed` values. Values that are null or no
    numbers carry y on.
    """
    rate = {n: -math.log(max(1 - alpha, 1e-16)) for n, (_, alpha, _, _) in series.items()}
    size = max(1, min(rows, int(EXACT / max(rate.values()))))
    columns = sorted({c for c, _, _, _ in series.values()})
    t = df.withColumns({"_stretch": F.floor(F.col("_rn") / size)} | {f"_x_{c}": sound(F.col(c).cast("double")) for c in columns})
    t = running(t, {f"_n__x_{c}": ("count", F.col(f"_x_{c}")) for c in columns}, by, "_stretch", ("_rn",))
    terms = {}
    for n, (c, alpha, seed, _) in series.items():
        x, k = F.col(f"_x_{c}"), F.col(f"_n__x_{c}")
        # The mean of the first values is an affine map too: each adds its share.
        terms[n] = F.when(x.isNotNull() & (k > seed), rate[n]).otherwise(0.0), F.when(x.isNull(), 0.0).when(k <= seed, x / seed).otherwise(x * alpha)
    out = affine(t, terms, by, "_stretch", ("_rn",))
    return out.withColumns({n: F.when(F.col(f"_n__x_{c}") >= shown, F.col(n)) for n, (c, _, _, shown) in series.items()}).drop("_stretch", *[f"_x_{c}" for c in columns], *[f"_n__x_{c}" for c in columns])
