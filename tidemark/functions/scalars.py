"""Scalar functions: safe arithmetic, parsing and normalization, ramps and gradients, all as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import query
from ..sources.frames import MULTI, bars_multi, rounded, table


def finite(c: Column) -> Column:
    """NULL for NaN and the infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def to_double(c) -> Column:
    """Lenient cast: what is no number becomes NULL."""
    return finite(F.expr(f"try_cast({c} AS double)") if isinstance(c, str) else c.try_cast("double"))


def safe_divide(a, b, default: float | None = None) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce(finite(F.try_divide(a, b)), F.lit(default).cast("double"))


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def ramp(c: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear through (x, y) points in rising x, constant outside."""
    out = F.lit(points[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        out = F.when(c < x1, F.lit(y0) + (c - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(c.isNull(), None).when(c <= points[0][0], points[0][1]).otherwise(out)


def first_at_most(c: Column, steps: list[tuple[float, float]], default: float = 1.0) -> Column:
    """The factor of the first threshold (rising) that is not below c."""
    out = F.lit(default)
    for threshold, factor in sorted(steps, reverse=True):
        out = F.when(c <= threshold, factor).otherwise(out)
    return out


def two_sided(c: Column, steps: list[tuple[float, float]]) -> Column:
    """Low thresholds (to 50) raise the multiplier, the first that holds; high ones lower it."""
    low = first_at_most(c, [s for s in steps if s[0] <= 50])
    high = F.least(*[F.when(c >= t, f).otherwise(1.0) for t, f in steps if t > 50], F.lit(1.0), F.lit(1.0))
    return F.when(low > 1, low).otherwise(high)


def level(c: Column, limits: list[float], names: list[str]) -> Column:
    """names[i] for values below limits[i], the last name above all."""
    out = F.lit(names[-1])
    for limit, name in reversed(list(zip(limits, names, strict=False))):
        out = F.when(c < limit, name).otherwise(out)
    return F.when(c.isNotNull(), out)


def cosine(a: str, b: str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similarity(a: str, b: str) -> Column:
    """0.6 of the cosine, scaled to 0..1, and 0.4 of the closeness by distance."""
    gap = F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: F.pow(p.cast("double") - q.cast("double"), 2)), F.lit(0.0), lambda s, v: s + v))
    near = F.greatest(F.lit(0.0), 1 - gap / F.sqrt(2.0 * F.size(a)))
    return 0.6 * (cosine(a, b) + 1) / 2 + 0.4 * near


def flow_number(c: Column) -> Column:
    """Money in millions: (1.2) is negative, blank and dash are 0, n.a. is unknown."""
    t = F.trim(F.regexp_replace(c, r"[,$]", ""))
    n = F.regexp_replace(t, r"[()]", "").try_cast("double") * 1e6
    return F.when(F.lower(t).isin("n.a.", "na", "n/a"), None).when(t.isin("", "-"), 0.0).when(t.startswith("("), -n).otherwise(n)


def parse_time(c: Column) -> Column:
    """ISO text, dates, and epochs in seconds, milli- or microseconds by magnitude; 0 is unknown."""
    n = c.try_cast("decimal(30,6)").cast("double")
    epoch = F.when(n == 0, None).when(n >= 1e14, F.timestamp_micros(n.cast("long"))).when(n >= 1e11, F.timestamp_millis(n.cast("long"))).otherwise(F.timestamp_seconds(n))
    text = F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy/MM/dd HH:mm:ss")), F.try_to_timestamp(c, F.lit("yyyy/MM/dd")), F.try_to_timestamp(c, F.lit("dd-MM-yyyy")))
    return F.when(n.isNotNull(), epoch).otherwise(text)


def to_decimal(c: Column, digits: int = 8) -> Column:
    """Without thousands separators and percent signs; words for nothing are NULL; rounds half up."""
    t = F.trim(F.regexp_replace(c, "[,%]", ""))
    return F.when(F.lower(t).isin("", "null", "none", "nan", "n/a", "-"), None).otherwise(F.round(t.try_cast(f"decimal(30,{digits + 4})"), digits)).cast(f"decimal(30,{digits})")


def compact_symbol(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"[\s\-_/:.]", ""))


QUOTES = ("USDT", "USDC", "BUSD", "USD", "EUR", "BTC", "ETH")


def split_pair(c: Column) -> tuple[Column, Column]:
    """Base and quote of a trading pair."""
    pattern = f"^(.+?)({'|'.join(QUOTES)})$"
    s = compact_symbol(c)
    return F.nullif(F.regexp_extract(s, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(s, pattern, 2), F.lit(""))


def option_parts(c: Column) -> dict[str, Column]:
    """Underlying, expiry (8:00), strike and type of names such as BTC-27JUN25-100000-C."""
    part = lambda k: F.nullif(F.regexp_extract(c, r"^([A-Z]+)-(\d{1,2}[A-Z]{3}\d{2})-(\d+)-([CP])$", k), F.lit(""))
    day = F.try_to_timestamp(F.initcap(F.regexp_replace(F.lpad(part(2), 7, "0"), "^(..)(...)(..)$", "$1-$2-20$3")), F.lit("dd-MMM-yyyy"))
    return {"underlying": part(1), "expiry": day + F.expr("INTERVAL 8 HOURS"), "strike": part(3).try_cast("double"), "kind": part(4)}


@query("scalar_returns", f"""WITH {MULTI} SELECT symbol, time, round(close / lag(close) OVER w - 1, 6) AS simple, round(ln(close / lag(close) OVER w), 6) AS log,
  round((close - low) / nullif(high - low, 0), 6) AS place FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time)""")
def scalar_returns(spark, sf_dir):
    from .windows import log_return, simple_return

    b = bars_multi(spark, sf_dir)
    return rounded(b.select("symbol", "time", simple_return("close").alias("simple"), log_return("close").alias("log"), safe_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")).alias("place")), 6)


@query("scalar_ramps", """SELECT event_id, round(CASE WHEN value <= 50 THEN 0 WHEN value < 100 THEN (value - 50) * 0.5 WHEN value < 300 THEN 25 + (value - 100) * 0.25 WHEN value >= 300 THEN 75 END, 6) AS ramped,
  CAST(CASE WHEN -value / 500 <= -0.4 THEN 2.5 WHEN -value / 500 <= -0.3 THEN 2.0 WHEN -value / 500 <= -0.2 THEN 1.5 WHEN -value / 500 <= -0.1 THEN 1.2 ELSE 1.0 END AS DOUBLE) AS dip,
  CAST(CASE WHEN value / 5 <= 15 THEN 3.0 WHEN value / 5 <= 30 THEN 2.0 WHEN value / 5 >= 85 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS valuation,
  CASE WHEN value < 60 THEN 'LOW' WHEN value < 200 THEN 'MID' ELSE 'HIGH' END AS band, round(least(greatest(value / 100 - 1, -1), 1), 6) AS clamped FROM events""")
def scalar_ramps(spark, sf_dir):
    v = F.col("value")
    e = table(spark, sf_dir, "events").select(
        "event_id", ramp(v, [(50, 0.0), (100, 25.0), (300, 75.0)]).alias("ramped"), first_at_most(-v / 500, [(-0.4, 2.5), (-0.3, 2.0), (-0.2, 1.5), (-0.1, 1.2)]).alias("dip"),
        two_sided(v / 5, [(15, 3.0), (30, 2.0), (85, 0.5)]).alias("valuation"), level(v, [60, 200], ["LOW", "MID", "HIGH"]).alias("band"), clamp(v / 100 - 1, -1.0, 1.0).alias("clamped"))
    return rounded(e, 6)


@query("scalar_similarity", """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (
  SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS c, list_distance(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS d, len(embedding) AS n FROM embeddings, q)
  SELECT vec_id, round(c, 6) AS cosine, round(0.6 * (c + 1) / 2 + 0.4 * greatest(0, 1 - d / sqrt(2 * n)), 6) AS similarity FROM s""")
def scalar_similarity(spark, sf_dir):
    """Similarity of every vector with one (a single row is broadcast, whatever the rows of that id)."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id = 0").agg(F.max("embedding").alias("q"))
    return rounded(e.join(F.broadcast(q)).select("vec_id", cosine("embedding", "q").alias("cosine"), similarity("embedding", "q").alias("similarity")), 6)


@query("scalar_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def scalar_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("scalar_symbols", """SELECT c_custkey, upper(regexp_replace(c_name, '[\\s\\-_/:.#]', '', 'g')) AS compact, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'AUTOMOBILE' THEN 2 ELSE 0 END AS ordinal FROM customer""")
def scalar_symbols(spark, sf_dir):
    order = F.create_map(*[F.lit(x) for x in ("BUILDING", 1, "AUTOMOBILE", 2)])
    return table(spark, sf_dir, "customer").select("c_custkey", F.upper(F.regexp_replace("c_name", r"[\s\-_/:.#]", "")).alias("compact"), F.coalesce(F.try_element_at(order, "c_mktsegment"), F.lit(0)).alias("ordinal"))


@query("scalar_calendar", "SELECT DISTINCT o_orderdate AS day, CAST(isodow(o_orderdate) AS INT) AS iso_weekday, CAST(day(o_orderdate) AS INT) AS month_day, to_timestamp(floor(epoch(o_orderdate) / 604800) * 604800) AT TIME ZONE 'UTC' AS week_slot FROM orders")
def scalar_calendar(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("day")).distinct()
    slot = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("day").cast("timestamp")) / 604800) * 604800)
    return d.select("day", (F.weekday("day") + 1).alias("iso_weekday"), F.dayofmonth("day").alias("month_day"), slot.cast("timestamp_ntz").alias("week_slot"))


_TEXTS = "CASE event_id % 7 WHEN 0 THEN concat('(', {v}, '.5)') WHEN 1 THEN concat('$1,', 100 + event_id % 900, '.25') WHEN 2 THEN '-' WHEN 3 THEN ' ' WHEN 4 THEN 'n.a.' WHEN 5 THEN 'about 3' ELSE concat('', {v}) END"


@query("scalar_flow_numbers", f"""WITH t AS (SELECT event_id, {_TEXTS.format(v='CAST(floor(value) AS BIGINT)')} AS t FROM events), c AS (SELECT *, trim(regexp_replace(t, '[,$]', '', 'g')) AS x FROM t)
  SELECT event_id, try_cast(t AS DOUBLE) AS lenient, CASE WHEN lower(x) IN ('n.a.', 'na', 'n/a') THEN NULL WHEN x IN ('', '-') THEN 0 WHEN x LIKE '(%' THEN -try_cast(regexp_replace(x, '[()]', '', 'g') AS DOUBLE) * 1e6 ELSE try_cast(x AS DOUBLE) * 1e6 END AS flow FROM c""")
def scalar_flow_numbers(spark, sf_dir):
    """Text as numbers: lenient, and as flows in millions with brackets, blanks and dashes."""
    t = table(spark, sf_dir, "events").selectExpr("event_id", f"{_TEXTS.format(v='CAST(floor(value) AS BIGINT)')} AS t")
    return t.select("event_id", to_double("t").alias("lenient"), flow_number(F.col("t")).alias("flow"))
