"""Scalar rules for records of market, sentiment, macro and option data, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import query
from ..sources.frames import MULTI, bars_multi, rounded, table

# Coefficients of quality marks, unit factors, aliases of bar intervals, keys that hold a document's rows.
QUALITY = {"VERIFIED": 1.0, "ESTIMATED": 0.9, "STALE": 0.5, "SUSPECT": 0.5, "UNAVAILABLE": 0.0}
UNKNOWN_QUALITY = 0.8
UNITS = {"satoshi": 1e-8, "wei": 1e-18, "gwei": 1e-9, "percent": 0.01, "bps": 0.0001, "thousand": 1e3, "million": 1e6, "billion": 1e9}
INTERVALS = {
    "1m": "1m", "1min": "1m", "60": "1m", "5m": "5m", "5min": "5m", "300": "5m", "15m": "15m", "15min": "15m", "30m": "30m", "1h": "1h", "60min": "1h", "1hour": "1h", "3600": "1h",
    "4h": "4h", "240min": "4h", "1d": "1d", "1day": "1d", "d": "1d", "daily": "1d", "86400": "1d", "1w": "1w", "1week": "1w", "w": "1w", "weekly": "1w",
}
LIST_KEYS = ("data", "result", "list", "rows", "items", "values")


def lookup(c: Column, table_: dict, default=None) -> Column:
    """The value of a literal map, or the default."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in table_.items() for x in kv]), c)
    return known if default is None else F.coalesce(known, F.lit(default))


def quality_coefficient(status: Column) -> Column:
    """1 for verified and for no mark at all, less for the others, 0.8 for a mark that is not known."""
    return F.when(status.isNull(), 1.0).otherwise(lookup(F.upper(status), QUALITY, UNKNOWN_QUALITY))


def normalized_weights(weights: dict[str, Column]) -> dict[str, Column]:
    """Negative and missing weights are 0; they add up to 1, and are all alike if none is positive."""
    sound = {k: F.greatest(F.coalesce(w, F.lit(0.0)), F.lit(0.0)) for k, w in weights.items()}
    total = sum(sound.values(), F.lit(0.0))
    return {k: F.when(total > 0, w / total).otherwise(1.0 / len(sound)) for k, w in sound.items()}


def to_int(c: Column) -> Column:
    """Text or number to an integer, halves away from zero; NULL for what is no number."""
    return F.round(F.regexp_replace(F.trim(c.cast("string")), ",", "").try_cast("decimal(30,8)"), 0).cast("long")


def scaled(c: Column, unit: Column) -> Column:
    return c * lookup(F.lower(unit), UNITS, 1.0)


def metric_name(c: Column) -> Column:
    """Upper case, runs of anything but letters and digits as one underscore."""
    return F.upper(F.regexp_replace(F.regexp_replace(F.trim(c), r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""))


def interval_name(c: Column) -> Column:
    """The canonical name of a bar's interval. A capital M is a month, which is kept as weeks are."""
    return F.when(F.trim(c) == "1M", "1w").otherwise(lookup(F.lower(F.trim(c)), INTERVALS))


def first_list(document: Column, keys=LIST_KEYS) -> Column:
    """The first of a JSON document's keys, in order, that holds a list, as text; the document itself if it is one."""
    array = lambda c: F.when(F.ltrim(c).startswith("["), c)
    return F.coalesce(array(document), *[array(F.get_json_object(document, f"$.{k}")) for k in keys])


def path(document: Column, keys: list[str]) -> Column:
    """A value by its path, each key as written, in lower or in upper case."""
    out = document
    for k in keys:
        out = F.coalesce(*[F.get_json_object(out, f"$.{form}") for form in dict.fromkeys((k, k.lower(), k.upper()))])
    return out


def sentiment(c: Column, fear_greed: Column) -> Column:
    """Fear and greed only within 0..100; other scores up to 1 are shares."""
    return F.when(fear_greed, F.when(c.between(0, 100), c)).otherwise(F.when(F.abs(c) <= 1, c * 100).otherwise(c))


def sentiment_class(c: Column) -> Column:
    return F.when(c >= 80, "very_positive").when(c >= 60, "positive").when(c >= 40, "neutral").when(c >= 20, "negative").when(c.isNotNull(), "very_negative")


def interpolated(points: Column, at: Column, x: str, y: str) -> Column:
    """y at `at` on the line through an array of structs, constant beyond its ends."""
    sorted_ = F.array_sort(F.filter(points, lambda p: p[x].isNotNull() & p[y].isNotNull()))
    below, above = F.filter(sorted_, lambda p: p[x] <= at), F.filter(sorted_, lambda p: p[x] >= at)
    lo, hi = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    between = lo[y] + F.coalesce(F.try_divide((at - lo[x]) * (hi[y] - lo[y]), hi[x] - lo[x]), F.lit(0.0))
    return F.when(lo.isNull(), hi[y]).when(hi.isNull(), lo[y]).otherwise(between)


def quote_fields(bid: Column, ask: Column) -> dict[str, Column]:
    mid = (bid + ask) / 2
    return {"spread": ask - bid, "mid": mid, "spread_pct": F.when(mid > 0, (ask - bid) / mid * 100)}


_MAP = lambda c, t, d: f"CASE {c} {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in t.items())} ELSE {d} END"


@query("record_quality", """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.9 WHEN 3 THEN 0.5 WHEN 4 THEN 0.5 WHEN 5 THEN 0.0 ELSE 0.8 END::DOUBLE AS coefficient,
  round(CASE WHEN greatest(value, 0) + greatest(100 - value, 0) > 0 THEN greatest(100 - value, 0) / (greatest(value, 0) + greatest(100 - value, 0)) ELSE 0.5 END, 6) AS weight_a FROM events""")
def record_quality(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 7
    status = F.when(k == 0, None).otherwise(F.element_at(F.array(*[F.lit(x) for x in ("verified", "ESTIMATED", "STALE", "SUSPECT", "UNAVAILABLE", "other")]), F.greatest(k, F.lit(1)).cast("int")))
    return rounded(e.select("event_id", quality_coefficient(status).alias("coefficient"), normalized_weights({"a": 100 - F.col("value"), "b": F.col("value")})["a"].alias("weight_a")), 6)


@query("record_units", f"""SELECT event_id, CAST(round(CAST(value AS DECIMAL(30,8)), 0) AS BIGINT) AS whole, value * {_MAP("CASE event_id % 4 WHEN 0 THEN 'satoshi' WHEN 1 THEN 'percent' WHEN 2 THEN 'million' ELSE 'none' END", UNITS, 1.0)} AS scaled,
  CASE event_id % 4 WHEN 0 THEN '1h' WHEN 1 THEN '1d' WHEN 2 THEN '1w' END AS bar FROM events""")
def record_units(spark, sf_dir):
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", to_int(F.col("value")).alias("whole"), scaled(F.col("value"), pick("SATOSHI", "percent", "Million", "none")).alias("scaled"), interval_name(pick(" 60min", "Daily", "1M", "odd")).alias("bar"))


@query("record_names", "SELECT p_partkey, trim(upper(regexp_replace(p_name || ' (' || p_type || ')', '[^A-Za-z0-9]+', '_', 'g')), '_') AS metric FROM part")
def record_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", metric_name(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("metric"))


@query("record_documents", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL ELSE event_id END AS deep, CASE event_id % 3 WHEN 2 THEN NULL ELSE 2 END AS items FROM events""")
def record_documents(spark, sf_dir):
    """A path with keys in other cases, and the list of a document by the priority of keys."""
    i = F.col("event_id").cast("string")
    doc = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"result": {"x": 1}, "rows": ['), i, F.lit(", 7]}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"DATA": {"Value": '), i, F.lit('}, "list": [1, 2]}'))).otherwise(F.concat(F.lit('{"data": {"value": '), i, F.lit("}}")))
    e = table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))
    return e.select("event_id", path(F.col("doc"), ["data", "Value"]).cast("long").alias("deep"), F.json_array_length(first_list(F.col("doc"))).alias("items"))


@query("record_sentiment", """WITH s AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CASE WHEN value BETWEEN 0 AND 100 THEN value END ELSE CASE WHEN value / 100 <= 1 THEN value / 100 * 100 ELSE value / 100 END END AS score FROM events)
  SELECT event_id, round(score, 6) AS score, CASE WHEN score >= 80 THEN 'very_positive' WHEN score >= 60 THEN 'positive' WHEN score >= 40 THEN 'neutral' WHEN score >= 20 THEN 'negative' WHEN score IS NOT NULL THEN 'very_negative' END AS class FROM s""")
def record_sentiment(spark, sf_dir):
    fg = F.col("event_id") % 2 == 0
    score = sentiment(F.when(fg, F.col("value")).otherwise(F.col("value") / 100), fg)
    return table(spark, sf_dir, "events").select("event_id", F.round(score, 6).alias("score"), sentiment_class(score).alias("class"))


@query("record_quotes", f"""WITH {MULTI} SELECT symbol, time, round(high - low, 4) AS spread, round((high + low) / 2, 4) AS mid, round((high - low) / nullif((high + low) / 2, 0) * 100, 6) AS spread_pct,
  round((open + close) / 2 * volume / volume, 4) AS vwap FROM bars""")
def record_quotes(spark, sf_dir):
    """Spread, middle and their ratio; a volume-weighted price from the quote volume."""
    b = bars_multi(spark, sf_dir).withColumn("quote_volume", (F.col("open") + F.col("close")) / 2 * F.col("volume"))
    q = quote_fields(F.col("low"), F.col("high"))
    return b.select("symbol", "time", F.round(q["spread"], 4).alias("spread"), F.round(q["mid"], 4).alias("mid"), F.round(q["spread_pct"], 6).alias("spread_pct"), F.round(F.try_divide("quote_volume", "volume"), 4).alias("vwap"))


@query("record_interpolated", """SELECT o_orderkey, round(CASE WHEN d <= 10 THEN p WHEN d >= 50 THEN p * 3 WHEN d <= 25 THEN p + (d - 10) / 15.0 * (p * 0.5) ELSE p * 1.5 + (d - 25) / 25.0 * (p * 1.5) END, 4) AS iv
  FROM (SELECT o_orderkey, o_totalprice AS p, CAST(o_orderkey % 61 AS DOUBLE) AS d FROM orders)""")
def record_interpolated(spark, sf_dir):
    """A curve of three points per row, read at the row's own place."""
    point = lambda x, f: F.struct(F.lit(float(x)).alias("x"), (F.col("o_totalprice") * f).alias("y"))
    at = (F.col("o_orderkey") % 61).cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(interpolated(F.array(point(50, 3.0), point(10, 1.0), point(25, 1.5)), at, "x", "y"), 4).alias("iv"))


@query("record_year_on_year", """WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders GROUP BY 1)
  SELECT month, round((value / lag(value, 12) OVER (ORDER BY month) - 1) * 100, 6) AS change FROM m""")
def record_year_on_year(spark, sf_dir):
    """Against the value twelve monthly points before; a table of months is small, so its window has no key."""
    from pyspark.sql import Window

    months = table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))
    return months.select("month", F.round((F.try_divide("value", F.lag("value", 12).over(Window.orderBy("month"))) - 1) * 100, 6).alias("change"))
