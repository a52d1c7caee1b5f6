"""Raw provider documents to audited values: a table of rules, applied in one scan.

A rule says where in a document its points are, which field each value may come from, how many digits it keeps and what must be
there. Rules are rows: a document meets its provider's rule, or the one for all providers, by a broadcast of that small table, and
one projection over arrays takes the values. Every point keeps the rule and the sources that its values came from; a point that
fails is not dropped but carries the reasons.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from .scalars import parse_time, to_decimal


class Rule(NamedTuple):
    """fields: (target, digits kept or TEXT, required, sources in order)."""

    provider: str
    category: str
    kind: str
    path: str
    times: tuple
    fields: tuple


TEXT = -1
# The names that providers give to fields, digits by kind of number, and the places of values in arrays.
BTC, USD, RATIO, SHARE, WHOLE = 8, 2, 10, 4, 0
TIMES = ("time", "timestamp", "ts", "t", "E", "openTime", "open_time", "datetime", "date", "day", "created_at", "createdAt", "event_time", "fundingTime")
SYMBOL = ("symbol", "pair", "instrument", "market", "contract", "instId", "product_id")
VOLUME = ("volume", "vol", "volume24h", "volume_24h", "v", "baseVolume", "qty")
QUOTE_VOLUME = ("quoteVolume", "quote_volume", "quoteVolume24h", "turnover", "volumeUsd", "volume_usd", "amount")
PRICE_FIELDS = (
    ("price", BTC, True, ("lastPrice", "last_price", "last", "price", "close", "c", "mark_price", "markPrice", "index_price", "indexPrice", "v", "value", "y", "usd", "px")),
    ("bid", BTC, False, ("bidPrice", "bid_price", "bid", "bestBid", "best_bid", "b")), ("ask", BTC, False, ("askPrice", "ask_price", "ask", "bestAsk", "best_ask", "a")),
    ("high_24h", BTC, False, ("highPrice", "high_price", "high24h", "high_24h", "h", "high24Hour")), ("low_24h", BTC, False, ("lowPrice", "low_price", "low24h", "low_24h", "l", "low24Hour")),
    ("volume_24h", SHARE, False, VOLUME), ("quote_volume_24h", SHARE, False, QUOTE_VOLUME),
    ("price_change_pct_24h", SHARE, False, ("priceChangePercent", "price_change_percent", "change24h", "changePercent24h", "change_pct_24h", "priceChangePct", "change24Hour")),
    ("market_cap", USD, False, ("marketCap", "market_cap", "marketCapUsd", "mc")), ("symbol", TEXT, False, SYMBOL))
CANDLE_FIELDS = (
    ("open", BTC, True, ("open", "o", "openPrice", "open_price")), ("high", BTC, True, ("high", "h", "highPrice", "high_price")), ("low", BTC, True, ("low", "l", "lowPrice", "low_price")), ("close", BTC, True, ("close", "c", "closePrice", "close_price")),
    ("volume", SHARE, False, VOLUME), ("quote_volume", SHARE, False, QUOTE_VOLUME), ("trades", WHOLE, False, ("trades", "n", "trade_count", "count", "num_trades")),
    ("taker_buy_volume", SHARE, False, ("takerBuyBaseAssetVolume", "taker_buy_volume", "takerBuyVolume", "buyVol", "buy_vol")), ("taker_sell_volume", SHARE, False, ("takerSellBaseAssetVolume", "taker_sell_volume", "takerSellVolume", "sellVol", "sell_vol")),
    ("symbol", TEXT, False, SYMBOL))
PLACES = {"binance": {"open": 1, "high": 2, "low": 3, "close": 4, "volume": 5, "quote_volume": 7, "trades": 8, "taker_buy_volume": 9, "taker_sell_volume": 10}, "okx": {"open": 1, "high": 2, "low": 3, "close": 4, "volume": 5, "quote_volume": 7}}


def placed(layout: str) -> tuple:
    """Candle fields by their places in an array; what has no place there keeps its names."""
    return tuple((t, d, r, (str(PLACES[layout][t]),) if t in PLACES[layout] else s) for t, d, r, s in CANDLE_FIELDS)


RULES = (
    Rule("*", "market", "price", "$", TIMES, PRICE_FIELDS),
    Rule("*", "market", "ohlcv", "$", ("openTime", "open_time", "time", "timestamp", "ts", "t", "datetime", "date"), CANDLE_FIELDS),
    Rule("binance", "market", "price", "$", ("closeTime", "E", "time", "timestamp"), (
        ("price", BTC, True, ("lastPrice", "price", "last")), ("bid", BTC, False, ("bidPrice", "bid")), ("ask", BTC, False, ("askPrice", "ask")), ("high_24h", BTC, False, ("highPrice",)), ("low_24h", BTC, False, ("lowPrice",)),
        ("volume_24h", SHARE, False, ("volume",)), ("quote_volume_24h", SHARE, False, ("quoteVolume",)), ("price_change_pct_24h", SHARE, False, ("priceChangePercent",)), ("symbol", TEXT, False, ("symbol",)))),
    Rule("binance", "market", "ohlcv", "$", ("0",), placed("binance")),
    Rule("okx", "market", "price", "$.data[0]", ("ts", "uTime"), (
        ("price", BTC, True, ("last",)), ("bid", BTC, False, ("bidPx",)), ("ask", BTC, False, ("askPx",)), ("high_24h", BTC, False, ("high24h",)), ("low_24h", BTC, False, ("low24h",)), ("volume_24h", SHARE, False, ("vol24h", "vol")), ("symbol", TEXT, False, ("instId",)))),
    Rule("okx", "market", "ohlcv", "$.data", ("0",), placed("okx")),
    Rule("coinbase", "market", "price", "$.data", TIMES, (("price", BTC, True, ("amount", "price", "last")), ("symbol", TEXT, False, ("product_id", "pair")))),
    Rule("coingecko", "market", "price", "$.market_data.current_price", TIMES, (
        ("price", BTC, True, ("usd", "current_price")), ("high_24h", BTC, False, ("high_24h",)), ("low_24h", BTC, False, ("low_24h",)), ("volume_24h", SHARE, False, ("total_volume",)), ("market_cap", USD, False, ("market_cap",)), ("price_change_pct_24h", SHARE, False, ("price_change_percentage_24h",)))),
    Rule("*", "onchain", "metric", "$", ("t", "time", "timestamp", "date", "datetime", "d", "day", "ts"), (("value", RATIO, True, ("v", "value", "val", "amount", "data", "y", "metric_value")), ("metric_name", TEXT, False, ("metric", "metric_name", "name", "indicator", "id", "series")))),
    Rule("glassnode", "onchain", "metric", "$", ("t",), (("value", RATIO, True, ("v", "value")),)),
    Rule("cryptoquant", "onchain", "metric", "$.data", ("date", "datetime"), (("value", RATIO, True, ("value", "v")),)),
    Rule("*", "etf", "flow", "$", ("date", "day", "time", "timestamp", "tradeDate"), (
        ("ticker", TEXT, True, ("ticker", "symbol", "fund", "etf", "code", "fundTicker")), ("net_flow_usd", USD, False, ("net_flow_usd", "netFlow", "net_flow", "daily_net_flow", "flow_usd", "totalNetFlow", "netFlowUsd")),
        ("total_holdings_btc", BTC, False, ("total_holdings_btc", "holdings_btc", "btcHoldings", "totalBtc", "holdingsBtc")), ("total_aum_usd", USD, False, ("total_aum_usd", "aum", "totalAum", "assetsUsd", "nav")),
        ("daily_volume_usd", USD, False, ("daily_volume_usd", "volume", "volumeUsd")), ("price", SHARE, False, ("price", "close", "nav")))),
    Rule("*", "derivatives", "funding", "$", TIMES, (
        ("exchange", TEXT, True, ("exchange", "exchangeName", "exchange_name", "venue", "market")), ("symbol", TEXT, False, SYMBOL), ("funding_rate", RATIO, False, ("fundingRate", "funding_rate", "rate", "funding", "currentFundingRate")),
        ("funding_rate_next", RATIO, False, ("nextFundingRate", "funding_rate_next", "predictedFundingRate")), ("open_interest", BTC, False, ("openInterest", "open_interest", "oi", "sumOpenInterest", "oiQty")),
        ("open_interest_usd", USD, False, ("openInterestUsd", "open_interest_usd", "oiUsd", "sumOpenInterestValue")), ("long_short_ratio", 6, False, ("longShortRatio", "long_short_ratio", "lsr", "longShortAccountRatio")),
        ("liquidation_long_usd", USD, False, ("longLiquidationUsd", "liquidation_long_usd", "buyVolUsd", "longLiqUsd")), ("liquidation_short_usd", USD, False, ("shortLiquidationUsd", "liquidation_short_usd", "sellVolUsd", "shortLiqUsd")))),
    Rule("*", "macro", "series", "$", ("date", "observation_date", "period", "time", "timestamp"), (("series_id", TEXT, True, ("series_id", "seriesId", "seriesid", "id", "symbol", "metric")), ("value", RATIO, True, ("value", "val", "y", "amount")))),
    Rule("*", "sentiment", "index", "$", ("timestamp", "time", "date", "ts"), (("value", 6, True, ("value", "score", "index", "v", "fear_greed", "value_score")), ("sentiment_label", TEXT, False, ("value_classification", "classification", "label", "sentiment")))),
)
_RULE = "provider string, category string, kind string, path string, times array<string>, fields array<struct<target:string,digits:int,required:boolean,sources:array<string>>>"


def _with_digits(text: Column, digits: Column) -> Column:
    """A number rounded half up, with 10 digits after the point; text that is none is NULL."""
    out = F.lit(None).cast("decimal(38,10)")
    for d in (WHOLE, USD, SHARE, 6, BTC, RATIO):
        out = F.when(digits == d, to_decimal(text, d).cast("decimal(38,10)")).otherwise(out)
    return out


def normalized(documents: DataFrame, rules: tuple = RULES) -> DataFrame:
    """documents (id, provider, category, kind, payload) as points: id, point, rule (provider/category/kind), observed, fields
    (target, number, text, source) and reasons; a point without reasons is accepted."""
    spark = documents.sparkSession
    known = spark.createDataFrame([tuple(r) for r in rules], _RULE)
    exact, general = (known.select("category", "kind", *([F.col("provider")] if name == "exact" else []), F.struct("provider", "path", "times", "fields").alias(name)) for name in ("exact", "general"))
    general = general.filter("general.provider = '*'")
    d = documents.join(F.broadcast(exact), ["provider", "category", "kind"], "left").join(F.broadcast(general), ["category", "kind"], "left")
    d = d.withColumn("r", F.coalesce("exact", "general"))
    found = F.expr("get_json_object(payload, r.path)")
    texts = F.from_json("_root", "array<string>")
    one = F.array("_root")
    # An array is a list of points, or one point if its first element is neither an object nor an array.
    points = F.when(F.col("_root").startswith("["), F.when(F.get(texts, 0).startswith("{") | F.get(texts, 0).startswith("["), texts).otherwise(one)).when(F.col("_root").isNotNull(), one)
    entries = lambda x: F.transform(F.from_json(x, "array<string>"), lambda v, i: F.struct(i.cast("string"), v))
    keyed = lambda x: F.when(x.startswith("["), F.map_from_entries(entries(x))).otherwise(F.from_json(x, "map<string,string>"))
    # Parsed before the explode, so that the plan has each point's map as a column and not as an expression to repeat.
    p = d.withColumn("_root", F.trim(found)).select("id", "provider", "category", "kind", "payload", "r", F.posexplode_outer(F.transform(points, keyed)).alias("point", "_m"))
    given = lambda s: F.nullif(F.trim(F.col("_m")[s]), F.lit(""))
    first = lambda sources: F.get(F.filter(sources, lambda s: given(s).isNotNull()), 0)
    picked = F.transform("r.fields", lambda f: F.struct(f["target"].alias("target"), f["digits"].alias("digits"), f["required"].alias("required"), first(f["sources"]).alias("source")))
    p = p.withColumns({"_picked": picked, "_time": first(F.col("r.times"))})
    value = lambda f: F.struct(f["target"].alias("target"), f["required"].alias("required"), _with_digits(given(f["source"]), f["digits"]).alias("number"), F.when(f["digits"] == TEXT, given(f["source"])).alias("text"), f["source"].alias("source"))
    p = p.withColumns({"_fields": F.transform("_picked", value), "observed": parse_time(given(F.col("_time")))})
    known_value = lambda f: f["number"].isNotNull() | f["text"].isNotNull()
    failed = F.transform(F.filter("_fields", lambda f: ~known_value(f) & (f["required"] | f["source"].isNotNull())), lambda f: F.concat(F.when(f["source"].isNull(), "missing:").otherwise("no number:"), f["target"]))
    why = F.when(F.col("r").isNull(), F.array(F.lit("no rule"))).when(F.get_json_object("payload", "$").isNull(), F.array(F.lit("no document"))).when(F.col("_m").isNull(), F.array(F.lit("no point")))
    reasons = F.coalesce(why, F.concat(failed, F.when(F.col("observed").isNull(), F.array(F.lit("no time"))).otherwise(F.array().cast("array<string>"))))
    kept = F.transform(F.filter("_fields", known_value), lambda f: F.struct(f["target"].alias("target"), f["number"].alias("number"), f["text"].alias("text"), f["source"].alias("source")))
    rule = F.concat_ws("/", "r.provider", "category", "kind")
    return p.select("id", "point", F.when(F.col("r").isNotNull(), rule).alias("rule"), "observed", F.coalesce(kept, F.array().cast(p.select(kept.alias("x")).schema["x"].dataType)).alias("fields"), reasons.alias("reasons"))


#: Documents made of events: two for each rule, and four that fail. {ms}, {s}: milliseconds and seconds of ts; {day}: its date.
_A, _B = "CAST(floor(value * 100) AS BIGINT)", "CAST(floor(value) AS BIGINT)"
_DOCUMENTS = (
    ("other", "market", "price", """concat('{{"last":"', {a}, '.123456789","bid":', {b}, ',"volume":"1,', 100 + event_id % 900, '.5","pair":"btc-usd","ts":', {ms}, '}}')"""),
    ("other", "market", "ohlcv", """concat('[{{"o":', {b}, ',"h":', {b} + 2, ',"l":', {b}, ',"c":', {b} + 1, ',"v":3,"n":7,"t":', {s}, '}},{{"open":', {b}, ',"high":"n/a","low":1,"close":2,"date":"', {day}, '"}}]')"""),
    ("binance", "market", "price", """concat('{{"symbol":"BTCUSDT","lastPrice":"', {a}, '.5","bidPrice":"', {b}, '","priceChangePercent":"-1.23456","closeTime":', {ms}, '}}')"""),
    ("binance", "market", "ohlcv", """concat('[[', {ms}, ',"', {b}, '","', {b} + 3, '","', {b}, '","', {b} + 1, '","12.5",', {ms}, ',"99.999999999",', event_id % 50, ',"1","2","0"]]')"""),
    ("okx", "market", "price", """concat('{{"code":"0","data":[{{"instId":"BTC-USDT","last":"', {a}, '","vol24h":"10","ts":"', {ms}, '"}}]}}')"""),
    ("okx", "market", "ohlcv", """concat('{{"data":[["', {ms}, '","', {b}, '","', {b}, '","', {b}, '","', {b}, '","5","6","7","1"],["bad","1","2","3","4"]]}}')"""),
    ("coinbase", "market", "price", """concat('{{"data":{{"amount":"', {a}, '","pair":"BTC-USD","time":"', {day}, '"}}}}')"""),
    ("coingecko", "market", "price", """concat('{{"market_data":{{"current_price":{{"usd":', {a}, ',"market_cap":123.456,"timestamp":', {s}, '}}}}}}')"""),
    ("other", "onchain", "metric", """concat('[{{"t":', {s}, ',"v":', {b}, ',"metric":"sopr"}},{{"t":', {s}, ',"v":null}}]')"""),
    ("glassnode", "onchain", "metric", """concat('[{{"t":', {s}, ',"v":0.', 1000 + event_id % 9000, '}}]')"""),
    ("cryptoquant", "onchain", "metric", """concat('{{"data":[{{"date":"', {day}, '","value":', {b}, '}}]}}')"""),
    ("other", "etf", "flow", """concat('{{"ticker":"IBIT","netFlow":"', {a}, '.005","nav":12,"date":"', {day}, '"}}')"""),
    ("other", "derivatives", "funding", """concat('{{"exchangeName":"X","fundingRate":"0.000', event_id % 10, '","oiUsd":', {a}, ',"fundingTime":', {ms}, '}}')"""),
    ("other", "macro", "series", """concat('{{"seriesId":"CPI","value":"', {a}, '","date":"', {day}, '"}}')"""),
    ("other", "sentiment", "index", """concat('{{"value":"', event_id % 101, '","value_classification":"Fear","timestamp":"', {s}, '"}}')"""),
    ("other", "sentiment", "index", """concat('{{"score":"none","timestamp":0}}')"""),
    ("other", "weather", "index", """concat('{{"value":1}}')"""),
    ("okx", "market", "price", """concat('{{"code":"50001","data":[]}}')"""),
)


def document_columns(ms: str, s: str, day: str) -> list[str]:
    case = lambda k: f"CASE event_id % {len(_DOCUMENTS)} " + " ".join(f"WHEN {i} THEN '{x[k]}'" if k < 3 else f"WHEN {i} THEN {x[3].format(a=_A, b=_B, ms=ms, s=s, day=day)}" for i, x in enumerate(_DOCUMENTS)) + " END"
    return ["event_id AS id", *[f"{case(k)} AS {c}" for k, c in enumerate(("provider", "category", "kind", "payload"))]]


def _rules_sql() -> str:
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    fields = lambda r: "[" + ", ".join(f"{{'target': '{t}', 'digits': {d}, 'required': {q}, 'sources': {quoted(s)}}}" for t, d, q, s in r.fields) + "]"
    return " UNION ALL ".join(f"SELECT '{r.provider}' AS provider, '{r.category}' AS category, '{r.kind}' AS kind, '{r.path}' AS path, {quoted(r.times)} AS times, {fields(r)} AS fields" for r in RULES)


_AT = lambda s: f"(CASE WHEN json_type(p) = 'ARRAY' THEN nullif(trim(json_extract_string(p, concat('$[', CASE WHEN regexp_matches({s}, '^[0-9]+$') THEN {s} ELSE '999' END, ']'))), '') ELSE nullif(trim(json_extract_string(p, ('$.' || {s}))), '') END)"
_NUMBER = "regexp_replace(raw, '[,%]', '', 'g')"
_TIME = "(CASE WHEN n = 0 THEN NULL WHEN n >= 1e14 THEN make_timestamp(CAST(n AS BIGINT)) WHEN n >= 1e11 THEN make_timestamp(CAST(n AS BIGINT) * 1000) WHEN n IS NOT NULL THEN make_timestamp(CAST(n * 1000000 AS BIGINT)) ELSE try_cast(t AS TIMESTAMP) END)"
NORMALIZED = f"""d AS (SELECT {', '.join(document_columns('epoch_us(ts) // 1000', 'epoch_us(ts) // 1000000', 'CAST(ts AS DATE)'))} FROM events), rules AS ({_rules_sql()}),
  m AS (SELECT d.*, coalesce(e.provider, g.provider) AS rp, coalesce(e.path, g.path) AS path, coalesce(e.times, g.times) AS times, coalesce(e.fields, g.fields) AS fields FROM d
    LEFT JOIN rules e ON e.provider = d.provider AND e.category = d.category AND e.kind = d.kind LEFT JOIN rules g ON g.provider = '*' AND g.category = d.category AND g.kind = d.kind),
  roots AS (SELECT *, json_extract(payload, path) AS root FROM m),
  pts AS (SELECT *, unnest(CASE WHEN json_type(root) = 'ARRAY' AND json_type(root, '$[0]') IN ('OBJECT', 'ARRAY') THEN CAST(root AS JSON[]) ELSE [root] END) AS p FROM roots),
  x AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) - 1 AS point FROM (SELECT *, generate_subscripts(CASE WHEN json_type(root) = 'ARRAY' AND json_type(root, '$[0]') IN ('OBJECT', 'ARRAY') THEN CAST(root AS JSON[]) ELSE [root] END, 1) AS ord, unnest(CASE WHEN json_type(root) = 'ARRAY' AND json_type(root, '$[0]') IN ('OBJECT', 'ARRAY') THEN CAST(root AS JSON[]) ELSE [root] END) AS p FROM roots)),
  y AS (SELECT *, list_filter(times, lambda s: {_AT('s')} IS NOT NULL)[1] AS ts_ FROM x), z AS (SELECT *, {_AT('ts_')} AS t, try_cast({_AT('ts_')} AS DOUBLE) AS n FROM y),
  o AS (SELECT *, {_TIME} AS observed FROM z),
  f0 AS (SELECT id, point, p, unnest(fields) AS f FROM o), f1 AS (SELECT id, point, f.target AS target, f.digits AS digits, f.required AS required, list_filter(f.sources, lambda s: {_AT('s')} IS NOT NULL)[1] AS source, p FROM f0),
  f2 AS (SELECT *, {_AT('source')} AS raw FROM f1),
  f3 AS (SELECT *, CASE WHEN digits >= 0 AND lower({_NUMBER}) NOT IN ('', 'null', 'none', 'nan', 'n/a', '-') THEN CASE digits {' '.join(f'WHEN {d} THEN CAST(round(try_cast({_NUMBER} AS DECIMAL(30, 12)), {d}) AS DOUBLE)' for d in (0, 2, 4, 6, 8, 10))} END END AS number, CASE WHEN digits < 0 THEN raw END AS text FROM f2)"""


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.frames import table

    ts = "unix_micros(CAST(ts AS TIMESTAMP))"
    return table(spark, sf_dir, "events").selectExpr(*document_columns(f"{ts} div 1000", f"{ts} div 1000000", "CAST(ts AS DATE)"))


@query("normalized_values", f"""WITH {NORMALIZED} SELECT f3.id, CAST(f3.point AS INT) AS point, target, round(CAST(number AS DOUBLE), 8) AS number, text, source FROM f3 WHERE number IS NOT NULL OR text IS NOT NULL""")
def q_values(spark, sf_dir):
    """Every value that a rule found, with the field that it came from."""
    n = normalized(_made(spark, sf_dir)).select("id", F.coalesce("point", F.lit(0)).alias("point"), F.inline("fields"))
    return n.withColumn("number", F.round(F.col("number").cast("double"), 8))


@query("normalized_points", f"""WITH {NORMALIZED}, w AS (SELECT id, point, list(CASE WHEN source IS NULL THEN 'missing:' ELSE 'no number:' END || target ORDER BY target) AS bad FROM f3 WHERE number IS NULL AND text IS NULL AND (required OR source IS NOT NULL) GROUP BY 1, 2)
  SELECT o.id, CAST(o.point AS INT) AS point, CASE WHEN rp IS NOT NULL THEN concat(rp, '/', category, '/', kind) END AS rule, CASE WHEN p IS NOT NULL THEN observed END AS observed,
    CASE WHEN rp IS NULL THEN 'no rule' WHEN p IS NULL OR json_type(p) = 'NULL' THEN 'no point' ELSE array_to_string(list_concat(coalesce(bad, []), CASE WHEN observed IS NULL THEN ['no time'] ELSE [] END), ',') END AS reasons FROM o LEFT JOIN w ON w.id = o.id AND w.point = o.point""")
def q_points(spark, sf_dir):
    """Every point with its rule, time and the reasons against it."""
    n = normalized(_made(spark, sf_dir))
    ordered = F.concat(F.array_sort(F.filter("reasons", lambda r: r != "no time")), F.filter("reasons", lambda r: r == "no time"))
    bare = F.transform(ordered, lambda r: r)
    return n.select("id", F.coalesce("point", F.lit(0)).alias("point"), "rule", F.col("observed").cast("timestamp_ntz").alias("observed"), F.array_join(bare, ",").alias("reasons"))
