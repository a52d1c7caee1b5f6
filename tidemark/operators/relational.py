"""Filters, joins, latest-per-key, top-k, paging and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.frames import HOURLY, MULTI, bars_hourly, bars_multi, table


def latest_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by an order: one aggregation with partial maxima, no window."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, "_best.*")


def first_column(df: DataFrame, candidates: list[str]) -> str | None:
    """The first of several names that a table has."""
    return next((c for c in candidates if c in df.columns), None)


def last_wins(*frames: DataFrame, keys: list[str]) -> DataFrame:
    """Union of frames; of rows with equal keys the one of the last frame stays."""
    ranked = [f.withColumn("_rank", F.lit(k)) for k, f in enumerate(frames)]
    both = ranked[0]
    for f in ranked[1:]:
        both = both.unionByName(f)
    return latest_per(both, keys, ["_rank"]).drop("_rank")


@query("filters", """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderdate BETWEEN '1996-01-01' AND '1996-12-31' AND o_orderstatus IN ('F', 'O') AND lower(o_orderpriority) = lower('1-urgent') AND o_totalprice IS NOT NULL
  AND abs(o_totalprice - 100000) > 0.0001 AND o_totalprice >= 1000""")
def filters(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = lambda s: F.lit(s).cast("timestamp")
    return o.filter(F.col("o_orderdate").between(day("1996-01-01"), day("1996-12-31")) & F.col("o_orderstatus").isin("F", "O") & (F.lower("o_orderpriority") == "1-urgent") & F.col("o_totalprice").isNotNull()
                    & (F.abs(F.col("o_totalprice") - 100000) > 1e-9 * 100000) & (F.col("o_totalprice") >= 1000)).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("row_validity", f"""WITH {HOURLY}, h AS (SELECT *, CASE WHEN hour(time) = 3 THEN low - 1 ELSE high END AS h2, CASE WHEN hour(time) = 5 THEN -1.0 ELSE volume END AS v2, CASE WHEN hour(time) = 7 THEN 0.0 ELSE close END AS c2 FROM hours)
  SELECT symbol, time, CAST((CASE WHEN h2 < low THEN 1 ELSE 0 END) + (CASE WHEN h2 >= low AND (open > h2 OR open < low) THEN 1 ELSE 0 END) + (CASE WHEN h2 >= low AND (c2 > h2 OR c2 < low) THEN 1 ELSE 0 END) + (CASE WHEN v2 < 0 THEN 1 ELSE 0 END) + (CASE WHEN h2 <= 0 THEN 1 ELSE 0 END) + (CASE WHEN open <= 0 THEN 1 ELSE 0 END) + (CASE WHEN low <= 0 THEN 1 ELSE 0 END) + (CASE WHEN c2 <= 0 THEN 1 ELSE 0 END) AS INT) AS problems,
  CASE WHEN h2 < low OR v2 < 0 OR h2 <= 0 OR open <= 0 OR low <= 0 OR c2 <= 0 THEN 'HIGH' WHEN open > h2 OR c2 > h2 OR open < low OR c2 < low THEN 'MEDIUM' END AS severity FROM h""")
def row_validity(spark, sf_dir):
    """Range and consistency rules as an array of messages per row."""
    h = bars_hourly(spark, sf_dir).withColumn("high", F.when(F.hour("time") == 3, F.col("low") - 1).otherwise(F.col("high"))).withColumn("volume", F.when(F.hour("time") == 5, -1.0).otherwise(F.col("volume").cast("double"))).withColumn("close", F.when(F.hour("time") == 7, 0.0).otherwise(F.col("close")))
    found = problems(h.columns)
    return h.select("symbol", "time", F.size(found).alias("problems"), severity(found).alias("severity"))


PRICES = ("open", "high", "low", "close", "price", "bid", "ask")


def severity(found):
    """Of the messages of problems(): values out of range and crossed bounds are HIGH, a price outside its bar MEDIUM."""
    grave = F.exists(found, lambda m: m.contains(" 0: ") | m.isin("high below low", "bid above ask"))
    return F.when(grave, "HIGH").when(F.size(found) > 0, "MEDIUM")


def problems(columns: list[str]):
    """Messages about a row's values, by the columns that it has. Prices must be above 0, amounts not below it."""
    rules = []
    for c in PRICES:
        if c in columns:
            rules.append(F.when(F.col(c) <= 0, F.concat(F.lit(f"{c} not above 0: "), F.col(c).cast("string"))))
    for c in ("volume", "open_interest"):
        if c in columns:
            rules.append(F.when(F.col(c) < 0, F.concat(F.lit(f"{c} below 0: "), F.col(c).cast("string"))))
    if {"open", "high", "low", "close"} <= set(columns):
        rules.append(F.when(F.col("high") < F.col("low"), F.lit("high below low")))
        rules += [F.when((F.col("high") >= F.col("low")) & ((F.col(c) > F.col("high")) | (F.col(c) < F.col("low"))), F.lit(f"{c} outside low and high")) for c in ("open", "close")]
    if {"bid", "ask"} <= set(columns):
        rules.append(F.when(F.col("bid") > F.col("ask"), F.lit("bid above ask")))
    return F.array_compact(F.array(*rules))


@query("join_inner", """SELECT l_orderkey, l_linenumber, c_name, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000""")
def join_inner(spark, sf_dir):
    o, l, c, n = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer", "nation"))
    big = o.filter("o_totalprice > 300000").select("o_orderkey", "o_custkey")
    return l.select("l_orderkey", "l_linenumber").join(big, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("l_orderkey", "l_linenumber", "c_name", "n_name")


@query("join_left_twice", """SELECT c_custkey, o_orderkey, a.n_name AS from_nation, b.n_name AS to_nation FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON c_custkey = o_custkey
  JOIN nation a ON a.n_nationkey = c_nationkey LEFT JOIN nation b ON b.n_nationkey = c_nationkey + 20""")
def join_left_twice(spark, sf_dir):
    """Left outer joins, one table under two names."""
    c, o, n = (table(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    last = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    a, b = n.alias("a"), n.alias("b")
    return c.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").join(a, F.col("a.n_nationkey") == F.col("c_nationkey")).join(b, F.col("b.n_nationkey") == F.col("c_nationkey") + 20, "left").select(
        "c_custkey", "o_orderkey", F.col("a.n_name").alias("from_nation"), F.col("b.n_name").alias("to_nation"))


@query("join_or_filter", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' OR c_acctbal < -900")
def join_or_filter(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).filter((F.col("o_orderstatus") == "P") | (F.col("c_acctbal") < -900)).select("o_orderkey", "c_mktsegment")


@query("latest_per_key", "SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    return latest_per(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])


@query("rows_at_latest_time", f"WITH {MULTI} SELECT symbol, time, close FROM bars WHERE time = (SELECT max(time) FROM bars)")
def rows_at_latest_time(spark, sf_dir):
    b = bars_multi(spark, sf_dir)
    return b.join(b.agg(F.max("time").alias("time")), "time").select("symbol", "time", "close")


@query("top_k_per_key", f"WITH {MULTI} SELECT symbol, time, volume, CAST(row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, time) AS INT) AS rank FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, time) <= 3")
def top_k_per_key(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy(F.desc("volume"), "time")
    return bars_multi(spark, sf_dir).withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("symbol", "time", "volume", "rank")


@query("page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50).select("o_orderkey", "o_totalprice")


@query("rank_by_score", "SELECT s_suppkey, s_acctbal, CAST(rank() OVER (ORDER BY s_acctbal DESC) AS INT) AS rank FROM supplier")
def rank_by_score(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.rank().over(Window.orderBy(F.desc("s_acctbal"))).alias("rank"))


@query("union_last_wins", f"""WITH {HOURLY}, u AS (SELECT symbol, time, close, 0 AS k FROM hours WHERE hour(time) < 12 UNION ALL SELECT symbol, time, close + 1, 1 FROM hours WHERE hour(time) BETWEEN 6 AND 18)
  SELECT symbol, time, arg_max(close, k) AS close FROM u GROUP BY 1, 2""")
def union_last_wins(spark, sf_dir):
    h = bars_hourly(spark, sf_dir).select("symbol", "time", "close")
    return last_wins(h.filter(F.hour("time") < 12), h.filter(F.hour("time").between(6, 18)).withColumn("close", F.col("close") + 1), keys=["symbol", "time"])


@query("keep_last_per_day", "SELECT user_id, CAST(ts AS DATE) AS day, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def keep_last_per_day(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
