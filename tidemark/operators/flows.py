"""Cumulative flows over a range with what came before it, and the depth of order books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.frames import table

LEVELS = 20


def cumulative_flow(rows: DataFrame, start: str, end: str, day: str = "day", flow: str = "flow", by: tuple[str, ...] = ()) -> DataFrame:
    """Per key and day from start to end (ISO dates, both included): flow, cumulative (since the first row of all) and baseline (what came before start).

    All days before start become one row per key before anything is shuffled, so the window holds the range's days alone. Rows without a day are left out.
    """
    d = F.col(day).cast("date")
    inside = rows.filter(d <= F.lit(end).cast("date")).groupBy(*by, F.when(d >= F.lit(start).cast("date"), d).alias("day")).agg(F.sum(flow).alias("flow"))
    w = Window.partitionBy(*by).orderBy(F.col("day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    nothing = F.lit(0).cast(inside.schema["flow"].dataType)
    out = inside.withColumns({"cumulative": F.sum("flow").over(w), "baseline": F.coalesce(F.max(F.when(F.col("day").isNull(), F.col("flow"))).over(w), nothing)})
    return out.filter("day IS NOT NULL")


@query("flow_cumulative_range", """WITH e AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(CASE WHEN user_id % 2 = 0 THEN value ELSE -value END AS DECIMAL(18,4)) AS f FROM events), d AS (SELECT event_type, day, sum(f) AS flow FROM e GROUP BY 1, 2),
  c AS (SELECT *, sum(flow) OVER (PARTITION BY event_type ORDER BY day) AS cumulative FROM d), b AS (SELECT event_type, sum(f) AS b FROM e WHERE day < DATE '2024-01-10' GROUP BY 1)
  SELECT c.event_type, c.day, flow, cumulative, coalesce(b, 0) AS baseline FROM c LEFT JOIN b USING (event_type) WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'""")
def q_cumulative(spark, sf_dir):
    signed = F.when(F.col("user_id") % 2 == 0, F.col("value")).otherwise(-F.col("value")).cast("decimal(18,4)")
    e = table(spark, sf_dir, "events").select("event_type", F.col("ts").alias("day"), signed.alias("flow"))
    return cumulative_flow(e, "2024-01-10", "2024-01-20", by=("event_type",))


def depth(levels: Column, price: str = "price", quantity: str = "quantity") -> Column:
    """Money in the first LEVELS levels of one side of a book (an array of structs, best first); levels without a number count nothing, no book is 0."""
    money = lambda level: F.coalesce(level[price].cast("double") * level[quantity].cast("double"), F.lit(0.0))
    return F.coalesce(F.aggregate(F.slice(levels, 1, LEVELS), F.lit(0.0), lambda total, level: total + money(level)), F.lit(0.0))


def book(bids: Column, asks: Column) -> dict[str, Column]:
    """bid_depth, ask_depth, their sum, and imbalance from -1 (only asks) to 1 (only bids), NULL of an empty book."""
    b, a = depth(bids), depth(asks)
    return {"bid_depth": b, "ask_depth": a, "depth": b + a, "imbalance": F.try_divide(b - a, b + a)}


@query("book_depth", """WITH s AS (SELECT l_orderkey, sum(CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice * l_quantity ELSE 0 END) AS b, sum(CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice * l_quantity ELSE 0 END) AS a FROM
    (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_extendedprice DESC, l_quantity DESC) AS r FROM lineitem) WHERE r <= 20 GROUP BY 1)
  SELECT l_orderkey, round(b, 2) AS bid_depth, round(a, 2) AS ask_depth, round(b + a, 2) AS depth, round((b - a) / nullif(b + a, 0), 6) + 0.0 AS imbalance FROM s""")
def q_depth(spark, sf_dir):
    """Lines of an order (few) as a book: even numbers bid, odd ones ask."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    level = F.struct(F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))
    side = lambda k: F.reverse(F.array_sort(F.collect_list(F.when(F.col("l_linenumber") % 2 == k, level))))
    o = l.groupBy("l_orderkey").agg(side(0).alias("bids"), side(1).alias("asks"))
    digits = {"imbalance": 6}
    return o.select("l_orderkey", *[(F.round(c, digits.get(n, 2)) + 0.0).alias(n) for n, c in book(F.col("bids"), F.col("asks")).items()])
