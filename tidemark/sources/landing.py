"""Readers and writers: raw landing with content hashes, upserts, partitioned bars, tables in web pages, checkpointed ingestion."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from .frames import table


def content_hash(*columns: str):
    """SHA-256 of the columns as JSON."""
    return F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256)


def land(raw: DataFrame, existing: DataFrame | None, columns: list[str]) -> DataFrame:
    """The rows whose content is new: once each, and none that has landed before."""
    hashed = raw.withColumn("content_hash", content_hash(*columns)).dropDuplicates(["content_hash"])
    return hashed if existing is None else hashed.join(existing.select("content_hash"), "content_hash", "left_anti").select(hashed.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table after new rows have replaced old ones of the same keys."""
    from ..operators.relational import last_wins

    return last_wins(old, new, keys=keys)


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned by symbol and month and sorted by time, so range scans prune partitions and row groups."""
    day = bars.withColumn("month", F.date_format("time", "yyyy-MM"))
    day.repartition("symbol", "month").sortWithinPartitions("symbol", "month", "time").write.mode(mode).partitionBy("symbol", "month").option("compression", "zstd").parquet(path)


def read_bars(spark: SparkSession, path: str, symbol: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """A range scan; the month predicate prunes partitions, the time predicate reaches the row groups."""
    df = spark.read.parquet(path)
    if symbol:
        df = df.filter(F.col("symbol") == symbol)
    if start:
        df = df.filter((F.col("month") >= start[:7]) & (F.col("time") >= F.lit(start).cast("timestamp_ntz")))
    if end:
        df = df.filter((F.col("month") <= end[:7]) & (F.col("time") < F.lit(end).cast("timestamp_ntz")))
    return df.drop("month")


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> None:
    """Append the files that have come since the last call; the checkpoint makes each file count once."""
    stream = spark.readStream.schema(schema).json(source)
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start().awaitTermination()


_ROW, _CELL = re.compile(r"<tr\b[^>]*>(.*?)(?=</tr>|<tr\b|</table>|$)", re.S | re.I), re.compile(r"<t[dh]\b[^>]*>(.*?)(?=</t[dh]>|<t[dh]\b|</tr>|$)", re.S | re.I)


def html_rows(html: str | None) -> list[list[str]]:
    """The cells of a page's table rows as plain text."""
    from html import unescape

    text = lambda x: " ".join(unescape(re.sub(r"<[^>]+>", " ", x)).split())
    return [[text(c) for c in _CELL.findall(r)] for r in _ROW.findall(html or "") if _CELL.search(r)]


def page_tables(pages: DataFrame, html: str = "html", id_col: str = "page_id") -> DataFrame:
    """page_id, row, cells of all table rows."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = [(i, k, cells) for i, h in zip(frame[id_col], frame[html], strict=True) for k, cells in enumerate(html_rows(h))]
            yield pd.DataFrame(out, columns=["page_id", "row", "cells"])

    return pages.select(F.col(id_col).cast("long").alias(id_col), html).mapInPandas(run, "page_id long, row int, cells array<string>")


@query("landing_dedup", "SELECT event_type, user_id, count(*) AS n FROM (SELECT DISTINCT event_type, user_id, props FROM events) GROUP BY 1, 2")
def landing_dedup(spark, sf_dir):
    """Raw documents land once per content."""
    raw = table(spark, sf_dir, "events").select("event_type", "user_id", "props")
    return land(raw, None, ["event_type", "user_id", "props"]).groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


@query("upsert", """WITH o AS (SELECT o_orderkey, o_totalprice, 0 AS k FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, 1 AS k FROM orders WHERE o_orderkey % 2 = 0)
  SELECT o_orderkey, arg_max(o_totalprice, k) AS o_totalprice FROM (SELECT * FROM o UNION ALL SELECT * FROM n) GROUP BY 1""")
def q_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return upsert(o.filter("o_orderkey % 3 <> 0"), o.filter("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1), ["o_orderkey"])


@query("page_table_rows", """SELECT n_regionkey AS page_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INT) AS row, [CAST(n_nationkey AS VARCHAR), n_name || ' & co', CASE WHEN n_nationkey % 2 = 0 THEN '(1.2)' ELSE '' END] AS cells FROM nation
  UNION ALL SELECT DISTINCT n_regionkey, 0, ['Key', 'Name', 'Flow'] FROM nation""")
def q_pages(spark, sf_dir):
    """Rows of tables in web pages: a page per region with a table of its nations, written here as pages have them."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.format_string("<TR class='x'><td>%s<td> <b>%s</b>\n &amp; co</td><td>%s</td></tr>", F.col("n_nationkey").cast("string"), "n_name", F.when(F.col("n_nationkey") % 2 == 0, "(1.2)").otherwise("")).alias("tr"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "tr"))), lambda r: r["tr"]), "\n")
    pages = n.groupBy(F.col("n_regionkey").alias("page_id")).agg(F.concat(F.lit("<html><p>Flows</p><table><tr><th>Key</th><th>Name</th><th>Flow</th></tr>"), rows, F.lit("</table></html>")).alias("html"))
    return page_tables(pages)


@query("array_levels", """SELECT user_id, count(*) AS n, round(list_sum(list_slice(list_sort(list(value), 'DESC'), 1, 20)), 4) AS top20 FROM events GROUP BY 1""")
def q_levels(spark, sf_dir):
    return levels(table(spark, sf_dir, "events"))


def levels(events: DataFrame, salts: int = 64) -> DataFrame:
    """Count and depth of the twenty largest levels per user: the top of each (user, salt), then of the user, so no book is gathered."""
    e = events.select("user_id", "value").withColumn("salt", F.pmod(F.xxhash64("value", F.monotonically_increasing_id()), F.lit(salts)))
    for by in (["user_id", "salt"], ["user_id"]):
        best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last("value")))
        e = e.withColumn("k", best).filter("k <= 20").drop("k")
    counts = events.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("top20", F.lit(None).cast("double"))
    top = e.groupBy("user_id").agg(F.sum("value").alias("top20")).select("user_id", F.lit(0).cast("long").alias("n"), "top20")
    return counts.unionByName(top).groupBy("user_id").agg(F.sum("n").alias("n"), F.round(F.max("top20"), 4).alias("top20"))


