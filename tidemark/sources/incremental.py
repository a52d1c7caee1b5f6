"""Tables that grow by batches: bars of five levels, and a merge that lets better values in. Only touched partitions are rewritten."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..registry import query
from ..tables import shared_folder, written
from .frames import table

#: level -> (width in seconds or a date_trunc unit, format of the partition that holds a bar)
LEVELS = {"1m": (60, "yyyy-MM-dd"), "5m": (300, "yyyy-MM-dd"), "1h": (3600, "yyyy-MM-dd"), "1d": ("day", "yyyy-MM"), "1w": ("week", "yyyy-MM")}
BAR = "symbol string, time timestamp, first struct<time:timestamp,seq:bigint,price:double>, last struct<time:timestamp,seq:bigint,price:double>, high double, low double, volume bigint, part string"


def _bucket(time, level: str):
    width = LEVELS[level][0]
    return F.date_trunc(width, time) if isinstance(width, str) else F.timestamp_seconds(F.floor(F.unix_seconds(time) / width) * width)


def _rewrite(rows: DataFrame, path: str) -> None:
    """Replace the partitions (part) that rows has, and no others. rows is written down first, as it may read the same path."""
    done = written(rows, "partitions")
    done.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path; none of it where nothing was written yet."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def merged(parts: DataFrame, level: str) -> DataFrame:
    """Partial bars of shorter periods, or of the same period from several batches, as one bar a period."""
    return parts.groupBy("symbol", _bucket(F.col("time"), level).alias("time")).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume")).withColumn(
        "part", F.date_format("time", LEVELS[level][1]))


def add_ticks(ticks: DataFrame, path: str) -> None:
    """Add a batch of ticks (symbol, time, price, seq), late ones too, to the bars of all levels under a path.

    The batch becomes partial bars of a minute. A level takes its touched bars from its own rows (minutes: old and new are merged)
    or from the level below (recomputed from its bars), and rewrites the partitions in which these lie; other partitions keep their
    files. Bars keep their first and last tick, so the order in which batches come says nothing. A tick counts as often as it is added.
    """
    spark = ticks.sparkSession
    tick = F.struct("time", F.col("seq").cast("long").alias("seq"), F.col("price").cast("double").alias("price"))
    fresh = ticks.select("symbol", F.col("time").cast("timestamp").alias("time"), "seq", "price").select("symbol", "time", tick.alias("first"), tick.alias("last"), F.col("price").cast("double").alias("high"), F.col("price").cast("double").alias("low"), F.lit(1).cast("long").alias("volume"))
    fresh = written(merged(fresh, "1m"), "minutes")
    below, lower, touched = None, "", fresh.select("symbol", "time")
    for level in LEVELS:
        own = _stored(spark, f"{path}/{level}", BAR)
        keys = touched.select("symbol", _bucket(F.col("time"), level).alias("time")).distinct().withColumn("part", F.date_format("time", LEVELS[level][1]))
        keys = written(keys, "touched")
        # Partitions are days or months: few, and with them broadcast only the touched ones are read.
        old = own.join(F.broadcast(keys.select("part").distinct()), "part", "left_semi")
        if below is None:
            news = merged(old.join(keys, ["symbol", "time"], "left_semi").select(fresh.columns).unionByName(fresh), level)
        else:
            # Bars below that lie in a touched period, from the partitions of its first and last moment.
            width = {"day": 86_400, "week": 7 * 86_400}.get(LEVELS[level][0], LEVELS[level][0])
            ends = F.array(F.date_format("time", lower), F.date_format(F.col("time") + F.make_interval(secs=F.lit(width - 1)), lower))
            parts = keys.select(F.explode(ends).alias("part")).distinct()
            inside = below.join(F.broadcast(parts), "part", "left_semi").withColumn("_time", _bucket(F.col("time"), level)).join(keys.select("symbol", F.col("time").alias("_time")), ["symbol", "_time"], "left_semi").drop("_time")
            news = merged(inside, level)
        _rewrite(old.join(keys, ["symbol", "time"], "left_anti").select(news.columns).unionByName(news), f"{path}/{level}")
        below, touched, lower = _stored(spark, f"{path}/{level}", BAR), keys, LEVELS[level][1]


def bars_of(spark: SparkSession, path: str, level: str) -> DataFrame:
    b = _stored(spark, f"{path}/{level}", BAR)
    return b.select("symbol", "time", F.col("first.price").alias("open"), "high", "low", F.col("last.price").alias("close"), "volume")


_LEVEL_SQL = {"1m": "date_trunc('minute', ts)", "5m": "time_bucket(INTERVAL 5 MINUTE, ts)", "1h": "date_trunc('hour', ts)", "1d": "CAST(date_trunc('day', ts) AS TIMESTAMP)", "1w": "CAST(date_trunc('week', ts) AS TIMESTAMP)"}


@query("bars_incremental", " UNION ALL ".join(f"""SELECT '{level}' AS level, event_type AS symbol, {at} AS time, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY ALL""" for level, at in _LEVEL_SQL.items()))
def q_incremental(spark, sf_dir):
    """All levels after two batches, of which the second brings late rows to old bars."""
    import uuid

    path = f"{shared_folder(spark)}/tidemark/bars-{uuid.uuid4().hex}"
    ticks = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("time"), F.col("event_id").alias("seq"), F.col("value").alias("price"))
    late = F.pmod(F.xxhash64("seq"), F.lit(4)) == 0
    for batch in (ticks.filter(~late), ticks.filter(late)):
        add_ticks(batch, path)
    every = None
    for level in LEVELS:
        b = bars_of(spark, path, level).select(F.lit(level).alias("level"), "symbol", F.col("time").cast("timestamp_ntz").alias("time"), "open", "high", "low", "close", "volume")
        every = b if every is None else every.unionByName(b)
    return every


# Landed pages as a stream, and the sink that counts each batch once.

PAGE = "symbol string, time timestamp, value double, quality int, page int"


class _Pages(InputPartition):
    def __init__(self, symbol: str, first: int, last: int):
        self.symbol, self.first, self.last = symbol, first, last


class LandedPages(DataSource):
    """Pages that a fetcher lands as <path>/<symbol>/<number>.json, numbered from 0: lists of {time (epoch seconds), value, quality}.

    The offset is a cursor per symbol, so that a symbol that lags or starts late holds up no other; a page that is missing holds up
    those after it. Options: path, and pages_per_task, the most that one task reads.
    """

    @classmethod
    def name(cls):
        return "landed_pages"

    def schema(self):
        return PAGE

    def streamReader(self, schema):
        return PageReader(self.options["path"], int(self.options.get("pages_per_task", "100")))


class PageReader(DataSourceStreamReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def initialOffset(self):
        return {}

    def latestOffset(self):
        from pyarrow import fs

        store, root = self._store()
        landed: dict = {}
        for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if f.is_file and f.extension == "json" and f.base_name.split(".")[0].isdigit():
                landed.setdefault(f.path.split("/")[-2], set()).add(int(f.base_name.split(".")[0]))
        end = {}
        for symbol, pages in landed.items():
            end[symbol] = next(n for n in range(len(pages) + 1) if n not in pages)
        return end

    def partitions(self, start: dict, end: dict):
        return [_Pages(s, k, min(k + self.most, n)) for s, n in sorted(end.items()) for k in range(start.get(s, 0), n, self.most)]

    def read(self, partition):
        from datetime import datetime, timezone

        store, root = self._store()
        for page in range(partition.first, partition.last):
            with store.open_input_stream(f"{root}/{partition.symbol}/{page}.json") as f:
                for row in json.loads(f.read()):
                    yield partition.symbol, datetime.fromtimestamp(row["time"], timezone.utc), float(row["value"]), int(row["quality"]), page


KEPT = "symbol string, time timestamp, value double, quality int, batch bigint, part string"


def merge_gated(batch: DataFrame, batch_id: int, path: str) -> None:
    """Merge rows (symbol, time, value, quality) into a table partitioned by month: a value enters where there is none, or where its
    quality is no less and it differs. What has entered is decided by the rows alone, so a batch that is merged again, after a
    failure or in part, changes nothing. Partitions that get no new value keep their files. Of rows of one key in a batch the best, then the largest value counts."""
    spark = batch.sparkSession
    new = batch.groupBy("symbol", "time").agg(F.max(F.struct("quality", "value")).alias("b")).select("symbol", "time", F.col("b.value").alias("value"), F.col("b.quality").cast("int").alias("quality"), F.lit(batch_id).cast("long").alias("batch"), F.date_format("time", "yyyy-MM").alias("part"))
    new = written(new, "incoming")
    stored = _stored(spark, path, KEPT)
    old = stored.join(F.broadcast(new.select("part").distinct()), "part", "left_semi").select("symbol", "time", F.struct("value", "quality", "batch").alias("o"))
    enters = F.col("o").isNull() | ((F.col("o.batch") <= F.col("batch")) & (F.col("quality") >= F.col("o.quality")) & ~F.col("value").eqNullSafe(F.col("o.value")))
    entered = written(new.join(old, ["symbol", "time"], "left").filter(enters).select("symbol", "time", "value", "quality", "batch", "part"), "entered")
    if entered.limit(1).count():
        kept = stored.join(F.broadcast(entered.select("part").distinct()), "part", "left_semi").join(entered.select("symbol", "time"), ["symbol", "time"], "left_anti")
        _rewrite(kept.select(entered.columns).unionByName(entered), path)


def sync(spark: SparkSession, pages: str, target: str, checkpoint: str) -> None:
    """Take what has landed since the last call into the target, batch by batch."""
    spark.dataSource.register(LandedPages)
    stream = spark.readStream.format("landed_pages").option("path", pages).load()
    stream.writeStream.foreachBatch(lambda batch, k: merge_gated(batch, k, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stored_values(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path, KEPT)


@query("sync_gated_merge", """WITH n AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS time, value, CAST(event_id % 5 AS INT) AS quality, CAST(event_id % 3 AS INT) AS b FROM events),
  g AS (SELECT symbol, time, b, max((quality, value)) AS x FROM n GROUP BY 1, 2, 3), w AS (SELECT symbol, time, x[1] AS quality, x[2] AS value, b, max(x[1]) OVER (PARTITION BY symbol, time ORDER BY b) AS best FROM g),
  k AS (SELECT *, row_number() OVER (PARTITION BY symbol, time ORDER BY b DESC) AS place FROM w WHERE quality = best) SELECT symbol, time, value, quality FROM k WHERE place = 1""")
def q_gated(spark, sf_dir):
    """Three batches of hourly values of unequal quality, the second one merged twice."""
    import uuid

    path = f"{shared_folder(spark)}/tidemark/values-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("time"), "value", (F.col("event_id") % 5).cast("int").alias("quality"), (F.col("event_id") % 3).alias("b"))
    for k in (0, 1, 1, 2):
        merge_gated(rows.filter(F.col("b") == k), k, path)
    return stored_values(spark, path).select("symbol", F.col("time").cast("timestamp_ntz").alias("time"), "value", "quality")
