"""Mix sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Slots of the mix are points of the golden-ratio sequence, taken as fractions of a large Fibonacci number so that
they are exact integers. A point falls into one interval of the cumulative target weights, which names the slot's
source. Slots are ranked per source, and rank r takes block r mod n of the source's n blocks. A source's blocks are
equal stretches of its words (BLOCK_WORDS at every size, the last one shorter), with its documents in the order of
md5(doc_id), so a document may lie in several blocks and a block may hold many documents. A source's last slot is cut where
its target is reached, so each source takes its target to the word.

Nulls: a null source is a source of its own (last in order); a null or empty text has size 0 and is never taken;
a null doc_id orders as the empty string. Repeated rows are documents of their own. Rows that tie on md5, doc_id and
size are interchangeable. An empty table gives an empty result. Only the named columns are read, so others may clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import exclusive_prefix, materialize, n_words, read

#: Neighbouring Fibonacci numbers: slot i is the point (i * FIB_45 mod FIB_46) / FIB_46. Products stay below 2**63.
FIB_45, FIB_46 = 1134903170, 1836311903
#: Intervals of the points for the equi-join of slots with sources.
BINS = 1024
BIN_WIDTH = FIB_46 // BINS + 1
#: Weights of the sources in order, repeating, and the share of all words that the mix takes.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BLOCK_WORDS = 2048


def sizes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Per row: doc_id, source, size (words), place (md5 of the id: the shuffled order)."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        n_words(F.col(text_col)).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("place"),
    )


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per source: src (its rank), source, source_size, target (capped at most x its size, the excess reshared).

    The table has a row per source, so its windows need no partitioning key.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("src") - 1) % len(weights) + 1).cast("int"))
    base = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("src", F.row_number().over(rank))
        .withColumn("weight", weight)
        .withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double"))
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    everything = Window.partitionBy()
    level = (
        base.withColumn("full", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.lit(share) * F.col("total") - F.col("full")) / F.col("open_weight"))
        .withColumn("at", F.row_number().over(by_ratio))
        .withColumn("water", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("at", "level"))).over(everything)["level"])
    )
    return level.select(
        "src", "source", "source_size",
        F.least(F.col("cap"), F.col("weight") * F.coalesce("water", "level")).alias("target"),
    )


def slot_schedule(spark, wanted: DataFrame, total: float, block: int) -> DataFrame:
    """Per slot of the mix: slot, src, rank (0, 1, ... within the source)."""
    n = -(-int(total) // block)
    whole = F.sum("target").over(Window.partitionBy())
    upto = F.sum("target").over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0))
    until = wanted.select("src", F.round(upto / whole * FIB_46).cast("long").alias("hi"))
    # Written down, as the slots' plan has all of this twice.
    spans = (
        materialize(until.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("src")), F.lit(0).cast("long"))).filter("hi > lo"), "mix-spans")
        .withColumn("bin", F.explode(F.sequence(F.expr(f"lo div {BIN_WIDTH}"), F.expr(f"(hi - 1) div {BIN_WIDTH}"))))
    )
    points = spark.range(n).select(
        F.col("id").alias("slot"), ((F.col("id") % FIB_46) * FIB_45 % FIB_46).alias("point"), F.expr("id div 8192").alias("chunk")
    ).withColumn("bin", F.expr(f"point div {BIN_WIDTH}"))
    slots = points.join(spans, "bin").filter("point >= lo and point < hi").select("slot", "src", "chunk", F.lit(1).alias("one"))
    return exclusive_prefix(slots, ["src"], "chunk", ["slot"], "one", "rank").select("slot", "src", "rank")


def slot_times(slots: DataFrame, wanted: DataFrame, block: int) -> DataFrame:
    """Per source and block: times that whole slots take it, and cut, the words that the source's last slot takes of it.

    The slots of a source take its blocks in turn until its target is reached to the word. Where the points gave it too few
    slots the missing ones come last; the schedule's discrepancy bounds how many they are.
    """
    per = wanted.filter("source_size > 0").select(
        "src", "source_size", F.floor(F.col("target") + 0.5).cast("long").alias("goal"), F.expr(f"(source_size + {block - 1}) div {block}").alias("n_blocks"))
    before = lambda r: F.expr(f"({r} div n_blocks) * source_size + ({r} % n_blocks) * {block}")
    enough = F.expr(f"(goal div source_size) * n_blocks + ((goal % source_size) + {block - 1}) div {block}")
    given = slots.groupBy("src").agg(F.count("*").alias("given"))
    missing = (
        per.join(given, "src", "left").withColumn("given", F.coalesce("given", F.lit(0))).filter(F.col("given") < enough)
        .select("src", F.explode(F.sequence("given", enough - 1)).alias("rank"))
    )
    told = slots.select("src", "rank").unionByName(missing).join(per, "src").withColumn("left", F.col("goal") - before("rank")).filter("left > 0")
    length = F.least(F.lit(block).cast("long"), F.col("source_size") - F.expr(f"(rank % n_blocks) * {block}"))
    return told.groupBy("src", F.expr("rank % n_blocks").alias("block")).agg(
        F.sum(F.when(F.col("left") >= length, 1).otherwise(0)).alias("times"), F.max(F.when(F.col("left") < length, F.col("left"))).alias("cut"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (its source's), taken (words that the mix takes of it)."""
    spark = docs.sparkSession
    sized = materialize(sizes(docs), "mix-sizes")
    wanted = materialize(targets(sized, weights, share, most), "mix-targets")
    total = wanted.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    # Slots and takes are a few rows a block; written down, they are not planned and run again wherever they are read.
    slots = materialize(slot_schedule(spark, wanted, total, block), "mix-slots")
    times = materialize(slot_times(slots, wanted, block), "mix-times")
    known = sized.join(wanted, sized["source"].eqNullSafe(wanted["source"])).select(
        "doc_id", sized["source"], "size", "place", "src", "source_size", "target", F.substring("place", 1, 3).alias("bucket"))
    placed = exclusive_prefix(known.filter("size > 0"), ["src"], "bucket", ["place", "doc_id", "size"], "size", "start")
    pieces = placed.withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    ends = lambda words: F.least(F.col("start") + F.col("size"), F.col("block") * block + words) - F.greatest(F.col("start"), F.col("block") * block)
    taken = (
        pieces.join(times, ["src", "block"], "left")
        .withColumn("words", ends(F.lit(block)) * F.coalesce("times", F.lit(0)) + F.greatest(F.lit(0), ends(F.coalesce("cut", F.lit(0)))))
        .groupBy("src", "start", "doc_id", "source", "size", "source_size", "target").agg(F.sum("words").alias("taken"))
    )
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    return taken.select(columns).unionByName(known.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).select(columns))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM {{documents}}),
base AS (
  SELECT *, CAST([3.0, 1.0, 2.0][CAST((src - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS cap FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS src FROM sized GROUP BY source)),
levels AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * total - filled) / open_weight AS level FROM (
    SELECT *, row_number() OVER (ORDER BY cap / weight, src) AS place_no, coalesce(sum(cap) OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS filled,
           sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
           CAST(sum(source_size) OVER () AS BIGINT) AS total FROM base)),
wanted AS (
  SELECT src, source, source_size, least(cap, weight * coalesce(water, level)) AS target FROM (
    SELECT *, arg_min(level, CASE WHEN level <= cap / weight THEN place_no END) OVER () AS water FROM levels)),
conf AS (SELECT 2048 AS block, CAST(ceil(floor(coalesce(sum(target), 0.0)) / 2048) AS BIGINT) AS n FROM wanted),
hi AS (SELECT src, CAST(round(sum(target) OVER (ORDER BY src ROWS UNBOUNDED PRECEDING) / sum(target) OVER () * {FIB_46}) AS BIGINT) AS hi FROM wanted),
spans AS (SELECT src, coalesce(lag(hi) OVER (ORDER BY src), 0) AS lo, hi FROM hi),
slots AS (SELECT i AS slot, (i % {FIB_46}) * {FIB_45} % {FIB_46} AS point FROM (SELECT unnest(range(n)) AS i FROM conf)),
ranked AS (SELECT s.src, row_number() OVER (PARTITION BY s.src ORDER BY slot) - 1 AS rank FROM slots JOIN spans s ON point >= s.lo AND point < s.hi),
per AS (SELECT src, source_size, CAST(floor(target + 0.5) AS BIGINT) AS goal, (source_size + block - 1) // block AS n_blocks, block FROM wanted, conf WHERE source_size > 0),
needed AS (SELECT src, unnest(range((goal // source_size) * n_blocks + (goal % source_size + block - 1) // block)) AS rank FROM per),
used AS (
  SELECT p.src, rank % n_blocks AS block_no, goal - (rank // n_blocks) * source_size - (rank % n_blocks) * block AS room, least(block, source_size - (rank % n_blocks) * block) AS length
  FROM (SELECT src, rank FROM ranked UNION SELECT src, rank FROM needed) r JOIN per p ON r.src = p.src),
times AS (
  SELECT src, block_no, sum(CASE WHEN room >= length THEN 1 ELSE 0 END) AS times, max(CASE WHEN room < length THEN room END) AS cut FROM used WHERE room > 0 GROUP BY 1, 2),
placed AS (
  SELECT s.doc_id, s.source, s.size, w.src, w.source_size, w.target,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY w.src ORDER BY place, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN wanted w ON s.source IS NOT DISTINCT FROM w.source WHERE s.size > 0),
pieces AS (SELECT p.*, unnest(range(start // c.block, (start + size - 1) // c.block + 1)) AS piece, c.block AS width FROM placed p, conf c),
taken AS (
  SELECT p.doc_id, p.source, p.size, p.source_size, p.target, p.start, p.src,
         CAST(sum((least(start + size, (piece + 1) * width) - greatest(start, piece * width)) * coalesce(times, 0)
           + greatest(0, least(start + size, piece * width + coalesce(cut, 0)) - greatest(start, piece * width))) AS BIGINT) AS taken
  FROM pieces p LEFT JOIN times t ON t.src = p.src AND t.block_no = p.piece GROUP BY ALL),
mixed AS (
  SELECT doc_id, source, size, source_size, target, taken FROM taken
  UNION ALL SELECT s.doc_id, s.source, s.size, w.source_size, w.target, 0 FROM sized s JOIN wanted w ON s.source IS NOT DISTINCT FROM w.source WHERE s.size = 0)
"""
SQL = ORACLE.replace("{documents}", "documents") + "SELECT doc_id, size, source_size, target, taken FROM mixed"
QUERIES = {"op10_mixing": op10_mixing}
ORACLES = {"op10_mixing": SQL}
