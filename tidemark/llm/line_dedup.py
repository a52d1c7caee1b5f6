"""Drop lines that many documents repeat (DataFrame functions only).

Lines become 128-bit hashes of their normalized keys. The hashes are range-partitioned and sorted by document and
position, and each run of equal hashes is streamed: its first document (the largest doc_id) keeps its lines, the
others lose theirs if the run has enough documents. A document gets a keep bitmap, compressed as run lengths, not text.

A very common line would be one long run in one task. Such hashes are counted beforehand (partial counts per task,
then per hash); those above 1/4096 of all lines are at most 4096, so their table of counts is broadcast: they are
settled without being shuffled, and every other run is shorter than that.

Nulls and repeats: a null or empty text is one empty line. Rows of one doc_id with the same text count as one document
and get the same bitmap; rows of one doc_id with other texts are told apart by a hash of the text but are one document
for the counts. A null doc_id is the smallest document. An empty table gives an empty result. Only doc_id and text are
read, so other columns may clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, materialize, read

#: Longer runs of one hash than this part of all lines are settled apart.
HOT_PART, LEAST_HOT = 4096, 1000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hashes(docs: DataFrame, least_chars: int) -> DataFrame:
    """doc_id, version, pos, h1, h2 of every line whose key has at least least_chars code points."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split(ascii_lower(F.col("text")), "\n")).alias("pos", "line"))
    keys = lines.select("doc_id", "version", "pos", F.trim("line", F.lit(SPACES)).alias("key")).filter(F.length("key") >= least_chars)
    return keys.select("doc_id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def repeated_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """doc_id, version, pos of every line to drop."""
    hashes = materialize(line_hashes(docs, least_chars), "line-hashes")
    key = ["h1", "h2"]
    limit = max(LEAST_HOT, -(-hashes.count() // HOT_PART))
    hot = materialize(hashes.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > limit).select(*key), "hot-lines")
    common = F.broadcast(hot)  # at most HOT_PART rows, as each stands for more than 1 / HOT_PART of the lines

    # The other lines: one range shuffle, then streaming over sorted runs.
    run = Window.partitionBy(*key)
    cold = hashes.join(common, key, "left_anti").repartitionByRange("h1").sortWithinPartitions(*key, F.col("doc_id").desc(), "pos")
    streamed = cold.withColumn("nth_doc", F.dense_rank().over(run.orderBy(F.col("doc_id").desc())))
    dropped = streamed.withColumn("n_docs", F.max("nth_doc").over(run)).filter((F.col("n_docs") >= least_docs) & (F.col("nth_doc") > 1))

    # The common ones: counted with partial sums, then looked up where they lie.
    apart = hashes.join(common, key)
    counted = (
        apart.select(*key, "doc_id").distinct().groupBy(*key)
        .agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc")).filter(F.col("n_docs") >= least_docs)
    )
    looked_up = apart.join(F.broadcast(counted), key).filter(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    columns = ["doc_id", "version", "pos"]
    return dropped.select(columns).unionByName(looked_up.select(columns))


def bitmaps(dropped: DataFrame) -> DataFrame:
    """doc_id, version, n_dropped, keep_runs: lengths of kept, dropped, kept, ... stretches of lines; what follows is kept."""
    sets = dropped.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    starts = F.filter("at", lambda x, i: (i == 0) | (F.get("at", i - 1) != x - 1))
    ends = F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1) != x + 1))
    runs = sets.select("doc_id", "version", F.size("at").cast("long").alias("n_dropped"), starts.alias("starts"), ends.alias("ends"))
    keep = F.flatten(F.transform("starts", lambda s, i: F.array(
        s - F.when(i == 0, F.lit(0)).otherwise(F.get("ends", i - 1) + 1), F.get("ends", i) - s + 1)))
    return runs.select("doc_id", "version", "n_dropped", keep.alias("keep_runs"))


def kept_text(text: Column, keep_runs: Column) -> Column:
    """The lines that a bitmap keeps, joined by a newline."""
    lines = lines_of(text)
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("keep"), empty.alias("parts"))
    walked = F.aggregate(
        keep_runs, start,
        lambda a, n: F.struct(
            (a["at"] + n).alias("at"), (~a["keep"]).alias("keep"),
            F.when(a["keep"] & (n > 0), F.concat(a["parts"], F.array(F.array_join(F.slice("_lines", a["at"] + 1, n), "\n")))).otherwise(a["parts"]).alias("parts")),
    )
    return lines, walked


def line_bitmaps(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """Per document that loses lines: doc_id, version (xxhash64 of its text), n_dropped, keep_runs."""
    return bitmaps(repeated_lines(docs.select("doc_id", "text"), least_chars, least_docs))


def apply_bitmaps(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """docs with n_lines, n_dropped and kept (the text that stays)."""
    maps = maps.select(F.col("doc_id").alias("_doc"), F.col("version").alias("_version"), F.col("n_dropped").alias("_n"), F.col("keep_runs").alias("_runs"))
    joined = docs.join(maps, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_version")), "left")
    lines, walked = kept_text(F.col("text"), F.col("_runs"))
    walked_text = F.array_join(
        F.concat(F.col("_walk.parts"), F.when(F.col("_walk.at") < F.size("_lines"), F.array(F.array_join(F.slice("_lines", F.col("_walk.at") + 1, F.size("_lines")), "\n"))).otherwise(F.array().cast("array<string>"))), "\n")
    return (
        joined.withColumn("_lines", lines).withColumn("_walk", walked)
        .withColumn("n_lines", F.size("_lines").cast("long")).withColumn("n_dropped", F.coalesce("_n", F.lit(0)).cast("long"))
        .withColumn("kept", F.when(F.col("_runs").isNull(), F.coalesce("text", F.lit(""))).otherwise(walked_text))
        .drop("_doc", "_version", "_n", "_runs", "_lines", "_walk")
    )


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_bitmaps(docs, line_bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: Common table expressions over a table {documents}: deduped(doc_id, n_lines, n_dropped, kept).
ORACLE = r"""
lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM {documents}),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM lines),
common AS (SELECT line_key, max(doc_id) AS last_doc FROM keyed WHERE length(line_key) >= 20 GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, c.line_key IS NOT NULL AND k.doc_id <> c.last_doc AS gone FROM keyed k LEFT JOIN common c USING (line_key)),
deduped AS (
  SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
         coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos), '') AS kept FROM marked GROUP BY doc_id)
"""
SQL = "WITH " + ORACLE.replace("{documents}", "documents") + "SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM deduped"
QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLES = {"op4_line_dedup": SQL}
