"""A training corpus from raw documents, stage by stage: quality, repeated lines, near-duplicates, mixture, sequences.

Each stage takes (spark, docs, sf_dir) and returns a table. All but the last return the columns of documents; what a stage
decides is in what it returns: rejected and duplicate documents are gone, repeated lines are cut out of the texts, and the
mixture holds a document as often as it takes it whole, and the beginning of one that it takes in part. Other columns of docs are carried along. Rows of one doc_id are one
document in the stages that drop documents; a null doc_id is never dropped as a duplicate. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, materialize, n_words, read
from tidemark.llm.line_dedup import apply_bitmaps, line_bitmaps
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import mix
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import judge


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the robust outlier test keep."""
    rejected = judge(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("_rejected")).distinct()
    return docs.join(rejected, F.col("doc_id").eqNullSafe(F.col("_rejected")), "left_anti")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more of them share (the one with the largest doc_id keeps its own)."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    apart = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"_of_{k}") for k, c in enumerate(rest)])  # names of the user's own are none of the operator's
    kept = apply_bitmaps(apart, line_bitmaps(docs))
    back = {c: F.col(f"_of_{k}").alias(c) for k, c in enumerate(rest)} | {"doc_id": F.col("doc_id"), "text": F.col("kept").alias("text")}
    back["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return kept.select([back[c] for c in docs.columns])


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the smallest doc_id."""
    dropped = near_duplicates(docs, words=5, percent=80).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it whole, and once more its first words where the mixture takes a part, so that every source has its words."""
    # Written down, so that the stage's last plan is one join: the driver keeps little of it.
    took = mix(docs).groupBy(F.col("doc_id").alias("_doc")).agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size")).filter("_taken > 0")
    held = docs.join(materialize(took, "mix-took"), F.col("doc_id").eqNullSafe(F.col("_doc"))).withColumn("_own", n_words(F.col("text")))
    # Rows of one doc_id share what it is taken beyond its whole copies by their sizes.
    held = held.withColumns({"_whole": F.expr("_taken div _size").cast("int"), "_part": F.expr("(_taken % _size) * _own div _size").cast("int")})
    copies = held.filter("_whole > 0 OR _part > 0").withColumn("_copy", F.explode(F.sequence(F.when(F.col("_part") > 0, 0).otherwise(1), F.col("_whole"))))  # 0: the part
    text, cut = F.ltrim("text", F.lit(SPACES)), F.col("_copy") == 0
    after = F.get(F.split(text, r"[\x20\x09-\x0D]+", F.col("_part") + 1), F.col("_part"))
    begin = F.rtrim(F.substring(text, F.lit(1), F.length(text) - F.length(after)), F.lit(SPACES))
    taken = copies.withColumn("text", F.when(cut, F.coalesce(begin, "text")).otherwise(F.col("text")))
    return taken.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return pack_documents(docs, special=True)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("minhash_near_dedup", minhash_near_dedup), ("mixing", mixing), ("packing", packing)]
#: Tokenizing, verified similarity and the packing rule are not SQL; tests/llm/test_pipeline.py holds every stage against one of its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
