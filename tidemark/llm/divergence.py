"""Source divergence audit: how far the sources of a language differ from each other, and by which terms from their language.

Terms are counted per (lang, source) in one pass; the terms in at least LEAST_DOCS documents of a language are kept. The kept
terms of a language are dealt into blocks of about BLOCK terms and numbered within them, and its sources into cells of about
CELL sources, so that one (lang, block, cell) is a bounded group: there the vectors of its sources are packed (sorted numbers
and shares of the terms that occur, compressed; all other terms have one share), and a heap per source ranks its terms.

The packed cells then play a round-robin tournament by the circle method. Cells stay where they are (a cached table dealt by
lang, block and cell, made from one that is written down); in every round the higher seat of each meeting travels to the lower
one, which is the only shuffle of a round, and all pairs between the two cells are evaluated there, in both directions. After
S - 1 rounds each two of S cells have met once. Divergences are sums over terms, so those of blocks are added up. A round
appends its sums to one table in the shared folder; a lost executor makes Spark deal a cell anew from the written table.

Work and rows grow with the square of the number of sources in a language, as the result does; no task grows with it.
All arithmetic is on integers: shares by decimals, products below 2^63.

Nulls: null text, lang and source are read as ''. Repeated rows count each. A group without terms has the share of an absent
term everywhere; in a language without kept terms all divergences are 0. Empty tables give an empty result. Only lang,
source and text are read, so other columns may clash.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, fresh_path, materialize, read

LEAST_DOCS = 10
BLOCK, CELL = 4096, 8  # terms a block, sources a cell, about
TOP = 10
SCALE = 1_000_000_000
_FLUSH = 300_000
#: Bytes of terms as they are, with A-Z lower-cased; all other ASCII becomes a space.
_TERMS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs: sums over parts of the input, still to be added up. A group without terms has a row of the null term."""

    def count(batches):
        held: dict = {}
        size = 0

        def flush():
            rows = [(lang, source, term, n, in_docs[term]) for (lang, source), (seen, in_docs) in held.items() for term, n in seen.items()]
            rows += [(lang, source, None, 0, 0) for lang, source in held]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()))], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            langs, sources = (c.to_pylist() for c in batch.columns[:2])
            for lang, source, text in zip(langs, sources, batch.column(2), strict=True):
                seen, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                terms = text.as_py().translate(_TERMS).split()
                before = len(seen)
                seen.update(terms)
                in_docs.update(set(terms))
                size += len(seen) - before
                if size > _FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    few = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    return few.mapInArrow(count, "lang string, source string, term binary, n long, docs long").withColumn("term", F.col("term").cast("string"))


def _share(n, total, terms):
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exact; 1 where there are no terms."""
    return f"CASE WHEN {terms} = 0 THEN 1 ELSE 1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + 2 AS DECIMAL(20,0))) div CAST({total} + 2 * {terms} AS DECIMAL(20,0)) END"


def _differ(p, q):
    return (p - q) * (p - q) // (p + q)


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x, np.uint32).tobytes(), codec="zstd", asbytes=True)


def _unpack(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint32).astype(np.int64)


def _opened(cell) -> list[tuple]:
    return [(v["source"], v["base"], _unpack(v["ids"], v["n"]), _unpack(v["shares"], v["n"])) for v in cell]


def meet(a: tuple, b: tuple, terms: int) -> int:
    """The divergence of two vectors (source, share of absent terms, numbers, shares) over a block of so many terms."""
    ids = np.union1d(a[2], b[2])
    p, q = np.full(len(ids), a[1], np.int64), np.full(len(ids), b[1], np.int64)
    p[np.searchsorted(ids, a[2])] = a[3]
    q[np.searchsorted(ids, b[2])] = b[3]
    return int(_differ(p, q).sum()) + (terms - len(ids)) * _differ(a[1], b[1])


_VECTOR = "array<struct<source:string,base:long,n:int,ids:binary,shares:binary>>"
_PAIRS = "array<struct<source:string,item:string,value:long>>"


def _home(key, frame):
    """Of a cell: its packed vectors, the pairs within it and each source's heap of terms."""
    import pandas as pd

    lang, block, cell = key
    terms = int(frame.terms.iloc[0])
    vectors, opened, ranked = [], [], []
    for source, own in frame.groupby("source", sort=True):
        base = int(own.base.iloc[0])
        own = own[own.id >= 0].sort_values("id")
        ids, p, q = (own[c].to_numpy(np.int64) for c in ("id", "p", "q"))
        vectors.append({"source": source, "base": base, "n": len(ids), "ids": _pack(ids), "shares": _pack(p)})
        opened.append((source, base, ids, p))
        ahead = np.flatnonzero(p > q)
        heap = heapq.nsmallest(TOP, zip((-_differ(p, q)[ahead]).tolist(), (x.encode("utf-8", "surrogatepass") for x in own.term.to_numpy()[ahead]), own.term.to_numpy()[ahead], strict=True))
        ranked += [{"source": source, "item": term, "value": -value} for value, _, term in heap]
    pairs = []
    for i, a in enumerate(opened):
        for b in opened[:i]:
            value = meet(a, b, terms)
            pairs += [{"source": x[0], "item": y[0], "value": value} for x, y in ((a, b), (b, a))]
    return pd.DataFrame({"lang": [lang], "block": [block], "cell": [cell], "terms": [terms], "vectors": [vectors], "pairs": [pairs], "ranked": [ranked]})


def _meetings(batches):
    """All pairs between the cells that meet, in both directions."""
    for batch in batches:
        for row in batch.to_pylist():
            own, visiting = _opened(row["vectors"]), _opened(row["visitors"])
            found = [(x[0], y[0], value) for a in own for b in visiting for value in (meet(a, b, row["terms"]),) for x, y in ((a, b), (b, a))]
            columns = [pa.array([row["lang"]] * len(found), pa.string()), *[pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))]]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "item", "value"])


def _partner(round_: int):
    """Of seat `cell` among `seats` (even) in a round of the circle method: seats i and j meet where i + j = round (mod seats - 1), and who would meet itself meets the last."""
    turn = F.pmod(F.lit(round_) - F.col("cell"), F.col("seats") - 1)
    of_last = F.pmod(F.lit(round_) * (F.col("seats") / 2).cast("long"), F.col("seats") - 1)
    return F.when(F.col("cell") == F.col("seats") - 1, of_last).otherwise(F.when(turn == F.col("cell"), F.col("seats") - 1).otherwise(turn))


def cells_of(docs: DataFrame, least_docs: int = LEAST_DOCS, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """lang, block, cell, seats, terms, vectors, pairs, ranked: the packed cells, written down."""
    # Dealt by (lang, term): all sources of a term are together, so that its documents are added up without another shuffle.
    counted = count_terms(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counted = counted.withColumn("_docs", F.sum("docs").over(Window.partitionBy("lang", "term")))
    counted = materialize(counted.filter(f"term IS NULL OR _docs >= {least_docs}").select("lang", "source", "term", "n"), "divergence-counts")
    kept = counted.filter("term IS NOT NULL")
    groups = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"))  # the null term makes a row for every group
    totals = kept.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("sources")).join(totals.groupBy("lang").agg(F.count("*").alias("lang_terms")), "lang", "left")
    langs = langs.withColumn("lang_terms", F.coalesce("lang_terms", F.lit(0))).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("lang_terms") / block)))
    langs = materialize(langs.withColumn("cells", F.greatest(F.lit(1), F.ceil(F.col("sources") / cell))), "divergence-langs")
    of_block = Window.partitionBy("lang", "block")
    numbered = totals.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks"))).withColumn("id", F.row_number().over(of_block.orderBy("term")) - 1)
    numbered = materialize(numbered.withColumn("terms", F.count("*").over(of_block)).withColumn("q", F.expr(_share("in_lang", "lang_total", "lang_terms"))).select("lang", "term", "block", "id", "q", "terms"), "divergence-terms")
    seats = F.pmod(F.xxhash64("source"), F.col("cells"))
    groups = groups.join(langs, "lang").withColumn("cell", seats).withColumn("base", F.expr(_share("0", "total", "lang_terms")))
    groups = materialize(groups.select("lang", "source", "total", "lang_terms", "blocks", "cell", "base"), "divergence-groups")
    rows = kept.join(numbered, ["lang", "term"]).join(groups, ["lang", "source"]).withColumn("p", F.expr(_share("n", "total", "lang_terms")))
    # Every source stands in every block, with or without terms there.
    sizes = numbered.groupBy("lang", "block").agg(F.count("*").alias("terms"))
    marks = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).join(sizes, ["lang", "block"], "left")
    none = {"term": F.lit(""), "id": F.lit(-1), "p": F.lit(0).cast("long"), "q": F.lit(0).cast("long"), "terms": F.coalesce("terms", F.lit(0).cast("long"))}
    columns = ["lang", "block", "cell", "source", "base", "terms", "term", "id", "p", "q"]
    both = rows.select(columns).unionByName(marks.withColumns(none).select(columns))
    schema = f"lang string, block long, cell long, terms long, vectors {_VECTOR}, pairs {_PAIRS}, ranked {_PAIRS}"
    packed = both.groupBy("lang", "block", "cell").applyInPandas(_home, schema)
    even = langs.select("lang", (F.col("cells") + F.col("cells") % 2).alias("seats"))
    return materialize(packed.join(even, "lang"), "divergence-cells")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language by divergence (pair), and the terms that set a source apart (term)."""
    spark = docs.sparkSession
    cells = cells_of(docs, least_docs, block, cell)
    path = fresh_path(spark, "divergence-pairs")
    one = lambda c: cells.select("lang", F.explode(c).alias("x")).select("lang", "x.*")
    one("pairs").write.parquet(path)
    packed = cells.select("lang", "block", "cell", "seats", "terms", "vectors")
    resident = packed.repartition("lang", "block", "cell").persist(StorageLevel.MEMORY_AND_DISK)
    rounds = cells.agg(F.max("seats")).first()[0] or 1
    for k in range(rounds - 1):
        # Languages with fewer seats are through earlier.
        visitors = packed.filter(F.lit(k) < F.col("seats") - 1).withColumn("_to", _partner(k)).filter("_to < cell").select("lang", "block", F.col("_to").alias("cell"), F.col("vectors").alias("visitors"))
        met = resident.join(visitors, ["lang", "block", "cell"]).select("lang", "terms", "vectors", "visitors")
        met.mapInArrow(_meetings, "lang string, source string, item string, value long").write.mode("append").parquet(path)
    resident.unpersist()
    pairs = spark.read.schema("lang string, source string, item string, value long").parquet(path).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(one("ranked"), "term").filter(F.col("rank") <= TOP))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))


SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{UPPER}', '{LOWER}') AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= {LEAST_DOCS}),
counts AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
langs AS (SELECT lang, count(term) AS v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY 1),
groups AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN counts c USING (lang, source) GROUP BY 1, 2),
shares AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST({SCALE} AS HUGEINT) * (coalesce(c.n, 0) + 2) // (g.total + 2 * l.v) AS p, 1 + CAST({SCALE} AS HUGEINT) * (k.n + 2) // (l.total + 2 * l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q),
parts AS (SELECT *, 'pair' AS part FROM pairs UNION ALL SELECT *, 'term' FROM terms)
SELECT lang, source, part, item, value, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM parts) WHERE part = 'pair' OR rank <= {TOP}"""
QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLES = {"op13_source_divergence": SQL}
