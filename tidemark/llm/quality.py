"""Quality rules: base rules, then robust multivariate outliers per language and source (DataFrame and SQL only).

Each document has a vector of five transformed statistics. Per (lang, source) group the minimum-covariance-determinant
estimate is sought from three starts: median with MAD, median with the least deviations (FLOORS), and the moments of all
documents. From each, concentration steps (take the three quarters of the group with the smallest Mahalanobis distances,
estimate mean and covariance from them) are repeated until no volume moves by half a bucket of the histogram that finds the nearest
(or, should subsets take turns, until a state comes again); of the three estimates that with the least determinant stands. A document whose distance under it exceeds `reach` is rejected; REACH is the distance that
one in a million of normally distributed documents exceeds (TAIL).

The vectors are integers (thousandths), so all sums are exact and do not depend on the order of rows; the three quarters
are found from a histogram of distances, so no group is sorted or gathered (a subset is whole buckets, at least three
quarters). The medians of a group hold its distinct integers, some ten thousand at most, whatever its size.

Two things are shrunk, alike at every size. A group's moments are joined by those of its language as PRIOR further documents:
a group of a few documents has no regular covariance of its own. And the squares of FLOORS are added to the variances: most
documents have no symbols, repeats or equal lines at all, so the nearest three quarters often vary by nothing, and without
that any fluent text with one repeated line would be rejected. FLOORS is how far ordinary texts go in these statistics.

Nulls: a null text has no words and fails the base rules; null languages and sources are groups of their own. Repeated
rows count each for itself. An empty table gives an empty result. Other columns are not read and may clash.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialize, read

P = 5
KEPT_PART = 0.75  # of a group, in a concentration step
STARTS = 3
SQL_STEPS = 12  # concentration steps that the SQL spells out; DataFrames take as many as it needs
PRIOR = 100.0  # documents' worth of the language's moments in a group's
TAIL = 1e-6  # share of normally distributed documents beyond the largest distance of a kept one
#: Least standard deviations, in thousandths: ln words, characters a word, symbols, repeated words, repeated lines.
FLOORS = (300.0, 250.0, 200.0, 80.0, 120.0)
BINS = 16.0  # of the histogram of distances, per unit of its logarithm
SETTLED = 0.5 / BINS  # a step that moves no volume by as much as half a bucket is the last
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spaces = r"[\x20\x09-\x0D]+"
    none = F.array().cast("array<string>")
    trimmed = F.trim(text, F.lit(SPACES))
    step1 = (
        docs.withColumn("_text", text)
        .withColumn("_words", F.when(trimmed == "", none).otherwise(F.split(trimmed, spaces)))
        .withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != ""))
    )
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    step2 = step1.withColumn(
        "_hashes", F.when(F.size("_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), window)).otherwise(F.array().cast("array<bigint>"))
    ).withColumn("_sorted", F.sort_array("_hashes"))
    repeats = F.exists(F.transform("_sorted", lambda x, i: (i > 0) & (x == F.get("_sorted", i - 1))), lambda x: x)
    step3 = step2.withColumn("_pairs", F.when(repeats, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("_pairs", lambda p, i: (p["h"] == F.get("_pairs", i - 1)["h"]) | (p["h"] == F.get("_pairs", i + 1)["h"]))
    places = F.array_distinct(F.flatten(F.transform(twice, lambda p: F.array(p["i"], p["i"] + 1, p["i"] + 2))))
    return (
        step3.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace("_text", spaces, "")).cast("long"))
        .withColumn("n_symbols", (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]+", ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_n_lines", F.size("_lines").cast("long"))
        .withColumn("n_repeat_words", F.when(F.col("_pairs").isNull(), F.lit(0)).otherwise(F.size(places)).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .drop("_text", "_words", "_lines", "_hashes", "_sorted", "_pairs")
    )


# The rest is SQL that Spark and DuckDB both run: select lists over tables whose names are filled in.

VECTOR = """SELECT *, coalesce(concat('=', lang), '~') AS l, concat(coalesce(concat('=', lang), '~'), '/', coalesce(concat('=', source), '~')) AS g,
  CAST(floor(1000 * ln(1 + n_words) + 0.5) AS BIGINT) AS x1,
  CAST(floor(1000 * (word_chars / CAST(greatest(n_words, 1) AS DOUBLE)) + 0.5) AS BIGINT) AS x2,
  CAST(floor(1000 * ln(1 + 20 * (n_symbols / CAST(greatest(n_words, 1) AS DOUBLE))) + 0.5) AS BIGINT) AS x3,
  CAST(floor(1000 * (n_repeat_words / CAST(greatest(n_words, 1) AS DOUBLE)) + 0.5) AS BIGINT) AS x4,
  CAST(floor(1000 * (n_dup_lines / CAST(greatest(_n_lines, 1) AS DOUBLE)) + 0.5) AS BIGINT) AS x5 FROM {stats}"""

_ALL = range(1, P + 1)
_PAIRS = [(i, j) for i in _ALL for j in range(1, i + 1)]
_cols = lambda form: ", ".join(form.format(i=i) for i in _ALL)

MEDIANS = f"SELECT g, {_cols('median(x{i}) AS m{i}')} FROM {{fit}} GROUP BY g"
SPREADS = f"SELECT f.g, {_cols('median(abs(f.x{i} - s.m{i})) AS s{i}')} FROM {{fit}} f JOIN {{medians}} s ON f.g = s.g GROUP BY f.g"
#: Every start works on rows of its own: languages and groups end in its number.
OF_STARTS = " UNION ALL ".join(f"SELECT concat(l, '#{k}') AS l, concat(g, '#{k}') AS g, {_cols('x{i}')} FROM {{fit}}" for k in range(STARTS))


def _start(k: int, deviation: str) -> str:
    """Centre and lower triangle of the Cholesky factor, here a diagonal."""
    factor = ", ".join(f"greatest({deviation.format(i=i)}, CAST({FLOORS[i - 1]} AS DOUBLE)) AS l{i}{j}" if i == j else f"CAST(0 AS DOUBLE) AS l{i}{j}" for i, j in _PAIRS)
    return f"SELECT concat(m.g, '#{k}') AS g, {_cols('CAST(m{i} AS DOUBLE) AS m{i}')}, {factor} FROM {{medians}} m JOIN {{spreads}} s ON m.g = s.g"


def distances(rows: str, model: str) -> str:
    """Rows with d2, the squared Mahalanobis distance under their group's model."""
    sql = f"(SELECT r.*, {_cols('k.m{i} AS m{i}')}, {', '.join(f'k.l{i}{j} AS l{i}{j}' for i, j in _PAIRS)} FROM {rows} r JOIN {model} k ON r.g = k.g)"
    for i in _ALL:
        before = "".join(f" - l{i}{j} * z{j}" for j in range(1, i))
        sql = f"(SELECT *, (x{i} - m{i}{before}) / l{i}{i} AS z{i} FROM {sql} t{i})"
    gone = _cols("m{i}"), ", ".join(f"l{i}{j}" for i, j in _PAIRS), _cols("z{i}")
    return f"SELECT * EXCLUDING ({', '.join(gone)}) FROM (SELECT *, {' + '.join(f'z{i} * z{i}' for i in _ALL)} AS d2 FROM {sql} d) e"


def bucketed(rows: str, model: str) -> str:
    return f"SELECT *, CAST(floor({BINS} * ln(d2 + 0.001)) AS BIGINT) AS bucket FROM ({distances(rows, model)}) b"


#: Per group and bucket of distances: documents and sums. One pass over the rows; what follows has a few hundred rows a group.
SUMS = ", ".join([f"sum(x{i}) AS a{i}" for i in _ALL] + [f"sum(x{i} * x{j}) AS a{i}{j}" for i, j in _PAIRS])
_SUMMED = ", ".join(f"CAST(sum({x}) AS DOUBLE) AS {x}" for x in [f"a{i}" for i in _ALL] + [f"a{i}{j}" for i, j in _PAIRS])
BUCKETS = f"SELECT l, g, bucket, count(*) AS n, {SUMS} FROM {{bucketed}} GROUP BY l, g, bucket"
#: Per group: the sums of the nearest three quarters, in whole buckets.
MOMENTS = f"""SELECT l, g, CAST(sum(n) AS DOUBLE) AS n, {_SUMMED} FROM (
  SELECT *, sum(n) OVER (PARTITION BY g ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(n) OVER (PARTITION BY g) AS total FROM {{buckets}}) u
  WHERE upto - n < {KEPT_PART} * total GROUP BY l, g"""


def _gamma_p(a: float, x: float) -> float:
    """Regularized lower incomplete gamma function, by its series."""
    term = total = 1 / a
    for n in range(1, 500):
        term *= x / (a + n)
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def quantile(part: float, p: int = P) -> float:
    """The squared distance that this part of a normal sample keeps within."""
    lo, hi = 0.0, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _gamma_p(p / 2, mid / 2) < part else (lo, mid)
    return lo


def consistency(part: float = KEPT_PART, p: int = P) -> float:
    """What the covariance of the nearest part of a normal sample is multiplied by."""
    return part / _gamma_p(p / 2 + 1, quantile(part, p) / 2)


def model_of(moments: str) -> str:
    """Mean and Cholesky factor per group, from its moments and its language's."""
    names = [f"a{i}" for i in _ALL] + [f"a{i}{j}" for i, j in _PAIRS]
    # Languages have few groups and the sums run over one row each, in the order of g: the same result on every run.
    over = "OVER (PARTITION BY l ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    sql = f"(SELECT *, sum(n) {over} AS ln_, {', '.join(f'sum({x}) {over} AS l_{x}' for x in names)} FROM {moments} o)"
    sql = f"(SELECT g, n + {PRIOR} AS n, {', '.join(f'{x} + {PRIOR} * (l_{x} / ln_) AS {x}' for x in names)} FROM {sql} s)"
    sql = f"(SELECT g, n, {_cols('a{i} / n AS m{i}')}, {', '.join(f'a{i}{j} / n AS e{i}{j}' for i, j in _PAIRS)} FROM {sql} m)"
    sql = f"(SELECT g, {_cols('m{i}')}, {', '.join(f'{consistency()!r} * (e{i}{j} - m{i} * m{j})' + (f' + {FLOORS[i - 1] ** 2}' if i == j else '') + f' AS c{i}{j}' for i, j in _PAIRS)} FROM {sql} e)"
    for j in _ALL:
        own = "".join(f" - l{j}{k} * l{j}{k}" for k in range(1, j))
        sql = f"(SELECT *, sqrt(c{j}{j}{own}) AS l{j}{j} FROM {sql} p{j})"
        if j < P:
            below = ", ".join(f"(c{i}{j}{''.join(f' - l{i}{k} * l{j}{k}' for k in range(1, j))}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, P + 1))
            sql = f"(SELECT *, {below} FROM {sql} q{j})"
    return f"SELECT g, {_cols('m{i}')}, {', '.join(f'l{i}{j}' for i, j in _PAIRS)} FROM {sql} w"


REACH = math.sqrt(quantile(1 - TAIL))
#: Moments of all rows of the last start, as if all were near.
ALL_MOMENTS = f"""SELECT concat(l, '#2') AS l, concat(g, '#2') AS g, CAST(count(*) AS DOUBLE) AS n, {_cols('CAST(sum(x{i}) AS DOUBLE) AS a{i}')}, {', '.join(f'CAST(sum(x{i} * x{j}) AS DOUBLE) AS a{i}{j}' for i, j in _PAIRS)}
  FROM {{fit}} GROUP BY l, g"""
#: How far the volume of any group's ellipsoid has gone in a step, as a logarithm.
MOVED = f"SELECT max(abs({' + '.join(f'ln(n.l{i}{i} / o.l{i}{i})' for i in _ALL)})) AS moved FROM {{new}} n JOIN {{old}} o ON n.g = o.g"
BEGIN = f"{_start(0, '1.4826 * s{i}')} UNION ALL {_start(1, '0')} UNION ALL {model_of('({all_moments})')}"
#: The estimate of least determinant; the determinant is the squared product of the factor's diagonal.
LEAST = f"""SELECT substring(g, 1, length(g) - 2) AS g, {_cols('m{i}')}, {', '.join(f'l{i}{j}' for i, j in _PAIRS)} FROM (
  SELECT *, row_number() OVER (PARTITION BY substring(g, 1, length(g) - 2) ORDER BY {' * '.join(f'l{i}{i}' for i in _ALL)}, g) AS place FROM {{model}} f) o WHERE place = 1"""


def verdicts(stats: DataFrame, reach: float = REACH) -> DataFrame:
    """stats (as of statistics(), materialized) with distance and kept."""
    spark = stats.sparkSession
    sql = lambda text, **tables: spark.sql(text.replace("EXCLUDING", "EXCEPT"), **tables)
    vectors = sql(VECTOR, stats=stats)
    # Written down, so that the plan of a step holds the step alone and the driver keeps little of each.
    fit = materialize(vectors.filter(~F.col("base_failed")).select("l", "g", *[f"x{i}" for i in _ALL]), "quality-vectors")
    medians = materialize(sql(MEDIANS, fit=fit), "quality-medians")
    begin = sql(BEGIN.replace("{all_moments}", ALL_MOMENTS), medians=medians, spreads=sql(SPREADS, fit=fit, medians=medians), fit=fit)
    model = materialize(begin, "quality-start")
    rows, seen = materialize(sql(OF_STARTS, fit=fit), "quality-rows"), set()
    while True:
        buckets = sql(BUCKETS.replace("{bucketed}", f"({bucketed('{fit}', '{model}')}) k"), fit=rows, model=model)
        before, model = model, materialize(sql(model_of(f"({MOMENTS})"), buckets=buckets), "quality-step")
        moved, *state = sql(MOVED.replace("FROM", f", count(*), bit_xor(xxhash64({', '.join(f'n.{c}' for c in model.columns)})) FROM"), new=model, old=before).first()
        if moved is None or moved < SETTLED or tuple(state) in seen:
            break
        seen.add(tuple(state))
    model = sql(LEAST, model=model)
    judged = sql(distances("{rows}", "{model}"), rows=vectors.filter(~F.col("base_failed")), model=model)
    good = judged.withColumn("distance", F.sqrt("d2")).withColumn("kept", F.col("d2") <= reach * reach)
    failed = vectors.filter("base_failed").withColumn("distance", F.lit(None).cast("double")).withColumn("kept", F.lit(False))
    helpers = ["l", "g", "d2", *[f"x{i}" for i in _ALL]]
    return good.drop(*helpers).unionByName(failed.drop(*helpers))


def judge(docs: DataFrame, reach: float = REACH) -> DataFrame:
    """Per document: doc_id, lang, source, the five counts, base_failed, distance, kept."""
    few = docs.select("doc_id", "lang", "source", "text")
    return verdicts(materialize(statistics(few).drop("text"), "quality-stats"), reach).drop("_n_lines")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


def _oracle() -> str:
    """Common table expressions over a table {documents}: stats_of (the counts) and judged (doc_id, kept)."""
    word = r"'[^\x20\x09-\x0D]+'"
    text = r"""
words AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), WORD) AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, WORD)) AS lines, row_number() OVER () AS r FROM {documents}),
grams AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest([concat_ws(chr(32), w[k], w[k + 1], w[k + 2]) for k in range(1, len(w) - 1)]) AS gram FROM words),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS times FROM grams),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE times > 1 GROUP BY r),
counts AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  coalesce(c.n, 0) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS _n_lines FROM words LEFT JOIN covered c USING (r)),
stats_of AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
vectors AS MATERIALIZED (""".replace("WORD", word) + VECTOR.format(stats="stats_of") + """),
fit AS MATERIALIZED (SELECT l, g, x1, x2, x3, x4, x5 FROM vectors WHERE NOT base_failed),
medians AS MATERIALIZED (""" + MEDIANS.format(fit="fit") + "), spreads AS (" + SPREADS.format(fit="fit", medians="medians") + "),\nrows_ AS MATERIALIZED (" + OF_STARTS.format(fit="fit")
    text += "),\nmoved0 AS (SELECT 1 AS moved), model0 AS MATERIALIZED (" + BEGIN.format(medians="medians", spreads="spreads", all_moments=ALL_MOMENTS.format(fit="fit")) + ")"
    for k in range(SQL_STEPS):
        text += f",\nbuckets{k} AS MATERIALIZED ({BUCKETS.format(bucketed=f"({bucketed('rows_', f'model{k}')}) k")}),\nstep{k} AS MATERIALIZED ({model_of('(' + MOMENTS.format(buckets=f'buckets{k}') + ')')})"
        # From the step that moves little on, the model stays.
        done = f"(SELECT coalesce(moved < {SETTLED}, TRUE) FROM moved{k})"
        text += f",\nmodel{k + 1} AS MATERIALIZED (SELECT * FROM step{k} WHERE NOT {done} UNION ALL SELECT * FROM model{k} WHERE {done}),\nmoved{k + 1} AS MATERIALIZED ({MOVED.format(new=f'model{k + 1}', old=f'model{k}')})"
    text += f",\nleast AS MATERIALIZED ({LEAST.format(model=f'model{SQL_STEPS}')})"
    judged = f",\nall_judged AS (SELECT *, d2 <= {REACH * REACH!r} AS kept FROM ({distances('(SELECT * FROM vectors WHERE NOT base_failed)', 'least')}) UNION ALL BY NAME SELECT *, FALSE AS kept FROM vectors WHERE base_failed)"
    return (text + judged).replace("EXCLUDING", "EXCLUDE")


ORACLE = _oracle()
SQL = "WITH " + ORACLE.replace("{documents}", "documents") + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM all_judged"
QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLES = {"op6_quality_rules": SQL}
