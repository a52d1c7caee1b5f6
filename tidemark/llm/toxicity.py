"""Toxicity scores from weak supervision.

Voters are words (a lexicon) and word beginnings of four to eight letters (patterns). The bounded sample of labelled rows is
dealt into five parts; the voters of a part are the marks that set toxic documents apart in the other four, so no voter has
seen the label of a row that it votes on. A generative label model is fitted to the votes alone by expectation maximization:
it estimates each voter's rates of firing on toxic and on clean texts (starting from, and held near, its rates in the other
parts, with the weight of ANCHOR rows) and, from what these leave unexplained, the voters' correlations, by which correlated
voters share one vote. A voter that does not fire abstains, so that one kind of toxic text does not speak against another.
Labels enter the posterior only as the share of toxic rows, which its mean is. The posterior labels train a logistic
regression over the marks of whole texts, which scores every document.

SAMPLE (labelled rows, chosen by hash) and VOTERS (marks a part) are sizes of the model, as its number of weights; they keep
the driver's matrices under 20,000 x 2560 small numbers. All texts that it scores are whole, and all rows are scored. Labels
are learnt only from rows whose crc32(doc_id) mod 5 is not 0.

Nulls and repeats: a null or empty text has no votes and gets the score of one; null labels and ids teach nothing. Repeated
rows are scored each. Without labels all scores are the prior 0.01. An empty table gives an empty result. Only the named
columns are read, so others may clash.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, read

SAMPLE, VOTERS = 20_000, 512
LENGTHS = (4, 5, 6, 7, 8)  # letters of the word beginnings
LEAST_TOXIC, LEAST_Z = 4, 5.5  # a voter's toxic documents, and the root of its G statistic against the share of toxic ones
FOLDS, HELD_OUT = 5, 0
PARTS, ANCHOR, SAME = 5, 50, 0.7  # SAME: the residual correlation from which voters share a vote
_WORD = re.compile(r"\w+")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def marks(text: str | None) -> set[str]:
    """Distinct words of a text, lower case, and their beginnings (with a star)."""
    words = set(_WORD.findall(text.lower())) if text else set()
    return words | {f"{w[:n]}*" for w in words for n in LENGTHS if len(w) > n}


def sample_of(labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id and toxic of at most about `most` labelled rows outside the held-out fold, by hash."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(fold(F.col("doc_id")) != HELD_OUT).select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    ratio = min(1.0, most / max(1, known.count()))
    return known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(ratio * (1 << 20)))


def part(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit("part")), F.lit(PARTS)).cast("int")


class Voters:
    """The marks, and per part: the places of its voters in marks, and their rates on toxic and clean texts of the other parts."""

    def __init__(self, rows):
        self.marks = sorted({r.mark for r in rows})
        place = {m: k for k, m in enumerate(self.marks)}
        self.of_part, self.rates = [], []
        for f in range(PARTS):
            own = sorted((place[r.mark], r.on_toxic, r.on_clean) for r in rows if r.part == f)
            self.of_part.append(np.array([x[0] for x in own], np.int64))
            self.rates.append(np.array([x[1:] for x in own], float).reshape(-1, 2))


def voters_of(texts: DataFrame, most: int = VOTERS) -> Voters:
    """Per part, the marks of the other parts of texts (text, toxic, part) that speak most clearly for toxicity."""

    def count(batches):
        seen: Counter = Counter()

        def flush():
            rows = [(m, n, f, toxic) for (m, f, toxic), n in seen.items()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int32()))], names=["mark", "n", "part", "toxic"])

        for batch in batches:
            for text, toxic, f in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                seen.update((m, f, int(toxic > 0)) for m in marks(text.as_py()))
                if len(seen) > 500_000:
                    yield flush()
        yield flush()

    sizes = {(r.part, r.toxic > 0): r.n for r in texts.groupBy("part", (F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    total = [sum(n for (_, t), n in sizes.items() if t == toxic) for toxic in (True, False)]
    n_if = lambda *on: F.sum(F.when(F.lit(True) if not on else on[0], F.col("n")).otherwise(0))
    toxic = F.col("toxic") == 1
    sums = [n_if(toxic).alias("a_all"), n_if(~toxic).alias("b_all")]
    for f in range(PARTS):
        sums += [n_if(toxic & (F.col("part") == f)).alias(f"a{f}"), n_if(~toxic & (F.col("part") == f)).alias(f"b{f}")]
    counted = texts.select("text", "toxic", "part").mapInArrow(count, "mark string, n long, part int, toxic int").groupBy("mark").agg(*sums).filter(f"a_all >= {LEAST_TOXIC}")
    counted = materialize(counted, "marks")
    rows = []
    a, b = F.col("a"), F.col("b")
    for f in range(PARTS):
        n_toxic, n_clean = total[0] - sizes.get((f, True), 0), total[1] - sizes.get((f, False), 0)
        if not n_toxic or not n_clean:
            continue
        share = n_toxic / (n_toxic + n_clean)
        g = 2 * (a * F.log(a / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0))
        others = counted.select("mark", (F.col("a_all") - F.col(f"a{f}")).alias("a"), (F.col("b_all") - F.col(f"b{f}")).alias("b"))
        scored = others.filter((a >= LEAST_TOXIC) & (a >= 4 * b)).withColumn("z", F.sqrt(g)).filter(F.col("z") >= LEAST_Z)
        rows += scored.select("mark", F.lit(f).alias("part"), "z", ((a + 0.1) / (n_toxic + 1)).alias("on_toxic"), ((b + 0.02) / (n_clean + 1)).alias("on_clean")).orderBy(F.desc("z"), "mark").limit(most).collect()
    return Voters(rows)


def votes_of(texts: DataFrame, voters: Voters) -> list[np.ndarray]:
    """Of the bounded sample, per part: one row of 0 and 1 per text, a column per mark."""
    place = {v: k for k, v in enumerate(voters.marks)}

    def run(batches):
        for batch in batches:
            found = [sorted(place[m] for m in marks(x.as_py()) if m in place) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], names=["votes", "part"])

    rows = texts.select("text", "part").mapInArrow(run, "votes array<int>, part int").collect()
    rows.sort(key=lambda r: (r.part, r.votes))  # the order of rows says nothing, so let it be the same each time
    out = []
    for f in range(PARTS):
        own = [r.votes for r in rows if r.part == f]
        matrix = np.zeros((len(own), len(place)), np.float32)
        for k, found in enumerate(own):
            matrix[k, found] = 1
        out.append(matrix)
    return out


def with_mean(evidence: np.ndarray, mean: float) -> np.ndarray:
    """Probabilities whose log odds are the evidence and one constant, so that they have the given mean."""
    low, high = -60.0, 60.0
    for _ in range(60):
        middle = (low + high) / 2
        p = 1 / (1 + np.exp(-np.clip(evidence + middle, -30, 30)))
        low, high = (low, middle) if len(p) and p.mean() > mean else (middle, high)
    return p


def label_model(votes: list[np.ndarray], voters: Voters, prior: float, rounds: int = 10) -> list[np.ndarray]:
    """Posterior probability of toxicity of each row of votes, part by part, from the votes of the part's own voters."""
    m = len(voters.marks)
    asked = [v[:, at] for v, at in zip(votes, voters.of_part, strict=True)]
    start = np.zeros((m, 3))  # sums of a voter's rates in the other parts, and how many parts ask it
    for at, rates in zip(voters.of_part, voters.rates, strict=True):
        start[at] += np.column_stack([rates, np.ones(len(at))])
    start = np.clip(start[:, :2] / start[:, 2:], 1e-6, 0.99)
    rate, share = start.copy(), np.ones(m)
    for _ in range(rounds):
        posterior, up, down, left, seen = [], np.zeros((m, 2)), np.zeros((m, 2)), np.zeros((m, m)), np.zeros((m, m))
        for v, at in zip(asked, voters.of_part, strict=True):
            p = with_mean(v @ (share[at] * np.log(rate[at, 0] / rate[at, 1])), prior)
            posterior.append(p)
            both = np.column_stack([p, 1 - p])
            up[at] += v.T @ both
            down[at] += both.sum(axis=0)
            # Sums of products of what the rates leave unexplained, v - both @ rate', without ever writing that out.
            cross, fit = (v.T @ both) @ rate[at].T, rate[at] @ (both.T @ both) @ rate[at].T
            left[np.ix_(at, at)] += v.T @ v - cross - cross.T + fit
            seen[np.ix_(at, at)] += 1
        rate = np.clip((up + ANCHOR * start) / (down + ANCHOR), 1e-6, 0.99)
        size = np.sqrt(np.diag(left).clip(1e-9))
        correlation = left / np.outer(size, size) * (seen > 0)
        np.fill_diagonal(correlation, 1)
        share = 1 / np.where(correlation > SAME, correlation, 0).sum(axis=1).clip(1)
    return posterior


def logistic(votes: np.ndarray, target: np.ndarray, ridge: float = 0.5, rounds: int = 15) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method on the cross entropy, whose sum the squared weights are added to (times ridge)."""
    x = np.hstack([votes, np.ones((len(votes), 1), votes.dtype)])
    penalty = np.full(x.shape[1], 2 * ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    w[-1] = np.log(np.clip(target.mean(), 1e-4, 0.9999) / (1 - np.clip(target.mean(), 1e-4, 0.9999)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        bend = (x * (p * (1 - p)).clip(1e-4).astype(x.dtype)[:, None]).T @ x + np.diag(penalty)
        w = w - np.linalg.solve(bend, x.T @ (p - target) + penalty * w)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, voters: int = VOTERS) -> tuple[dict[str, float], float]:
    """Weights of the marks, and the bias."""
    known = docs.select("doc_id", "text").join(sample_of(labels, sample), "doc_id").select("text", "toxic", part(F.col("doc_id")).alias("part"))
    texts = materialize(known, "toxic-sample")
    toxic = texts.agg(F.avg(F.when(F.col("toxic") > 0, 1.0).otherwise(0.0))).first()[0]
    prior = min(0.5, max(0.01, toxic or 0.0))
    chosen = voters_of(texts, voters)
    if not chosen.marks:
        return {}, float(np.log(prior / (1 - prior)))
    votes = votes_of(texts, chosen)
    weights, bias = logistic(np.concatenate(votes), np.concatenate(label_model(votes, chosen, prior)))
    return dict(zip(chosen.marks, weights.tolist(), strict=True)), bias


def score(docs: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """Per row: doc_id, score."""

    def run(batches):
        memo: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            scores = []
            for text in batch.column(1):
                found: set[str] = set()
                for word in set(_WORD.findall(text.as_py().lower())) if text.is_valid else ():
                    own = memo.get(word)
                    if own is None:
                        if len(memo) > 1_000_000:
                            memo.clear()
                        own = memo[word] = tuple(m for m in (word, *(f"{word[:n]}*" for n in LENGTHS if len(word) > n)) if m in weights)
                    if own:
                        found.update(own)
                z = bias + sum(weights[m] for m in sorted(found))
                scores.append(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    weights, bias = fit(docs, read(spark, sf_dir, "labels"))
    scored = score(docs, weights, bias)
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES = {}
