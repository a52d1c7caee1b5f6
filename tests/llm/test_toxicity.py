import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import toxicity

SF, HELD_SF = "/root/testdata/sf0.01", "/root/testdata/sf0.1"  # sf0.01 has 6 toxic documents held out, sf0.1 has 97


def auc(scores, labels):
    """Ties count half."""
    on, off = scores[labels][:, None], scores[~labels][None]
    return ((on > off) + 0.5 * (on == off)).mean()


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{HELD_SF}/labels.parquet").collect()}
    rows = toxicity.op8_toxicity(spark, HELD_SF).collect()
    assert len(rows) == spark.read.parquet(f"{HELD_SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    known = [(r.score, labels[r.doc_id] == 1) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    scores, toxic = np.array([s for s, _ in known]), np.array([t for _, t in known])
    assert auc(scores, toxic) > 0.95
    assert (scores[~toxic] >= 0.5).mean() < 0.05 and (scores[toxic] >= 0.5).mean() > 0.7


def test_held_out_labels_teach_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, flipped)


def test_without_labels_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (1, "", 0.5), (None, "w " * 100_000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    weights, bias = toxicity.fit(docs, labels)
    assert weights == {}
    assert [round(r.score, 3) for r in toxicity.score(docs, weights, bias).collect()] == [0.01] * 3
    assert toxicity.score(docs.limit(0), weights, bias).count() == 0
    clean = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs, clean)[0] == {}


class Given:
    """Voters of one part, with their rates in the others."""

    def __init__(self, rates):
        self.marks = [str(k) for k in range(len(rates))]
        none = np.array([], np.int64)
        self.of_part = [np.arange(len(rates)), *[none] * (toxicity.PARTS - 1)]
        self.rates = [np.array(rates, float), *[np.zeros((0, 2))] * (toxicity.PARTS - 1)]


def posterior(columns, rates, prior):
    votes = [np.stack(columns, axis=1), *[np.zeros((0, len(rates)), np.float32)] * (toxicity.PARTS - 1)]
    return toxicity.label_model(votes, Given(rates), prior)[0]


def test_label_model_discounts_correlated_voters():
    """Five copies of one weak voter weigh about as much as that voter alone."""
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    fires = lambda a, b: np.where(truth, rng.random(4000) < a, rng.random(4000) < b).astype(np.float32)
    weak, good = fires(0.4, 0.2), [fires(0.9, 0.02), fires(0.8, 0.03)]
    alone = posterior([weak, *good], [(0.4, 0.2), (0.9, 0.02), (0.8, 0.03)], 0.2)
    copied = posterior([weak] * 5 + good, [(0.4, 0.2)] * 5 + [(0.9, 0.02), (0.8, 0.03)], 0.2)
    assert np.abs(alone - copied).mean() < 0.02
    assert ((alone > 0.5) == truth).mean() > 0.93


def test_rates_come_from_the_votes():
    """Voters whose rates are given wrongly are put right where they meet."""
    rng = np.random.default_rng(1)
    truth = rng.random(8000) < 0.3
    real = [(0.7, 0.01), (0.6, 0.02), (0.65, 0.4), (0.7, 0.02)]
    columns = [np.where(truth, rng.random(8000) < a, rng.random(8000) < b).astype(np.float32) for a, b in real]
    p = posterior(columns, [(0.7, 0.05)] * 4, 0.3)
    assert ((p > 0.5) == truth).mean() > 0.93
    third = (columns[2] == 1) & (columns[0] + columns[1] + columns[3] == 0)
    assert third.sum() > 100 and p[third].mean() < 0.5


def test_posterior_finds_the_truth_behind_flipped_labels(spark):
    """A tenth of the labels are wrong; the posterior follows the texts, not these labels."""
    rng = np.random.default_rng(2)
    bad, plain = [f"bad{k}word" for k in range(6)], [f"plain{k}" for k in range(300)]
    truth = rng.random(1500) < 0.3
    rows = [" ".join([*rng.choice(plain, 20), *(rng.choice(bad, 3) if t else [])]) for t in truth]
    flipped = rng.random(1500) < 0.1
    given = truth ^ flipped
    table = spark.createDataFrame([(k, text, int(g)) for k, (text, g) in enumerate(zip(rows, given, strict=True))], "doc_id long, text string, toxic int")
    texts = toxicity.materialize(table.withColumn("part", toxicity.part(F.col("doc_id"))), "flipped")
    chosen = toxicity.voters_of(texts)
    votes = toxicity.votes_of(texts, chosen)
    p = np.concatenate(toxicity.label_model(votes, chosen, float(given.mean())))
    # votes_of sorts the rows, so each is told by the part and the marks that it has.
    place = {m: k for k, m in enumerate(chosen.marks)}
    at = sorted(range(1500), key=lambda k: (parts[k], sorted(place[m] for m in toxicity.marks(rows[k]) if m in place))) if (parts := {r.doc_id: r.part for r in texts.collect()}) else []
    assert ((p > 0.5) == truth[at]).mean() > 0.98
    assert ((p > 0.5) == given[at]).mean() < 0.95
