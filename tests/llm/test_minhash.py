import random

import pytest

from tidemark.llm import minhash
from tidemark.llm.components import components

from .helpers import near_components

SF = "/root/testdata/sf0.001"


def got(frame, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame, **options).collect()}


@pytest.mark.parametrize("sf_dir", [SF, SF.replace("0.001", "0.01")])
def test_whole_table_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = near_components([(r.doc_id, r.text) for r in docs.collect()], 3, 85)
    rows = minhash.op5_minhash_near_dedup(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert len({c for _, c in want.values()}) < len(want)


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_chains_of_edits(spark, words, percent):
    """Texts that drift away from a start: neighbours are linked, the ends are not, and several drifts share one bucket."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows, doc = [], 0
    for _ in range(3):
        text = list(base)
        for _ in range(40):
            text[rng.randrange(400)] = f"v{rng.randrange(10**6)}"
            rows.append((doc, " ".join(text)))
            doc += 1
    rows += [(doc + k, " ".join(f"u{rng.randrange(300)}" for _ in range(200))) for k in range(60)]
    rng.shuffle(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), words=words, percent=percent) == near_components(rows, words, percent)


def test_drift_of_a_thousand(spark, monkeypatch):
    """A thousand texts, each an edit of an earlier one, in blocks far smaller than their bucket."""
    monkeypatch.setattr(minhash, "BLOCK", 20_000)
    rng = random.Random(11)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(150)]]
    while len(texts) < 1000:
        text = list(rng.choice(texts))
        for _ in range(rng.choice([2, 3, 5, 9])):
            text[rng.randrange(150)] = f"v{rng.randrange(10**6)}"
        texts.append(text)
    rng.shuffle(texts)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    want = near_components(rows, 3, 85)
    assert len({c for _, c in want.values()}) > 20
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85) == want


def test_nulls_short_texts_copies_and_long_texts(spark):
    long = " ".join(f"x{k % 7919}" for k in range(60_000))
    rows = [(9, None), (8, ""), (7, " \t "), (6, "One two"), (5, "one  TWO"), (4, "one"), (3, "a b c d e f"), (2, "A b C d e\nf"), (20, long), (21, long + " end"), (1, "É b c"), (0, "é b c")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    assert got(frame, words=3, percent=85) == near_components(rows, 3, 85)
    nulls = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in minhash.near_duplicates(nulls).collect()) == [(False, 1, True), (True, None, True), (True, None, True)]
    assert got(frame.limit(0)) == {}


def test_pruning_bounds():
    """A pair at the threshold is pruned with a small probability at every look; a pair far below it soon is."""
    least = minhash.least_matches(0.85, minhash.MISS)
    assert all(a < b for a, b in zip(least, least[1:]))
    for n, m in zip(range(minhash.BATCH, minhash.HASHES + 1, minhash.BATCH), least, strict=True):
        assert minhash.reaching(m, n, 0.85) >= minhash.MISS > minhash.reaching(m - 1, n, 0.85)


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(200)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(90)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    loops = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    want = {x: find(x) for x in list(parent) if x not in loops}
    assert {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
