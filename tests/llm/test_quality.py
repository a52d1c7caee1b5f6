import collections
import random

import numpy as np
import pytest

from tidemark.llm import quality

from .helpers import WORD, duck, same_rows

SF = "/root/testdata/sf0.001"


def counted(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_against_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    assert same_rows(quality.op6_quality_rules(spark, SF), duck(documents=docs), quality.SQL)


def numpy_verdicts(rows):
    """The docstring's method in NumPy. rows: (doc_id, lang, source, n, chars, symbols, dup lines, repeats, failed, lines)."""
    vector = lambda r: [int(np.floor(1000 * t + 0.5)) for t in (np.log(1 + r[3]), r[4] / r[3], np.log(1 + 20 * (r[5] / r[3])), r[7] / r[3], r[6] / max(1, r[9]))]
    good = [r for r in rows if not r[8]]
    x, groups = np.array([vector(r) for r in good], float), [(r[1], r[2]) for r in good]
    floors, names = np.array(quality.FLOORS), sorted(set(groups), key=str)
    at = {g: np.array([k for k, h in enumerate(groups) if h == g]) for g in names}

    def estimates(chosen):
        """Mean and covariance per group from the chosen rows and the language's."""
        out = {}
        for g in names:
            own, whole = x[chosen[g]], np.concatenate([x[chosen[h]] for h in names if h[0] == g[0]])
            n = len(own) + quality.PRIOR
            mean = (own.sum(axis=0) + quality.PRIOR * whole.mean(axis=0)) / n
            second = (own.T @ own + quality.PRIOR * (whole.T @ whole) / len(whole)) / n
            out[g] = mean, quality.consistency() * (second - np.outer(mean, mean)) + np.diag(floors**2)
        return out

    def distance(g, model, rows):
        gone = x[rows] - model[0]
        return (gone @ np.linalg.inv(model[1]) * gone).sum(axis=1)

    median = {g: np.median(x[at[g]], axis=0) for g in names}
    mad = {g: np.median(np.abs(x[at[g]] - median[g]), axis=0) for g in names}
    starts = [{g: (median[g], np.diag(np.maximum(1.4826 * mad[g], floors) ** 2)) for g in names}, {g: (median[g], np.diag(floors**2)) for g in names}, estimates(at)]
    moved = 1
    while moved >= quality.SETTLED:
        models = []
        for model in starts:
            chosen = {}
            for g in names:
                bucket = np.floor(quality.BINS * np.log(distance(g, model[g], at[g]) + 0.001))
                chosen[g] = at[g][bucket <= np.sort(bucket)[int(np.ceil(quality.KEPT_PART * len(bucket))) - 1]]
            models.append(estimates(chosen))
        volume = lambda m: np.linalg.slogdet(m[1])[1] / 2
        moved = max(abs(volume(new[g]) - volume(old[g])) for new, old in zip(models, starts, strict=True) for g in names)
        starts = models
    best = {}
    for model in starts:
        for g in names:
            det = np.linalg.det(model[g][1])
            if g not in best or det < best[g][0] * (1 - 1e-9):
                best[g] = det, model[g]
    kept = {r[0]: False for r in rows}
    for g in names:
        for k, d2 in zip(at[g], distance(g, best[g][1], at[g]), strict=True):
            kept[good[k][0]] = d2 <= quality.REACH**2
    return kept


@pytest.mark.parametrize("sf_dir", [SF, SF.replace("0.001", "0.01")])
def test_against_numpy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.lang, r.source, *counted(r.text), sum(bool(WORD.search(x)) for x in (r.text or "").split("\n"))) for r in docs.collect()]
    want = numpy_verdicts(rows)
    got = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert got == want and 0 < sum(want.values()) < sum(not r[8] for r in rows)


def test_cut_is_a_quantile():
    sample = np.random.default_rng(1).normal(size=(400_000, quality.P))
    d2 = (sample**2).sum(axis=1)
    assert abs((d2 > quality.quantile(0.99)).mean() - 0.01) < 0.001
    assert abs(quality.REACH**2 - 35.888) < 0.01


def test_counts(spark):
    rng = random.Random(1)
    texts = [None, "", " \n ", "a", "a b c a b c", "x y\nx y\n x y\n\nz", "\U0001f600é #*$%&|<> \x0b\fq"] + [
        "".join(rng.choice(["ab", "c", " ", "\n", "\t", "é", "#", " "]) for _ in range(rng.randrange(300))) for _ in range(80)] + ["w " * 30_000 + "\n" + "v u t " * 9]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = quality.statistics(docs).select("doc_id", *quality.COUNTS, "base_failed").collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {k: counted(t) for k, t in enumerate(texts)}


def test_outliers_are_rejected_and_ordinary_documents_stay(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 9)))
    plain = [(k, "\n".join(" ".join(word() for _ in range(12)) for _ in range(rng.randrange(8, 30))), "en", "web" if k % 3 else None) for k in range(400)]
    odd = [(1000 + k, " ".join("#" * 9 + word() + "|$%&" * 8 for _ in range(100)), "en", "web") for k in range(4)] + [(1100, " ".join("q" * 90 + word() for _ in range(100)), "en", "web")]
    docs = spark.createDataFrame([(*d, 1, "x") for d in plain + odd], "doc_id long, text string, lang string, source string, x1 int, g string")
    verdict = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert not any(verdict[d[0]] for d in odd) and sum(verdict[d[0]] for d in plain) >= 0.99 * len(plain)


def test_small_odd_and_empty_groups(spark):
    rows = [(1, None, None, None), (2, "w " * 60, "en", "a"), (2, "w " * 60, "en", "a"), (3, " ".join(f"w{k}" for k in range(60)), None, "~"), (None, " ".join(f"w{k}" for k in range(60)), "de", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = quality.judge(docs).collect()
    assert len(found) == 5 and all(r.kept is not None for r in found)
    assert quality.judge(docs.limit(0)).count() == 0


def test_consistency_factor():
    """Against the truncated normal itself."""
    sample = np.random.default_rng(0).normal(size=(200_000, quality.P))
    d2 = (sample**2).sum(axis=1)
    nearest = sample[d2 <= np.quantile(d2, quality.KEPT_PART)]
    assert abs(quality.consistency() * nearest.var() - 1) < 0.02


def test_no_python_in_the_plan(spark):
    plan = quality.op6_quality_rules(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
