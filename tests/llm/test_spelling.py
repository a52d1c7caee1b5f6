"""Spelling variants against their SQL and against plain versions."""

import collections
import random
import re
from zlib import crc32

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import spelling as sp

from .helpers import LOWER, duck, same_rows


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    """rows: (doc_id, text)."""
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    first = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: v for w, v in first.items() if n[v] >= 10 * n[w]}
    root = dict(zip(n, n, strict=True))
    for w in n:
        while root[w] in form:
            root[w] = form[root[w]]
    return sorted((w, form.get(w), root[w], k, len(near[w]), n.get(form.get(w))) for w, k in n.items())


def rows_of(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    docs = pd.read_parquet(f"/root/testdata/{sf}/documents.parquet")
    assert same_rows(sp.op12_spelling_variants(spark, f"/root/testdata/{sf}"), duck(documents=docs), sp.SQL)


def test_wavelet():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64, 100):
        values = rng.permutation(n)
        tree = sp.Wavelet(values)
        lo, least = rng.integers(0, n, 50), rng.integers(0, n, 50)
        hi, most = np.minimum(n, lo + rng.integers(0, n + 1, 50)), np.minimum(n, least + rng.integers(0, n + 1, 50))
        got = collections.defaultdict(list)
        for k, v in zip(*tree.report(lo, hi, least, most), strict=True):
            got[int(k)].append(int(v))
        for k in range(50):
            assert sorted(got[k]) == sorted(int(v) for v in values[lo[k] : hi[k]] if least[k] <= v < most[k])


@pytest.mark.parametrize("seed", range(4))
def test_pairs_of_one_group(seed):
    """Few letters, so that runs of one letter and many neighbours occur."""
    rng = random.Random(seed)
    m = rng.choice([4, 7])
    words = sorted({"".join(rng.choices("abÿ", k=m - rng.randrange(2))).encode("latin-1") for _ in range(60)})
    rng.shuffle(words)
    found = collections.Counter((words[o], words[w]) for of, near in sp.near_pairs(m, 0, m, np.zeros(len(words), np.int64), words) for o, w in zip(of.tolist(), near.tolist(), strict=True))
    wanted = {(a, b) for a in words for b in words if m in (len(a), len(b)) and one_edit(a, b)}
    assert set(found) == wanted and set(found.values()) <= {1}


@pytest.mark.parametrize("group", [4096, 130])
def test_against_plain(spark, group):
    """Large groups of words with one beginning, halved again and again; chains of forms."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzäß×"
    words = ["common" + "".join(rng.choices(letters, k=rng.choice([2, 2, 3]))) for _ in range(900)] + ["".join(rng.choices("ab", k=rng.choice([7, 8, 9]))) for _ in range(200)]
    words += [w for n, w in ((3, "firstlyy"), (50, "firstly"), (900, "firstky"), (15000, "ferstky")) for _ in range(n)]
    rng.shuffle(words)
    rows = [(k, " ".join(words[k::40]) + "\n" + " ".join(words[k::40]).upper()) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = rows_of(sp.variants(docs, group=group))
    assert found == plain(rows)
    assert any(f != r for _, f, r, *_ in found if f)  # a chain of two at least


def test_edges(spark):
    long = "x" * 30_000
    rows = [(1, "Straßen straßen straszen straße"), (2, None), (None, "straßes straßes"), (3, ""), (3, f"{long} {long}y z{long} {long[1:]}q"), (4, f"{long} {long}y z{long} {long[1:]}q"), (4, "abcdefg1abcdefg ĀabcdefgĀ")]
    docs = spark.createDataFrame([(*r, "w", 1, 2) for r in rows], "doc_id long, text string, word string, n int, key int")
    assert rows_of(sp.variants(docs)) == plain(rows)
    assert sp.variants(docs.limit(0)).count() == 0
