"""Source divergence against its SQL and against a plain version."""

import collections
import random
import re

import pandas as pd
import pytest

from tidemark.llm import divergence as dv

from .helpers import LOWER, duck, same_rows

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least=10):
    """rows: (lang, source, text)."""
    rows = [(a or "", b or "", t or "") for a, b, t in rows]
    docs, counts = collections.Counter(), collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        terms = [x.translate(LOWER) for x in TERM.findall(text)]
        docs.update((lang, x) for x in set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {x[0] for x in rows}:
        kept = [t for (x, t), n in docs.items() if x == lang and n >= least]
        share = lambda c, v=len(kept), kept=kept: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * v) for t in kept}
        own = {s: share(c) for (x, s), c in counts.items() if x == lang}
        whole = share(sum((collections.Counter(c) for (x, _), c in counts.items() if x == lang), collections.Counter()))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, p in own.items():
            pairs = sorted((-sum(f(p[t], q[t]) for t in kept), o.encode(), o) for o, q in own.items() if o != s)
            terms = sorted((-f(p[t], whole[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[t] > whole[t])[:10]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def made(seed, n, sources, words=40):
    rng = random.Random(seed)
    vocabulary = [f"{'abé語Z'[k % 5]}{chr(97 + k // 5)}" for k in range(words)]
    return [(rng.choice(["en", "de", None]), rng.choice([*[f"s{k}" for k in range(sources)], None]), " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(words)], k=rng.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    docs = pd.read_parquet(f"/root/testdata/{sf}/documents.parquet")
    assert same_rows(dv.op13_source_divergence(spark, f"/root/testdata/{sf}"), duck(documents=docs), dv.SQL)


@pytest.mark.parametrize(("seed", "sources", "block", "cell"), [(1, 5, 4, 1), (2, 9, 7, 2), (3, 3, 4096, 8), (4, 12, 5, 1)])
def test_blocks_and_cells_do_not_show(spark, seed, sources, block, cell):
    rows = made(seed, 300, sources)
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert rows_of(dv.divergence(docs, block=block, cell=cell)) == plain(rows)


def test_every_two_seats_meet_once(spark):
    for seats in (2, 4, 6, 10):
        met = collections.Counter()
        for k in range(seats - 1):
            table = spark.range(seats).selectExpr("id AS cell", f"{seats}L AS seats").withColumn("to", dv._partner(k)).collect()
            found = {r.cell: r.to for r in table}
            assert all(found[found[c]] == c and found[c] != c for c in found)
            met.update(frozenset(x) for x in found.items())
        assert len(met) == seats * (seats - 1) // 2 and set(met.values()) == {2}


def test_edges(spark):
    schema = "doc_id long, lang string, source string, text string, term string, n int, cell int, block int"
    rows = [(k, "en", f"s{k % 3}", "Same same TERM " * 3, "x", 1, 2, 3) for k in range(30)] + [(99, "en", "none", None, None, None, None, None), (100, "xx", None, "", "", 0, 0, 0), (101, "xx", "b", "rare", "", 0, 0, 0), (102, "en", "long", "same " * 200_000 + "\x00   word", "", 0, 0, 0)]
    docs = spark.createDataFrame(rows, schema)
    found = rows_of(dv.divergence(docs))
    assert found == plain([(r[1], r[2], r[3]) for r in rows])
    assert ("xx", "", "pair", "b", 0, 1) in found and any(r[1] == "none" for r in found)  # ties by name, groups without terms
    assert dv.divergence(docs.limit(0)).count() == 0
