"""The URL filter: split and rules against SQL, the model against a plain version and on words that it was not taught."""

import math

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import url_filter as uf
from tidemark.llm.common import LOWER, UPPER

from .helpers import duck

RULES = uf.RULES_SQL.format(rules=", ".join(repr(r) for r in uf.RULES), upper=UPPER, lower=LOWER)


@pytest.fixture(scope="module")
def model(spark):
    return uf.fit(spark.createDataFrame(uf.LABELLED, "url string, label int"))


def parts_of(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1].split("#", 1)[0].split("?", 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), slash + path


def plain_score(url, model):
    """One n-gram after the other."""
    weights, bias = model
    found = []
    for turn, text in zip((0, 0x155555 & (2**uf.BITS - 1)), parts_of(url), strict=True):
        t = b"\x02" + text.encode() + b"\x03"
        for n in uf.GRAMS:
            for k in range(len(t) - n + 1):
                h = n
                for c in t[k : k + n]:
                    h = (h * 0x9E3779B97F4A7C15 + c + 1) % 2**64
                h = (h ^ (h >> 33)) * 0xFF51AFD7ED558CCD % 2**64
                found.append((h >> (64 - uf.BITS)) ^ turn)
    return 1 / (1 + math.exp(-(sum(weights[b] for b in found) / math.sqrt(max(1, len(found))) + bias)))


ODD = [None, "", "no scheme", "http://", "://A.ORG", "://A.ORG/", "http://É.Example.ORG/es/x?y#z", "http://example.org/en/1", "http://example.org/en/12", "http://notexample.org/en/1", "http://b.com/fr/?q", "http://com/de/", "http://xcom/de/",
       "a://b://c.com/de/1", "http://h.net?x=/de/", "http://h.com#/de/", "http://m.casino.net/" + "x" * 300_000, "http://a\nb.org/\n/es/", "http://user@x.com:80/de/1", "http://h/%F0%9F%98%80/😀"]


def test_rules_and_scores(spark, model):
    rows = [(k, u, "h", "p", "r", "v", 0.5) for k, u in enumerate(ODD + ODD[:5])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, verdict string, score double")
    found = sorted(uf.judge(pages.select("page_id", "url"), model).collect(), key=lambda r: r.page_id)
    wanted = sorted(duck(pages=pd.DataFrame({"page_id": [r[0] for r in rows], "url": [r[1] for r in rows]})).execute(RULES).fetchall())
    assert len(found) == len(wanted) == len(rows)
    for r, (_, host, path, rule, verdict), row in zip(found, wanted, rows, strict=True):
        assert (r.host, r.path, r["rule"]) == (host, path, rule) and (host, path) == parts_of(row[1])
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
        if len(row[1] or "") < 1000:
            assert abs(r.score - plain_score(row[1], model)) < 1e-9
    assert uf.judge(pages.select("page_id", "url").limit(0), model).count() == 0


def test_query(spark, model):
    found = {r.page_id: r for r in uf.op11_url_filter(spark, "/root/testdata/sf0.01").collect()}
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet", columns=["page_id", "url"])
    assert len(found) == len(pages)
    for page_id, host, path, rule, verdict in duck(pages=pages).execute(RULES).fetchall():
        r = found[page_id]
        assert (r.host, r.path, r["rule"]) == (host, path, rule) and r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))


def test_words_that_were_held_out(spark):
    """A fifth of the words at a time is taken from the table and judged by what the rest teaches, pairs included."""
    right = total = 0
    for part in range(5):
        out = {w for words in (uf.BLOCKED, uf.ALLOWED) for w in words[part::5]}
        touched = lambda u, out=out: out & set(parts_of(u)[0].replace(".", "-").split("-"))
        known, held = [r for r in uf.LABELLED if not touched(r[0])], [r for r in uf.LABELLED if touched(r[0])]
        as_bytes = lambda rows: ([parts_of(u)[0].encode() for u, _ in rows], [parts_of(u)[1].encode() for u, _ in rows])
        model = uf.train(*as_bytes(known), np.array([label for _, label in known], float))
        scores = uf.scored(*as_bytes(held), *model)
        right += sum((s >= 0.5) == bool(label) for s, (_, label) in zip(scores, held, strict=True))
        total += len(held)
    assert right / total > 0.7, right / total


def test_sample_is_bounded_and_fits_repeat(spark, model):
    many = spark.range(5000).selectExpr("concat('http://a', id, '.com/') AS url", "CAST(id % 2 AS INT) AS label")
    assert uf.fit(many, most=100)[0].any()
    again = uf.fit(spark.createDataFrame(uf.LABELLED[::-1], "url string, label int"))
    assert again[1] == model[1] and (again[0] == model[0]).all()
    assert uf.fit(many.limit(0))[1] == 0.0
