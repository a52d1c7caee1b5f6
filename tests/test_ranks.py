"""Ranks over all earlier rows, by a tree of any depth, against a count."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.functions import ranks

DAY0 = datetime(2020, 1, 1)


@pytest.mark.parametrize(("span", "parts", "kind"), [(20_000, 32, "walk"), (20, 3, "walk"), (16, 4, "ties"), (8, 2, "one"), (50, 8, "gaps")])
def test_expanding_rank(spark, span, parts, kind):
    rng = np.random.default_rng(span)
    make = {"walk": lambda: rng.normal(size=400).cumsum(), "ties": lambda: rng.integers(0, 5, 300).astype(float), "one": lambda: np.where(rng.random(200) < 0.9, 7.0, rng.normal(size=200)), "gaps": lambda: np.where(rng.random(300) < 0.3, np.nan, rng.normal(size=300))}[kind]
    data = {"A": make(), "B": make()[:5]}
    df = spark.createDataFrame([(s, DAY0 + timedelta(days=k), None if np.isnan(v) else float(v)) for s, x in data.items() for k, v in enumerate(x)], "symbol string, time timestamp_ntz, v double")
    got = {(r.symbol, (r.time - DAY0).days): r["rank"] for r in ranks.expanding_percent_below(df, "rank", "v", span=span, parts=parts).collect()}
    assert len(got) == sum(map(len, data.values()))
    for s, x in data.items():
        for k, v in enumerate(x):
            before = x[:k][~np.isnan(x[:k])]
            want = None if np.isnan(v) or len(before) < 2 else 100 * (before < v).sum() / len(before)
            assert got[s, k] == (want if want is None else pytest.approx(want, abs=1e-12))
