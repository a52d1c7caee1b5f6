"""Outcomes, snapshots and similar periods against plain versions."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.operators import replay
from tidemark.plans import patterns

DAY0 = datetime(2020, 1, 1)


def test_outcomes_with_gaps(spark):
    rng = random.Random(1)
    days = sorted(rng.sample(range(400), 150))
    prices = {s: [(d, 100 + rng.random() * 50) for d in days[: n]] for s, n in (("A", 150), ("B", 1))}
    df = spark.createDataFrame([(s, DAY0 + timedelta(days=d), p) for s, x in prices.items() for d, p in x], "symbol string, time timestamp_ntz, close double")
    got = {(r.symbol, (r.time - DAY0).days, r.horizon): r for r in replay.outcomes(df, (1, 7, 60)).collect()}
    assert len(got) == 151 * 3
    for (s, d, h), r in got.items():
        inside = [p for t, p in prices[s] if d <= t <= d + h]
        peak, fall = 0, 0
        for p in inside:
            peak = max(peak, p)
            fall = max(fall, 1 - p / peak)
        assert (r.price, r.min_price, r.max_price, r.n) == (inside[-1], min(inside), max(inside), len(inside))
        assert r.max_drawdown == pytest.approx(fall) and r["return"] == pytest.approx(inside[-1] / inside[0] - 1)


def test_snapshots_never_see_the_future(spark):
    rng = random.Random(2)
    asks = [(s, DAY0 + timedelta(days=d)) for s in "AB" for d in range(0, 900, 50)]
    rows = {n: [(rng.choice("AB"), DAY0 + timedelta(days=rng.randrange(900)), rng.randrange(40), k) for k in range(60)] for n in "xy"}
    series = {n: (spark.createDataFrame([(s, t + timedelta(days=lag), t, v) for s, t, lag, v in own], "symbol string, known timestamp_ntz, time timestamp_ntz, value int"), ["time", "value"], []) for n, own in rows.items()}
    found = replay.snapshots(spark.createDataFrame(asks, "symbol string, time timestamp_ntz"), series, by=("symbol",)).collect()
    assert len(found) == len(asks)
    for r in found:
        for n, own in rows.items():
            known = [(t, v) for s, t, lag, v in own if s == r.symbol and t + timedelta(days=lag) <= r.time]
            assert (r[f"{n}_time"], r[f"{n}_value"]) == (max(known) if known else (None, None))


@pytest.mark.parametrize("rows", [5, 40, 256])
def test_similar_periods_of_every_date(spark, rows):
    rng = np.random.default_rng(rows)
    data = {"A": rng.normal(size=(240, 3)).cumsum(axis=0) / 5, "B": rng.normal(size=(12, 3)), "C": np.zeros((60, 3))}
    lookback, gap = 90, 20
    df = spark.createDataFrame([(s, DAY0 + timedelta(days=k), v.tolist()) for s, x in data.items() for k, v in enumerate(x)], "symbol string, time timestamp_ntz, v array<double>")
    got = {(r.symbol, (r.time - DAY0).days): r for r in patterns.most_like(df, lookback, gap, rows=rows).collect()}
    assert len(got) == sum(map(len, data.values()))
    for s, x in data.items():
        similar = patterns._similarity(x, x)
        for k in range(len(x)):
            window = [j for j in range(len(x)) if gap < k - j <= lookback]
            best = sorted((-similar[k, j], j) for j in window if similar[k, j] >= patterns.SIMILAR)[:3]
            r = got[s, k]
            assert r.history == len(window)
            assert [(-f.similarity, round((f.us / 1e6 - (DAY0 - datetime(1970, 1, 1)).total_seconds()) / 86400)) for f in r.found or []] == best
    assert patterns.most_like(df.limit(0)).count() == 0
