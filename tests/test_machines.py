"""Composed state machines against plain loops, and holdings against decimals."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from tidemark.functions import machines
from tidemark.plans import alerts, engines, portfolio
from tidemark.streaming import alert_state

from . import loops

DAY0 = datetime(2020, 1, 1)


def test_maps_of_a_table_compose():
    rng = np.random.default_rng(1)
    machine = machines.Table(rng.integers(0, 50, (4, 50)).astype(np.int32), 0)
    rows = rng.integers(-1, 4, (300, 1))
    want = machine.replay(rows, 7)
    a, b, c = (machine.map_of(x) for x in (rows[:100], rows[100:101], rows[101:]))
    for whole in (machine.compose(machine.compose(a, b), c), machine.compose(a, machine.compose(b, c))):
        assert machine.apply(whole, 7) == want[-1]


@pytest.mark.parametrize("seed", range(30))
def test_maps_of_a_gate_compose(seed):
    """Stretches as long as the cooldown, long runs that span several of them, candidates at equal times."""
    rng = np.random.default_rng(seed)
    cooldown = int(rng.integers(1, 30))
    at = np.sort(rng.integers(0, 400, 120))
    run = np.cumsum(rng.random(120) < rng.choice([0.02, 0.2, 1.0]))
    rows, gate = np.stack([at, run], axis=1), machines.Gate(cooldown)
    want, last = [], None
    for t, r in rows.tolist():
        ok = last is None or (t - last[0] >= cooldown and r > last[1])
        last = (t, r) if ok else last
        want.append(int(ok))
    assert gate.replay(rows, None).tolist() == want
    cuts = [rows[at // (2 * cooldown) == k] for k in range(400 // (2 * cooldown) + 1)]
    cuts = [x for x in cuts if len(x)]
    memory, got = None, []
    for x in cuts:
        got += gate.replay(x, memory).tolist()
        passed = [r for r, w in zip(x.tolist(), gate.replay(x, memory), strict=True) if w]
        after = gate.apply(gate.map_of(x), memory)
        assert after == (tuple(passed[-1]) if passed else memory)
        memory = after
    assert got == want
    whole = gate.map_of(cuts[0])
    for x in cuts[1:]:
        whole = gate.compose(whole, gate.map_of(x))
    assert gate.apply(whole, None) == memory
    middle = len(cuts) // 2
    if middle > 1:  # composed later parts, from every memory that may come before them
        begun = None
        for x in cuts[:middle]:
            begun = gate.apply(gate.map_of(x), begun)
        rest = gate.map_of(cuts[middle])
        for x in cuts[middle + 1 :]:
            rest = gate.compose(rest, gate.map_of(x))
        assert gate.apply(rest, begun) == memory


@pytest.mark.parametrize("rows", [3, 8192])
def test_debounce_equals_the_loop(spark, rows):
    rng = random.Random(rows)
    names, data = list(engines.TRANSITIONS), {}
    for s in ("A", "B", "C"):
        t, phase, own = DAY0, None, []
        for _ in range(150):
            t += timedelta(hours=rng.choice([24, 24, 24, 30, 200]))
            phase = phase if rng.random() < 0.6 else rng.choice([*names, None])
            own.append((t, phase))
        data[s] = own
    data["D"] = [(DAY0, None)]
    df = spark.createDataFrame([(s, t, p) for s, own in data.items() for t, p in own], "symbol string, time timestamp_ntz, phase string")
    got = {}
    for r in engines.debounced(df, rows=rows).orderBy("time").collect():
        got.setdefault(r.symbol, []).append((r.state, r.days))
    assert got == {s: loops.debounced(own, engines.advanced, engines.Memory) for s, own in data.items()}


@pytest.mark.parametrize(("cooldown", "most"), [(0, None), (3600, None), (86_400 * 3, None), (600, 2), (0, 1)])
def test_cooldown_equals_the_loop(spark, cooldown, most):
    rng = random.Random(cooldown)
    data = {s: sorted({rng.randrange(40 * 86_400) if s == "A" else rng.randrange(5_000) for _ in range(400)}) for s in ("A", "B")}
    df = spark.createDataFrame([(s, DAY0 + timedelta(seconds=t)) for s, own in data.items() for t in own], "symbol string, time timestamp_ntz")
    got = {s: [] for s in data}
    for r in alerts.cooled_down(df, cooldown, most).orderBy("time").collect():
        got[r.symbol].append(int((r.time - DAY0).total_seconds()))
    assert got == {s: loops.cooled_down(own, cooldown, most or 10**9) for s, own in data.items()}


@pytest.mark.parametrize("limits", [(0, 1, 0), (600, 2, 3600), (0, 3, 50_000), (5000, 1, 0)])
def test_alerts_equal_the_loop(spark, limits):
    rng = random.Random(str(limits))
    zero = datetime(2020, 1, 1, tzinfo=timezone.utc)
    data = {}
    for s in ("A", "B"):
        cond, own, t = False, [], 0
        for _ in range(500):
            t += rng.choice([0, 20, 400, 3000])
            cond = cond if rng.random() < 0.8 else rng.choice([True, False, None])
            own.append((zero + timedelta(seconds=t), cond))
        data[s] = own
    df = spark.createDataFrame([(s, t, c) for s, own in data.items() for t, c in own], "key string, time timestamp, cond boolean")
    got = sorted((r.key, r.time.astimezone(timezone.utc), r.action) for r in alert_state.fired_batch(df, *limits).collect())
    order = lambda x: (x[0], 2 if x[1] is None else int(x[1]))
    assert got == sorted((s, *x) for s, own in data.items() for x in loops.fired(sorted(own, key=order), alert_state.step, *limits)) and got
    assert alert_state.fired_batch(df.limit(0), *limits).count() == 0


def held(spark, rows, user="u"):
    data = [(user, DAY0 + timedelta(minutes=k), k, *r) for k, r in enumerate(rows)]
    df = spark.createDataFrame(data, "user_id string, time timestamp_ntz, event_id long, side string, amount string, price string, fee string")
    return portfolio.holdings(df.selectExpr("user_id", "time", "event_id", "side", *[f"CAST({c} AS DECIMAL(30,12)) AS {c}" for c in ("amount", "price", "fee")]))


def test_many_large_sales(spark):
    """1,200 purchases of 100 coins at 1, each followed by a sale of 60 % of what is held."""
    rows, coins = [], 0.0
    for _ in range(1200):
        coins += 100
        rows += [("BUY", "100", "1", "0"), ("SELL", f"{coins * 0.6:.12f}", "1", "0")]
        coins -= float(rows[-1][1])
    r = held(spark, rows).first()
    assert r.coins == pytest.approx(66.6666667, abs=1e-6) and r.avg_cost == pytest.approx(1.0, abs=1e-9) and r.realized_pnl == pytest.approx(0.0, abs=1e-6)


def test_long_histories_against_decimals(spark):
    rng = random.Random(3)
    rows, coins = [], 0.0
    for k in range(50_000):
        price = 50 + rng.random() * 100
        amount = rng.random() * 1000
        coins += amount / price
        rows.append(("BUY", f"{amount:.8f}", f"{price:.8f}", f"{amount / 1000:.8f}"))
        part = coins * rng.choice([0.1, 0.5, 0.9, 1.5 if k % 5000 == 77 else 0.3])
        rows.append(("SELL", f"{part * price:.8f}", f"{price:.8f}", "0.01"))
        coins = max(0.0, coins - part)
    want = loops.positions(rows)
    r = held(spark, rows).first()
    for got, w in zip((r.coins, r.avg_cost, r.realized_pnl), want, strict=True):
        assert got == pytest.approx(float(w), rel=1e-6, abs=1e-6)
