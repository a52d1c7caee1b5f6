"""Folds, rules and streams against hand-worked cases and plain loops."""

import json
import math
from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import asof, data_quality, relational
from tidemark.plans import alerts, backtest, engines, indicators, portfolio

from tidemark.sources import landing
from tidemark.streaming import alert_state

from . import loops

SF = "/root/testdata/sf0.001"
DAY0 = datetime(2023, 1, 1)


def bars_of(spark, closes, symbol="X"):
    rows = [(symbol, DAY0 + timedelta(days=k), closes[k - 1] if k else c, c * 1.01, c * 0.99, c, 10) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, time timestamp_ntz, open double, high double, low double, close double, volume long")


def wave(n=120):
    return [30000 + 50 * i + 3000 * math.sin(i / 15) for i in range(n)]


# --- recursive indicators ---

def test_smoothing_against_pandas():
    x = np.random.default_rng(1).normal(100, 5, 300)
    want = pd.Series(x).ewm(span=12, adjust=False).mean().to_numpy()
    got = loops.ema(x, 12)
    assert np.isnan(got[:11]).all() and np.allclose(got[11:], want[11:])


@given(st.lists(st.floats(1, 1000), min_size=2, max_size=60))
@settings(max_examples=60, deadline=None)
def test_rsi_and_di_bounds(values):
    x = np.array(values)
    found = loops.all_of(x * 1.01, x * 0.99, x)
    for c in ("rsi14", "adx"):
        sound = found[c][np.isfinite(found[c])]
        assert ((sound >= 0) & (sound <= 100 + 1e-9)).all()


def test_rsi_extremes():
    up = np.linspace(100, 200, 60)
    assert loops.all_of(up, up, up)["rsi14"][-1] == 100
    assert loops.all_of(up[::-1], up[::-1], up[::-1])["rsi14"][-1] == 0
    flat = np.full(60, 5.0)
    assert loops.all_of(flat, flat, flat)["rsi14"][-1] == 100


def test_adx_against_a_loop():
    rng = np.random.default_rng(7)
    c = 100 + np.cumsum(rng.normal(0, 1, 200))
    h, lo, n = c + rng.uniform(0, 1, 200), c - rng.uniform(0, 1, 200), 14
    tr = [h[0] - lo[0]] + [max(h[i] - lo[i], abs(h[i] - c[i - 1]), abs(lo[i] - c[i - 1])) for i in range(1, 200)]
    up = [0.0] + [h[i] - h[i - 1] for i in range(1, 200)]
    dn = [0.0] + [lo[i - 1] - lo[i] for i in range(1, 200)]

    def smooth(v, first):
        out, y = {}, sum(v[first : first + n]) / n
        out[first + n - 1] = y
        for i in range(first + n, len(v)):
            y = out[i] = y * (n - 1) / n + v[i] / n
        return out

    a, p, m = smooth(tr, 0), smooth([u if u > d and u > 0 else 0 for u, d in zip(up, dn, strict=True)], 1), smooth([d if d > u and d > 0 else 0 for u, d in zip(up, dn, strict=True)], 1)
    dx = [abs(p[i] - m[i]) / (p[i] + m[i]) * 100 if i in p else 0 for i in range(200)]
    want = smooth(dx, 14)
    got = loops.all_of(h, lo, c)["adx"]
    assert np.isnan(got[:27]).all() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in range(27, 200))


# --- window indicators ---

def test_missing_columns_are_null_and_none_overrides_are_ignored(spark):
    b = bars_of(spark, wave(30))
    assert indicators.calculate(b, "onchain.nupl").filter("value is not null").count() == 0
    assert indicators.calculate(b, "tech.sma", period=None).filter("value is not null").count() == 0
    assert indicators.calculate(b, "tech.sma", period=5).filter("value is not null").count() == 26


def test_identities(spark):
    f = indicators.research_frame(spark, SF)
    m, n = indicators.calculate(f, "onchain.mvrv"), indicators.calculate(f, "onchain.nupl").withColumnRenamed("value", "nupl")
    assert m.join(n, ["symbol", "time"]).filter(F.abs(F.col("nupl") - (1 - 1 / F.col("value"))) > 1e-9).count() == 0
    d = indicators.calculate(f, "composite.drawdown")
    assert d.filter("value > 0").count() == 0
    assert len(indicators.codes()) == 28


def test_registering_twice_fails():
    with pytest.raises(ValueError):
        indicators.indicator("tech.sma", "close")(lambda: {})


# --- as-of ---

def test_asof_matches_pandas_and_buckets_change_nothing(spark):
    rng = np.random.default_rng(3)
    left = pd.DataFrame({"s": rng.choice(["a", "b"], 300), "t": pd.to_datetime("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 10**6, 300)), "s")})
    right = pd.DataFrame({"s": rng.choice(["a", "b"], 60), "t": pd.to_datetime("2024-01-01") + pd.to_timedelta(np.sort(rng.choice(10**6, 60, replace=False)), "s"), "v": np.arange(60.0)})
    want = pd.merge_asof(left, right, on="t", by="s")
    wanted = sorted((r.s, r.t.to_pydatetime(), None if math.isnan(r.v) else r.v) for r in want.itertuples())
    l, r = spark.createDataFrame(left).select("s", F.col("t").cast("timestamp_ntz").alias("t")), spark.createDataFrame(right).select("s", F.col("t").cast("timestamp_ntz").alias("t"), "v")
    for bucket in (None, "day", "hour"):
        got = asof.asof_backward(l, r.withColumnRenamed("t", "rt"), "t", "rt", ["v"], ["s"], bucket)
        key = lambda x: (x[0], x[1], x[2] is None, x[2] or 0)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(wanted, key=key), bucket


def test_known_at_is_inclusive_on_both_clocks(spark):
    rows = [(1, datetime(2024, 1, 1), datetime(2024, 1, 5)), (2, datetime(2024, 1, 1), None), (3, datetime(2024, 1, 5), datetime(2024, 1, 5)), (4, datetime(2024, 1, 1), datetime(2024, 1, 6))]
    df = spark.createDataFrame(rows, "id int, time timestamp, fetch_time timestamp")
    assert sorted(r.id for r in asof.known_at(df, F.lit("2024-01-05").cast("timestamp")).collect()) == [1, 2, 3]


# --- backtests ---

def test_event_engine_agrees_with_vectorized(spark):
    b = bars_of(spark, wave())
    for next_open, within in ((False, 0.005), (True, 0.01)):
        for strategy in ("fixed_dca", "dip_buy", "drawdown_buy"):
            a = backtest.vectorized(b, strategy, "WEEKLY", next_open=next_open).orderBy(F.desc("time")).first()
            e = backtest.event_driven(b, strategy, "WEEKLY", next_open=next_open).orderBy(F.desc("time")).first()
            assert abs(a.value / e.value - 1) < within + (0.15 if next_open and abs(a.invested - e.invested) > 1 else 0)


def test_irr():
    assert math.isclose(backtest.irr([0, 365], [-100.0, 110.0]), 0.1, rel_tol=1e-8)
    assert backtest.irr([0, 10], [100.0, 5.0]) is None
    flows = ([0, 100, 200, 400], [-100.0, -50.0, -50.0, 260.0])
    r = backtest.irr(*flows)
    assert abs(sum(f / (1 + r) ** (d / 365) for d, f in zip(*flows, strict=True))) < 1e-6


def test_drawdown_episodes(spark):
    rows = [("X", DAY0 + timedelta(days=k), v) for k, v in enumerate([10.0, 8.0, 6.0, 10.0, 12.0, 9.0, 11.0])]
    found = sorted(map(tuple, backtest.drawdown_episodes(spark.createDataFrame(rows, "symbol string, time timestamp_ntz, value double")).collect()), key=lambda r: r[1])
    day = lambda k: DAY0 + timedelta(days=k)
    assert [r[1:4] for r in found] == [(day(0), day(2), day(3)), (day(4), day(5), None)]
    assert [round(r[4], 9) for r in found] == [0.4, 0.25] and [r[5:] for r in found] == [(3, 1), (2, None)]


def test_sweep_gives_a_row_per_run_and_symbol(spark):
    out = backtest.sweep(bars_of(spark, wave()), [{"amount": 50.0}, {"amount": 100.0, "strategy": "dip_buy"}])
    assert out.count() == 2 and out.filter("max_drawdown < 0").count() == 0


# --- portfolio ---

def test_holdings(spark):
    rows = [("u", 1, "BUY", 100, 10, 1), ("u", 2, "SELL", 60, 12, 0), ("u", 3, "SELL", 60, 12, 0), ("u", 4, "BUY", 50, 5, 0), ("v", 1, "SELL", 10, 5, 1), ("v", 2, "BUY", 30, 3, 0), ("v", 3, "SELL", 20, 4, 2), ("v", 4, "BUY", None, None, None)]
    df = spark.createDataFrame([(u, datetime(2024, 1, k), k, side, *(None if x is None else float(x) for x in (a, p, f))) for u, k, side, a, p, f in rows],
                               "user_id string, time timestamp_ntz, event_id long, side string, amount double, price double, fee double")
    got = {r.user_id: tuple(round(x, 6) for x in tuple(r)[1:]) for r in portfolio.holdings(df).collect()}
    # u: 10 coins for 101, sold at 12 in two halves (9.5 each), then 10 coins for 50. v: a sale of nothing, 10 coins for 30, 5 of them sold for 20.
    assert got == {"u": (4, 10, 5, 50, 19, 151, 120, 1), "v": (4, 5, 3, 15, 9 + 3, 30, 27, 3)}


def test_plan_rules(spark):
    df = spark.createDataFrame([(100.0, -10.0), (100.0, -60.0), (320000.0, -60.0), (360000.0, -1.0), (None, None)], "price double, drawdown_pct double")
    assert [r[0] for r in df.select(portfolio.plan_amount(100.0, portfolio.PLAN)).collect()] == [100.0, 200.0, 100.0, 10.0, 100.0]
    assert [r[0] for r in df.select(portfolio.plan_amount(100.0, [{"priority": 1, "condition": {"type": "threshold", "metric": "price", "operator": "gt", "value": 1}, "action": "skip"}])).collect()] == [0.0, 0.0, 0.0, 0.0, 100.0]
    # Whatever its priority, a skip that holds stands, a fixed amount comes next, and multipliers compound.
    always = {"type": "threshold", "metric": "price", "operator": "gt", "value": 1}
    rule = lambda p, action, value=None: {"priority": p, "condition": always, "action": action, "value": value}
    spent = lambda *rules: df.select(portfolio.plan_amount(100.0, list(rules))).first()[0]
    assert spent(rule(1, "skip"), rule(2, "fix", 50.0), rule(3, "multiply", 2.0)) == 0.0
    assert spent(rule(1, "fix", 50.0), rule(2, "multiply", 2.0)) == 50.0
    assert spent(rule(1, "multiply", 3.0), rule(1, "multiply", 2.0), rule(2, "multiply", 0.5)) == 100.0


# --- engines ---

def test_risk_floor(spark):
    df = spark.createDataFrame([(40.0, 95.0, 10.0, 10.0), (40.0, 95.0, 75.0, 75.0), (40.0, 71.0, 71.0, 71.0), (80.0, 95.0, 1.0, 1.0), (20.0, 1.0, None, 1.0)], "s double, a double, b double, c double")
    cols = [F.col(c) for c in "abc"]
    assert [r[0] for r in df.select(engines.floored(F.col("s"), cols)).collect()] == [50, 70, 70, 80, 20]
    assert [r[0] for r in df.select(engines.floored(F.col("s"), cols, compat=True)).collect()] == [50, 50, 70, 80, 20]


def test_debounce(spark):
    phases = ["BEAR"] * 9 + ["UPTREND"] * 3 + ["BOTTOM_BUILDING"] * 4
    df = spark.createDataFrame([("X", DAY0 + timedelta(days=k), p) for k, p in enumerate(phases)], "symbol string, time timestamp_ntz, phase string")
    states = [r.state for r in engines.debounced(df).orderBy("time").collect()]
    assert states == ["BEAR"] * 14 + ["BOTTOM_BUILDING"] * 2  # illegal jump refused, then three confirmations


def test_fuse_renormalizes(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 3.0), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(engines.fuse([(F.col("a"), 0.25), (F.col("b"), 0.75)])).collect()] == [2.5, 3.0, None]


# --- rules ---

KLEENE = [(a, b) for a in (True, False, None) for b in (True, False, None)]


def test_kleene_table(spark):
    df = spark.createDataFrame([(1.0 if a else 0.0 if a is False else None, 1.0 if b else 0.0 if b is False else None) for a, b in KLEENE], "a double, b double")
    leaf = lambda m: {"type": "threshold", "metric": m, "operator": "gt", "value": 0.5}
    both, either, no = ({"type": "AND", "children": [leaf("a"), leaf("b")]}, {"type": "OR", "children": [leaf("a"), leaf("b")]}, {"type": "NOT", "children": [leaf("a")]})
    rows = df.select(*[alerts.compiled(t) for t in (both, either, no)]).collect()
    for (a, b), r in zip(KLEENE, rows, strict=True):
        assert r[0] is (False if a is False or b is False else None if a is None or b is None else True)
        assert r[1] is (True if a or b else None if a is None or b is None else False)
        assert r[2] is (None if a is None else not a)


def test_crossing_change_and_depth(spark):
    df = spark.createDataFrame([("X", DAY0 + timedelta(days=k), v, s) for k, (v, s) in enumerate([(1.0, "a"), (2.0, "a"), (3.0, "b"), (1.0, "c")])], "symbol string, time timestamp_ntz, v double, s string")
    trees = [{"type": "cross_above", "metric": "v", "value": 2}, {"type": "cross_below", "metric": "v", "value": 2}, {"type": "state_change", "metric": "s", "to": "b"}]
    rows = df.select("time", *[alerts.compiled(t).alias(f"c{k}") for k, t in enumerate(trees)]).orderBy("time").collect()
    assert [r.c0 for r in rows] == [None, False, True, False] and [r.c1 for r in rows] == [None, False, False, True] and [r.c2 for r in rows] == [None, False, True, False]
    deep = trees[0]
    for _ in range(6):
        deep = {"type": "NOT", "children": [deep]}
    assert df.select(alerts.compiled(deep).alias("c")).filter("c is not null").count() == 0
    assert "NOT" in alerts.describe(deep)


def test_unknown_keeps_an_episode_open(spark):
    conds = [True, None, True, False, None, True]
    df = spark.createDataFrame([("X", DAY0 + timedelta(days=k), c) for k, c in enumerate(conds)], "symbol string, time timestamp_ntz, cond boolean")
    assert [r.fired for r in alerts.episodes(df).orderBy("time").collect()] == [True, False, False, False, False, True]


# --- streams ---

def test_stream_equals_batch(spark, tmp_path):
    obs = alert_state.observations(spark, SF)
    source = str(tmp_path / "in")
    obs.coalesce(1).sortWithinPartitions("time").write.parquet(source)
    stream = spark.readStream.schema(obs.schema).parquet(source)
    q = alert_state.fired(stream, 600, 2, 3600).writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = sorted(map(tuple, alert_state.fired_batch(obs, 600, 2, 3600).collect()))
    assert sorted(map(tuple, spark.table("fired").collect())) == want and want


def test_step():
    state, out = (-1, 0, False, -1), []
    for t, c in enumerate([True, True, None, True, False, True, True, True]):
        state, action = alert_state.step(state, t * 10, c, 10, 2, 45)
        out.append(action)
    assert out == [None, "trigger", None, None, "recover", None, "trigger", None]


def test_ingest_counts_each_file_once(spark, tmp_path):
    src, dst, ck = (str(tmp_path / x) for x in ("src", "dst", "ck"))
    (tmp_path / "src").mkdir()
    for k in range(2):
        (tmp_path / "src" / f"{k}.json").write_text(json.dumps({"k": k}) + "\n")
        landing.ingest(spark, src, "k long", dst, ck)
    assert sorted(r.k for r in spark.read.parquet(dst).collect()) == [0, 1]


def test_levels_of_a_hot_user(spark):
    values = [("hot", float(k % 700)) for k in range(5000)] + [("few", 1.5), ("few", None), (None, 2.0), ("none", None)] + [("same", 3.25)] * 30
    events = spark.createDataFrame(values, "user_id string, value double")
    found = landing.levels(events)
    want = {}
    for user in {u for u, _ in values}:
        own = [v for u, v in values if u == user]
        known = sorted((v for v in own if v is not None), reverse=True)[:20]
        want[user] = (len(own), sum(known) if known else None)
    assert {r.user_id: (r.n, r.top20) for r in found.collect()} == want
    assert "collect_list" not in landing.q_levels(spark, SF)._jdf.queryExecution().toString()


# --- sources, checks, scalars ---

def test_report_counts_invalid_rows(spark):
    import datetime

    start = datetime.datetime(2024, 1, 1)
    bars = [("good", start + datetime.timedelta(hours=k), 1.0, 2.0, 1.0, 1.5, 1.0) for k in range(10)]
    bars += [("negative", t, -1.0, -1.0, -2.0, -1.5, v) for _, t, *_, v in bars[:10]] + [("crossed", t, 1.5, 1.0 if k < 4 else 2.0, 1.5, 1.5, v) for k, (_, t, *_, v) in enumerate(bars[:10])]
    rows = data_quality.report(spark.createDataFrame(bars, "symbol string, time timestamp_ntz, open double, high double, low double, close double, volume double")).collect()
    assert {r.symbol: (round(r.validity, 9), round(r.overall, 9), r.status) for r in rows} == {"good": (100, 100, "OK"), "negative": (0, 70, "WARNING"), "crossed": (60, 88, "WARNING")}


def test_report_query_agrees_on_zeros_and_a_stuck_series(spark, tmp_path):
    import duckdb

    from tidemark import catalog

    start = datetime(2024, 1, 1)
    hours = [k for k in range(60) if k % 24 not in (3, 4)]
    value = {"zeros": lambda k: 0.0 if k % 9 == 0 else 5.0 + k % 4, "below": lambda k: -1.0 - k % 5, "stuck": lambda k: 5.0, "jump": lambda k: 900.0 if k == 25 else 5.0 + k % 3}
    rows = [(n, start + timedelta(hours=k, minutes=n % 50), n, name, v(k), "{}") for n, (name, v, k) in enumerate((name, v, k) for name, v in value.items() for k in hours)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    cur = con.execute(catalog.oracle_sql()["quality_report"])
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    assert sorted(map(tuple, data_quality.q_report(spark, str(tmp_path)).select(*names).collect())) == want and len(want) == 4


def test_partitioned_bars(spark, tmp_path):
    b = bars_of(spark, wave(90))
    landing.write_bars(b, str(tmp_path / "bars"))
    got = landing.read_bars(spark, str(tmp_path / "bars"), "X", "2023-02-01", "2023-03-01")
    assert got.count() == 28 and set(got.columns) == set(b.columns)


def test_landing_twice_adds_nothing(spark):
    raw = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "x string, y int")
    first = landing.land(raw, None, ["x", "y"])
    assert first.count() == 2 and landing.land(raw, first, ["x", "y"]).count() == 0


def test_html_tables(spark):
    page = "<table><tr><th>Day</th><th>Flow</th></tr><tr><td>1 Jan &amp; 2</td><td>(1.5)</td></tr></table>"
    rows = landing.page_tables(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")).orderBy("row").collect()
    assert [r.cells for r in rows] == [["Day", "Flow"], ["1 Jan & 2", "(1.5)"]]


def test_parsers(spark):
    df = spark.createDataFrame([("(1.5)",), ("-",), ("n.a.",), ("2,000.5",)], "s string")
    assert [r[0] for r in df.select(scalars.flow_number(F.col("s"))).collect()] == [-1.5e6, 0.0, None, 2000.5e6]
    t = spark.createDataFrame([("2024-01-02T03:04:05",), ("1704164645",), ("1704164645000",), ("0",), ("2024/01/02",), ("x",)], "s string")
    got = [r[0] for r in t.select(scalars.parse_time(F.col("s"))).collect()]
    assert got[0] == got[1] == got[2] == datetime(2024, 1, 2, 3, 4, 5) and got[3] is None and got[4] == datetime(2024, 1, 2) and got[5] is None
    o = spark.createDataFrame([("BTC-27JUN25-100000-C",), ("BTC-7JUN25-5-P",), ("bad",)], "s string").select(*[c.alias(k) for k, c in scalars.option_parts(F.col("s")).items()]).collect()
    assert o[0] == ("BTC", datetime(2025, 6, 27, 8), 100000.0, "C") and o[1].expiry == datetime(2025, 6, 7, 8) and o[2].underlying is None
    p = spark.createDataFrame([("btc-usdt",), ("ETH/BTC",)], "s string").select(*scalars.split_pair(F.col("s"))).collect()
    assert [tuple(r) for r in p] == [("BTC", "USDT"), ("ETH", "BTC")]
    d = spark.createDataFrame([("1,234.5%",), ("null",), ("0.123456789",)], "s string").select(scalars.to_decimal(F.col("s"), 4)).collect()
    assert [r[0] for r in d] == [Decimal("1234.5000"), None, Decimal("0.1235")]


def test_gap_runs(spark):
    rows = [("X", datetime(2024, 1, 1, h)) for h in (0, 1, 4, 5, 9)]
    got = sorted(map(tuple, data_quality.gaps(spark.createDataFrame(rows, "symbol string, time timestamp_ntz"), ["symbol"], 3600).collect()))
    assert got == [("X", datetime(2024, 1, 1, 2), datetime(2024, 1, 1, 3), 2), ("X", datetime(2024, 1, 1, 6), datetime(2024, 1, 1, 8), 3)]


def test_problems(spark):
    df = spark.createDataFrame([(1.0, 3.0, 0.5, 2.0, -1.0), (1.0, 0.5, 0.7, 2.0, 1.0), (9.0, 3.0, 0.5, 2.0, None)], "open double, high double, low double, close double, volume double")
    assert [len(r[0]) for r in df.select(relational.problems(df.columns)).collect()] == [1, 1, 1]
    assert relational.first_column(df, ["price", "close"]) == "close" and relational.first_column(df, ["x"]) is None
