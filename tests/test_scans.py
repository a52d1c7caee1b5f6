"""Scans of composed maps against plain loops."""

import math
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import scans
from tidemark.plans import recursive

from . import loops

DAY0 = datetime(2020, 1, 1)


def walk(n, seed, gaps=True):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    if gaps:
        close[rng.random(n) < 0.05] = np.nan
    return close * 1.01, close * 0.99, close


def frame(spark, series):
    f = lambda x: None if np.isnan(x) else float(x)
    rows = [(s, DAY0 + timedelta(days=k), *map(f, x)) for s, (h, lo, c) in series.items() for k, x in enumerate(zip(h, lo, c, strict=True))]
    return spark.createDataFrame(rows, "symbol string, time timestamp_ntz, high double, low double, close double")


def near(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g is None) == (not np.isfinite(w)), (g, w)
        assert g is None or math.isclose(g, w, rel_tol=1e-9, abs_tol=1e-9), (g, w)


def test_numbers_and_lags(spark):
    df = frame(spark, {"A": walk(900, 1), None: walk(40, 2), "B": walk(1, 3)})
    for bucket in ("year", "week", "day"):
        rows = scans.numbered(df, bucket=bucket, lags=("close",)).orderBy("symbol", "time").collect()
        assert len(rows) == 941
        for a, b in zip([None, *rows], rows, strict=False):
            same = a is not None and a.symbol == b.symbol
            assert b["_rn"] == (a["_rn"] + 1 if same else 0) and b["_lag_close"] == (a.close if same else None)


@pytest.mark.parametrize("rows", [3, 50, 8192])
def test_indicators_equal_the_loops(spark, rows):
    series = {"A": walk(400, 1), "B": walk(300, 2, gaps=False), "C": walk(20, 3), "D": (np.full(80, 5.0),) * 3}
    got = {}
    for r in recursive.recursive_frame(frame(spark, series), rows=rows).orderBy("time").collect():
        got.setdefault(r.symbol, []).append(r)
    for s, x in series.items():
        want = loops.all_of(*x)
        for c in recursive.COLUMNS:
            near([r[c] for r in got[s]], want[c])


def test_rsi_keeps_six_digits(spark, tmp_path):
    rng = np.random.default_rng(9)
    prices = {"A": rng.uniform(900, 500_000, 1300).round(2), "B": np.concatenate([rng.uniform(1, 9, 30), np.full(600, 5.0)]), "C": rng.uniform(1, 9, 9)}
    rows = [(n, p, s, DAY0 + timedelta(days=k)) for n, (s, k, p) in enumerate((s, k, float(p)) for s, x in prices.items() for k, p in enumerate(x))]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, o_orderpriority string, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    sql = {r[:2]: r[2] for r in con.execute(catalog.oracle_sql()["indicator_tech_rsi"]).fetchall()}
    got = {}
    for r in catalog.queries()["indicator_tech_rsi"](spark, str(tmp_path)).orderBy("time").collect():
        assert r.value == sql.pop((r.symbol, r.time))
        got.setdefault(r.symbol, []).append(r.value)
    assert not sql
    for s, x in prices.items():
        want = loops.all_of(x, x, x)["rsi14"]
        assert len(got[s]) == len(want)
        assert all((g is None and np.isnan(w)) or abs(g - w) <= 0.51e-6 for g, w in zip(got[s], want, strict=True))


@pytest.mark.parametrize(("span", "rows"), [(1, 8192), (2, 40), (2000, 7), (5000, 8192)])
def test_fast_and_slow_smoothing(spark, span, rows):
    """Fast ones are cut early so that no weight overflows; slow ones carry over very many stretches."""
    h, lo, c = walk(1500, span)
    t = scans.numbered(frame(spark, {"A": (h, lo, c)}))
    got = scans.smoothed(t, {"e": ("close", 2 / (span + 1), 1, 1), "w": ("close", 1 / span, span, span)}, rows=rows).orderBy("time").collect()
    near([r.e for r in got], loops.smooth(c, 2 / (span + 1), 1))
    near([r.w for r in got], loops.smooth(c, 1 / span, span))


def test_affine_with_any_fades(spark):
    rng = np.random.default_rng(4)
    fades = np.where(rng.random(3000) < 0.02, 900.0, rng.exponential(0.5, 3000))
    adds = rng.normal(1, 1, 3000)
    want, y = [], 0.0
    for f, b in zip(fades, adds, strict=True):
        y = y * math.exp(-f) + b
        want.append(y)
    df = spark.createDataFrame([("k", i, float(f), float(b)) for i, (f, b) in enumerate(zip(fades, adds, strict=True))], "k string, i int, f double, b double")
    total = F.sum("f").over(scans.Window.partitionBy("k").orderBy("i"))
    got = scans.affine(df.withColumn("s", F.floor(total / scans.LIMIT)), {"y": (F.col("f"), F.col("b"))}, ("k",), "s", ("i",)).orderBy("i").collect()
    near([r.y for r in got], want)


def test_no_python_in_the_plan(spark):
    plan = recursive.recursive_frame(frame(spark, {"A": walk(10, 1)}))._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Python" not in plan
    assert recursive.recursive_frame(frame(spark, {"A": walk(10, 1)}).limit(0)).count() == 0
