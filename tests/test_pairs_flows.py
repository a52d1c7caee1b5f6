"""Pairs of every writing, flows over ranges, and books."""

from datetime import date

from pyspark.sql import functions as F

from tidemark.functions.pairs import IN_DOLLARS, compact, dashed, kraken, normalized
from tidemark.operators.flows import book, cumulative_flow


def test_pairs(spark):
    told = {"BTCUSDT": "BTC/USDT", "btc-usdt": "BTC/USDT", "BTC/USDT": "BTC/USDT", "XBTUSD": "BTC/USD", "XXBTZUSD": "BTC/USD", "XETHZEUR": "ETH/EUR", "BTC-USDT-SWAP": "BTC/USDT", "XBT/EUR": "BTC/EUR", "BTC/": None, "BTCUS": None, "": None, "/-/": None, None: None}
    df = spark.createDataFrame([(k,) for k in told], "s string")
    assert [r[0] for r in df.select(normalized(F.col("s"))).collect()] == list(told.values())
    s = F.lit("XXBTZUSD")
    assert spark.range(1).select(compact(s), dashed(s, swap=True), dashed(F.lit("ETHUSDC"), IN_DOLLARS), kraken(F.lit("btc/usd")), kraken(F.lit("btc/usd"), True)).first()[:] == ("BTCUSD", "BTC-USD-SWAP", "ETH-USD", "XBTUSD", "XXBTZUSD")


def test_flows_over_a_range(spark):
    rows = [("a", date(2024, 1, d), float(d)) for d in (1, 2, 3, 3, 5, 9)] + [("b", date(2024, 1, 4), 1.0), ("c", date(2024, 1, 1), 7.0), ("a", None, 100.0)]
    df = spark.createDataFrame(rows, "k string, day date, flow double")
    out = sorted(map(tuple, cumulative_flow(df, "2024-01-03", "2024-01-05", by=("k",)).select("k", "day", "flow", "cumulative", "baseline").collect()))
    assert out == [("a", date(2024, 1, 3), 6.0, 9.0, 3.0), ("a", date(2024, 1, 5), 5.0, 14.0, 3.0), ("b", date(2024, 1, 4), 1.0, 1.0, 0.0)]
    assert cumulative_flow(df.limit(0), "2024-01-03", "2024-01-05").count() == 0


def test_books(spark):
    level = "array<struct<price double, quantity double>>".replace("price double", "price: double").replace("quantity double", "quantity: double")
    df = spark.createDataFrame([([(2.0, 1.0)] * 25, [(1.0, 10.0), (None, 5.0)]), (None, []), ([(1.0, 4.0)], None)], f"bids {level}, asks {level}")
    rows = [tuple(r) for r in df.select(*[c.alias(n) for n, c in book(F.col("bids"), F.col("asks")).items()]).collect()]
    assert rows == [(40.0, 10.0, 50.0, 0.6), (0.0, 0.0, 0.0, None), (4.0, 0.0, 4.0, 1.0)]
