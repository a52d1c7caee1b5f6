"""Values some time ago, against a loop over all rows."""

import random
from datetime import datetime, timedelta

from tidemark.operators.lags import changes, values_before

BEGIN = datetime(2024, 1, 1)


def loop(rows, seconds):
    out = []
    for key, at, _, tag in rows:
        known = [(t, v) for k, t, v, _ in rows if k == key and v is not None and t is not None and at is not None and t <= at - timedelta(seconds=seconds)]
        out.append((tag, max(known)[1] if known else None))
    return sorted(out)


def test_against_a_loop(spark):
    draw = random.Random(5)
    rows = []
    for tag in range(400):
        # One key has most rows; times tie, have gaps longer than the longest distance, and lie before 1970 too.
        at = BEGIN + timedelta(seconds=draw.choice([0, 0, -60 * 365 * 86_400, 90_000_000]) + draw.randrange(200) * 600)
        rows.append((draw.choice(["hot"] * 5 + ["cold", None]), at if draw.random() > 0.02 else None, draw.choice([None, *map(float, range(6))]), tag))
    df = spark.createDataFrame(rows, "k string, t timestamp, _v double, tag int").repartition(7)
    seconds = {"minute": 60.0, "hours": 7200.0, "none": 0.0}
    found = values_before(df, "_v", seconds, ("k",), "t").collect()
    assert len(found) == len(rows) and found[0].asDict().keys() == {"k", "t", "_v", "tag", *seconds}
    for name, s in seconds.items():
        assert sorted((r["tag"], r[name]) for r in found) == loop(rows, s), name


def test_changes_of_no_rows_and_of_nothing(spark):
    none = spark.createDataFrame([], "symbol string, time timestamp, close double")
    assert changes(none, "close").collect() == []
    rows = [("a", BEGIN + timedelta(hours=h), float(h)) for h in (0, 1, 2, 3)]
    c = changes(spark.createDataFrame(rows, none.schema), "close", {"1h": 1, "half": 0.5}).orderBy("time").collect()
    assert [r["change_1h"] for r in c] == [None, None, 100.0, 50.0]
    assert [r["change_half"] for r in c] == [None, None, 100.0, 50.0]
