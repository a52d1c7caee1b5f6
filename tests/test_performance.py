"""The full report, daily snapshots and templates against loops over small inputs."""

from datetime import date, datetime, timedelta

import pytest

from tidemark.plans.alerts import compiled
from tidemark.plans.performance import daily_snapshots, one_payment_rate, report, yearly_returns
from tidemark.plans.templates import TEMPLATES, from_template

BEGIN = datetime(2023, 12, 30)
CURVE = "symbol string, time timestamp, value double, invested double, amount double, fee double, qty double, btc double, avg_cost double"


def curve_of(spark, values, invested):
    rows = []
    for k, (v, i) in enumerate(zip(values, invested, strict=True)):
        paid = i - (invested[k - 1] if k else 0.0)
        rows.append(("a", BEGIN + timedelta(days=k), v, i, paid, 0.0, paid, i, 1.0 if i else 0.0))
    return spark.createDataFrame(rows, CURVE)


def test_report(spark):
    c = curve_of(spark, [0.0, 100.0, 70.0, 110.0, 80.0, 101.0], [0.0, 100.0, 100.0, 100.0, 100.0, 100.0])
    r = report(c).first()
    assert r["max_drawdown"] == pytest.approx(0.3) and r["max_drawdown_days"] == 2 and r["recovery_days"] == [1, None]
    assert [(y["year"], round(y["ret"], 6)) for y in r["yearly"]] == [(2024, 0.01)]  # 2023 begins from nothing, so 2024 is measured against its end
    assert r["best"]["year"] == r["worst"]["year"] == 2024 and r["final_coins"] == 100.0 and r["avg_cost"] == 1.0
    assert 100 * (1 + r["irr"]) ** (4 / 365) == pytest.approx(101.0) and r["calmar"] == pytest.approx(r["irr"] / 0.3)
    assert yearly_returns(c.limit(0)).count() == 0 and report(c.limit(0)).count() == 0


def test_daily_snapshots(spark):
    at = lambda day, hour: datetime(2024, 1, day, hour)
    tx = spark.createDataFrame([(1, at(1, 5), 1, "BUY", 100.0, 10.0, 1.0), (1, at(3, 5), 2, "SELL", 60.0, 12.0, 0.0), (1, at(3, 6), 3, "BUY", 12.0, 12.0, 0.0), (2, at(4, 1), 4, "SELL", 5.0, 12.0, 0.0)],
                               "user_id long, time timestamp, event_id long, side string, amount double, price double, fee double")
    prices = spark.createDataFrame([(date(2024, 1, 1), 10.0), (date(2024, 1, 3), 12.0), (date(2024, 1, 5), 6.0)], "day date, price double")
    rows = {(r["user_id"], r["day"].day): r for r in daily_snapshots(tx, prices).collect()}
    assert sorted(rows) == [(1, d) for d in range(1, 6)] + [(2, 4), (2, 5)]
    one = [rows[1, d] for d in range(1, 6)]
    assert [r["value"] for r in one] == [100.0, 100.0, 72.0, 72.0, 36.0] and [r["invested"] for r in one] == [101.0, 101.0, 53.0, 53.0, 53.0]
    assert [r["daily_return"] for r in one] == pytest.approx([None, 0.0, -0.28, 0.0, -0.5])
    assert [r["drawdown"] for r in one] == pytest.approx([0.0, 0.0, 0.28, 0.28, 0.64]) and one[4]["max_drawdown"] == pytest.approx(0.64)
    assert one[0]["volatility_30d"] is None and one[2]["volatility_30d"] == pytest.approx(0.28 / 2**0.5 * 365**0.5)
    assert one[0]["annualized_return"] is None and one[1]["annualized_return"] == pytest.approx((100 / 101) ** 365 - 1) and one[4]["annualized_return"] is None
    assert rows[2, 5]["value"] == 0.0 and rows[2, 5]["cumulative_return"] is None and rows[2, 5]["invested"] == 0.0
    assert daily_snapshots(tx.limit(0), prices).count() == 0


def test_rate_of_one_payment(spark):
    df = spark.createDataFrame([(110.0, 100.0, 365), (100.0, 100.0, 0), (0.0, 100.0, 9), (100.0, 0.0, 9), (1e6, 1.0, 30), (121.0, 100.0, 730)], "v double, p double, d int")
    assert [r[0] for r in df.select(one_payment_rate(df.v, df.p, df.d)).collect()] == pytest.approx([0.1, None, None, None, None, 0.1])


def test_templates(spark):
    assert len(TEMPLATES) == 12
    tree = from_template("leverage_risk", value=0.1)
    assert tree["children"][0]["value"] == 0.1 and TEMPLATES["leverage_risk"][1]["children"][0]["value"] == 0.0005
    assert from_template("cycle_change", engine="risk_level")["metric"] == "risk_level"
    with pytest.raises(ValueError):
        from_template("price_below", metric="mvrv")
    df = spark.createDataFrame([("a", 1, 80.0), ("a", 2, None)], "symbol string, time int, price double")
    assert [r[0] for r in df.select(compiled(from_template("price_below", value=90))).collect()] == [True, None]
