"""Investment rules: unknown values, order, conflicts and every action."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans.rules import KINDS, columns_of, condition, decided, rule_multiplier

NAMES = lambda name: columns_of({"price": "price", "risk_level": "risk", "indicators.mvrv": "mvrv", "date": "day"})(name)
RULE = lambda id_, priority, if_, op, **args: {"id": id_, "priority": priority, "if": if_, "then": {"op": op, **args}}
ALWAYS = {"op": "price_above", "value": 0}


@pytest.fixture(scope="module")
def days(spark):
    rows = [("2024-01-01", 100.0, "HIGH", 0.5), ("2024-01-02", None, None, None), ("2024-02-01", 50.0, "LOW", float("nan"))]
    return spark.createDataFrame(rows, "day string, price double, risk string, mvrv double").withColumn("day", F.to_timestamp("day"))


def of(df, column):
    return [r[0] for r in df.orderBy("day").select(column).collect()]


def test_unknown_values_make_conditions_unknown(days):
    low, high = {"op": "indicator_value", "code": "mvrv", "lt": 1}, {"op": "risk_level", "gte": "HIGH"}
    cases = {
        "low": (low, [True, None, None]), "high": (high, [True, None, False]), "both": ({"all": [low, high]}, [True, None, False]), "either": ({"any": [low, {"not": high}]}, [True, None, True]),
        "absent": ({"op": "cycle_stage", "in": ["BEAR"]}, [None, None, None]), "none": ({"all": []}, [True, True, True]), "first": ({"op": "day_of_month", "eq": 1}, [True, False, True]),
        "monday": ({"op": "day_of_week", "eq": 1}, [True, False, False]), "january": ({"op": "date_range", "to": "2024-01-31"}, [True, True, False]), "named": ({"op": "risk_level", "in": ["LOW"]}, [False, None, True]),
        "average": ({"op": "price_vs_ma"}, [None, None, None]), "no_bound": ({"op": "indicator_value", "code": "mvrv"}, [True, None, None])}
    told = days.select("day", *[condition(spec, NAMES).alias(n) for n, (spec, _) in cases.items()])
    for n, (_, wanted) in cases.items():
        assert of(told, n) == wanted, n


def test_what_cannot_be_read_is_an_error(days):
    deep = {"not": {"not": {"not": ALWAYS}}}
    for wrong in (deep, {"op": "nothing"}, {"not": [ALWAYS, ALWAYS]}):
        with pytest.raises(ValueError):
            condition(wrong, NAMES)
    with pytest.raises(ValueError):
        decided(days, [RULE("a", 1, ALWAYS, "sell")], 100.0, NAMES)
    assert len(KINDS) == 15


def test_every_action_and_their_order(days):
    rules = [
        RULE("double", 20, ALWAYS, "multiply_amount", factor=2), RULE("half", 10, {"op": "price_below", "value": 60}, "multiply_amount", factor=0.5), RULE("more", 30, ALWAYS, "extra_buy", value=7),
        RULE("yet_more", 30, ALWAYS, "extra_buy", value=3), RULE("short", 40, ALWAYS, "pause", days=3), RULE("long", 50, {"op": "price_above", "value": 90}, "pause", days=9), RULE("say", 60, ALWAYS, "notify_only", message="hm")]
    d = decided(days, rules, 100.0, NAMES)
    assert of(d, "amount") == [210.0, 100.0, 110.0]
    assert of(d, "pause_days") == [9, None, 3]
    assert of(d, "triggered") == [["double", "more", "yet_more", "short", "long", "say"], [], ["half", "double", "more", "yet_more", "short", "say"]]
    assert of(d, "unknown")[1] == ["half", "double", "more", "yet_more", "short", "long", "say"]
    assert of(d, "messages")[2] == ["pause 3", "hm"]
    assert of(decided(days, [*rules, RULE("stop", 1, ALWAYS, "skip")], 100.0, NAMES), "amount") == [0.0, 100.0, 0.0]
    assert of(decided(days, [{**RULE("stop", 1, ALWAYS, "skip"), "enabled": False}], 100.0, NAMES), "amount") == [100.0] * 3
    assert of(decided(days, [], 100.0, NAMES), "triggered") == [[], [], []]


def test_fixed_amounts_and_multipliers_of_one_priority(days):
    fix, times = RULE("fix", 10, {"op": "price_above", "value": 90}, "fixed_amount", value=40), RULE("times", 10, ALWAYS, "multiply_amount", factor=3)
    d = decided(days, [fix, times], 100.0, NAMES)
    assert of(d, "amount") == [40.0, 100.0, 300.0] and of(d, "multiplier") == [1.0, 1.0, 3.0] and of(d, "conflict") == [True, False, False]
    d = decided(days, [times, fix], 100.0, NAMES)
    assert of(d, "amount") == [40.0, 100.0, 300.0] and of(d, "multiplier") == [3.0, 1.0, 3.0] and of(d, "conflict") == [True, False, False]
    d = decided(days, [fix, RULE("later", 20, ALWAYS, "multiply_amount", factor=3), RULE("last", 30, ALWAYS, "fixed_amount", value=5)], 100.0, NAMES)
    assert of(d, "amount") == [5.0, 100.0, 5.0] and of(d, "conflict") == [False, False, False] and of(d, "multiplier") == [3.0, 1.0, 3.0]


def test_multiplier_of_a_backtest(days):
    rules = [RULE("fix", 10, {"op": "price_above", "value": 90}, "fixed_amount", value=40), RULE("times", 20, ALWAYS, "multiply_amount", factor=3), RULE("more", 30, ALWAYS, "extra_buy", value=9)]
    assert of(rule_multiplier(days, rules, 200.0, NAMES), "rule_multiplier") == [0.2, 1.0, 3.0]
    assert of(rule_multiplier(days, rules, 0.0, NAMES), "rule_multiplier") == [1.0, 1.0, 3.0]
