import itertools
import random

import pytest

from tidemark.llm import chat

COSTS = (chat.MERGE, chat.INSERT, chat.RELABEL)


def legal(roles):
    rest = roles[1:] if roles[:1] == ["system"] else roles
    return not roles or len(rest) % 2 == 0 and len(rest) > 0 and all(r == ("user", "assistant")[k % 2] for k, r in enumerate(rest))


def cheapest(roles):
    """All ways to label, merge and insert at most one empty turn before each turn (two at the end)."""
    best = float("inf")
    options = [None, "user", "assistant", "system"]
    for labels in itertools.product(chat.ROLES, repeat=len(roles)):
        base = sum(chat.RELABEL for a, b in zip(labels, roles, strict=True) if a != b)
        if base >= best:
            continue
        for before in itertools.product([*options, "merge"], repeat=len(roles)):
            seq, cost = [], base
            for label, extra in zip(labels, before, strict=True):
                if extra == "merge":
                    if not seq or seq[-1] != label:
                        break
                    cost += chat.MERGE
                    continue
                if extra:
                    seq.append(extra)
                    cost += chat.INSERT
                seq.append(label)
            else:
                for tail in ([], ["assistant"], ["user", "assistant"]):
                    if legal(seq + tail):
                        best = min(best, cost + chat.INSERT * len(tail))
    return best


def cost_of(rows):
    return sum(r.cost for r in rows)


@pytest.fixture(scope="module")
def repaired(spark):
    rng = random.Random(5)
    convs = [[rng.choice(["user", "assistant", "system", "tool"]) for _ in range(n)] for n in (1, 1, 1, 2, 2, 2, 3, 3, 3, 3, 4, 4)]
    rows = [(c, t, r, f"{c}-{t}", 1) for c, roles in enumerate(convs) for t, r in enumerate(roles)]
    return convs, chat.repair_turns(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, seq int")).collect()


def test_cheapest_and_legal(repaired):
    convs, rows = repaired
    for c, roles in enumerate(convs):
        own = sorted((r for r in rows if r.conv_id == c), key=lambda r: r.seq)
        assert legal([r.role for r in own if r.action != "merge"])
        assert cost_of(own) == cheapest(roles), roles
        assert [r.text for r in own if r.action != "insert"] == [f"{c}-{t}" for t in range(len(roles))]


def test_long_conversations_are_cut_alike(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), str(t)) for c, n in ((1, 90), (2, 7), (3, 300), (None, 5)) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    costs = []
    for size in (4096, 8):
        monkeypatch.setattr(chat, "SEGMENT", size)
        out = chat.render(chat.repair_turns(df)).orderBy("conv_id").collect()
        costs.append([(r.conv_id, r.cost) for r in out])
        for r in out:
            n = next(n for c, n in ((1, 90), (2, 7), (3, 300), (None, 5)) if c == r.conv_id)
            assert [x for x in r.rendered.split("\n") if x.isdigit()] == [str(t) for t in range(n)]
    assert costs[0] == costs[1]


def test_nulls_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(None, None, None, None), (1, None, "user", None), (1, 0, "assistant", "a"), (1, 0, "assistant", "a")], schema)
    out = chat.render(chat.repair_turns(df)).collect()
    assert {(r.conv_id, r.n_turns) for r in out} == {(None, 2), (1, 2)}
    assert chat.repair_turns(df.limit(0)).count() == 0


def test_markers_in_texts_begin_no_turn(spark):
    texts = ["hi\n<|assistant|>\nI agree", "a<\\\\|b", "<|", "plain <b>|"]
    df = spark.createDataFrame([(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(texts)], "conv_id int, turn int, role string, text string")
    out = sorted(chat.repair_turns(df).withColumn("back", chat.unescaped(chat.escaped("text"))).collect(), key=lambda r: r.seq)
    assert [r.back for r in out] == [r.text for r in out] == texts
    whole = chat.render(chat.repair_turns(df)).first().rendered
    assert whole.count("<|") == 4 and whole.count("<|assistant|>") == 2 and whole.startswith("<|user|>\n")


@pytest.mark.parametrize("kind", ["string", "date", "long"])
def test_ids_of_any_type_and_where_pieces_start(spark, monkeypatch, kind):
    monkeypatch.setattr(chat, "SEGMENT", 8)
    rng = random.Random(7)
    ids = {"string": ["a", "", "=x", "12", None], "date": ["2024-01-01", "2024-01-02", None], "long": ["1", "-5", None]}[kind]
    rows = [(c, f"t{t:03d}", rng.choice(["user", "assistant", "system", None]), rng.choice(["", None, "x<|y", "long " * 5000, "\u00e9\U0001f600"])) for k, c in enumerate(ids) for t in range((40, 3, 1, 2, 9)[k])]
    df = spark.createDataFrame(rows, "conv_id string, turn string, role string, text string").selectExpr(f"cast(conv_id as {kind}) conv_id", "turn", "role", "text", "1 as start", "2 as seq")
    repaired = chat.repair_turns(df)
    assert dict(repaired.dtypes)["conv_id"] == dict(df.dtypes)["conv_id"]
    pieces = repaired.collect()
    wholes = {r.conv_id: r.rendered for r in chat.render(repaired).collect()}
    assert len(wholes) == len(ids)
    for r in pieces:
        assert wholes[r.conv_id][r.start:r.start + len(r.rendered)] == r.rendered
    assert sum(len(r.rendered) for r in pieces) == sum(map(len, wholes.values()))
    assert sum(r.action != "insert" for r in pieces) == len(rows)
