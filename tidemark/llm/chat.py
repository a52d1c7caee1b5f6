"""Repair the roles of conversations at minimum cost, and render them.

A legal conversation is an optional system turn, then user and assistant turns in alternation, ending with the assistant (or it
is empty). Dynamic programming over that automaton's states finds the cheapest way to keep each turn, relabel it, merge it into
the turn before, or insert an empty turn before it (or at the end). Of equally cheap repairs the first in the order of the
moves' list is taken, so the result depends on the turns alone.

Conversations of any length are handled in bounded tasks: rows are range-partitioned and sorted by (conversation, turn) and cut
into segments of SEGMENT rows. A segment's effect is a matrix of costs from state to state; for the few conversations that
span segments these matrices are combined first, which fixes the states at the cuts, and then each segment is repaired alone.
The repair sees roles only; texts are joined back by segment and place.

A repaired conversation is rendered as <|role|>, a line break and the text, turn after turn on lines of their own. Each row holds its
piece of that sequence and where it starts there, so a sequence of any length is whole without being one string; render() joins the
pieces of those that fit one. What looks like a marker in a text gets a backslash (<| becomes <\\|, <\\| becomes <\\\\|), so that no text
can begin a turn; unescaped() takes it out again.

Nulls and repeats: null or unknown roles are relabelled, a null text is empty, null turns come first, and rows with a null
conversation id are one conversation. Conversation ids are of any type that text can stand for (numbers, strings, dates), turns of any type
that has an order. Rows of one turn number are turns of their own, in the order of role and a hash of the text. An empty
table gives an empty result. Only the named columns are read, so others may clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import materialize, read

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)  # states: what stands last
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ENDS = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}  # empty turns that make an ending legal
MERGE, INSERT, RELABEL = 1.0, 2.0, 3.0
SEGMENT = 4096
MARK = 6  # characters of a piece besides role and text: a line break, <|, |> and a line break


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def moves(role: int | None) -> list[tuple[int, int, float, str, tuple[int, ...]]]:
    """For a turn of a role (a state number, or None): from state, to state, cost, action, empty turns put before it."""
    found = []
    for state in range(4):
        for as_ in (SYSTEM, USER, ASSISTANT):
            cost, action = (0.0, "keep") if as_ == role else (RELABEL, "relabel")
            if as_ in NEXT[state]:
                found.append((state, as_, cost, action, ()))
            if as_ == state:
                found.append((state, as_, cost + MERGE, "merge", ()))
            for extra in NEXT[state]:
                if as_ in NEXT[extra] and as_ not in NEXT[state]:
                    found.append((state, as_, cost + INSERT, action, (extra,)))
    return found


MOVES = {role: moves(role) for role in (None, SYSTEM, USER, ASSISTANT)}
_NUMBER = {r: k + 1 for k, r in enumerate(ROLES)}


def _matrices() -> dict:
    out = {}
    for role, own in MOVES.items():
        m = np.full((4, 4), np.inf)
        for a, b, cost, *_ in own:
            m[a, b] = min(m[a, b], cost)
        out[role] = m
    return out


MATRICES = _matrices()


def effect(roles: list) -> np.ndarray:
    """Least cost from each state to each over a run of turns."""
    total = np.where(np.eye(4) > 0, 0.0, np.inf)
    for role in roles:
        total = (total[:, :, None] + MATRICES[role][None]).min(axis=1)
    return total


def end_cost(state: int) -> float:
    return INSERT * len(ENDS[state])


def repair(roles: list, entry: int = START, leave: int | None = None) -> tuple[list[tuple], int]:
    """The moves for a run of turns from state `entry` to `leave` (None: a legal ending), and the last state."""
    cost = [np.inf] * 4
    cost[entry] = 0.0
    back: list[list] = []
    for role in roles:
        new, how = [np.inf] * 4, [None] * 4
        for move in MOVES[role]:
            c = cost[move[0]] + move[2]
            if c < new[move[1]]:
                new[move[1]], how[move[1]] = c, move
        back.append(how)
        cost = new
    last = leave if leave is not None else min(range(4), key=lambda s: cost[s] + end_cost(s))
    path, state = [], last
    for how in reversed(back):
        path.append(how[state])
        state = how[state][0]
    return path[::-1], last


def _slices(ids: np.ndarray):
    """(start, end) of each run of equal ids."""
    cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
    return list(zip(cuts, cuts[1:], strict=False)) if len(ids) else []


def segmented(turns: DataFrame) -> DataFrame:
    """turns sorted, with seg (the segment) and pos (the place in it). Written down at once, as they follow from the sorted partitions."""
    order = ["conv_id", "turn", "role", "h"]
    sorted_ = turns.withColumn("h", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order).drop("h")
    at = sorted_.withColumn("_at", F.monotonically_increasing_id())  # the partition above 33 bits of the row in it
    row = F.col("_at").bitwiseAND((1 << 33) - 1)
    seg = F.shiftleft(F.shiftright("_at", 33), 32) + F.floor(row / SEGMENT)
    return materialize(at.withColumn("seg", seg).withColumn("pos", row % SEGMENT).drop("_at"), "turns")


def edge_effects(rows: DataFrame) -> DataFrame:
    """Per segment, of its first and its last conversation: conv_id, seg, costs (16)."""

    def run(frame):
        import pandas as pd

        frame = frame.sort_values("pos")
        runs = _slices(frame.conv_id.to_numpy())
        out = []
        for a, b in dict.fromkeys((runs[0], runs[-1])):
            roles = [_NUMBER.get(r) for r in frame.role.iloc[a:b]]
            out.append((frame.conv_id.iloc[a], frame.seg.iloc[0], effect(roles).ravel().tolist()))
        return pd.DataFrame(out, columns=["conv_id", "seg", "costs"])

    return rows.select("conv_id", "role", "seg", "pos").groupBy("seg").applyInPandas(run, "conv_id string, seg long, costs array<double>")


def cuts(effects: DataFrame) -> DataFrame:
    """Of conversations over several segments: conv_id, seg, entry and leave states (leave null: the last segment)."""

    def run(frame):
        import pandas as pd

        frame = frame.sort_values("seg")
        cost = np.array([0.0, np.inf, np.inf, np.inf])
        back = []
        for costs in frame.costs:
            step = cost[:, None] + np.array(costs).reshape(4, 4)
            back.append(step.argmin(axis=0))
            cost = step.min(axis=0)
        state = min(range(4), key=lambda s: cost[s] + end_cost(s))
        leave: list = [None]
        entry = [int(back[-1][state])]
        for how in reversed(back[:-1]):
            leave.append(entry[-1])
            entry.append(int(how[entry[-1]]))
        return pd.DataFrame({"conv_id": frame.conv_id, "seg": frame.seg, "entry": entry[::-1], "leave": pd.array(leave[::-1], dtype="Int64")})

    several = effects.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select("conv_id")
    return effects.join(several, "conv_id").groupBy("conv_id").applyInPandas(run, "conv_id string, seg long, entry long, leave long")


def repair_turns(conversations: DataFrame) -> DataFrame:
    """Per turn after the repair: conv_id, seq (its order), turn (null if inserted), role, source_role, action, text, cost, rendered, start.

    action is keep, relabel, merge or insert; a merged row continues the turn before it. rendered is the row's piece of the rendered
    conversation, start the number of characters before it.
    """
    types = {f.name: f.dataType for f in conversations.schema.fields}
    turn = F.col("turn").cast("long") if isinstance(types["turn"], IntegralType) else F.col("turn")
    key = F.when(F.col("conv_id").isNotNull(), F.concat(F.lit("="), F.col("conv_id").cast("string"))).otherwise("")
    turns = conversations.select(key.alias("conv_id"), turn.alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = segmented(turns)
    found = materialize(cuts(edge_effects(rows)), "turn-cuts")

    def run(frame):
        import pandas as pd

        frame = frame.sort_values("pos")
        out = []
        for a, b in _slices(frame.conv_id.to_numpy()):
            part = frame.iloc[a:b]
            entry, leave = part.entry.iloc[0], part.leave.iloc[0]
            spans = not pd.isna(entry)
            path, last = repair([_NUMBER.get(r) for r in part.role], int(entry) if spans else START, int(leave) if spans and not pd.isna(leave) else None)
            conv, seg, at = part.conv_id.iloc[0], int(part.seg.iloc[0]), 0
            begins = not spans or int(entry) == START
            start = 0

            def put(pos, at, role, action, size):
                nonlocal start, begins
                piece = size + 1 if action == "merge" else size + MARK + len(role) - begins
                out.append((conv, seg, pos, at, role, action, begins, start, piece))
                start, begins = start + piece, False

            for (_, state, _, action, extra), pos, size in zip(path, part.pos.tolist(), part["size"].tolist(), strict=True):
                at = 4 * int(pos)
                for k, e in enumerate(extra):
                    put(None, at + k, ROLES[e - 1], "insert", 0)
                put(pos, at + 1, ROLES[state - 1], action, size)
            if not spans or pd.isna(leave):
                for k, e in enumerate(ENDS[last]):
                    put(None, at + 2 + k, ROLES[e - 1], "insert", 0)
        return pd.DataFrame(out, columns=["conv_id", "seg", "pos", "at", "role", "action", "begins", "start", "piece"]).astype({"pos": "Int64"})

    told = rows.select("conv_id", "seg", "pos", "role", F.length(escaped(F.col("text"))).alias("size")).join(found, ["conv_id", "seg"], "left")
    fixed = materialize(told.groupBy("seg").applyInPandas(run, "conv_id string, seg long, pos long, at long, role string, action string, begins boolean, start long, piece long"), "turn-moves")
    # Of conversations over several segments, the characters before each segment: one row per segment.
    sizes = fixed.join(found.select("conv_id", "seg"), ["conv_id", "seg"]).groupBy("conv_id", "seg").agg(F.sum("piece").alias("_n"))
    before = sizes.select("conv_id", "seg", F.sum("_n").over(Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    placed = fixed.join(before, ["conv_id", "seg"], "left").withColumn("start", F.col("start") + F.coalesce("_before", F.lit(0)))
    seq = (F.shiftleft(F.shiftright("seg", 32), 22) + F.col("seg").bitwiseAND(0x3FFFFF)) * (8 * SEGMENT) + F.col("at")
    source = rows.select("seg", "pos", "turn", F.col("role").alias("source_role"), "text")
    known = placed.join(source, ["seg", "pos"], "left").select("conv_id", seq.alias("seq"), "turn", "role", "source_role", "action", F.coalesce("text", F.lit("")).alias("text"), "begins", "start")
    relabelled = (F.col("action") != "insert") & ~F.col("source_role").eqNullSafe(F.col("role"))
    cost = F.when(F.col("action") == "insert", INSERT).otherwise(0.0) + F.when(F.col("action") == "merge", MERGE).otherwise(0.0) + F.when(relabelled, RELABEL).otherwise(0.0)
    text = escaped(F.col("text"))
    rendered = F.when(F.col("action") == "merge", F.concat(F.lit("\n"), text)).otherwise(F.concat(F.when(F.col("begins"), "<|").otherwise("\n<|"), "role", F.lit("|>\n"), text))
    conv_id = F.when(F.col("conv_id") != "", F.substr("conv_id", F.lit(2))).cast(types["conv_id"])
    return known.select(conv_id.alias("conv_id"), "seq", "turn", "role", "source_role", "action", "text", cost.alias("cost"), rendered.alias("rendered"), "start")


def render(repaired: DataFrame) -> DataFrame:
    """Per conversation: conv_id, n_turns, cost, rendered (its pieces joined; a conversation must fit one string)."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "rendered")))
    return repaired.groupBy("conv_id").agg(
        F.sum(F.when(F.col("action") != "merge", 1).otherwise(0)).alias("n_turns"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(parts, lambda p: p["rendered"]), "").alias("rendered"))


def op2_chat_repair(spark, sf_dir: str) -> DataFrame:
    return repair_turns(read(spark, sf_dir, "conversations"))


QUERIES = {"op2_chat_repair": op2_chat_repair}
ORACLES = {}
