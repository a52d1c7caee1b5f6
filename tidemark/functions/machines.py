"""State machines over ordered rows, as composed maps from memory to memory.

What a stretch of rows does to a machine is a map: the memory before it to the memory after it. Maps compose, so they are made
per stretch, composed per FAN stretches, walked once per key over those few, and handed down again; then every stretch is
replayed from the memory that it begins with. No task folds a whole key. A machine says how a map is made of rows, composed,
applied and replayed:

- Table: finitely many memories and inputs; a map is an array.
- Gate: candidates of which one passes at a time, then none for `cooldown` and none of its own run. A memory is the last one
  passed; as stretches last at least `cooldown`, a map need only tell entries apart in the stretch's first `cooldown`.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 1024


class Table:
    """table[input, memory] -> memory; begins at `start`. A negative input changes nothing."""

    def __init__(self, table: np.ndarray, start: int):
        self.table, self.start = table, start

    def map_of(self, rows: np.ndarray):
        memory, place = np.arange(self.table.shape[1]), np.arange(self.table.shape[1])
        for k, x in enumerate(rows[:, 0].tolist()):
            if x >= 0:
                memory = self.table[x][memory]
            if k % 16 == 15 and len(memory) > 1:  # memories that have met stay together
                memory, at = np.unique(memory, return_inverse=True)
                place = at[place]
        return memory[place].astype(np.int32)

    def compose(self, first, second):
        return second[first]

    def apply(self, map_, memory):
        return int(map_[memory])

    def replay(self, rows: np.ndarray, memory: int) -> np.ndarray:
        table, out = self.table, np.empty(len(rows), np.int64)
        for k, x in enumerate(rows[:, 0].tolist()):
            if x >= 0:
                memory = int(table[x, memory])
            out[k] = memory
        return out


class Gate:
    """Rows are (time, run), both rising; a memory is the (time, run) of the last row that passed. Replayed to 1 (passes) or 0."""

    def __init__(self, cooldown: int):
        self.cooldown, self.start = cooldown, None

    def _next(self, at, run, time, of):
        """The first row that may pass after one of this time and run."""
        return np.maximum(np.searchsorted(at, np.asarray(time) + self.cooldown), np.searchsorted(run, of, side="right"))

    def map_of(self, rows: np.ndarray):
        at, run = rows[:, 0], rows[:, 1]
        n, after = len(rows), self._next(at, run, at, run).tolist()
        last = list(range(n))
        for k in range(n - 1, -1, -1):
            if after[k] < n:
                last[k] = last[after[k]]
        outcome = lambda e: (int(at[last[e]]), int(run[last[e]])) if e < n else None
        zone = int(np.searchsorted(at, at[0] + self.cooldown))
        own = int(np.searchsorted(run, run[0], side="right"))
        # rest: what becomes of a memory of an earlier run, or of this one, that none of the rows changes; None: it stays.
        return {"at": at[:zone].copy(), "run": int(run[0]), "own": own, "out": [outcome(e) for e in range(zone + 1)], "out_own": outcome(own), "rest": (None, None)}

    def apply(self, map_, memory):
        entry = 0 if memory is None else int(np.searchsorted(map_["at"], memory[0] + self.cooldown))
        same = memory is not None and memory[1] == map_["run"]
        found = map_["out_own"] if same and map_["own"] > entry else map_["out"][entry]
        found = map_["rest"][same] if found is None else found
        return memory if found is None else found

    def compose(self, first, second):
        def rest(found, run):
            # What the first stretch leaves as it was is more than a cooldown old in the second: only its run can matter there.
            before = (-(2**62), run) if found is None else found
            after = self.apply(second, before)
            return None if found is None and after == before else after

        then = lambda found: None if found is None else self.apply(second, found)
        rests = rest(first["rest"][0], first["run"] - 1), rest(first["rest"][1], first["run"])
        return first | {"out": [then(x) for x in first["out"]], "out_own": then(first["out_own"]), "rest": rests}

    def replay(self, rows: np.ndarray, memory) -> np.ndarray:
        at, run = rows[:, 0], rows[:, 1]
        out, after = np.zeros(len(rows), np.int64), self._next(at, run, at, run).tolist()
        k = 0 if memory is None else int(self._next(at, run, memory[0], memory[1]))
        while k < len(rows):
            out[k] = 1
            k = after[k]
        return out


def run_machine(df: DataFrame, machine, inputs: list[str], by: str, stretch: str, place: list[str], out: str) -> DataFrame:
    """df with `out`, the machine's result on each row. by: key; stretch: a whole number that rises along a key, at least 0; place: the order inside it.

    inputs: columns of whole numbers. Of a Table also <out>_before, the memory before each row. df is read twice (for the maps and for the replay).
    """
    import pandas as pd

    traced = isinstance(machine, Table)
    kind = df.schema[by].dataType.simpleString()
    asked = df.withColumn("_s", F.col(stretch).cast("long")).withColumn("_u", F.expr(f"_s div {FAN}"))

    def maps_of(key, frame):
        rows = frame.sort_values(place)[inputs].to_numpy(np.int64)
        return pd.DataFrame({"_k": [key[0]], "_u": [key[1]], "_s": [key[2]], "_m": [pickle.dumps(machine.map_of(rows))]})

    def composed(key, frame):
        maps = [pickle.loads(m) for m in frame.sort_values("_s")._m]
        whole = maps[0]
        for m in maps[1:]:
            whole = machine.compose(whole, m)
        return pd.DataFrame({"_k": [key[0]], "_u": [key[1]], "_m": [pickle.dumps(whole)]})

    def walked(frame, column, memory):
        frame, begins = frame.sort_values(column), []
        for m in frame._m:
            begins.append(pickle.dumps(memory))
            memory = machine.apply(pickle.loads(m), memory)
        return frame, begins

    def tops(key, frame):
        frame, begins = walked(frame, "_u", machine.start)
        return pd.DataFrame({"_k": [key[0]] * len(frame), "_u": frame._u.to_numpy(), "_b": begins})

    def down(key, maps, begin):
        frame, begins = walked(maps, "_s", pickle.loads(begin._b.iloc[0]))
        return pd.DataFrame({"_k": [key[0]] * len(frame), "_s": frame._s.to_numpy(), "_b": begins})

    def replayed(key, rows, begin):
        rows = rows.sort_values(place)
        found = machine.replay(rows[inputs].to_numpy(np.int64), pickle.loads(begin._b.iloc[0]))
        memories = {f"{out}_before": np.concatenate([[pickle.loads(begin._b.iloc[0])], found[:-1]]).astype(np.int64)} if traced else {}
        return rows.drop(columns=["_s", "_u"]).assign(**{out: found}, **memories)

    maps = asked.select(F.col(by).alias("_k"), "_u", "_s", *{*inputs, *place}).groupBy("_k", "_u", "_s").applyInPandas(maps_of, f"_k {kind}, _u long, _s long, _m binary")
    top = maps.groupBy("_k", "_u").applyInPandas(composed, f"_k {kind}, _u long, _m binary").groupBy("_k").applyInPandas(tops, f"_k {kind}, _u long, _b binary")
    begins = maps.groupBy("_k", "_u").cogroup(top.groupBy("_k", "_u")).applyInPandas(down, f"_k {kind}, _s long, _b binary")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {out} long" + (f", {out}_before long" if traced else "")
    return asked.groupBy(by, "_s").cogroup(begins.groupBy("_k", "_s")).applyInPandas(replayed, schema)
