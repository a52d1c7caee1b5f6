"""Plain-Python versions that the operators are held against."""

import collections
import re

import duckdb

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_components(rows, n, percent):
    """rows: (doc_id, text). Per doc_id: size of its shingle set and the smallest doc_id reachable by links, from all pairs that share a shingle."""
    sets = {}
    for d, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[d] = frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where, both = collections.defaultdict(list), collections.Counter()
    for d in sorted(sets):
        for s in sets[d]:
            where[s].append(d)
    for docs in where.values():
        for i, a in enumerate(docs):
            for b in docs[i + 1 :]:
                both[a, b] += 1
    for (a, b), k in both.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def duck(**tables):
    """A connection with pandas frames as tables."""
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(f"_{name}", frame)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM _{name}")
    return con


def same_rows(df, con, sql, digits=9):
    """Whether a DataFrame has the rows of a query, by column name."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    form = lambda v: f"{v:.{digits}g}" if isinstance(v, float) else repr(v)
    own = sorted(tuple(form(r[c]) for c in sorted(names)) for r in df.collect())
    other = sorted(tuple(form(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    assert own == other
    return True
