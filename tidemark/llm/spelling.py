"""Spelling variants: words one edit apart, by two-dimensional range reporting over wavelet trees.

Every word is a point: its place in forward order and its place in the order of the reversed words. Words that differ from q
at position i alone share its first i characters and those after i, so they are the points in the rectangle of two intervals,
one in each order. The same holds for a shorter word that lacks position i. A wavelet tree over the points of one word length
M reports a rectangle's points; words of length M ask it for replacements, words of length M - 1 for insertions, and what an
insertion finds answers the deletion too. Of the positions at which one insertion can stand the leftmost counts, so each pair
is found once.

Words meet by parts of positions: for edits in [a, b) of length M, those that agree before a and after b. The two halves are
the first parts; where more than GROUP words (or BYTES of them) agree, the part is halved, down to a single position, where at
most the 90 letters can differ. So no group grows with the vocabulary, and no pair is lost. A task takes its groups in chunks;
a tree is built over all groups of a chunk that have one length and part, the group being the first character in both orders.

Words are counted in one pass with sums per task; the chain from a word to its root is shorter than the logarithm of the
largest count, as every form is `ratio` times as frequent, and is followed by doubling.

Nulls: a null text has no words; a null doc_id is written as nothing. Repeated rows count each. Words of any length are whole.
An empty table gives an empty result. Only doc_id and text are read, so other columns may clash.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, read

LETTERS = 7  # of a word, at least
TIMES, RATIO = 2, 10  # occurrences of a word, at least; how much more frequent a form is
SLIPS = 31  # one in so many runs of letters loses a character
GROUP, BYTES = 4096, 16_000_000  # of the words that meet
ALPHABET = 128  # more than the letters that one position can hold
BROADCAST_KEYS = 1_000_000
_CHUNK, _ASKED, _FLUSH = 65_536, 100_000, 300_000
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LETTERS)
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: the words with their slips, summed per task. A run shorter than LETTERS makes no word."""

    def count(batches):
        held: dict = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                before = crc32(f"{doc_id.as_py()}:".encode())
                for run, n in Counter(_RUN.findall(text.as_py().translate(_LOWER).decode("utf-8", "replace"))).items():
                    h = crc32(run.encode(), before)
                    if h % SLIPS == 0:
                        k = h % len(run)
                        run = run[:k] + run[k + 1 :]
                        if len(run) < LETTERS:
                            continue
                    held[run] = held.get(run, 0) + n
                if len(held) > _FLUSH:
                    yield flush()
        if held:
            yield flush()

    few = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return few.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Wavelet:
    """A wavelet tree, level by level, over a permutation of 0..n-1."""

    def __init__(self, values: np.ndarray):
        self.n, self.levels = len(values), []
        for shift in range(max(1, (self.n - 1).bit_length()) - 1, -1, -1):
            bit = (values >> shift) & 1
            ones = np.zeros(self.n + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((shift, ones, self.n - ones[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def report(self, lo, hi, least, most) -> tuple[np.ndarray, np.ndarray]:
        """Of many rectangles at once, places in [lo, hi) and values in [least, most): the number of the rectangle and the value of each point within."""
        asked, value = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for shift, ones, zeros in self.levels:
            lo1, hi1 = ones[lo], ones[hi]
            asked = np.concatenate([asked, asked])
            lo, hi = np.concatenate([lo - lo1, zeros + lo1]), np.concatenate([hi - hi1, zeros + hi1])
            value = np.concatenate([2 * value, 2 * value + 1])
            open_ = np.flatnonzero((lo < hi) & ((value << shift) < most[asked]) & (((value + 1) << shift) > least[asked]))
            asked, lo, hi, value = asked[open_], lo[open_], hi[open_], value[open_]
        return asked, value


def _intervals(common: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row of a sorted table, the first and last (exclusive) row that shares its first `length` characters; common: those shared by neighbours."""
    starts = np.concatenate([[0], np.flatnonzero(common < length) + 1])
    sizes = np.diff(np.concatenate([starts, [len(common) + 1]]))
    return np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)


def _common(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Characters that neighbours share, -1 between groups."""
    differ = rows[1:] != rows[:-1]
    found = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.where(group[1:] != group[:-1], -1, found)


def near_pairs(m: int, a: int, b: int, group: np.ndarray, words: list[bytes]):
    """Arrays (of, near) of row numbers: every pair of one group that one edit at a position in [a, b) of the longer word makes, in both directions.

    words: of length m, or m - 1 for those that lack one character; a group's agree before a and after b.
    """
    n = len(words)
    as_text = np.array(words, dtype=f"S{m}")
    letters = np.frombuffer(as_text.tobytes(), np.uint8).reshape(n, m)
    long = np.fromiter(map(len, words), np.int64, n) == m
    back = letters[:, ::-1].copy()
    back[~long, :-1] = back[~long, 1:]
    back[~long, -1] = 0
    forward, reverse = np.lexsort((as_text, group)), np.lexsort((back.view(f"S{m}").ravel(), group))
    if not long.any():
        return
    points = lambda order: np.concatenate([[0], np.cumsum(long[order])])  # noqa: E731  points before each place
    in_forward, in_reverse = points(forward), points(reverse)
    place = np.empty(n, np.int64)
    place[reverse] = in_reverse[:-1]
    tree = Wavelet(place[forward][long[forward]])
    at_value = reverse[long[reverse]]
    shared, shared_back = _common(letters[forward], group[forward]), _common(back[reverse], group[reverse])
    at_forward, at_reverse = np.empty(n, np.int64), np.empty(n, np.int64)
    at_forward[forward] = at_reverse[reverse] = np.arange(n)
    least = np.where(long, 2, 1)  # a word of its own length finds itself
    held, size = [], 0

    def found():
        of, at, lo, hi, low, high = (np.concatenate(x) for x in zip(*held, strict=True))
        asked, value = tree.report(lo, hi, low, high)
        of, at, near = of[asked], at[asked], at_value[value]
        # The same insertion stands anywhere in a run of one letter: the leftmost counts.
        sound = np.where(long[of], of != near, (at == 0) | (letters[near, at - 1] != letters[near, at]))
        of, near = of[sound], near[sound]
        short = ~long[of]
        return np.concatenate([of, near[short]]), np.concatenate([near, of[short]])

    for i in range(a, b):
        s, e = _intervals(shared, i)
        u, v = _intervals(shared_back, m - 1 - i)
        lo, hi = in_forward[s][at_forward], in_forward[e][at_forward]
        low, high = in_reverse[u][at_reverse], in_reverse[v][at_reverse]
        ask = np.flatnonzero((hi - lo >= least) & (high - low >= least))
        held.append((ask, np.full(len(ask), i), lo[ask], hi[ask], low[ask], high[ask]))
        size += len(ask)
        if size >= _ASKED:
            yield found()
            held, size = [], 0
    if size:
        yield found()


def _best(m: int, a: int, b: int, keys: np.ndarray, words: list[bytes], counts: np.ndarray) -> list[tuple]:
    """(word, its near words, the largest count among them, the smallest word of that count) of one length and part."""
    group = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
    order = np.lexsort((np.array(words, dtype=f"S{m}"), -counts))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    times, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
    for of, near in near_pairs(m, a, b, group, words):
        times += np.bincount(of, minlength=len(words))
        np.minimum.at(best, of, rank[near])
    found = np.flatnonzero(times)
    first = order[best[found]]
    return [(words[k].decode("latin-1"), int(times[k]), int(counts[f]), words[f].decode("latin-1")) for k, f in zip(found.tolist(), first.tolist(), strict=True)]


def _search(batches):
    """Rows sorted by m, a, b and key: whole groups in chunks."""
    rows: list[tuple] = []
    weight = 0

    def flush(whole: list[tuple]):
        out, k = [], 0
        while k < len(whole):
            part, end = whole[k][:3], k
            while end < len(whole) and whole[end][:3] == part:
                end += 1
            keys, words, counts = (list(x) for x in zip(*(r[3:] for r in whole[k:end]), strict=True))
            out += _best(*part, np.array(keys, np.int64), words, np.array(counts, np.int64))
            k = end
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "times", "near_n", "near"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (len(rows) >= _CHUNK or weight > BYTES) and row[:4] != rows[-1][:4]:
                yield flush(rows)
                rows, weight = [], 0
            rows.append(row)
            weight += len(row[4])
    if rows:
        yield flush(rows)


def _dealt(rows: DataFrame, halve: bool) -> DataFrame:
    """word, n, m with the parts [a, b) of its positions and the key of what lies outside."""
    if halve:
        middle = F.expr("(a + b) div 2")
        parts = F.array(F.struct(F.col("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b")))
    else:
        middle = F.expr("m div 2")
        parts = F.array(F.struct(F.lit(0).alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("m").alias("b")))
    cut = rows.select("word", "n", "m", F.explode(parts).alias("p")).select("word", "n", "m", "p.a", "p.b")
    return cut.withColumn("key", F.expr("xxhash64(m, a, b, substring(word, 1, a), substring(word, length(word) - (m - b) + 1, m - b))"))


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """words (word, n; distinct, of letters up to U+00FF): word, n_near, near (n, word), the near word of largest n, for those that have one."""
    todo = _dealt(words.select("word", "n", F.explode(F.expr("array(length(word), length(word) + 1)")).alias("m")), False)
    done = None
    while True:
        limit = F.greatest(F.lit(ALPHABET), F.least(F.lit(group), F.lit(BYTES) / F.col("m")))
        large = todo.filter("b - a > 1").groupBy("m", "a", "b", "key").agg(F.count("*").alias("size")).filter(F.col("size") > limit).select("key")
        large = materialize(large.distinct(), "spelling-large")
        size = large.count()
        if not size:
            break
        large = F.broadcast(large) if size <= BROADCAST_KEYS else large
        small = todo.join(large, "key", "left_anti").unionByName(todo.filter("b - a <= 1").join(large, "key", "left_semi"))
        done = small if done is None else done.unionByName(small)
        todo = materialize(_dealt(todo.filter("b - a > 1").join(large, "key", "left_semi"), True), "spelling-parts")
    every = todo if done is None else done.unionByName(todo)
    dealt = every.select("m", "a", "b", "key", F.encode("word", "ISO-8859-1").alias("word"), "n").repartition("key").sortWithinPartitions("m", "a", "b", "key")
    found = dealt.mapInArrow(_search, "word string, times long, near_n long, near string")
    return found.groupBy("word").agg(F.sum("times").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("first")).select(
        "word", "n_near", F.struct((-F.col("first.less")).alias("n"), F.col("first.near").alias("word")).alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form): word, root, the last of the chain."""
    jumps = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = jumps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        jumps = materialize(jumps.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        moved = jumps.filter("_moved").limit(1).count()
        jumps = jumps.drop("_moved")
        if not moved:
            return jumps


def variants(docs: DataFrame, ratio: int = RATIO, group: int = GROUP) -> DataFrame:
    """word, n, n_near, form, form_n, root."""
    words = materialize(count_words(docs).filter(F.col("n") >= TIMES), "spelling-words")
    near = near_words(words, group)
    is_form = F.col("near.n") >= ratio * F.col("n")
    judged = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near.word")).alias("form"), F.when(is_form, F.col("near.n")).alias("form_n"))
    judged = materialize(judged, "spelling-forms")
    return judged.join(roots(judged.filter("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


SQL = rf"""WITH RECURSIVE crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
per_doc AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS d, run, count(*) AS n FROM runs WHERE length(run) >= {LETTERS} GROUP BY ALL),
points AS (SELECT *, flatten(list_transform(string_split(d || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 | (unicode(x) >> 6) AS BIGINT), 128 | (unicode(x) & 63)] END)) AS bytes FROM per_doc),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INT)])), 4294967295) AS h FROM points, crc_table),
slipped AS (SELECT CASE WHEN h % {SLIPS} = 0 THEN left(run, CAST(h % length(run) AS INT)) || substring(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= {LETTERS} GROUP BY word HAVING sum(n) >= {TIMES}),
cut AS MATERIALIZED (SELECT word, i, left(word, CAST(i AS INT)) || '_' || substring(word, CAST(i AS INT) + 2) AS gap, left(word, CAST(i AS INT)) || substring(word, CAST(i AS INT) + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.gap = b.gap AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, near, m, n_near FROM (SELECT p.word, p.near, w.n AS m, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.near) AS k FROM pairs p JOIN words w ON p.near = w.word) WHERE k = 1),
judged AS MATERIALIZED (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= {RATIO} * w.n THEN b.near END AS form, CASE WHEN b.m >= {RATIO} * w.n THEN b.m END AS form_n FROM words w LEFT JOIN best b USING (word)),
chain AS (SELECT word, form AS at FROM judged WHERE form IS NOT NULL UNION ALL SELECT c.word, j.form FROM chain c JOIN judged j ON c.at = j.word WHERE j.form IS NOT NULL),
ends AS (SELECT c.word, c.at FROM chain c JOIN judged j ON c.at = j.word WHERE j.form IS NULL)
SELECT j.word, form, coalesce(e.at, j.word) AS root, n, n_near, form_n FROM judged j LEFT JOIN ends e USING (word)"""
QUERIES = {"op12_spelling_variants": op12_spelling_variants}
ORACLES = {"op12_spelling_variants": SQL}
