import re
from collections import Counter

import pandas as pd

import corpus_pipeline
from tidemark.llm import line_dedup, mixing, quality
from tidemark.llm.common import materialize

from .helpers import duck, near_components
from .test_packing import check_places

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()))


def fewest(lengths, room=1024):
    """A lower bound on the sequences that pieces of these lengths need: no two over half share one, and those under k fit beside none over room - k."""
    bound = -(-sum(lengths) // room)
    for k in range(1, room // 2 + 1):
        alone, large, small = ([x for x in lengths if a < x <= b] for a, b in ((room - k, room), (room // 2, room - k), (k - 1, room // 2)))
        bound = max(bound, len(alone) + len(large) + max(0, -(-(sum(small) - len(large) * room + sum(large)) // room)))
    return bound


def test_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(COLUMNS)
    last = None
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        after = materialize(stage(spark, docs, SF), name)
        con = duck(documents=before)
        if name == "quality_rules":
            want = con.execute("WITH " + quality.ORACLE.replace("{documents}", "documents") + " SELECT d.* FROM documents d JOIN all_judged j USING (doc_id) WHERE j.kept").fetchall()
        elif name == "line_dedup":
            want = con.execute("WITH " + line_dedup.ORACLE.replace("{documents}", "documents") + " SELECT doc_id, kept, lang, source, length(kept) FROM documents d JOIN deduped USING (doc_id)").fetchall()
        elif name == "minhash_near_dedup":
            found = near_components(zip(before.doc_id, before.text, strict=True), 5, 80)
            want = [tuple(r) for r in before.itertuples(index=False) if found[r.doc_id][1] == r.doc_id]
        elif name == "mixing":
            want = []
            for doc_id, taken, size, target, source in con.execute(mixing.ORACLE.replace("{documents}", "documents") + " SELECT doc_id, taken, size, target, source FROM mixed WHERE size > 0").fetchall():
                own = next(r for r in before.itertuples(index=False) if r.doc_id == doc_id)
                want += [tuple(own)] * (taken // size)
                if taken % size:
                    begin = re.match(r"[\x20\x09-\x0D]*((?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){%d}[^\x20\x09-\x0D]+)" % (taken % size - 1), own.text).group(1)
                    want.append((doc_id, begin, own.lang, own.source, len(begin)))
            words, targets = Counter(), dict(con.execute(mixing.ORACLE.replace("{documents}", "documents") + " SELECT DISTINCT source, target FROM mixed").fetchall())
            for r in after.collect():
                words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
            assert all(abs(words[s] - t) <= 1 for s, t in targets.items())
        else:
            last, counts = after.collect(), before.groupby("doc_id").size()
            assert len(last) and set(r.doc_id for r in last) == set(before.doc_id)
            single = {r.doc_id: r.text for r in before.itertuples() if counts[r.doc_id] == 1}
            per_sequence = pd.Series([r.length for r in last]).groupby([r.sequence_id for r in last]).sum()
            assert per_sequence.max() <= 1024 and len(per_sequence) <= 1.02 * fewest([r.length for r in last]) + 1
            # Documents that come once, alone; the next test has all copies.
            alone = stage(spark, docs.join(spark.createDataFrame([(d,) for d in single], "doc_id long"), "doc_id", "left_semi"), SF).collect()
            check_places(alone, single)
            assert len(single) > 10
            break
        assert rows_of(after) == sorted(map(tuple, want)), name
        assert 0 < after.count()
        docs = after


def test_packing_stage_gives_every_piece(spark):
    """On the stage's own input, whose documents come several times: all pieces of all copies, their ids and gapless offsets."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
    name, packing = corpus_pipeline.STAGES[-1]
    rows = docs.collect()
    assert name == "packing" and len(rows) > len({r.doc_id for r in rows})
    apart = spark.createDataFrame([(k, r.text) for k, r in enumerate(rows)], "doc_id long, text string")
    pieces = packing(spark, apart, SF).collect()
    check_places(pieces, {k: r.text for k, r in enumerate(rows)})
    assert any(r.piece for r in pieces)
    for last in (packing(spark, docs, SF).collect(), corpus_pipeline.run(spark, SF).collect()):
        assert Counter(tuple(r)[:5] for r in last) == Counter((rows[r.doc_id].doc_id, *tuple(r)[1:5]) for r in pieces)
        ends = {}
        for r in sorted(last, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == ends.get(r.sequence_id, 0)
            ends[r.sequence_id] = r.offset + r.length
        assert max(ends.values()) <= 1024


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)


def test_empty_and_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars int, kept string"
    odd = [(1, None, None, None, None, "x"), (None, "a b c", "en", None, 5, None), (3, "", "en", "s", 0, None), (4, "w " * 300, None, "s", 600, None), (4, "w " * 300, None, "s", 600, None)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            out.collect()
            if "text" in out.columns:
                assert set(COLUMNS) <= set(out.columns)


def test_own_columns_are_carried_along(spark):
    """Columns named as the operators name theirs keep their values through every stage that keeps documents."""
    names = ["kept", "n_lines", "n_dropped", "size", "src", "g", "x1", "_of_0", "copies", "component_id"]
    rows = [(k, "a line that all of these share, long enough\n" + " ".join(f"w{k}x{j}" for j in range(80)), "en", "s", 400, *[f"{n}{k}" for n in names]) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{n} string" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        found = out.collect()
        assert found and all(r[n] == f"{n}{r.doc_id}" for r in found for n in names)


def test_mixing_stage_has_a_small_plan_and_reads_its_documents_once(spark):
    """Of what the mixture takes nothing is planned twice; rows of one doc_id with empty, null and cut texts come as often as they are taken."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(COLUMNS)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    mixed = plan(corpus_pipeline.mixing(spark, docs, SF))
    assert mixed.count("Exchange") <= 3 and mixed.count("Scan parquet") == 2
    assert plan(mixing.mix(docs)).count("Exchange") <= 12
    rows = [(1, "a b c d e f g h i j", "en", "s", 19), (1, "", "en", "s", 0), (1, None, "en", "s", None), (2, "k", "en", "t", 1), (3, "", "en", "t", 0)]
    got = Counter((r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.mixing(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int"), SF).collect())
    assert got == {(1, "a b c d e f g h i j", 19): 1, (1, "a b c d e", 9): 1, (1, "", 0): 1, (1, None, None): 1, (2, "k", 1): 2}
