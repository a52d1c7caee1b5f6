import collections
import random

from tidemark.llm import line_dedup

from .helpers import LOWER, duck, same_rows

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\f\r"


def brute(rows, least_chars=20, least_docs=3):
    """Per row: n_lines, n_dropped, kept."""
    key = lambda line: line.strip(SPACES).translate(LOWER)
    holders = collections.defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(-1 if doc is None else doc)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= least_chars and len(v) >= least_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), doc if doc is not None else -1) == (-1 if doc is None else doc)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def got(frame):
    return [(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.apply_bitmaps(frame, line_dedup.line_bitmaps(frame)).collect()]


def order(rows):
    return sorted(rows, key=repr)


def test_against_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    assert same_rows(line_dedup.op4_line_dedup(spark, SF), duck(documents=docs), line_dedup.SQL)


def test_random_texts_and_edge_cases(spark):
    rng = random.Random(5)
    lines = ["short", "", " \t ", "exactly twenty chars", "  EXACTLY twenty CHARS\r", "nineteen characters", "a line of more than twenty", "Ünïcode LINE of some length é", "\x0bA line of more than TWENTY\f",
             "ÜNÏCODE line of some length é"]
    rows = [(k, "\n".join(rng.choices(lines, k=rng.randrange(0, 9)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "x" * 200_000 + "\nexactly twenty chars"), (None, "exactly twenty chars\nown"), (104, "exactly twenty chars\n" * 50)]
    frame = spark.createDataFrame([(*r, True, 7) for r in rows], "doc_id long, text string, kept boolean, n_lines int").select("doc_id", "text", "n_lines")
    assert order(got(frame)) == order(brute(rows))


def test_repeated_rows_get_the_same_bitmap(spark):
    common = "this line is found in many documents"
    rows = [(1, f"{common}\na"), (1, f"{common}\na"), (2, f"b\n{common}"), (3, f"{common}\nc")]
    assert order(got(spark.createDataFrame(rows, "doc_id long, text string"))) == order(brute(rows))


def test_very_common_lines_take_the_counted_way(spark):
    common, rare = "the very same line stands in every document", "this one stands in three of the documents"
    rows = [(k, f"{common}\nown words of document number {k}" + (f"\n{rare}" if k in (3, 5, 900) else "")) for k in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(rows) > line_dedup.LEAST_HOT
    assert order(got(frame)) == order(brute(rows))


def test_empty_table(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []


def test_no_python_in_the_plan(spark):
    plan = line_dedup.op4_line_dedup(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
