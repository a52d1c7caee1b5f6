from tidemark.llm import mixing

from .helpers import WORD, duck, same_rows

SF = "/root/testdata/sf0.001"


def poured(sizes):
    """Targets by repeated resharing: sizes per source in order."""
    weights = [(3, 1, 2)[k % 3] for k in range(len(sizes))]
    left, full = 1.5 * sum(sizes), {}
    while True:
        open_ = [k for k in range(len(sizes)) if k not in full]
        share = {k: left * weights[k] / sum(weights[j] for j in open_) for k in open_}
        over = [k for k in open_ if share[k] > 2 * sizes[k]]
        if not over:
            return [full.get(k, share.get(k)) for k in range(len(sizes))]
        for k in over:
            full[k] = 2 * sizes[k]
            left -= full[k]


def check(docs, rows):
    order = sorted({d[2] for d in docs}, key=lambda s: (s is None, (s or "").encode()))
    per = {s: sum(len(WORD.findall(d[1] or "")) for d in docs if d[2] == s) for s in order}
    wanted = dict(zip(order, poured([per[s] for s in order]), strict=True))
    for s in order:
        own = [r for r in rows if r.source == s]
        assert all(abs(r.target - wanted[s]) <= 1e-6 * max(1, wanted[s]) and r.source_size == per[s] for r in own)
        assert abs(sum(r.taken for r in own) - wanted[s]) <= max(8, 0.01 * wanted[s])
        assert all(0 <= r.taken <= 2 * r.size for r in own)


def test_targets_and_takes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check([(r.doc_id, r.text, r.source) for r in docs.collect()], mixing.mix(docs).collect())


def test_skewed_null_and_empty_sources(spark):
    docs = [(k, "w " * (k % 50), ("hot", "b", None, "z")[0 if k % 3 else k % 4]) for k in range(600)] + [(None, "x y", "b"), (7, None, "zero"), (7, "", "zero")]
    frame = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, source string, size int")
    rows = mixing.mix(frame).collect()
    assert len(rows) == len(docs)
    check(docs, rows)
    assert mixing.mix(frame.limit(0)).count() == 0


def test_against_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert same_rows(mixing.op10_mixing(spark, SF), duck(documents=docs.toPandas()), mixing.SQL)
