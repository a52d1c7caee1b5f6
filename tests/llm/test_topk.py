import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import topk

from .helpers import duck, same_rows

SF = "/root/testdata/sf0.001"


def brute(rows, step=100, k=10):
    sound = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in sorted(sound) if i % step == 0}.items():
        best = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in sound if i != q and len(w) == len(v)))[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def got(frame, step=100, **options):
    return sorted(map(tuple, topk.top_k(topk.integer_vectors(frame), F.col("vec_id") % step == 0, **options).select("query_id", "rank", "vec_id", "score").collect()))


def test_against_sql(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    assert same_rows(topk.op9_exact_topk(spark, SF), duck(embeddings=frame), topk.SQL)


def test_many_shards_blocks_and_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.integers(-2, 3, 4)]) for k in range(1200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got(frame, 20, shard_rows=150, query_rows=17) == brute(rows, 20)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.1, -0.5]), (100, [1e15, -1e15]), (1, None), (2, [None, 1.0]), (3, [nan, 0.0]), (4, [inf, 0.0]), (5, [0.0, 0.0]), (6, [-0.0001, 0.9999]), (7, [1.0]), (200, [2.0]), (None, [1.0, 1.0]), (300, [])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    assert got(frame.filter("vec_id is null or vec_id <> 100")) == brute([r for r in rows if r[0] != 100])
    assert got(frame.limit(0)) == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(3000, 6)), rng.normal(size=(20, 6))
    tree = topk.Tree(x)
    leaves = [r for r in tree.rows if r is not None]
    assert sorted(np.concatenate(leaves).tolist()) == list(range(3000)) and max(map(len, leaves)) <= topk.LEAF_ROWS
    bounds = tree.bounds(q)

    def below(node):
        return tree.rows[node] if tree.rows[node] is not None else np.concatenate([below(c) for c in tree.children[node]])

    for node in range(len(tree.rows)):
        assert ((q @ x[below(node)].T).max(axis=1) <= bounds[:, node] + 1e-9).all()
        for child in tree.children[node] or ():
            assert (bounds[:, child] <= bounds[:, node] + 1e-9).all()


def test_far_nodes_are_not_visited(monkeypatch):
    """Of vectors in clusters, a query reads a few leaves only."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.integers(0, 50, (2000, 3)) + c for c in ([0, 0, 0], [900, 0, 0], [0, 900, 0], [0, 0, 900])]).astype(np.int64)
    read = []
    real = topk.Tree.__init__

    def counted(self, *args, **options):
        real(self, *args, **options)

        class Rows(list):
            def __getitem__(self, k):
                found = super().__getitem__(k)
                if found is not None:
                    read.append(len(found))
                return found

        self.rows = Rows(self.rows)

    monkeypatch.setattr(topk.Tree, "__init__", counted)
    best = topk.search(np.arange(8000), x, np.array([-1]), np.array([[1, 0, 0]], dtype=np.int64), np.array([topk.LEAST]), 10)
    scores = x[:, 0].copy()
    assert [s for s, _ in best[0]] == sorted(scores, reverse=True)[:10] and sum(read) < 2000


def test_regions_and_a_common_vector(spark):
    """Most rows are one vector: its region is dealt into parts, and the ties go by id."""
    rng = np.random.default_rng(9)
    rows = [(k, [1.0, 2.0, 0.5] if k % 3 else [float(t) for t in rng.normal(size=3)]) for k in range(1500)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    shards = topk.dealt(topk.integer_vectors(frame), 100).groupBy("dim", "region", "part").count().collect()
    assert len({r.region for r in shards}) > 3 and max(r["count"] for r in shards) < 200
    assert got(frame, 50, shard_rows=100) == brute(rows, 50)


def test_components_beyond_64_bits(spark):
    rows = [(0, [1.0, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [2.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(frame) == [(0, 1, 1, topk.MOST), (0, 2, 3, 2 * 1024 * 1024), (0, 3, 2, topk.LEAST)]


def test_large_components_are_exact():
    x = np.array([[2**30, 1], [2**30, 2], [-(2**30), 5]], dtype=np.int64)
    best = topk.search(np.array([1, 2, 3]), x, np.array([9]), np.array([[2**30, 1]], dtype=np.int64), np.array([-(2**62)]), 2)
    assert best == [[(2**60 + 2, 2), (2**60 + 1, 1)]]
