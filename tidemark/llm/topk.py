"""Exact top-k by inner product, with KD-trees per shard.

Vectors are dealt into shards by space: median splits, learnt from a bounded sample (SAMPLE vectors of each length), give
regions of about SHARD_ROWS vectors, and a region that holds more (a common vector, a region the sample misjudged) is dealt
by hash into parts. Every shard has its tight bounding box. A query's best possible score in a box is the sum over dimensions
of the larger of query times lower and query times upper edge.

A task builds one shard's KD-tree (median splits of the widest dimension, tight boxes at every node) and answers a block of
queries best first: a queue of nodes by their bound, until the best bound left is below the query's kth score. Queries go
through the shards in rounds: first the shard of the best bound, then the next few, then all that are left, each time with
the kth score reached so far, and only to shards whose box can still hold something better; these pairs are told from boxes
alone, before any vector is moved. A task holds one shard and one block, whatever the number of vectors and queries.

Nulls and repeats: vectors that are null or hold null or non-finite components take no part; a null vec_id neither. Vectors of
different lengths never meet. Rows of one vec_id are candidates each (a query's own id is excluded); of queries with one id
the one with the largest vector asks. Ties go to the smaller vec_id. An empty table gives an empty result. Only vec_id and
embedding are read, so other columns may clash. Components and scores beyond 64 bits count as the nearest 64-bit integer.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read

SHARD_ROWS, QUERY_ROWS, LEAF_ROWS, BOX_ROWS, SAMPLE = 16_384, 4096, 128, 4096, 65_536
ROUNDS = (1, 4)  # shards that each query visits in a round; the rest follow in a last one
LEAST, MOST = -(2**63), 2**63 - 1
FOUND = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v (floor(scale * component)) of the vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(
        F.col("vec_id").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return sound.select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def exact(x: np.ndarray) -> np.ndarray:
    """As doubles where all inner products are exact in them, else as Python integers."""
    most = float(np.abs(x.astype(np.float64)).max(initial=0))
    return x.astype(np.float64) if x.shape[1] * most * most < 2**52 else x.astype(object)


def box_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query and box: no vector in the box scores more."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def median_split(x: np.ndarray, rows: np.ndarray) -> tuple[int, np.ndarray, np.ndarray] | None:
    """The widest dimension and the rows below and from its median on; nothing if all rows are equal."""
    spread = x[rows].max(axis=0) - x[rows].min(axis=0) if x.shape[1] else np.zeros(1)
    if not spread.any():
        return None
    half, widest = len(rows) // 2, int(spread.argmax())
    order = np.argpartition(x[rows, widest], half)
    return widest, rows[order[:half]], rows[order[half:]]


class Tree:
    """A KD-tree over the rows of a matrix: per node its box, and either two children or the rows of a leaf."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF_ROWS):
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray | None] = []
        low, high = [], []
        stack = [(np.arange(len(x)), None)]
        while stack:
            rows, parent = stack.pop()
            node = len(self.rows)
            if parent is not None:
                self.children[parent] = (*(self.children[parent] or ()), node)
            low.append(x[rows].min(axis=0)), high.append(x[rows].max(axis=0))
            split = median_split(x, rows) if len(rows) > leaf else None
            self.children.append(None)
            self.rows.append(rows if split is None else None)
            if split is not None:
                stack += [(split[2], node), (split[1], node)]
        self.low, self.high = np.array(low), np.array(high)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        return box_bounds(q, self.low, self.high)


def search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int):
    """For each query the (score, id) of its best k among rows of other ids that score at least `least`."""
    both = exact(np.concatenate([x, q]))
    x, q = both[: len(x)], both[len(x) :]
    tree = Tree(x)
    out = []
    for own_id, own, kth, bounds in zip(query_ids.tolist(), q, least.tolist(), tree.bounds(q).tolist(), strict=True):
        kth = kth if kth > LEAST else float("-inf")
        best: list[tuple[int, int]] = []  # a heap of (score, -id): its first is the worst of the best k
        queue = [(-bounds[0], 0)]
        while queue and -queue[0][0] >= kth:
            node = heapq.heappop(queue)[1]
            rows = tree.rows[node]
            if rows is None:
                for child in tree.children[node]:
                    if bounds[child] >= kth:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            scores = x[rows] @ own
            near = np.flatnonzero((scores >= kth).astype(bool))
            for score, other in zip(scores[near].tolist(), ids[rows[near]].tolist(), strict=True):
                if other == own_id:
                    continue
                hit = (min(MOST, max(LEAST, int(score))), -other)
                if len(best) < k:
                    heapq.heappush(best, hit)
                elif hit > best[0]:
                    heapq.heapreplace(best, hit)
                if len(best) == k:
                    kth = max(kth, best[0][0])
        out.append([(score, -other) for score, other in sorted(best, reverse=True)])
    return out


def _matrix(table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _searching(k: int):
    def run(shard, queries):
        query_id, vec_id, score = [], [], []
        if shard.num_rows and queries.num_rows:
            ids, query_ids = shard.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
            best = search(ids, _matrix(shard, "v"), query_ids, _matrix(queries, "v"), queries.column("least").to_numpy(), k)
            for q, hits in zip(query_ids, best, strict=True):
                for s, v in hits:
                    query_id.append(q), vec_id.append(v), score.append(s)
        return pa.table({"query_id": pa.array(query_id, pa.int64()), "vec_id": pa.array(vec_id, pa.int64()), "score": pa.array(score, pa.int64())})

    return run


def regions_of(vectors: DataFrame, shard_rows: int, sample: int = SAMPLE) -> dict[int, list]:
    """Per length of more than shard_rows vectors: median splits of a sample, as nodes (dimension, edge, left, right) or region numbers."""
    trees = {}
    for dim, n in vectors.groupBy("dim").count().filter(F.col("count") > shard_rows).collect():
        ratio = min(1.0, sample / n)
        rows = vectors.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) < int(ratio * (1 << 20)))).select("v").collect()
        x = np.array(sorted(r.v for r in rows), np.int64).reshape(-1, dim).astype(np.float64)
        wanted, nodes, regions = -(-n // shard_rows), [], 0
        stack = [(np.arange(len(x)), float(wanted), None, 0)]
        while stack:
            rows, share, parent, side = stack.pop()
            at = len(nodes)
            if parent is not None:
                nodes[parent][2 + side] = at
            split = median_split(x, rows) if share > 1 and len(rows) >= 16 else None
            if split is None:
                nodes.append(regions)
                regions += 1
                continue
            widest, below, above = split
            nodes.append([widest, float(x[above, widest].min()), None, None])
            stack += [(below, share / 2, at, 0), (above, share / 2, at, 1)]
        trees[dim] = nodes
    return trees


def region_of(nodes: list, x: np.ndarray) -> np.ndarray:
    out, stack = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
    while stack:
        at, rows = stack.pop()
        if isinstance(nodes[at], int):
            out[rows] = nodes[at]
            continue
        widest, edge, left, right = nodes[at]
        below = x[rows, widest] < edge
        stack += [(left, rows[below]), (right, rows[~below])]
    return out


def dealt(vectors: DataFrame, shard_rows: int) -> DataFrame:
    """vectors (vec_id, v) with dim, region and part, which name a shard together."""
    held = vectors.withColumn("dim", F.size("v"))
    trees = regions_of(held, shard_rows)

    def place(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            region, v = np.zeros(len(dims), np.int64), batch.column(1)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if int(dim) in trees:
                    region[at] = region_of(trees[int(dim)], v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region)], names=["vec_id", "v", "dim", "region"])

    placed = materialize(held.select("vec_id", "v", "dim").mapInArrow(place, "vec_id long, v array<long>, dim int, region long"), "vectors")
    parts = placed.groupBy("dim", "region").agg(F.expr(f"(count(*) + {shard_rows - 1}) div {shard_rows}").alias("parts"))
    return placed.join(parts, ["dim", "region"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).drop("parts")


def boxes_of(placed: DataFrame) -> DataFrame:
    """Per shard: low and high, arrays of the smallest and largest components."""

    def partial(batches):
        for batch in batches:
            frame = batch.select(["dim", "region", "part"]).to_pandas()
            groups, v = frame.groupby(["dim", "region", "part"]).indices, batch.column(3)
            rows = []
            for (dim, region, part), at in groups.items():
                x = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                rows.append((dim, region, part, x.min(axis=0).tolist(), x.max(axis=0).tolist()))
            yield pa.RecordBatch.from_pylist([dict(zip(("dim", "region", "part", "low", "high"), r, strict=True)) for r in rows], schema=schema)

    schema = pa.schema([("dim", pa.int32()), ("region", pa.int64()), ("part", pa.int64()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64()))])
    few = placed.select("dim", "region", "part", "v").mapInArrow(partial, "dim int, region long, part long, low array<long>, high array<long>")
    edges = few.select("dim", "region", "part", F.posexplode(F.arrays_zip("low", "high")).alias("at", "edge")).groupBy("dim", "region", "part", "at").agg(F.min("edge.low").alias("low"), F.max("edge.high").alias("high"))
    sides = F.sort_array(F.collect_list(F.struct("at", "low", "high")))
    return edges.groupBy("dim", "region", "part").agg(sides.alias("s")).select("dim", "region", "part", F.col("s.low").alias("low"), F.col("s.high").alias("high"))


def reachable(queries: DataFrame, boxes: DataFrame, visited: DataFrame | None, most: int | None, query_rows: int) -> DataFrame:
    """query_id and shard, for the `most` best shards of each query (None: all) not visited whose box can hold a score of at least `least`."""
    many, wide = queries.count(), boxes.count()
    n_q, n_b = max(1, -(-many // query_rows)), max(1, -(-wide // BOX_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = queries.withColumn("qb", F.pmod(F.xxhash64("query_id", F.lit(7)), F.lit(n_q))).withColumn("bb", every(n_b))
    b = boxes.withColumn("bb", F.pmod(F.xxhash64("region", "part"), F.lit(n_b))).withColumn("qb", every(n_q))
    room = None if most is None else most + sum(ROUNDS)  # those visited may be among the best

    def run(asking, shards):
        out = []
        if asking.num_rows and shards.num_rows:
            v, low, high = (_matrix(t, c) for t, c in ((asking, "v"), (shards, "low"), (shards, "high")))
            all_ = exact(np.concatenate([v, low, high]))
            v, low, high = all_[: len(v)], all_[len(v) : len(v) + len(low)], all_[len(v) + len(low) :]
            bounds = box_bounds(v, low, high)
            least = asking.column("least").to_numpy()[:, None]
            can = (bounds >= least).astype(bool) | (least == LEAST)
            approx = bounds.astype(np.float64)
            for k in range(len(v)):
                at = np.flatnonzero(can[k])
                if room is not None and len(at) > room:
                    at = at[np.argsort(-approx[k, at], kind="stable")[:room]]
                out.append((k, at, approx[k, at]))
        rows = np.concatenate([np.full(len(at), k) for k, at, _ in out]) if out else np.array([], np.int64)
        cols = np.concatenate([at for _, at, _ in out]) if out else np.array([], np.int64)
        bound = np.concatenate([x for _, _, x in out]) if out else np.array([], float)
        return pa.table({
            "query_id": asking.column("query_id").take(pa.array(rows.astype(np.int64))), "dim": shards.column("dim").take(pa.array(cols.astype(np.int64))),
            "region": shards.column("region").take(pa.array(cols.astype(np.int64))), "part": shards.column("part").take(pa.array(cols.astype(np.int64))), "bound": pa.array(bound, pa.float64())})

    key = ["dim", "qb", "bb"]
    pairs = q.select(*key, "query_id", "v", "least").groupBy(*key).cogroup(b.select(*key, "region", "part", "low", "high").groupBy(*key)).applyInArrow(run, "query_id long, dim int, region long, part long, bound double")
    if visited is not None:
        pairs = pairs.join(visited, ["query_id", "dim", "region", "part"], "left_anti")
    if most is not None:
        best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "region", "part")
        pairs = pairs.withColumn("_at", F.row_number().over(best)).filter(F.col("_at") <= most)
    return pairs.select("query_id", "dim", "region", "part")


def top_k(vectors: DataFrame, is_query, k: int = 10, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """vectors: vec_id, v (array<long>). Per query: query_id, rank (from 1), vec_id, score of its k best other rows."""
    placed = materialize(dealt(vectors, shard_rows), "shards")
    boxes = materialize(boxes_of(placed), "boxes")
    asking = materialize(placed.filter(is_query).groupBy("vec_id", "dim").agg(F.max("v").alias("v")).withColumnRenamed("vec_id", "query_id"), "queries")
    run, shard = _searching(k), ["dim", "region", "part"]
    best = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    found = visited = None
    for most in (*ROUNDS, None):
        if found is None:
            least = asking.withColumn("least", F.lit(LEAST).cast("long"))
        else:
            reached = found.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).filter(F.col("n") >= k)
            least = asking.join(reached.select("query_id", "kth"), "query_id", "left").withColumn("least", F.coalesce("kth", F.lit(LEAST).cast("long"))).drop("kth")
        pairs = materialize(reachable(least, boxes, visited, most, query_rows), "visits")
        # A shard is read once per block of the queries that visit it, and not at all without any.
        blocks = pairs.groupBy(*shard).agg(F.expr(f"(count(*) + {query_rows - 1}) div {query_rows}").alias("blocks"))
        held = placed.join(blocks, shard).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        queries = pairs.join(blocks, shard).withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(7)), F.col("blocks"))).join(least.drop("dim"), "query_id")
        key = [*shard, "block"]
        more = held.select(*key, "vec_id", "v").groupBy(*key).cogroup(queries.select(*key, "query_id", "v", "least").groupBy(*key)).applyInArrow(run, FOUND)
        found = materialize(best(more if found is None else found.select("query_id", "vec_id", "score").unionByName(more)), "best")
        visited = pairs if visited is None else visited.unionByName(pairs)
    return found.select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(integer_vectors(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
QUERIES = {"op9_exact_topk": op9_exact_topk}
ORACLES = {"op9_exact_topk": SQL}
