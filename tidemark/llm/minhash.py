"""Near-duplicate detection: banded MinHash candidates, sequential Bayesian verification, exact confirmation.

Rows with equal shingle sets form a class, represented by its smallest doc_id. Representatives are banded; in each band's
bucket a hub is compared with all members, which is linear in the bucket. A pair's signatures are compared batch by batch:
under a uniform prior the similarity after m matches of n is Beta(m + 1, n - m + 1), and a pair is pruned once the
probability of reaching the threshold falls below `miss`. Survivors are confirmed on full shingle sets and merge components.
Buckets whose members are still in several components get a second hub. What then remains is compared in full, in blocks:
every member outside a bucket's largest component with every member of another one, again batch by batch. Of a block only the
documents with an open pair go on; their texts meet in one task, best pairs first, and each confirmed pair merges two
components there, so one link speaks for all pairs between them. No link between different components of a bucket goes
unexamined, no bucket is gathered in one task, and no list of pairs within a bucket is ever written or shuffled.

With 25 bands of 5 hashes a pair of similarity 0.85 shares no bucket with probability 4e-7 (0.8: 5e-5).

Every join by band or signature is a shuffle at every size; texts are fetched by a broadcast of the ids wanted as long as
these are at most BROADCAST_IDS, else by a shuffle.

Nulls and repeats: a null or empty text has an empty set, no links, and is its own component. Rows of one doc_id are one
node; each row is labelled by its own text. A null doc_id takes no part: its component is null and it is kept. An empty
table gives an empty result. Only doc_id and text are read, so other columns may clash.
"""

from __future__ import annotations

from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, read
from .components import components
from .shingles import WordIds, shingle_set

BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
WIDTH = 2 * ROWS  # bytes of a band in a signature
BATCH = 25  # hashes compared before each look at the posterior
MISS = 1e-5  # largest posterior probability at which a pair is pruned
HUB_ROUNDS = 2
BLOCK = 1_000_000  # shingles whose texts may meet in one side of a block
BROADCAST_IDS = 2_000_000  # 16 bytes each


def _coefficients(n: int, seed: int):
    draw = np.random.Generator(np.random.PCG64(seed))
    return draw.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, n, np.uint64)


_A, _B = _coefficients(HASHES, 20240229)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The high 16 bits of the smallest of each of the 125 hashes."""
    low = np.full(HASHES, np.uint64(2**64 - 1))
    for k in range(0, len(hashes), 1024):
        low = np.minimum(low, (hashes[k : k + 1024, None] * _A + _B).min(axis=0))
    # A minimum's high bits are near zero, so they are mixed before they are cut.
    return ((low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


def reaching(m: int, n: int, threshold: float) -> float:
    """P(Beta(m + 1, n - m + 1) >= threshold), which is P(Binomial(n + 1, threshold) <= m)."""
    return sum(exp(lgamma(n + 2) - lgamma(j + 1) - lgamma(n + 2 - j) + j * log(threshold) + (n + 1 - j) * log1p(-threshold)) for j in range(m + 1))


def fewest(n: int, threshold: float, miss: float) -> int:
    """The fewest matches of n compared hashes at which reaching the threshold has at least the probability miss."""
    return next(m for m in range(n + 1) if reaching(m, n, threshold) >= miss)


def least_matches(threshold: float, miss: float) -> list[int]:
    """fewest() after 25, 50, ... compared hashes."""
    return [fewest(n, threshold, miss) for n in range(BATCH, HASHES + 1, BATCH)]


def unpruned(left: np.ndarray, right: np.ndarray, at_left: np.ndarray, at_right: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (left[at_left], right[at_right]) the sequential comparison leaves, and their matches."""
    open_, found = np.arange(len(at_left)), np.zeros(len(at_left), np.int64)
    for k, enough in enumerate(least):
        at = slice(k * BATCH, (k + 1) * BATCH)
        found = found + (left[at_left[open_], at] == right[at_right[open_], at]).sum(axis=1)
        stay = found >= enough
        open_, found = open_[stay], found[stay]
    return open_, found


def linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(one), len(two)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= percent * (small + large - both)


SKETCH = "doc_id long, n_shingles long, same binary, sig binary"


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """Per row: doc_id, n_shingles, same (128-bit hash of the set; null if empty), sig."""

    def run(batches):
        ids = WordIds()
        for batch in batches:
            n, same, sigs = [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py(), words, ids)
                n.append(len(found))
                same.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                sigs.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "same", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SKETCH)


def band_keys(sig: Column) -> Column:
    return F.array(*[F.xxhash64(F.lit(k), F.substring(sig, k * WIDTH + 1, WIDTH)) for k in range(BANDS)])


def _rows(binary) -> np.ndarray:
    return np.frombuffer(b"".join(binary), np.uint16).reshape(-1, HASHES)


def plausible(pairs: DataFrame, reps: DataFrame, least: list[int]) -> DataFrame:
    """The pairs (hub, doc_id) that the sequential comparison of signatures does not prune, with n_shingles of doc_id."""

    def run(batches):
        for batch in batches:
            left, right = (_rows(batch.column(k).to_pylist()) for k in (3, 4))
            every = np.arange(batch.num_rows)
            yield batch.select([0, 1, 2]).take(pa.array(unpruned(left, right, every, every, least)[0]))

    one = reps.select(F.col("doc_id").alias("hub"), F.col("sig").alias("hub_sig"))
    both = pairs.join(reps.select("doc_id", "n_shingles", "sig").hint("merge"), "doc_id").join(one.hint("merge"), "hub")
    return both.select("hub", "doc_id", "n_shingles", "hub_sig", "sig").mapInArrow(run, "hub long, doc_id long, n_shingles long")


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id and text of the documents in ids (distinct doc_id)."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id", "left_semi")


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (hub, doc_id, n_shingles) with 100 * intersection >= percent * union of their full sets, as (a, b)."""
    degrees = pairs.groupBy("hub").agg(F.expr(f"sum(n_shingles) div {BLOCK} + 1").alias("parts"))
    parted = pairs.join(degrees, "hub").select("hub", "doc_id", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"))
    wanted = parted.unionByName(parted.select("hub", F.col("hub").alias("doc_id"), "part").distinct())
    texts = texts_of(materialize(wanted.select("doc_id").distinct(), "wanted"), docs)

    def run(key, frame):
        import pandas as pd

        ids, hub = WordIds(), int(key[0])
        mine = frame.doc_id == hub
        owns = [shingle_set(x, words, ids) for x in frame.text[mine]]
        out = []
        for doc, text in zip(frame.doc_id[~mine], frame.text[~mine], strict=True):
            other = shingle_set(text, words, ids)
            if any(linked(own, other, percent) for own in owns):
                out.append((hub, doc))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return wanted.join(texts, "doc_id").select("hub", "part", "doc_id", "text").groupBy("hub", "part").applyInPandas(run, "a long, b long")


def in_blocks(labelled: DataFrame, reps: DataFrame) -> DataFrame:
    """The rows of labelled (band, band_at, doc_id, component) in blocks (band, i, j): all members outside a bucket's largest component
    as left side (side 0), all members as right side (1); a left and a right row of different components meet in just one block."""
    rows = labelled.join(reps.select("doc_id", "n_shingles", "sig").hint("merge"), "doc_id")
    weight = F.sum(F.col("n_shingles") + 64)
    largest = (
        rows.groupBy("band", "component").agg(weight.alias("w"))
        .groupBy("band").agg(F.max_by("component", F.struct("w", F.negate("component"))).alias("largest"), F.sum("w").alias("w"), F.max("w").alias("most"))
    )
    told = rows.join(largest, "band").withColumn("n_left", F.expr(f"(w - most) div {BLOCK} + 1")).withColumn("n_right", F.expr(f"w div {BLOCK} + 1"))
    own = lambda count: F.pmod(F.xxhash64("doc_id"), F.col(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    left = told.filter("component <> largest").withColumn("i", own("n_left")).withColumn("j", every("n_right")).withColumn("side", F.lit(0))
    right = told.withColumn("j", own("n_right")).withColumn("i", every("n_left")).withColumn("side", F.lit(1))
    columns = ["band", "band_at", "i", "j", "side", "doc_id", "component", "sig"]
    return left.select(columns).unionByName(right.select(columns))


def open_pairs(left, right, band_at: int, least: list[int]):
    """Of a block, chunk by chunk: positions in left and right of the pairs of different components that are not pruned and
    share no band before this one (there they meet as well), and their matches; most matches first."""
    one, two = _rows(left.sig), _rows(right.sig)
    parts, own_parts = right.component.to_numpy(), left.component.to_numpy()
    per = max(1, 500_000 // max(1, len(two)))
    for at in range(0, len(one), per):
        a, b = np.nonzero(own_parts[at : at + per, None] != parts[None])
        a = a + at
        kept, found = unpruned(one, two, a, b, least)
        a, b = a[kept], b[kept]
        first = (one[a] == two[b]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) if len(a) else a
        mine = first == band_at
        a, b, found = a[mine], b[mine], found[mine]
        order = np.argsort(-found, kind="stable")
        yield a[order], b[order]


def across_components(labelled: DataFrame, reps: DataFrame, docs: DataFrame, words: int, percent: int, least: list[int]) -> DataFrame:
    """Links (a, b) that join all components which labelled (band, band_at, doc_id, component) has a link between."""
    blocks = materialize(in_blocks(labelled, reps), "blocks")
    schema = "band long, i long, j long, side int, doc_id long"

    def sides(frame):
        return frame[frame.side == 0].reset_index(drop=True), frame[frame.side == 1].reset_index(drop=True)

    def involved(key, frame):
        import pandas as pd

        left, right = sides(frame)
        on, two = np.zeros(len(left), bool), np.zeros(len(right), bool)
        if len(left) and len(right):
            for a, b in open_pairs(left, right, int(frame.band_at.iloc[0]), least):
                on[a] = True
                two[b] = True
        out = pd.concat([left[on], right[two]])
        return pd.DataFrame({"band": key[0], "i": key[1], "j": key[2], "side": out.side, "doc_id": out.doc_id}).drop_duplicates()

    def confirm(key, frame):
        import pandas as pd

        left, right = sides(frame)
        ids, parent, out, sets = WordIds(), {}, [], {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        def set_of(side, k):
            found = sets.get((side, k))
            if found is None:
                found = sets[side, k] = shingle_set((left, right)[side].text.iat[k], words, ids)
            return found

        if len(left) and len(right):
            part_a, part_b = left.component.tolist(), right.component.tolist()
            id_a, id_b = left.doc_id.tolist(), right.doc_id.tolist()
            for a, b in open_pairs(left, right, int(frame.band_at.iloc[0]), least):
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    one, two = find(part_a[x]), find(part_b[y])
                    if one != two and linked(set_of(0, x), set_of(1, y), percent):
                        parent[one] = two
                        out.append((id_a[x], id_b[y]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    wanted = materialize(blocks.groupBy("band", "i", "j").applyInPandas(involved, schema), "open-documents")
    texts = texts_of(materialize(wanted.select("doc_id").distinct(), "wanted"), docs)
    rows = blocks.join(wanted, ["band", "i", "j", "side", "doc_id"]).join(texts, "doc_id")
    return rows.groupBy("band", "i", "j").applyInPandas(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, representative (smallest doc_id of its class), component_id, kept."""
    least = least_matches(percent / 100, miss)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = materialize(sketches(docs, words), "sketches")
    named = sketch.filter("doc_id is not null and same is not null")
    classes = named.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("same", "first")
    members = materialize(
        sketch.select("doc_id", "n_shingles", "same").join(classes, "same", "left").select("doc_id", "n_shingles", "same", F.coalesce("first", "doc_id").alias("representative")), "members")
    copies = members.filter("doc_id <> representative").select("doc_id", "same")
    reps = materialize(named.join(copies, ["doc_id", "same"], "left_anti").select("doc_id", "n_shingles", "sig"), "representatives")
    texts = docs.filter("doc_id is not null")

    banded = reps.select("doc_id", F.posexplode(band_keys(F.col("sig"))).alias("band_at", "band"))
    crowded = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("doc_id").alias("hub")).filter("n > 1")
    buckets = materialize(banded.join(crowded.hint("merge"), "band").select("band", "band_at", "doc_id", "n", "hub"), "buckets")

    tested = materialize(buckets.filter("doc_id <> hub").select("hub", "doc_id").distinct(), "tested-pairs")
    links = materialize(confirmed(materialize(plausible(tested, reps, least), "likely-pairs"), texts, words, percent), "links")
    remaining = buckets.filter("n > 2").select("band", "band_at", "doc_id")
    found = components(links)
    for k in range(HUB_ROUNDS):
        # Buckets whose members are all in one component are settled; the others get another hub, and at last the full comparison.
        labelled = remaining.join(found, F.col("doc_id") == F.col("node"), "left").select("band", "band_at", "doc_id", F.coalesce("component", "doc_id").alias("component"))
        hub = F.struct(F.xxhash64("doc_id", F.lit(k)).alias("order"), "doc_id", "component")
        open_ = labelled.groupBy("band").agg(F.min("component").alias("first"), F.max("component").alias("last"), F.min(hub).alias("hub")).filter("first <> last").select("band", "hub")
        labelled = materialize(labelled.join(open_, "band"), "open-buckets")
        if labelled.isEmpty():
            break
        if k < HUB_ROUNDS - 1:
            new = labelled.filter("component <> hub.component").select(F.col("hub.doc_id").alias("hub"), "doc_id").distinct()
            more = confirmed(materialize(plausible(new, reps, least), "likely-pairs"), texts, words, percent)
        else:
            more = across_components(labelled.select("band", "band_at", "doc_id", "component"), reps, texts, words, percent, least)
        links = links.unionByName(materialize(more, "links"))
        found = components(links)
        remaining = labelled.select("band", "band_at", "doc_id")
    return _labelled(members, found)


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    joined = members.join(found, F.col("representative") == F.col("node"), "left")
    component = F.coalesce("component", "representative")
    return joined.select("doc_id", "n_shingles", "representative", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op5_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op5_minhash_near_dedup": op5_minhash_near_dedup}
ORACLES = {}
