"""Pack tokenized documents into sequences by the sum-of-squares rule.

Documents longer than a sequence are cut into full pieces, with the remainder as their first piece. The pieces are counted
and dealt by hash into groups of about GROUP_PIECES; repeated rows, alike in all that is packed, are spread over the groups. In a group each piece goes where the sum over all gaps of the squared number of open
sequences with that gap becomes smallest: into an open sequence, or into a new one. Pieces of a quarter sequence or more
come first, longest first; the others follow in the order of a hash, so that all gaps meet all lengths (0.1 % above the
bound of total tokens; 1 % with all longest first). Sorting makes the result a function of the group's rows alone, so a
task that runs again gives the same places.

The tokenizer is a file: *.json is read by tokenizers, *.tiktoken (ranks of the same vocabulary) by tiktoken, which gives
the same ids five times as fast and is the default. The query and the pipeline take the ids that tokenizers gives for *.json
with add_special_tokens=False alone: a special token's string in a text becomes its id. Without `special` it is ordinary text.

Nulls and repeats: a null text is empty, so its only token is the end token; a null doc_id is kept. Repeated rows are
documents of their own. An empty table gives an empty result. Only doc_id and text are read, so other columns may clash.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, read

CAPACITY, END = 1024, 2
SPECIAL = {"<|endoftext|>": 50256}  # the added tokens of byte_bpe_50k.json, which the ranks do not have
_SPECIAL = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")
GROUP_PIECES = 100_000  # about as many one task packs, of less than 100 bytes each
PIECES = "doc_id long, piece int, start long, length long, ids binary"
PLACES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def with_special(encode, text: str) -> list[int]:
    """Ids of a text, cut where a special token stands, so that none is merged across it."""
    ids: list[int] = []
    for k, part in enumerate(_SPECIAL.split(text)):
        ids += [SPECIAL[part]] if k % 2 else encode(part)
    return ids


def encoder(path: str, special: bool = False):
    """texts -> lists of ids. special: strings of SPECIAL become their ids."""
    if path.endswith(".tiktoken"):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        if special:
            return lambda texts: [with_special(own.encode_ordinary, x) for x in texts]
        return lambda texts: [own.encode_ordinary(x) for x in texts]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = not special
    return lambda texts: [x.ids for x in tok.encode_batch_fast(texts, add_special_tokens=False)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, special: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit)."""

    def run(batches):
        encode = encoder(tokenizer, special)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                docs_, texts = (batch.column(c).slice(k, 256).to_pylist() for c in (0, 1))
                rows: dict = {"doc_id": [], "piece": [], "start": [], "length": [], "ids": []}
                for doc, found in zip(docs_, encode([x or "" for x in texts]), strict=True):
                    ids = np.array([*found, end], "<u4")
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        for name, value in zip(rows, (doc, piece, a, b - a, ids[a:b].tobytes()), strict=True):
                            rows[name].append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["piece"], pa.int32()), pa.array(rows["start"], pa.int64()), pa.array(rows["length"], pa.int64()), pa.array(rows["ids"], pa.binary())],
                    names=list(rows))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """For lengths in the order given: the sequence of each and its offset there."""
    counts = np.zeros(capacity + 1, np.int64)  # open sequences by gap; of gap 0 none is counted
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for i, length in enumerate(lengths.tolist()):
        rest = capacity - length
        # Growth of the sum: one more sequence of gap g - length (none if that is full) and one fewer of gap g; a new one has g = capacity.
        growth = 2 * (counts[: rest + 1] - counts[length:]) + 2
        growth[0] -= 1
        growth = np.where(counts[length:] > 0, growth, np.iinfo(np.int64).max)
        new = 2 * counts[rest] + 1 if rest else 0
        best = int(growth.argmin())
        if growth[best] <= new:
            gap = best + length
            at = open_[gap].pop()
            counts[gap] -= 1
        else:
            gap, at = capacity, made
            made += 1
        sequence[i], offset[i] = at, capacity - gap
        if gap > length:
            counts[gap - length] += 1
            open_[gap - length].append(at)
    return sequence, offset


def pack(cut: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """cut (doc_id, piece, start, length, ids_crc32, nr) with sequence_id and offset; nr is what equal rows are told apart by."""

    def run(key, table):
        table = table.drop_columns("group")
        length, place = table.column("length").to_numpy(), table.column("place").to_numpy()
        late = length < capacity // 4
        order = np.lexsort((place, np.where(late, 0, -length), late))
        table = table.drop_columns("place").take(pa.array(order))
        sequence, offset = sum_of_squares(length[order], capacity)
        number = pa.array(sequence + (key[0].as_py() << 32))
        return table.append_column("sequence_id", number).append_column("offset", pa.array(offset))

    group = F.pmod(F.xxhash64("doc_id", "piece", "nr"), F.lit(groups)).alias("group")
    place = F.xxhash64("doc_id", "piece", "length", "ids_crc32").alias("place")
    return cut.select("doc_id", "piece", "start", "length", "ids_crc32", place, group).groupBy("group").applyInArrow(run, PLACES)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, group_pieces: int = GROUP_PIECES, special: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Join pieces(), with the same `special`, on doc_id and piece for the ids."""
    cut = pieces(docs, tokenizer or default_tokenizer(), capacity, end, special).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    # The number is written down with the piece, so it stays when a task runs again.
    cut = materialize(cut.withColumn("nr", F.monotonically_increasing_id()), "pieces")
    return pack(cut, max(1, -(-cut.count() // group_pieces)), capacity)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), special=True)


QUERIES = {"op3_packing": op3_packing}
ORACLES = {}
