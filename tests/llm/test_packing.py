import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import packing

SF = "/root/testdata/sf0.001"


def check_places(rows, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, text in texts.items():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc.pop(doc), key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for rows_ in by_sequence.values():
        at = 0
        for r in sorted(rows_, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return len(by_sequence)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.op3_packing(spark, SF).collect()
    made = check_places(rows, {r.doc_id: r.text for r in docs.collect()})
    assert made <= 1.02 * -(-sum(r.length for r in rows) // 1024) + 1


def test_hard_texts(spark):
    texts = {1: None, 2: "", 3: "<|endoftext|> a", 4: "x" * 5000, 5: "ÄÖ 漢字 \U0001f600" * 900, 6: " \n\t ", 7: "same", 8: "same"}
    docs = spark.createDataFrame([(k, v, 0) for k, v in texts.items()], "doc_id long, text string, length int")
    check_places(packing.pack_documents(docs, group_pieces=3).collect(), texts)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def naive(lengths, capacity):
    """The rule by its definition: of all gaps, and a new sequence, the one after which the sum of squares is smallest (the smallest gap; a sequence of its own only if strictly better)."""
    gaps, places = [], []
    for length in lengths:
        def after(gap):
            counts = Counter(g for g in gaps if g)
            if gap is not None:
                counts[gap] -= 1
            counts[(capacity if gap is None else gap) - length] += 1
            return sum(n * n for g, n in counts.items() if g)

        fits = sorted({g for g in gaps if g >= length})
        best = min(fits, key=lambda g: (after(g), g), default=None)
        if best is None or after(None) < after(best):
            gaps.append(capacity)
            best, at = capacity, len(gaps) - 1
        else:
            at = max((k for k, g in enumerate(gaps) if g == best), key=lambda k: stamp[k])
        places.append((at, capacity - best))
        gaps[at] = best - length
        stamp[at] = len(places)
    return gaps, places


stamp = {}


def test_whole_runs_against_the_naive_rule():
    rng = np.random.default_rng(3)
    for capacity, n in ((10, 60), (64, 200), (37, 150)):
        for _ in range(5):
            lengths = rng.integers(1, capacity + 1, n)
            stamp.clear()
            gaps, places = naive(lengths.tolist(), capacity)
            sequence, offset = packing.sum_of_squares(lengths, capacity)
            assert list(zip(sequence.tolist(), offset.tolist(), strict=True)) == places and sequence.max() + 1 == len(gaps)


def test_repeated_rows_are_spread(spark):
    docs = spark.createDataFrame([(None, "same text")] * 600, "doc_id long, text string")
    rows = packing.pack_documents(docs, group_pieces=100).collect()
    assert len(rows) == 600 and len({r.sequence_id >> 32 for r in rows}) > 3


def test_both_libraries_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a, b = (packing.pieces(docs, public_tokenizers.path(f"byte_bpe_50k.{kind}")).orderBy("doc_id", "piece").collect() for kind in ("json", "tiktoken"))
    assert a == b


def test_rule_on_known_gaps():
    # 6 opens gap 4; 4 closes it; 5 opens gap 5; another 5 closes it.
    sequence, offset = packing.sum_of_squares(np.array([6, 4, 5, 5]), 10)
    assert sequence.tolist() == [0, 0, 1, 1] and offset.tolist() == [0, 6, 0, 5]


def test_special_tokens_as_the_plain_call_gives_them(spark, tmp_path):
    """The query and the pipeline's stage against tokenizers as it is, without encode_special_tokens."""
    import corpus_pipeline

    end = "<|endoftext|>"
    texts = [f"{end} a", f"a {end}", end, end * 3, f"  {end}  b\n{end}\n", f"don{end}'t", f"x{end[:-1]} {end} é{end}漢", f"<{end}>", f"word {end} " * 700, "none", "", None, end.upper(), f"1{end}2 3"]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert tok.encode(texts[0], add_special_tokens=False).ids == [50256, 257]
    assert {t.content: k for k, t in tok.get_added_tokens_decoder().items()} == packing.SPECIAL
    want = {}
    for k, text in enumerate(texts):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        want |= {(k, i): zlib.crc32(ids[max(0, first + 1024 * (i - 1)) : first + 1024 * i].tobytes()) for i in range(-(-len(ids) // 1024))}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for rows in (packing.op3_packing(spark, str(tmp_path)).collect(), corpus_pipeline.packing(spark, docs, "").collect()):
        assert {(r.doc_id, r.piece): r.ids_crc32 for r in rows} == want
    a, b = (packing.pieces(docs, public_tokenizers.path(f"byte_bpe_50k.{kind}"), special=True).orderBy("doc_id", "piece").collect() for kind in ("json", "tiktoken"))
    assert a == b
