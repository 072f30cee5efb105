import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyledger.llm import op1_planes, op2_packing, op4_sentencepiece
from skyledger.llm.chunked_tokens import ChunkEncoder, Recent
from skyledger.llm.common import scratch_path

WORD, BYTE, MODEL = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["a  b   c ", " x", "x\n\n y", "I'm don't 'sx it's!'s!", "ΑΣ ΣΑΣ İstanbul ǅ", "\x00a b", "a\x1cb\tc", "<|endoftext|> x<|startoftext|>", "", "  ", "日本 語 12345 ١٢", "ﬁ " + "x" * 200, "b ́c", "!", "a!b ! c"]


@pytest.mark.parametrize(("kind", "path"), [("word", WORD), ("byte", BYTE)])
def test_pre_tokens_give_the_library_ids(kind, path):
    coder = ChunkEncoder(path, kind, keep=20)
    assert coder.encode(ODD) == coder.whole(ODD)
    rng = random.Random(4)
    texts = ["".join(rng.choice("abEÉß '.,!?\n\t\x85 12²日-") for _ in range(rng.randrange(60))) for _ in range(300)]
    assert coder.encode(texts) == coder.whole(texts)
    with pytest.raises(ValueError, match="unknown kind"):
        ChunkEncoder(path, "other")


def test_recent_memory_is_bounded():
    memory = Recent(4)
    for k in range(20):
        new = memory.lacking({k, k - 1})
        memory.update((x, x) for x in new)
        assert len(memory) <= 4 and {k, k - 1} <= set(memory)


@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300), st.sampled_from(["bit", "byte"]))
@settings(max_examples=60, deadline=None)
def test_planes_round_trip(values, unit):
    ids = np.array(values, dtype="<u4")
    ends, planes = op1_planes.to_planes(ids, unit, lambda b: b)
    assert (op1_planes.from_planes(len(ids), unit, ends, planes, lambda b: b) == ids).all()


def test_planes_file(spark, odd_docs, no_docs):
    path = scratch_path(spark, "planes")
    op1_planes.write_planes(odd_docs, path, WORD, block_ids=500, unit="bit")
    rows = op1_planes.read_documents(spark, path).orderBy("start").collect()
    coder = ChunkEncoder(WORD, "word")
    given_ = Counter((r["doc_id"], coder.whole([r["text"] or ""])[0] + b"\x01\0\0\0") for r in odd_docs.collect())
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in rows) == given_
    at = 0
    for r in rows:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]) // 4)
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert ids == sorted(ids) and rows[0]["doc_id"] is None
    index = op1_planes.chunk_index(spark, path)
    assert "planes" not in index.columns and index.where("n_ids > 500").isEmpty()
    empty = scratch_path(spark, "planes")
    op1_planes.write_planes(no_docs, empty, WORD)
    assert op1_planes.read_documents(spark, empty).isEmpty()


def brute_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            min(fits)[0] -= n
        else:
            bins.append([capacity - n])
    return sorted(b[0] for b in bins)


@given(st.lists(st.integers(1, 40), max_size=120))
@settings(max_examples=120, deadline=None)
def test_plan_is_best_fit_decreasing(lengths):
    counts, used = Counter(lengths), Counter()
    for length, a, b, first, per_bin, at in op2_packing.best_fit_plan(counts, 40):
        for k in range(b - a):
            used[first + k // per_bin] += length
            assert used[first + k // per_bin] == at + (k % per_bin + 1) * length
    assert sum(used.values()) == sum(lengths)
    assert sorted(40 - v for v in used.values()) == brute_best_fit(lengths, 40)


def test_packing(spark, odd_docs, no_docs):
    packed = op2_packing.pack(odd_docs, BYTE, capacity=64).collect()
    coder = ChunkEncoder(BYTE, "byte")
    whole = Counter((r["doc_id"], len(coder.whole([r["text"] or ""])[0]) // 4 + 1) for r in odd_docs.collect())
    assert sum(r["length"] for r in packed) == sum(n * c for (_, n), c in whole.items())
    by_bin = {}
    for r in packed:
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_bin.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    long = sorted((r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in packed if r["doc_id"] == 5)
    assert all(n == 64 for _, _, n, _ in long[1:]) and b"".join(x[3] for x in long)[:-4] == coder.whole([next(r["text"] for r in odd_docs.collect() if r["doc_id"] == 5)])[0]
    assert op2_packing.pack(no_docs, BYTE).isEmpty()
    sequences = op2_packing.sequences(op2_packing.pack(odd_docs, BYTE, capacity=64))
    assert sequences.where("n_ids <> octet_length(ids) / 4").isEmpty()


def test_agendas_agree_with_the_library():
    merges = op4_sentencepiece.Merges(MODEL)
    assert merges.splits_at_marks
    rng = random.Random(2)
    chunks = ["▁" + "".join(rng.choice("abcdeénthe.,'19日\n") for _ in range(rng.randrange(31))) for _ in range(400)]
    theirs = [tuple(x) for x in merges.library.encode([c[1:].replace("▁", " ") for c in chunks])]
    heap = [merges.merge_heap(c) for c in chunks]
    for c, a, b, right in zip(chunks, heap, merges.merge_rows(chunks), theirs, strict=True):
        assert a == b, c
        assert len(c) == 1 or a == right, c


def test_sentencepiece_texts(spark, odd_docs, no_docs):
    sp = op4_sentencepiece.Merges(MODEL).library
    rows = op4_sentencepiece.digest_texts(odd_docs, MODEL).collect()
    want = Counter()
    for r in odd_docs.collect():
        ids = sp.encode(r["text"] or "", add_eos=True)
        want[r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:4] for r in rows) == want and not any(r["n_mismatched"] for r in rows)
    assert op4_sentencepiece.digest_texts(no_docs, MODEL).isEmpty()
    spans = op4_sentencepiece.encode_texts(odd_docs.where("doc_id = 4"), MODEL).first()
    assert spans["ids"] == sp.encode("  double  spaces \n\n and\ttabs  ", add_eos=True)


def test_queries_against_the_library(spark):
    """The registered queries on the smallest documents."""
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    coder, at = ChunkEncoder(WORD, "word"), 0
    found = {r["doc_id"]: r for r in op1_planes.query(spark, sf).collect()}
    for doc in sorted(docs):
        ids = coder.whole([docs[doc]])[0] + b"\x01\0\0\0"
        r = found[doc]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    pieces = op2_packing.query(spark, sf).collect()
    total = sum(r["length"] for r in pieces)
    assert len({r["sequence_id"] for r in pieces}) <= -(-total // 2048) + 1
