import re
import zlib

import corpus_pipeline as C
import public_tokenizers
from pyspark.sql import functions as F

from skyledger.llm import near_copies, op3_pseudonyms, op6_language
from skyledger.llm.chunked_tokens import ChunkEncoder

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    """Each stage on what the one before it kept, against a plain version of its decision."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = docs
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in C.STAGES[:-1]:
        kept = stage(spark, kept, SF).cache()
        assert tuple(kept.columns) == C.COLUMNS
        after = {r["doc_id"]: r for r in kept.collect()}
        assert set(after) <= set(before)
        gone = set(before) - set(after)
        if name == "language":
            assert all(not re.search(r"[^\W\d_]", before[k]["text"] or "") for k in gone)
        elif name == "quality":
            wrong = [k for k in before if k in marks and (k in after) != (marks[k] == 1)]
            assert len(wrong) <= 0.05 * len(before)
        elif name == "near_copies":
            sets = {k: set(near_copies.shingle_set(r["text"].encode()).tolist()) for k, r in before.items()}
            group = {k: k for k in sets}
            for k, x in sets.items():
                for j, y in sets.items():
                    if j < k and len(x & y) >= 0.8 * len(x | y) and group[j] != group[k]:
                        a, b = sorted((group[j], group[k]))
                        group = {i: a if g == b else g for i, g in group.items()}
            assert set(after) == set(group.values()) and gone
        else:
            finder = op3_pseudonyms.Finder(op3_pseudonyms.EXAMPLE_KEY)
            assert not gone and all(after[k]["text"] == finder.replace(r["text"])[0] for k, r in before.items())
        before = after
    coder = ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"), "byte")
    pieces = {}
    for r in C.STAGES[-1][1](spark, kept, SF).collect():
        pieces.setdefault(r["doc_id"], []).append((r["piece"], bytes(r["ids"]), r["ids_crc32"], r["length"]))
    assert set(pieces) == set(before)
    for k, parts in pieces.items():
        parts.sort()
        assert b"".join(p[1] for p in parts) == coder.whole([before[k]["text"]])[0] + bytes(4)
        assert all(zlib.crc32(p[1]) == p[2] and len(p[1]) == 4 * p[3] <= 8192 for p in parts)


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in C.STAGES:
            stage(spark, docs, SF).collect()
    assert C.known_language(spark, odd_docs, SF).where("text is null or text = ''").isEmpty()
    near = C.one_of_near_copies(spark, odd_docs, SF)
    assert near.where("doc_id = 1").count() == 1 and near.where("doc_id is null").count() == 1
    assert op6_language.UNKNOWN == "und" and C.ORACLE_SQL is None


def test_run_is_the_stages_in_turn(spark):
    got = C.run(spark, SF)
    assert got.agg(F.count_distinct("doc_id")).first()[0] > 100 and [n for n, _ in C.STAGES] == ["language", "quality", "near_copies", "personal_data", "packing"]
