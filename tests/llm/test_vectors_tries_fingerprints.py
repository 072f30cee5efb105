"""Operators 11 to 13 against plain versions, on whole small tables and on odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64

from skyledger import llm
from skyledger.llm import op11_whitening, op12_prefix_trie, op13_winnowing

SF = "/root/testdata/sf0.001"


# whitening


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def check_whitened(got, x):
    """``got`` rows against NumPy's eigenvectors of the distinct ``x`` by id."""
    fit = np.unique(np.array(list({tuple(v) for v in x.values()})), axis=0)
    n, mean = len(fit), fit.mean(axis=0)
    values, turns = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    values, turns = values[::-1], turns[:, ::-1]
    sums = [int(s) for s in fit.sum(axis=0)]
    found = {}
    for r in got:
        found.setdefault(r["component"], []).append(r)
        assert r["n"] == n and r["deviation"] == sum((n * int(v) - s) ** 2 for v, s in zip(x[r["vec_id"]], sums, strict=True))
        assert abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9
    for k, rows in found.items():
        want = np.array([(x[r["vec_id"]] - mean) @ turns[:, k - 1] / np.sqrt(values[k - 1]) for r in rows])
        have = np.array([r["whitened"] for r in rows])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-7
    return found


def test_op11_is_numpys_whitening(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = {r["vec_id"]: np.floor(256 * np.array(r["embedding"])).astype(int) for r in table}
    found = check_whitened(llm.QUERIES["op11_whitening"](spark, SF).collect(), x)
    assert {k: len(v) for k, v in found.items()} == dict.fromkeys(range(1, 5), len(table))


def test_op11_takes_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25, 1.0]), (2, [0.5, -0.25, 1.0]), (3, [-1.0, 2.0, 0.004]), (4, [-0.004, 0.0, 0.0]), (5, None), (6, [1.0, None, 0.0]), (7, [nan, 0.0, 0.0]), (8, [0.0, inf, 0.0]), (9, [1.0, 2.0]), (10, []), (10, [3.0, -0.0, 1.0])]
    odd = vectors_of(spark, [(i, v, 0) for i, v in rows]).withColumns({"x": F.lit("extra"), "n": F.lit(1), "block": F.lit(None)})
    whole = op11_whitening.whole_numbers(odd)
    got = op11_whitening.whiten(whole, op11_whitening.whitening(op11_whitening.fit_list(whole))).collect()
    kept = {1, 2, 3, 4, 10}
    check_whitened(got, {i: np.floor(256 * np.array(v, dtype=np.float32)).astype(int) for i, v in rows if i in kept and v})
    assert {r["vec_id"] for r in got} == kept and max(r["component"] for r in got) == 3


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]])
def test_op11_without_variance_gives_no_rows(spark, tmp_path, rows):
    vectors_of(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert llm.QUERIES["op11_whitening"](spark, str(tmp_path)).collect() == []


def test_op11_of_huge_entries(spark):
    whole = op11_whitening.whole_numbers(vectors_of(spark, [(i, [v, 1.0], 0) for i, v in enumerate((1e30, -1e30, 3.0))]))
    got = op11_whitening.whiten(whole, op11_whitening.whitening(op11_whitening.fit_list(whole))).collect()
    assert {r["deviation"] for r in got} == {None, (3 * 768 - 767) ** 2} and all(np.isfinite(r["whitened"]) for r in got)


def test_pairs_of_close_and_equal_eigenvalues():
    for spread in (np.r_[2.0, 2.0, 2.0, 2.0, 2.0, np.ones(40)], 1 + 1e-5 * np.arange(60.0), np.r_[1e6, 1.0, 1e-3, 1e-3, np.zeros(20)]):
        turn = np.linalg.qr(np.random.default_rng(3).standard_normal((len(spread),) * 2))[0]
        v = turn * spread @ turn.T
        values, vectors = op11_whitening.leading_pairs(lambda u, v=v: v @ u, len(spread))
        assert np.allclose(values, np.sort(spread)[::-1][:4], rtol=1e-8, atol=1e-12)
        assert np.abs(v @ vectors - vectors * values).max() <= 1e-12 * spread.max() and np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12


# tries


def plain_trie(rows):
    talks = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            talks.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in talks.items()}
    nodes = {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        seq = own.get(c - int(np.fmod(c, 5)), [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), {"members": [], "ends": []})["members"].append(c)
        nodes[tuple(seq)]["ends"].append(c)
    children = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    out = {}
    for path in sorted(nodes, key=len, reverse=True):
        n, kids = nodes[path], children.get(path, [])
        bytes_ = len(path[-1][1].encode()) if path else 0
        leaves = sum(out[k][5] for k in kids) if kids else 1
        saved = (len(n["members"]) - 1) * bytes_ + sum(out[k][6] for k in kids)
        parent = nodes[path[:-1]]["members"][0] if path else None
        out[path] = (n["members"][0], len(path), parent, len(n["members"]), len(kids), leaves, saved, hashlib.sha256(",".join(map(str, n["ends"])).encode()).hexdigest())
    return sorted(out.values(), key=str)


def trie_rows(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_op12_is_the_plain_trie(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(llm.QUERIES["op12_prefix_trie"](spark, SF)) == plain_trie(rows)


def odd_talks():
    rng = np.random.default_rng(5)
    rows = []
    for c in (*range(-7, 40), 1000, 10**12):
        n = 0 if c == 3 else 45 if c in (10, 11, 25) else int(rng.integers(1, 12))
        rows += [(c, i, ("user", "assistant")[i % 2], "abé"[rng.integers(3)] * (1 + int(rng.integers(2)))) for i in range(n)]
    rows += [(50, 0, None, None), (50, None, "user", ""), (50, 0, None, None), (51, 3, "user", "x"), (51, 3, "user", "a"), (None, 1, "user", "lost"), (52, 0, "u", ":se"), (53, 0, "u:", "se")]
    rows += [(c, 0, "user", "the same") for c in range(2000, 2060)]
    return rows


def odd_frame(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return frame.withColumns({"name": F.lit("extra"), "j": F.lit(1), "bytes": F.lit(None), "c": F.lit(2), "part": F.lit(0)})


def test_op12_takes_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(op12_prefix_trie, "IDS_BYTES", 40)  # ids that end in one node come in several blocks
    rows = odd_talks()
    found = op12_prefix_trie.prefix_trie(*op12_prefix_trie.rebuilt(op12_prefix_trie.placed_turns(odd_frame(spark, rows).repartition(7))))
    assert trie_rows(found) == plain_trie(rows)


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "a")], [(1, 0, "user", "a")], [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "user", "b")]])
def test_op12_of_few_turns(spark, rows):
    found = op12_prefix_trie.prefix_trie(*op12_prefix_trie.rebuilt(op12_prefix_trie.placed_turns(odd_frame(spark, rows))))
    assert trie_rows(found) == plain_trie(rows)


def test_op12_places_a_conversation_over_many_partitions(spark):
    rows = [(c, i, "user", str(i)) for c, n in ((1, 3), (2, 900), (3, 1), (4, 700)) for i in range(n)]
    placed = op12_prefix_trie.placed_turns(odd_frame(spark, rows))
    assert sorted((r["conv_id"], r["i"], r["bytes"]) for r in placed.collect()) == sorted((c, i + 1, len(t)) for c, i, _, t in rows)


# fingerprints


def plain_marks(text, k=5, w=8):
    words = re.findall(r"[^\x20\x09-\x0D]{1,16}", text)

    def hashed(run):
        seed = 42
        for word in run:
            seed = xxh64(word.encode(), seed=seed).intdigest()
        return (seed - (1 << 64) if seed >> 63 else seed) >> 24

    grams = [hashed(words[i : i + k]) for i in range(max(len(words) - k + 1, min(1, len(words))))]
    found = []
    for i in range(max(len(grams) - w + 1, min(1, len(grams)))):
        window = grams[i : i + w]
        place = i + max(j for j, g in enumerate(window) if g == min(window))
        if not found or found[-1][1] != place:
            found.append((min(window), place))
    return found


def plain_likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a or b else 1.0


def edited_text(text, following):
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def test_op13_is_plain_winnowing(spark):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    got = {r["doc_id"]: r for r in llm.QUERIES["op13_winnowing"](spark, SF).collect()}
    named: dict[str, set] = {}
    for (doc_id, text), (_, following) in zip(docs, docs[1:] + docs[:1], strict=True):
        r, edited = got[doc_id], edited_text(text, following)
        own, other, beside = plain_marks(text), plain_marks(edited), plain_marks(following)
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(plain_likeness(own, other)) and r["near_next"] == pytest.approx(plain_likeness(own, beside))
        for marks, name in ((own, r["fingerprint"]), (other, r["edited_fingerprint"])):
            named.setdefault(str(marks), set()).add(name)
    assert all(len(names) == 1 for names in named.values()) and len(set.union(*named.values())) == len(named)


def test_op13_takes_odd_rows(spark, odd_docs, no_docs, tmp_path):
    odd_docs.withColumns({"marks": F.lit(1), "range": F.lit(2), "at": F.lit(3), "next": F.lit("x")}).write.parquet(f"{tmp_path}/odd/documents.parquet")
    got = llm.QUERIES["op13_winnowing"](spark, f"{tmp_path}/odd").collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in odd_docs.collect())
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 1}
    assert by[2]["near_next"] < 1 and by[3]["near_next"] == 1.0  # nothing follows 3 but the null text of 2
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (2, 3)}) == 1
    assert by[None]["edited_sha256"] == hashlib.sha256(edited_text("a row without an id", "12 34 !!! ### %%%").encode()).hexdigest()
    no_docs.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert llm.QUERIES["op13_winnowing"](spark, f"{tmp_path}/none").collect() == []


def test_fingerprints_keep_places_and_find_shared_passages(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdef"), 6))
    passage = [word() for _ in range(12)]  # w + k - 1 words
    texts = [" ".join([word() for _ in range(n)] + passage + [word() for _ in range(m)]) for n, m in ((0, 30), (17, 3), (40, 0), (5, 5))] + ["x y x y " * 30, "only three words", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(m["hash"], m["place"]) for m in r["fingerprint"]] for r in op13_winnowing.fingerprints(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [plain_marks(t) for t in texts]
    assert set.intersection(*({h for h, _ in got[i]} for i in range(4)))


@pytest.mark.parametrize(("rows", "most"), [(7, 5), (3, 300), (1, 1000), (10**6, 1000)])
def test_next_documents_whatever_the_ranges(spark, rows, most):
    docs = spark.range(0, 400, 2).selectExpr("id * id AS doc_id", "'t' AS text").unionByName(spark.createDataFrame([(None, "t")], "doc_id long, text string"))
    got = {r["doc_id"]: r["next"]["doc_id"] for r in op13_winnowing.with_next(docs, ["doc_id"], F.xxhash64("text"), rows, most).collect()}
    ids = [*sorted((i for i in got if i is not None), reverse=True), None]
    assert [got[i] for i in ids] == ids[1:] + ids[:1]


def test_a_filter_on_likeness_costs_no_more_steps(spark):
    found = llm.QUERIES["op13_winnowing"](spark, SF)
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(found.where("near_edited > 0.4")) < 4 * size(found)
