import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from skyledger.llm import common, op7_simhash
from skyledger.llm.components import components


def brute_components(fps, budget):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def clustered(n, seed, flips):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 40))]
    out = set()
    while len(out) < n:
        x = rng.choice(centres) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randrange(flips)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize(("n", "flips"), [(2, 2), (60, 6), (400, 9)])
def test_trie_gives_the_components_of_all_links(n, flips):
    fps = clustered(n, n, flips)
    edges = op7_simhash.trie_links(np.array(fps, dtype=np.uint64), np.array([0]), 4)
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in edges.T.tolist())
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges.T.tolist():
        a, b = find(a), find(b)
        assert a != b  # a forest
        parent[max(a, b)] = min(a, b)
    assert [find(i) for i in range(n)] == brute_components(fps, 4)


@pytest.mark.parametrize("unit_rows", [16, 4096])
def test_links_over_spark(spark, unit_rows):
    fps = clustered(300, 9, 7) + [0]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    marked = spark.createDataFrame([(k, f) for k, f in enumerate(signed)] + [(1000 + k, signed[0]) for k in range(50)] + [(None, signed[1])], "doc_id long, fp long")
    rows = op7_simhash.link_fingerprints(marked, 4, unit_rows).collect()
    want = brute_components(fps, 4)
    assert len(rows) == 352
    for r in rows:
        k = r["doc_id"] if r["doc_id"] is not None and r["doc_id"] < 1000 else (0 if r["doc_id"] is not None else 1)
        assert r["component_id"] == want[k]


@pytest.mark.parametrize("budget", [2, 4])
def test_masks_meet_all_links(budget):
    """Two numbers within the budget agree under a mask, at every step; masks only grow."""
    rng, whole = random.Random(4), (1 << 64) - 1
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x
        for k in rng.sample(range(64), budget):
            y ^= 1 << k
        mask = 0
        for _ in range(5):
            masks = [m & whole for m in op7_simhash.block_masks(budget, mask)]
            assert len(masks) <= (budget + 2) * (budget + 1) // 2 and all(m & mask == mask for m in masks)
            mask = next(m for m in masks if not (x ^ y) & m)


def test_a_crowded_key_makes_rows_in_proportion(spark):
    """100,000 fingerprints that share half of their bits: no unit is crowded, no link is lost."""
    rng = random.Random(8)
    low = sorted({rng.getrandbits(40) for _ in range(99_900)})
    planted = [(x, x ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20, 40))) for x in rng.sample(low, 50)]
    fps = sorted({*low, *(y for _, y in planted)})
    distinct = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = {(r["a"], r["b"]) for r in op7_simhash.near_links(distinct).collect()}
    near = {frozenset(x) for x in links}
    assert all((a ^ b).bit_count() <= 4 for a, b in links) and all(frozenset(p) in near or len(set(p)) < 2 for p in planted)
    rows = op7_simhash.keyed(distinct.selectExpr("fp", "0L AS mask"), [0], 4)
    assert rows.count() == 15 * len(fps)


def test_hot_keys_are_few_and_joined(spark):
    keys = [0] * 700 + [1] * 300 + list(range(2, 300))
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int")
    sizes = common.stash(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "sizes")
    assert {r["k"] for r in common.hot_keys(sizes).collect()} == {0, 1} and common.hot_keys(sizes, 1000) is None
    got = sorted((r["i"], r["n"]) for r in common.join_spread(rows, sizes, ["k"]).collect())
    assert got == sorted((i, keys.count(k)) for i, k in enumerate(keys))


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {r["node"]: r["root"] for r in rows}
    assert len({roots[k] for k in range(201)}) == 1 and len({roots[k] for k in range(1000, 1300)}) == 1 and roots[0] != roots[1000] and 5000 not in roots
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_fingerprints(spark, odd_docs, no_docs):
    text = "The quick BROWN fox É jumps\x0bover É the lazy dog The quick BROWN fox É"
    words = ["the", "quick", "brown", "fox", "É", "jumps", "over", "É", "the", "lazy", "dog", "the", "quick", "brown", "fox", "É"]
    hashes = [xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert op7_simhash.simhash(text.encode(), 4) == want
    assert op7_simhash.simhash(b"Two words", 4) == xxh64_intdigest(b"two words", 42) and op7_simhash.simhash(b" \n", 4) == 0
    rows = op7_simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 9 and {r["component_id"] for r in rows if r["doc_id"] in (2, 3)} == {2} and [r["fingerprint"] for r in rows if r["doc_id"] == 2] == ["0" * 16]
    assert op7_simhash.near_duplicates(no_docs).isEmpty()
