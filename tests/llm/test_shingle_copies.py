import random

import corpus_pipeline as C

from skyledger.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(a, b):
    sets = [set(zip(*(t.lower().split()[k:] for k in range(5)), strict=False)) for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def edited(words, rng, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"x{rng.randrange(10**9)}"
    return out


def test_recall_against_all_pairs(spark):
    """Copies of similarities about 0.8, in small groups and in one that fills a bucket."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(60, 300))]
        texts += [" ".join(edited(base, rng, max(1, round(len(base) * part)))) for part in (0.0, 0.01, 0.018, 0.024, 0.035)]
    hot = [word() for _ in range(200)]
    texts += [" ".join(edited(hot, rng, 2)) for _ in range(120)]
    group = list(range(len(texts)))
    near = {(i, j): jaccard(texts[i], texts[j]) for i in group for j in range(i)}
    assert sum(0.8 <= s < 1 for s in near.values()) > 100 and sum(0.7 <= s < 0.8 for s in near.values()) > 10
    for (i, j), s in near.items():
        if s >= 0.8 and group[i] != group[j]:
            a, b = sorted((group[i], group[j]))
            group = [a if g == b else g for g in group]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA)
    kept = {r["doc_id"] for r in C.one_of_near_copies(spark, docs, "").collect()}
    assert kept == set(group)


def test_copies_among_texts_that_share_a_long_passage(spark):
    """Many texts of one boilerplate, far from each other, and some true near copies among them."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    shared = [word() for _ in range(150)]
    texts = [shared + [word() for _ in range(46)] for _ in range(1500)]
    copies = [t[:150] + edited(t[150:], rng, 3) for t in texts[:60]]
    texts = [" ".join(t) for t in texts + copies]
    far, near = [jaccard(texts[0], texts[k]) for k in (1, 70)], [jaccard(texts[k], texts[1500 + k]) for k in range(60)]
    assert 0.55 < min(far) and max(far) < 0.68 and min(near) >= 0.8
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA)
    found = near_copies.near_copies(docs).groupBy("root").agg({"least": "min"}).collect()
    assert {r[1]["doc_id"] for r in found} == set(range(1500))


def test_rows_that_share_an_id(spark):
    """A text without a copy stays though its id is also a copy's; of copies under one id one stays."""
    rng = random.Random(6)
    a, b, c = ([f"w{rng.randrange(5000)}" for _ in range(80)] for _ in range(3))
    texts = [(1, a), (2, a), (2, b), (3, c), (3, edited(c, rng, 1)), (3, c), (None, a), (None, a)]
    docs = spark.createDataFrame([(k, " ".join(t), "en", "s", 0) for k, t in texts], SCHEMA)
    kept = [(r["doc_id"], r["text"]) for r in C.one_of_near_copies(spark, docs, "").collect()]
    assert len(kept) == 5 and (1, " ".join(a)) in kept and (2, " ".join(b)) in kept
    assert sum(k == 3 for k, _ in kept) == 1 and kept.count((None, " ".join(a))) == 2


def test_sets_and_keys():
    assert len(near_copies.shingle_set(b" \n")) == 0 and near_copies.band_keys(near_copies.shingle_set(b"")) == []
    assert near_copies.shingle_set(b"Two words").tolist() == near_copies.shingle_set(b"two  WORDS").tolist()
    a = near_copies.shingle_set(b"a b c d e f g a b c d e")
    assert len(a) == 7 and len(near_copies.band_keys(a)) == near_copies.BANDS


def test_no_pair_is_left_out_of_a_bucket_of_near_misses(spark, monkeypatch):
    """Texts that are all just too far from each other, and share nearly all bands: true copies among them
    are neighbours by chance only, and longer keys do not part them."""
    monkeypatch.setattr(near_copies, "BESIDE", 1)
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    shared = [word() for _ in range(174)]
    texts = [shared + [word() for _ in range(26)] for _ in range(500)]
    copies = [t[:174] + edited(t[174:], rng, 3) for t in texts[:40]]
    texts = [" ".join(t) for t in texts + copies]
    far, near = [jaccard(texts[0], texts[k]) for k in (1, 70)], [jaccard(texts[k], texts[500 + k]) for k in range(40)]
    assert 0.74 < min(far) and max(far) < 0.8 and min(near) >= 0.8
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA)
    found = near_copies.near_copies(docs).groupBy("root").agg({"least": "min"}).collect()
    assert {r[1]["doc_id"] for r in found} == set(range(500))


def test_pairs_of_groups_are_all_that_are_near_and_few_more(spark, monkeypatch):
    """Against all pairs, with units of few rows; pairs within a group are left out."""
    monkeypatch.setattr(near_copies, "PAIR_ROWS", 8)
    rng = random.Random(12)
    sets = []
    for _ in range(12):
        base = rng.sample(range(1, 1 << 40), rng.randrange(5, 90))
        sets += [sorted({*rng.sample(base, len(base) - k), *(rng.randrange(1, 1 << 40) for _ in range(k))}) for k in (0, 0, *(rng.randrange(1 + len(base) // 6) for _ in range(10)))]
    roots = [k % 3 for k in range(len(sets))]
    table = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "cls long, hashes array<long>")
    first = near_copies.first_shingles(table).join(spark.createDataFrame(list(enumerate(roots)), "cls long, root long"), "cls")
    pairs = near_copies.pairs_of_groups(first)
    got = {(r["a"], r["b"]) for r in pairs.collect()}
    alike = lambda i, j: len({*sets[i]} & {*sets[j]}) / len({*sets[i]} | {*sets[j]})
    want = {(i, j) for j in range(len(sets)) for i in range(j) if roots[i] != roots[j] and alike(i, j) >= near_copies.LEAST}
    assert len(want) > 50 and want <= got and all(roots[i] != roots[j] for i, j in got)
    assert {(r["a"], r["b"]) for r in near_copies.confirmed(pairs, table).collect()} == want


def test_a_large_group_is_connected_by_few_pairs(spark, monkeypatch):
    """Many near copies of one text share nearly all bands: most pairs would only say again what others
    have said. No link is lost, also not that of the copies further out."""
    real, asked = near_copies.confirmed, []
    monkeypatch.setattr(near_copies, "confirmed", lambda pairs, sets: asked.append(pairs.count()) or real(pairs, sets))
    rng = random.Random(13)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = [edited(base, rng, rng.choice((1, 1, 2, 2, 2, 5))) for _ in range(600)]
    texts += [[f"v{rng.randrange(10**6)}" for _ in range(60)] for _ in range(20)]
    docs = spark.createDataFrame([(k, " ".join(t), "en", "s", 0) for k, t in enumerate(texts)], SCHEMA)
    found = near_copies.near_copies(docs).groupBy("root").agg({"least": "min"}).collect()
    assert {r[1]["doc_id"] for r in found} == {0, *range(600, 620)}
    assert sum(asked) < 30 * len(texts)
