import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyledger.llm import op3_pseudonyms, op9_flac, op10_divergence

KEY = b"test"


@given(st.integers(1, 10**12), st.data())
@settings(max_examples=60, deadline=None)
def test_permutation_has_an_inverse(size, data):
    v = data.draw(st.integers(0, size - 1))
    new = op3_pseudonyms.permute(v, size, KEY, "kind")
    assert 0 <= new < size and op3_pseudonyms.permute(new, size, KEY, "kind", back=True) == v


def test_permutation_is_one_to_one():
    assert sorted(op3_pseudonyms.permute(v, 1000, KEY, "a") for v in range(1000)) == list(range(1000))


def test_formats_are_kept():
    finder = op3_pseudonyms.Finder(KEY)
    text = 'card 4111-1111-1111-1111, phone +1 (437) 555-0689, ip 152.143.12.1. born 1987-02-28 or 28/02/1987; an.30@mail1.example.com token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" DE89 3704 0044 0532 0130 00 ssn 123-45-6789'
    new, found = finder.replace(text)
    assert len(new) == len(text) and Counter(k for _, _, k in found) == Counter(("card", "phone", "ip", "iso", "day", "email", "secret", "iban", "ssn"))
    for a, b, kind in found:
        assert new[a:b] != text[a:b], kind
        assert re.sub("[a-z]", "a", re.sub(r"\d", "9", new[a:b].lower())) == re.sub("[a-z]", "a", re.sub(r"\d", "9", text[a:b].lower())) or kind in ("secret", "iban"), kind
    card = re.sub(r"\D", "", new[found[0][0] : found[0][1]])
    assert op3_pseudonyms.luhn_digit(card[:-1]) == card[-1]
    assert finder.replace("again 4111-1111-1111-1111")[0] == "again " + new[5:24]
    iban = next(new[a:b] for a, b, k in found if k == "iban").replace(" ", "")
    assert op3_pseudonyms.iban_sum(iban) == 1
    for plain in ("1234567890123456", "1987-02-30", "999.1.1.1", "version 2.0.1", "123456", "666-12-3456", "a@b"):
        assert finder.replace(plain) == (plain, [])


def test_pseudonyms_over_spark(odd_docs, no_docs):
    rows = op3_pseudonyms.pseudonymise(odd_docs, KEY, ("doc_id", "lang")).collect()
    given_ = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    assert len(rows) == 9 and all(r["text"] == given_[r["doc_id"]] for r in rows)
    assert op3_pseudonyms.pseudonymise(no_docs, KEY).isEmpty()


def payloads():
    rng = np.random.default_rng(1)
    raw = [b"", b"a" * 576, rng.integers(0, 256, 5000, dtype=np.uint8).tobytes(), "héllo wörld ".encode() * 900]
    raw += [(np.cumsum(rng.integers(-1, 2, 80_000)) % 256).astype(np.uint8).tobytes(), (np.sin(np.arange(9000) / 30) * 100 + 128).astype(np.uint8).tobytes()]
    return [op9_flac.fill(p) for p in raw]


@pytest.mark.parametrize("predictor", [None, ([30, -15], 4), ([1], 0)])
@pytest.mark.parametrize("seek_every", [1, 4, 1000])
def test_flac_round_trip(predictor, seek_every):
    given_ = payloads()
    media = op9_flac.Writer(seek_every, predictor).encode(given_)
    for p, d in zip(given_, op9_flac.Reader().decode(media), strict=True):
        assert (np.frombuffer(d.samples, dtype=np.uint8) ^ 0x80).tobytes() == p
        assert sum(n for _, n, _ in d.blocks) == len(p) and [s for s, _, _ in d.blocks] == list(range(0, len(p), 576))


def test_flac_partitions_and_escapes():
    """A frame spelled by hand: two Rice partitions, the second one escaped."""
    x = np.zeros(576, dtype=np.int64)
    x[:288], x[288:] = np.arange(288) % 7 - 3, (np.arange(288) * 37) % 200 - 100
    fold = lambda v: 2 * v if v >= 0 else -2 * v - 1
    bits = f"{8 << 1:08b}" + "00" + "0001" + "0010"
    for v in x[:288].tolist():
        u = fold(v)
        bits += "0" * (u >> 2) + "1" + f"{u & 3:02b}"
    bits += "1111" + f"{8:05b}" + "".join(f"{v & 255:08b}" for v in x[288:].tolist())
    bits += "0" * (-len(bits) % 8)
    body = int(bits, 2).to_bytes(len(bits) // 8, "big")
    head = bytes([0xFF, 0xF8, 0x24, 0x02, 0x00])
    crc = lambda b, c: int(c.of(np.frombuffer(b, dtype=np.uint8), np.array([0]), np.array([len(b)]))[0])
    frame = head + bytes([crc(head, op9_flac.Checksum(op9_flac.POLY_8, 8))]) + body
    frame += crc(frame, op9_flac.Checksum(op9_flac.POLY_16, 16)).to_bytes(2, "big")
    samples = x.astype(np.int8).tobytes()
    info = (576).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | 576).to_bytes(8, "big") + hashlib.md5(samples).digest()
    stream = b"fLaC\x80\x00\x00\x22" + info + frame
    assert op9_flac.Reader().decode([stream])[0].samples == samples


def test_damage_is_seen():
    media = op9_flac.Writer().encode(payloads())[3]
    for at in (len(media) // 2, len(media) - 1, 500):
        broken = bytearray(media)
        broken[at] ^= 16
        with pytest.raises((ValueError, KeyError, IndexError)):
            op9_flac.Reader().decode([bytes(broken)])
    assert op9_flac.number_bytes(127) == b"\x7f" and op9_flac.number_bytes(128) == b"\xc2\x80" and op9_flac.number_bytes(0x20AC) == "€".encode()


def test_media_over_spark(odd_docs, no_docs):
    rows = op9_flac.from_flac(op9_flac.to_flac(odd_docs)).collect()
    given_ = Counter((r["doc_id"], op9_flac.fill((r["text"] or "").encode())) for r in odd_docs.collect())
    assert Counter((r["doc_id"], bytes(r["payload"])) for r in rows) == given_
    assert len({bytes(r["media"]) for r in rows if r["doc_id"] == 1}) == 1
    pcm = op9_flac.pcm_blocks(op9_flac.from_flac(op9_flac.to_flac(odd_docs.where("doc_id = 5")))).orderBy("first_sample").collect()
    assert zlib.crc32(b"".join(bytes(r["pcm"]) for r in pcm)) == zlib.crc32(next(bytes(r["payload"]) for r in rows if r["doc_id"] == 5))
    assert op9_flac.from_flac(op9_flac.to_flac(no_docs)).isEmpty()


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    twice, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if twice[w] > 1:
            covered |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_rules_of_odd_rows(spark, odd_docs, no_docs):
    extra = spark.createDataFrame([(20, "a b c a b c a b\na b\na b\n\x0b\n\n x|y", "en"), (21, "one\x85two three 🎉🎉", "en")], "doc_id long, text string, lang string")
    docs = odd_docs.select("doc_id", "text", "lang").unionByName(extra)
    table = op10_divergence.counted(docs)
    rows = op10_divergence.judge(table, op10_divergence.references(docs)).collect()
    given_ = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(rows) == 11
    for r in rows:
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == brute_counts(given_[r["doc_id"]]), r["doc_id"]
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["kept"] and r["base_failed"])
    none = op10_divergence.counted(no_docs)
    assert op10_divergence.judge(none, op10_divergence.references(no_docs)).isEmpty()
    assert {r["kept"] for r in op10_divergence.judge(op10_divergence.counted(docs.where("doc_id <> 5")), {}).collect()} == {False}


def test_windows_beyond_the_low_bits(spark, monkeypatch):
    texts = ["a b c a b c a b", "a b c", "a b", "", "the cat sat on the mat and the cat sat on the hat " * 40, " ".join(map(str, range(300)))]
    rows = spark.createDataFrame([(k, t, t.split()) for k, t in enumerate(texts)], "doc_id int, text string, words array<string>").selectExpr("*", "size(words) AS n_words")
    few = {r["doc_id"]: r["places"] for r in op10_divergence.with_places(rows).collect()}
    monkeypatch.setattr(op10_divergence, "PLACE_BITS", 1)
    many = {r["doc_id"]: r["places"] for r in op10_divergence.with_places(rows).collect()}
    for k, text in enumerate(texts):
        w = text.split()
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        assert few[k] == many[k] == [i for i, x in enumerate(windows) if windows.count(x) > 1]


def test_divergence_is_that_of_its_definition(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    table = op10_divergence.counted(docs)
    refs = op10_divergence.references(docs)
    rows = {r["doc_id"]: r for r in op10_divergence.judge(table, refs).collect()}

    def js(p, q):
        p, q = np.array(p, dtype=float), np.array(q, dtype=float)
        m = (p + q) / 2
        half = lambda a: np.sum(a[a > 0] * np.log2(a[a > 0] / m[a > 0]))
        return max(0.0, (half(p) + half(q)) / 2) ** 0.5

    for r in docs.limit(25).collect():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", r["text"]) if w]
        short = Counter(w.lower() for w in words)
        best = min(_both(js, r["text"], words, short, ref) for ref in refs.values())
        assert (rows[r["doc_id"]]["class_distance"], rows[r["doc_id"]]["word_distance"]) == pytest.approx(best[1:], abs=1e-6)


def _both(js, text, words, short, ref):
    import unicodedata

    kinds = {"Lu": 0, "Nd": 1, "Ll": 6}
    counts = [0] * 7
    for ch in text:
        cat = unicodedata.category(ch)
        counts[kinds[cat] if cat in kinds else 2 if ch in ".,;:!?'\"()-" else 4 if ch in " \t\n\x0b\f\r" else 5 if ch in "#*$%&|<>" else 3] += 1
    c = js([x / len(text) for x in counts], ref["classes"])
    p = [short[w] / max(1, len(words)) for w in ref["words"]]
    q = list(ref["words"].values())
    w = js([*p, 1 - sum(p)], [*q, 1 - sum(q)])
    return c + w, c, w


def test_rules_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    twin = con.sql(op10_divergence.ORACLE)
    rows = op10_divergence.query(spark, sf)
    names = sorted(rows.columns)
    assert names == sorted(twin.columns)
    assert sorted(tuple(r[c] for c in names) for r in rows.collect()) == sorted(tuple(r[twin.columns.index(c)] for c in names) for r in twin.fetchall())
