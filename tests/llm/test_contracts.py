"""The registered queries against plain versions of what they return, over a whole small table."""

import hashlib
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from xxhash import xxh64_intdigest

from skyledger import llm
from skyledger.llm import op3_pseudonyms, op4_sentencepiece, op9_flac

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows_of(spark, name):
    return {r["doc_id"]: r for r in llm.QUERIES[name](spark, SF).collect()}


def test_op1(spark, texts):
    from tokenizers import Tokenizer

    tok, got, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), rows_of(spark, "op1_bit_planes"), 0
    tok.encode_special_tokens = True
    for k in sorted(texts):
        ids = [*tok.encode(texts[k], add_special_tokens=False).ids, 1]
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert set(got) == set(texts)


def test_op2(spark, texts):
    from tokenizers import Tokenizer

    tok, pieces, bins = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}, {}
    tok.encode_special_tokens = True
    for r in llm.QUERIES["op2_best_fit"](spark, SF).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, text in texts.items():
        ids, at = [*tok.encode(text, add_special_tokens=False).ids, 0], 0
        for n, r in enumerate(sorted(pieces[k], key=lambda r: r["piece"])):
            part = ids[at : at + r["length"]]
            assert (r["piece"], r["start"], r["ids_crc32"]) == (n, at, zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
            at += r["length"]
        assert at == len(ids) and all(r["length"] == 2048 for r in pieces[k] if r["piece"])
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    lengths, plain = sorted((r["length"] for rs in pieces.values() for r in rs), reverse=True), []
    for n in lengths:  # best fit, a bin at a time
        fits = [i for i, room in enumerate(plain) if room >= n]
        if fits:
            plain[min(fits, key=lambda i: plain[i])] -= n
        else:
            plain.append(2048 - n)
    assert len(bins) == len(plain)


def test_op4(spark, texts):
    from sentencepiece import SentencePieceProcessor

    sp, got = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), rows_of(spark, "op4_sentencepiece")
    for k, text in texts.items():
        ids = [*sp.encode(text), sp.eos_id()]
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest(), 0)
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"], got[k]["n_mismatched"]) == want
    assert set(got) == set(texts) and op4_sentencepiece.Merges(public_tokenizers.path("piece_bpe_32k.model")).splits_at_marks


def test_op6(spark, texts):
    got = rows_of(spark, "op6_language")
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(got) == set(texts) and {r["lang_pred"] for r in got.values()} <= {"und", *truth.values()}
    for k, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", texts[k]))
    known = [k for k in texts if got[k]["held_out"] and truth[k] and got[k]["lang_pred"] != "und"]
    assert sum(got[k]["lang_pred"] == truth[k] for k in known) >= 0.97 * len(known)


def test_op7(spark, texts):
    prints = {}
    for k, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    group = {k: k for k in prints}
    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 4 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    got = rows_of(spark, "op7_simhash")
    assert {k: (r["fingerprint"], r["component_id"]) for k, r in got.items()} == {k: (f"{prints[k]:016x}", group[k]) for k in texts}


def test_op9(spark, texts):
    got, reader = rows_of(spark, "op9_flac"), op9_flac.Reader()
    for k, text in texts.items():
        raw, r = text.encode(), got[k]
        payload = raw + b"\xff" * (576 - len(raw) % 576 if len(raw) % 576 or not raw else 0)
        media = op9_flac.Writer().encode([payload])[0]
        assert (np.frombuffer(reader.decode([media])[0].samples, dtype=np.uint8) ^ 0x80).tobytes() == payload
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == want
        x = [b - 128 for b in payload]
        steps = [b - a for a, b in zip(x, x[1:], strict=False)]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        assert r["feature"] == f"min={min(x)};max={max(x)};sum={sum(x)};crossings={crossings};energy={sum(s * s for s in steps)}"
    assert set(got) == set(texts)


def test_media_and_pcm_as_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    op9_flac.write_media(docs, str(tmp_path / "media"))
    read = op9_flac.read_media(spark, str(tmp_path / "media"))
    op9_flac.write_pcm(read, str(tmp_path / "pcm"))
    back = {}
    for r in spark.read.parquet(str(tmp_path / "pcm")).orderBy("doc_id", "first_sample").collect():
        so_far = back.setdefault(r["doc_id"], b"")
        assert r["first_sample"] == len(so_far) and r["n_samples"] == len(r["pcm"])
        back[r["doc_id"]] = so_far + bytes(r["pcm"])
    assert back == {r["doc_id"]: op9_flac.fill((r["text"] or "").encode()) for r in docs.collect()}


def luhn(digits):
    doubled = [int(c) for c in digits[::-1]]
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(doubled)) % 10 == 0


def valid_by_itself(kind, s):
    """Whether a whole string is a valid value of a kind, by rules written apart from the operator's."""
    digits = re.sub(r"\D", "", s)
    if kind == "card":
        grouped = [len(g) for g in re.split("[ -]", s)]
        return (grouped in ([4, 4, 4, 4], [4, 6, 5], [4, 6, 4]) or (len(grouped) == 1 and 13 <= grouped[0] <= 19)) and luhn(digits) and len(set(digits)) > 1
    if kind == "iban":
        plain = s.replace(" ", "")
        return len(plain) == op3_pseudonyms.IBAN_SIZES.get(plain[:2]) and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    if kind == "ssn":
        return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    if kind == "phone":
        return digits[-10] in "23456789" and digits[-7] in "23456789"
    if kind == "ip":
        return all(p == str(int(p)) and int(p) < 256 for p in s.split("."))
    y, m, d = (int(x) for x in s.split("-"))
    return 1900 <= y < 2100 and 1 <= m <= 12 and 1 <= d <= [31, 29 if y % 4 == 0 and (y % 100 or y % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m - 1]


SHAPES = {
    "card": r"\d{13,19}|\d{4}([ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5}", "iban": r"[A-Z]{2}\d{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?", "ssn": r"\d{3}-\d{2}-\d{4}",
    "phone": r"(\+1[ .-]?)?(\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}", "ip": r"\d{1,3}(\.\d{1,3}){3}", "iso": r"\d{4}-\d{2}-\d{2}",
}


def every_value(text, longest=44):
    """Every substring that stands apart and is a valid value of a kind."""
    out = []
    for a in range(len(text)):
        if not (text[a].isdigit() or text[a].isupper() or text[a] in "(+") or (a and re.match(r"[\w.+-]", text[a - 1])):
            continue
        for b in range(a + 7, min(len(text), a + longest) + 1):
            if b < len(text) and (text[b].isalnum() or text[b] in "_-" or (text[b] in "./" and text[b + 1 : b + 2].isdigit())):
                continue
            out += [(a, b, k) for k, shape in SHAPES.items() if re.fullmatch(shape, text[a:b]) and valid_by_itself(k, text[a:b])]
    return out


GIVEN = [
    "card 4111 1111 1111 1111 12 items", "BE68 5390 0754 7034 2024", "BE68 5390 0754 7034 CODE", "pay DE89 3704 0044 0532 0130 00.", "AA12 GB82 WEST 1234 5698 7654 32, please",
    "call 011-155-0000 or (415) 555-0132 or +1 212.555.0199", "123-45-6789 and 000-45-6789", "2024-02-29 and 2023-02-29", "host 10.0.0.256 or 10.0.0.25", "4845168114407329 12/27",
]


def test_op3_finds_every_value(texts):
    finder = op3_pseudonyms.Finder(b"a key")
    for text in [*GIVEN, *(t[:20_000] for t in texts.values())]:
        new, found = finder.replace(text)
        assert len(new) == len(text)
        for a, b, kind in every_value(text):
            assert any(x < b and a < y for x, y, _ in found), (kind, text[a:b])
        for a, b, kind in found:
            if kind in ("iban", "ssn", "phone", "ip", "iso"):
                assert valid_by_itself(kind, text[a:b]) and valid_by_itself(kind, new[a:b]), (kind, text[a:b], new[a:b])
            elif kind == "card":
                assert luhn(re.sub(r"\D", "", text[a:b])) and luhn(re.sub(r"\D", "", new[a:b]))
    kinds = [[k for _, _, k in finder.replace(t)[1]] for t in GIVEN]
    assert kinds == [["card"], ["iban"], ["iban"], ["iban"], ["iban"], ["phone", "phone"], ["ssn"], ["iso"], ["ip"], ["card"]]


def test_op3_long_names(texts):
    """Whole local parts are replaced, whatever their length, and one changed letter changes its piece."""
    finder = op3_pseudonyms.Finder(b"a key")
    for n in (1, 63, 64, 65, 200, 5000):
        name = ("Ab1" * n)[:n]
        new, found = finder.replace(f"to {name}@example.org")
        assert found == [(3, 3 + n, "email")] and new.endswith("@example.org") and len(new) == n + 15
        assert n < 63 or not any(new[3 + k : 3 + k + 32] == name[k : k + 32] for k in range(0, n - 32, 16))
    big = op3_pseudonyms.permute(1 << 5000, 1 << 6000, b"a key", "x")
    assert op3_pseudonyms.permute(big, 1 << 6000, b"a key", "x", back=True) == 1 << 5000 and big >> 5900


def test_op3(spark, texts):
    got = rows_of(spark, "op3_feistel_pseudonyms")
    finder = op3_pseudonyms.Finder(op3_pseudonyms.EXAMPLE_KEY)
    raw = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for k, text in raw.items():
        new, found = finder.replace(text) if text else (text, [])
        assert (got[k]["text"], got[k]["n_found"], got[k]["kinds"]) == (new, len(found), ",".join(x for _, _, x in found))
    spark.conf.set(op3_pseudonyms.KEY_SETTING, "another key")
    try:
        assert op3_pseudonyms.session_key(spark) == b"another key"
        other = rows_of(spark, "op3_feistel_pseudonyms")
    finally:
        spark.conf.unset(op3_pseudonyms.KEY_SETTING)
    assert any(other[k]["text"] != got[k]["text"] for k in got) and all(other[k]["kinds"] == got[k]["kinds"] for k in got)
