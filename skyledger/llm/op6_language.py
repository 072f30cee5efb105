"""Operator 6: language identification by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything that is no letter counts as a space, and the 1- to 3-grams of
the whole text are hashed. The model is a matrix of log probabilities, a row for each hash and a
column for each language, which is broadcast (its size is fixed by ``bits`` and the number of
languages). A batch of texts is scored at once: the rows that its n-grams pick are summed text by
text. Naive Bayes takes n-grams for independent, which they are not; the sum is therefore scaled
to at most ``trust`` n-grams before it is turned into a probability.

The counts come from a bounded sample: of each of the ``most_languages`` values of ``lang`` that most
rows have, about ``per_language`` documents, and about ``max_docs`` of all, chosen by a hash of the id,
each of at most ``max_chars`` characters and whole. So neither the sample nor the matrix grows with
the rows or with a dirty ``lang``.

Defined results: a null text, or one without a letter, is ``und`` with score 0; with nothing to
learn from, every text is ``und``; repeated rows score alike; of languages of equal probability the
first by name is predicted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import carried, columns_of, documents, extended, held_out, map_texts, texts_of

UNKNOWN = "und"
#: Bytes of text that are hashed at once, unless one text alone is longer, and n-grams that are scored at once.
SCORE_BYTES, SCORE_GRAMS = 1 << 20, 1 << 18
ORDERS = 3


@dataclass
class Model:
    """``languages`` in order, the matrix ``log_p`` (hashes x languages) and the log ``prior``."""

    languages: list[str]
    log_p: np.ndarray
    prior: np.ndarray
    bits: int
    trust: int


class Grams:
    """Hashes of the n-grams of many texts at once."""

    def __init__(self, bits: int):
        self.shift = np.uint32(32 - bits)
        # code points of the first plane to their lower-case letter, a space for what is no letter
        plain = [ord(c.lower()[0]) if (c := chr(i)).isalpha() else 32 for i in range(0x10000)]
        self.table = np.array(plain, dtype=np.uint32)

    def letters(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The mapped characters of all texts, each with a space before and after, and where each starts."""
        joined = " " + "  ".join(texts) + " "
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        if len(points) and points.max() >= 0x10000:
            high = points >= 0x10000
            mapped = self.table[np.where(high, 32, points)]
            mapped[high] = [p if chr(p).isalpha() else 32 for p in points[high].tolist()]
        else:
            mapped = self.table[points]
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 2)])
        return mapped, starts

    def hashes(self, mapped: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each order, the hash of the n-gram that starts at each character and whether it
        counts: it holds a letter and ends before the next text."""
        out = []
        last = np.zeros(len(mapped), dtype=bool)
        last[starts[1:] - 1] = True
        letter = mapped != 32
        value, ok, crosses = mapped * np.uint32(0x9E3779B1), letter, np.zeros(len(mapped), dtype=bool)
        for n in range(1, ORDERS + 1):
            if n > 1:
                value = value[:-1] * np.uint32(0x85EBCA6B) + mapped[n - 1 :] * np.uint32(0xC2B2AE35)
                ok = ok[:-1] | letter[n - 1 :]
                crosses = crosses[:-1] | last[n - 2 : -1]
            mixed = (value ^ (value >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF)
            out.append((mixed >> self.shift, ok & ~crosses))
        return out


def train(sample: list[tuple[str, str]], bits: int = 16, trust: int = 60) -> Model:
    """Count the n-grams of ``(lang, text)`` rows; unseen ones have half a count."""
    languages = sorted({lang for lang, _ in sample})
    counts = np.full((1 << bits, len(languages)), 0.5)
    grams = Grams(bits)
    by_language: dict[str, list[str]] = {lang: [] for lang in languages}
    for lang, text in sample:
        by_language[lang].append(text)
    for k, texts in enumerate(by_language.values()):
        for at in range(0, len(texts), 500):
            mapped, starts = grams.letters(texts[at : at + 500])
            for h, ok in grams.hashes(mapped, starts):
                counts[:, k] += np.bincount(h[ok], minlength=1 << bits)
    n = np.array([len(texts) for texts in by_language.values()], dtype=np.float64)
    log_p = np.log(counts) - np.log(counts.sum(axis=0))
    return Model(languages, log_p.astype(np.float32), np.log(n / n.sum()) if len(n) else n, bits, trust)


def predict(model: Model, grams: Grams, texts: list[str]) -> tuple[list[str], list[float]]:
    """The likeliest language of each text and its probability."""
    if not model.languages:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    mapped, starts = grams.letters(texts)
    sums, n = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    for h, ok in grams.hashes(mapped, starts):
        # a long text's n-grams are added up in blocks
        for a in range(0, len(h), SCORE_GRAMS):
            part, counts = h[a : a + SCORE_GRAMS], ok[a : a + SCORE_GRAMS]
            rows = model.log_p[part]
            rows[~counts] = 0
            first, last = np.searchsorted(starts, [a, a + len(part) - 1], side="right") - 1
            here = np.maximum(starts[first : min(last, len(texts) - 1) + 1] - a, 0)
            sums[first : first + len(here)] += np.add.reduceat(rows, here, axis=0, dtype=np.float64)
            n[first : first + len(here)] += np.add.reduceat(counts.astype(np.int64), here)
    lettered = np.add.reduceat((mapped != 32).astype(np.int64), starts[:-1]) > 0
    z = model.prior + sums * (np.minimum(n, model.trust) / np.maximum(n, 1))[:, None]
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    return (
        [model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), lettered.tolist(), strict=True)],
        np.where(lettered, p[np.arange(len(texts)), best], 0.0).tolist(),
    )


def sample_languages(docs: DataFrame, keep, per_language: int, max_docs: int, most_languages: int, max_chars: int) -> list[tuple[str, str]]:
    """About ``per_language`` whole texts of each language among rows that ``keep`` allows, and about
    ``max_docs`` of all."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & keep)
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not sizes:
        return []
    each = min(per_language, max(1, max_docs // len(sizes)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], each / r["n"]) for r in sizes], "lang string, share double")
    # ``most_languages`` rows at most
    drawn = usable.join(F.broadcast(shares), "lang").where((F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000) & (F.length("text") <= max_chars))
    rows = drawn.groupBy("doc_id").agg(F.max(F.struct("lang", "text")).alias("x")).orderBy("doc_id").select("x.lang", "x.text").collect()
    return [(r["lang"], r["text"]) for r in rows]


def fit(docs: DataFrame, keep, per_language: int = 1000, max_docs: int = 20_000, most_languages: int = 200, max_chars: int = 40_000) -> Model:
    return train(sample_languages(docs.select("doc_id", "text", "lang"), keep, per_language, max_docs, most_languages, max_chars))


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` of ``docs``, ``lang_pred`` and ``score`` of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    slim = carried(docs, carry)

    def step():
        model = sent.value
        grams = Grams(model.bits)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores = predict(model, grams, texts_of(batch))
            return extended(batch, carry, lang_pred=pa.array(langs, pa.string()), score=pa.array(scores, pa.float64()))

        return run

    return map_texts(slim, step, f"{columns_of(slim, carry)}, lang_pred string, score double", SCORE_BYTES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = held_out(5, 0)
    return identify(docs, fit(docs, ~out)).select("doc_id", out.alias("held_out"), "lang_pred", "score")
