"""Operator 5: toxicity by multiple-instance learning.

Labels are known for documents, not for sentences. Each sentence gets a probability from a
logistic model over hashed words and word beginnings, and the document's is their noisy-or, one
minus the chance that no sentence is toxic. Training follows the gradient through the noisy-or
from document labels alone, so the weights settle on the words that make a single sentence
offend; scoring then says which sentences those are.

The model is fitted on the driver from a bounded sample of labelled documents (``max_docs`` of
them, half of either label, the least by a hash of the id, each of at most ``max_chars`` characters and taken whole) and
is a vector of ``1 << bits`` numbers, which is broadcast. Every row is scored over its whole text.
How readily it flags is set on documents that were not learned from: two models, each of one half of
the sample, score the other half, and the bias is raised as far as at most ``false_alarms`` of the
clean ones reach ``cut`` (``flagging``).

Defined results: null and empty texts have no sentence and score 0; repeated rows score alike; a
label that is null is not learned from, and of several labels of one id the larger counts; with no
usable label every score is 0.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import documents, held_out, labels, map_texts, texts_of

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W_]+")
BEGINNINGS = (4, 6)


@dataclass
class Model:
    """``weights`` by hashed feature and the sentence ``bias``."""

    weights: np.ndarray
    bias: float
    bits: int


def features(word: str, bits: int) -> list[int]:
    """Hashed features of a lower-case word: itself and its beginnings."""
    mask = (1 << bits) - 1
    out = [zlib.crc32(b"w" + word.encode()) & mask]
    out += [zlib.crc32(b"%d" % k + word[:k].encode()) & mask for k in BEGINNINGS if len(word) > k]
    return out


def labelled_sample(docs: DataFrame, marks: DataFrame, label: str, keep, max_docs: int, max_chars: int) -> list[tuple[str, int]]:
    """At most ``max_docs`` labelled texts that ``keep`` allows, half of them of either label at most."""
    known = marks.where(F.col(label).isNotNull() & keep).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    first = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("label > 0").orderBy(*first).limit(max_docs // 2).unionByName(known.where("label <= 0").orderBy(*first).limit(max_docs // 2))
    texts = docs.select("doc_id", F.col("text").cast("string")).where(F.length("text").between(1, max_chars))
    # ``max_docs`` ids at most
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max(F.struct("text", "label")).alias("x"))
    return [(r["text"], int(r["label"] > 0)) for r in rows.orderBy(*first).select("x.text", "x.label").collect()]


def train(sample: list[tuple[str, int]], bits: int = 18, steps: int = 200, rate: float = 0.1, shrink: float = 2e-4, least_docs: int = 8) -> Model:
    """Fit by proximal Adam on the noisy-or likelihood of document labels. Features of fewer than
    ``least_docs`` documents say nothing, and ``shrink`` draws weights to zero."""
    known: dict[str, list[int]] = {}
    entries: list[np.ndarray] = []
    per_sentence: list[int] = []
    per_doc: list[int] = []
    for text, _ in sample:
        n = 0
        for sentence in SENTENCE.findall(text.lower()):
            found = set()
            for word in WORD.findall(sentence):
                if word not in known:
                    known[word] = features(word, bits)
                found.update(known[word])
            if found:
                entries.append(np.fromiter(found, dtype=np.int32, count=len(found)))
                per_sentence.append(len(found))
                n += 1
        per_doc.append(n)
    size = 1 << bits
    y = np.array([label for _, label in sample], dtype=np.float64)
    has = np.array(per_doc, dtype=np.int64) > 0
    if not has.any() or y[has].min() == y[has].max():
        return Model(np.zeros(size, dtype=np.float32), -30.0 if not y.any() else 0.0, bits)
    feature = np.concatenate(entries)
    sentence = np.repeat(np.arange(len(per_sentence)), per_sentence)
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    seen = np.bincount(np.unique(np.repeat(doc, per_sentence) * size + feature) % size, minlength=size)
    used = seen >= least_docs
    feature, sentence = feature[used[feature]], sentence[used[feature]]
    w, b = np.zeros(size), -5.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    n = len(sample)
    for t in range(1, steps + 1):
        z = np.bincount(sentence, weights=w[feature], minlength=len(per_sentence)) + b
        total = np.bincount(doc, weights=np.logaddexp(0, z), minlength=n)
        push = np.where(y > 0, -1 / np.expm1(np.maximum(total, 1e-9)), 1.0) * has / n
        g = push[doc] / (1 + np.exp(-z))
        grad = np.bincount(feature, weights=g[sentence], minlength=size)
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        pace = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w -= pace * (m / (1 - 0.9**t))
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(pace * shrink, 1.0), 0)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    return Model(w.astype(np.float32), float(b), bits)


def flagging(sample: list[tuple[str, int]], cut: float = 0.7, false_alarms: float = 0.01, most: float = 1.0, **params) -> float:
    """What to add to the bias, 0 to ``most``: the most at which at most ``false_alarms`` of the clean
    documents score ``cut`` or more under a model of the sample's other half."""
    raises = np.linspace(0.0, most, 21)
    flagged, clean = np.zeros(len(raises)), 0
    for k in (0, 1):
        scorer = Scorer(train(sample[k::2], **params))
        for text, label in sample[1 - k :: 2]:
            if not label:
                z = scorer.logits(text)[1]
                scores = -np.expm1(-np.logaddexp(0, z[None, :] + raises[:, None]).sum(axis=1))
                flagged, clean = flagged + (scores >= cut), clean + 1
    fine = np.flatnonzero(flagged <= false_alarms * clean)
    return float(raises[fine[-1]]) if clean and len(fine) else 0.0


def fit(sample: list[tuple[str, int]], cut: float = 0.7, **params) -> Model:
    model = train(sample, **params)
    return Model(model.weights, model.bias + flagging(sample, cut, **params), model.bits)


class Scorer:
    """Sentence probabilities of a text; the weights of words are kept up to ``keep`` words."""

    def __init__(self, model: Model, keep: int = 300_000):
        self.model, self.keep = model, keep
        self.known: dict[str, tuple[int, ...]] = {}

    def logits(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        model, known, spans, z = self.model, self.known, [], []
        weights = model.weights
        for m in SENTENCE.finditer(text):
            # each feature counts once in a sentence, as in training
            found: set[int] = set()
            for word in WORD.findall(m.group().lower()):
                got = known.get(word)
                if got is None:
                    if len(known) >= self.keep:
                        known.clear()
                    got = known[word] = tuple(features(word, model.bits))
                found.update(got)
            if found:
                spans.append(m.span())
                z.append(weights[list(found)].sum(dtype=np.float64))
        return spans, np.array(z) + model.bias

    def sentences(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Where the sentences with a word stand, and the probability of each."""
        spans, z = self.logits(text)
        return spans, 1 / (1 + np.exp(-z))

    def document(self, p: np.ndarray) -> float:
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0


def score(docs: DataFrame, model: Model, offending: float = 0.5) -> DataFrame:
    """``doc_id, score, sentences``: the noisy-or of every whole text, and the sentences of
    probability ``offending`` at least as ``start, end`` (characters) and ``p``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def step():
        scorer = Scorer(sent.value)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores, found = [], []
            for text in texts_of(batch):
                spans, p = scorer.sentences(text)
                scores.append(scorer.document(p))
                found.append([{"start": spans[k][0], "end": spans[k][1], "p": float(p[k])} for k in np.flatnonzero(p >= offending)])
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(found, kind)], names=["doc_id", "score", "sentences"])

        return run

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_texts(slim, step, "doc_id long, score double, sentences array<struct<start:int,end:int,p:double>>")


def query(spark: SparkSession, sf_dir: str, max_docs: int = 4000, max_chars: int = 40_000) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = held_out(3, 1)
    model = fit(labelled_sample(docs, labels(spark, sf_dir), "toxic", ~out, max_docs, max_chars))
    return score(docs, model).select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("sentences").alias("n_offending")
    )
