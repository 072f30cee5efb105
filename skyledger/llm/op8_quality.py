"""Operator 8: document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are shares of kinds of characters, its length, how
its words repeat, and whether the document had the line before, each of the line itself and of
both neighbours. The field adds a weight for each pair of neighbouring labels. Forward-backward
gives every line's chance to be good, and the mean of these, weighted by line length, is the
document's score.

Training takes documents' labels as those of their lines and climbs the field's likelihood with
Adam, on the driver, over a bounded sample (``max_docs`` labelled documents of at most
``max_chars`` characters, whole). The model is a few dozen numbers. Every row is scored over its
whole text: features are made for a block of lines at a time, of which three numbers a line are
kept, and chains are cut into segments that are walked side by side (``marginals``), so a text of
millions of lines takes steps by the thousand and bounded memory for each line.

Defined results: a null or empty text is one empty line and gets that line's score; repeated rows
score alike; with labels of one kind only, every score is that label; with none, 0.5.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import carried, columns_of, documents, extended, held_out, labels, map_texts, texts_of
from skyledger.llm.op5_toxicity import labelled_sample

KINDS = ("lower", "upper", "digit", "space", "stop", "symbol", "bar", "other")
OWN = len(KINDS) + 7
WIDTH = 3 * OWN + 3
#: Lines whose features are held at once, and characters of a line that are spread out at once.
BLOCK_LINES, LONG_LINE = 1 << 14, 1 << 18
WORD = re.compile(r"\S+")
#: Class numbers of the characters before U+0250; all later ones count as "other" or by case.
SYMBOLS, STOPS = "#*$%&<>@^~=_{}[]\\/", ".,;:!?'\"()-"


@dataclass
class Model:
    weights: np.ndarray  # of a good line's features
    pairs: np.ndarray  # [from, to], 0 bad and 1 good
    mean: np.ndarray
    scale: np.ndarray


def _kind(c: str) -> int:
    if c in SYMBOLS:
        return 5
    if c == "|":
        return 6
    if c in STOPS:
        return 4
    if c.isspace():
        return 3
    if c.isdigit():
        return 2
    if c.isupper():
        return 1
    return 0 if c.isalpha() else 7


class Lines:
    """Features of the lines of many texts at once."""

    def __init__(self):
        self.table = np.array([_kind(chr(i)) for i in range(0x10000)], dtype=np.uint8)

    def own(self, lines: list[str], again: np.ndarray) -> np.ndarray:
        """A row of each line's own features; ``again`` marks those that their text had before."""
        size = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
        out = np.zeros((len(lines), OWN))
        long = np.flatnonzero(size > LONG_LINE).tolist()
        short = lines
        if long:
            short = list(lines)
            for k in long:
                short[k] = ""
        n, distinct, doubled = (np.zeros(len(lines), dtype=np.int64) for _ in range(3))
        if short:
            points = np.frombuffer(("\n".join(short) + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4")
            kinds = self.table[np.minimum(points, 0xFFFF)]
            width = np.fromiter(map(len, short), dtype=np.int64, count=len(short)) + 1
            starts = np.cumsum(width) - width
            for k in range(len(KINDS)):
                out[:, k] = np.add.reduceat((kinds == k).view(np.uint8), starts, dtype=np.int64)
            out[:, KINDS.index("space")] -= 1  # the line end
            words = [x.split() for x in short]
            n[:] = list(map(len, words))
            distinct[:] = [len(set(w)) for w in words]
            doubled[:] = [sum(map(eq, w, w[1:])) for w in words]
        for k in long:
            out[k, : len(KINDS)], n[k], distinct[k], doubled[k] = self._long(lines[k])
        k = len(KINDS)
        out[:, :k] /= np.maximum(size, 1)[:, None]
        out[:, k] = np.log1p(n)
        out[:, k + 1] = np.minimum(size / np.maximum(n, 1), 40) / 10
        out[:, k + 2] = 1 - distinct / np.maximum(n, 1)
        out[:, k + 3] = doubled / np.maximum(n - 1, 1)
        out[:, k + 4] = again
        out[:, k + 5] = n == 0
        out[:, k + 6] = np.log1p(size) / 5
        return out

    def _long(self, line: str) -> tuple[np.ndarray, int, int, int]:
        """Characters of each kind, words, distinct words and words that repeat the one before, of a
        line too long to spread out at once."""
        kinds = np.zeros(len(KINDS), dtype=np.int64)
        for at in range(0, len(line), LONG_LINE):
            points = np.frombuffer(line[at : at + LONG_LINE].encode("utf-32-le", "surrogatepass"), dtype="<u4")
            kinds += np.bincount(self.table[np.minimum(points, 0xFFFF)], minlength=len(KINDS))
        n, doubled, last, seen = 0, 0, None, set()
        for m in WORD.finditer(line):
            word = m.group()
            n, doubled, last = n + 1, doubled + (word == last), word
            seen.add(word)
        return kinds, n, len(seen), doubled

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A row for each line, how many lines each text has, and the weight of each line."""
        lines, again, counts = split_lines(texts)
        own = self.own(lines, again)
        first, last = edges(counts)
        before = np.where(first[:, None], 0, np.roll(own, 1, axis=0))
        after = np.where(last[:, None], 0, np.roll(own, -1, axis=0))
        rows = np.concatenate([own, before, after, first[:, None], last[:, None], np.ones((len(lines), 1))], axis=1)
        return rows, counts, np.fromiter(map(len, lines), dtype=np.float64, count=len(lines)) + 1.0


def split_lines(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The lines of all texts, which of them their text had before, and how many each text has."""
    split = [t.split("\n") for t in texts]
    counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    again = np.zeros(int(counts.sum()), dtype=bool)
    at = 0
    for part in split:
        if len(part) > 1 and len(set(part)) < len(part):
            seen: set[str] = set()
            for k, x in enumerate(part, at):
                again[k] = x in seen
                seen.add(x)
        at += len(part)
    return list(chain.from_iterable(split)), again, counts


def edges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are their text's first and last ones."""
    ends = np.cumsum(counts)
    first, last = (np.zeros(int(ends[-1]) if len(ends) else 0, dtype=bool) for _ in range(2))
    first[ends - counts] = True
    last[ends - 1] = True
    return first, last


def _through(x: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Log weights ``(..., 2)`` of a line's labels carried over to the labels of the next one."""
    return np.stack([np.logaddexp(x[..., 0] + pairs[0, j], x[..., 1] + pairs[1, j]) for j in (0, 1)], axis=-1)


def marginals(z: np.ndarray, counts: np.ndarray, pairs: np.ndarray, most: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's chance to be good, the log partition of each chain, and the expected number of
    each pair of neighbouring labels over all chains.

    ``z`` is the score of good over bad. Chains are cut into segments of at most ``most`` lines. What
    a segment does to the labels before it is a matrix of two by two; those carry the forward and
    backward weights from segment to segment, and then all segments are walked side by side, longest
    first, so that a step is one operation on those that still go on. The results are exact.
    """
    starts = np.cumsum(counts) - counts
    pieces = (counts + most - 1) // most
    rank = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)  # of a segment in its chain
    start = np.repeat(starts, pieces) + rank * most
    length = np.minimum(np.repeat(counts, pieces) - rank * most, most)
    order = np.argsort(-length, kind="stable")
    start, length, rank = start[order], length[order], rank[order]
    longest = int(length[0]) if len(length) else 0
    going = np.searchsorted(-length, -np.arange(longest), side="left")  # segments longer than t
    enter, leave = np.zeros((len(start), 2)), np.zeros((len(start), 2))
    joints = _between_segments(z, start, length, rank, going, pairs) if len(start) > len(counts) else None
    if joints is not None:
        enter, leave = joints
    alpha, beta = np.zeros((len(z), 2)), np.zeros((len(z), 2))
    for t in range(longest):
        at = start[: going[t]] + t
        alpha[at] = enter if not t else _through(alpha[at - 1], pairs)
        alpha[at, 1] += z[at]
    if len(start):
        beta[start + length - 1] = leave
    for t in range(longest - 2, -1, -1):
        at = start[: going[t + 1]] + t
        nxt = beta[at + 1]
        good = nxt[:, 1] + z[at + 1]
        beta[at, 0] = np.logaddexp(pairs[0, 0] + nxt[:, 0], pairs[0, 1] + good)
        beta[at, 1] = np.logaddexp(pairs[1, 0] + nxt[:, 0], pairs[1, 1] + good)
    both = alpha + beta
    log_all = np.logaddexp(both[:, 0], both[:, 1])
    p = np.exp(both[:, 1] - log_all)
    at = np.flatnonzero(~edges(counts)[1])  # lines with a next one
    expected = np.zeros((2, 2))
    for a in range(2):
        for b in range(2):
            x = alpha[at, a] + pairs[a, b] + beta[at + 1, b] + (z[at + 1] if b else 0) - log_all[at]
            expected[a, b] = np.exp(x).sum()
    return p, log_all[starts], expected


def _between_segments(z: np.ndarray, start: np.ndarray, length: np.ndarray, rank: np.ndarray, going: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log weights with which each segment's first line is entered and its last one left."""
    # over[s, i, j]: of all labelings of segment s that end in j, after label i
    over = np.zeros((len(start), 2, 2))
    for t in range(len(going)):
        n = going[t]
        over[:n] = np.broadcast_to(pairs, (n, 2, 2)) if not t else _through(over[:n], pairs)
        over[:n, :, 1] += z[start[:n] + t, None]
    # segments by their rank in the chain, chains in order: a chain's next segment starts where one ends
    enter, leave = np.zeros((len(start), 2)), np.zeros((len(start), 2))
    at_start = {int(s): k for k, s in enumerate(start.tolist()) if rank[k]}
    ranks = np.argsort(rank, kind="stable")
    bounds = np.searchsorted(rank[ranks], np.arange(int(rank.max()) + 2))
    following = np.array([at_start.get(e, -1) for e in (start + length).tolist()])
    ending = _first_ends(z, start, length, rank, going, pairs)
    for r in range(int(rank.max())):
        here = ranks[bounds[r] : bounds[r + 1]]
        here = here[following[here] >= 0]
        nxt = following[here]
        enter[nxt] = _through(ending[here], pairs)
        ending[nxt] = np.stack([np.logaddexp(ending[here, 0] + over[nxt, 0, j], ending[here, 1] + over[nxt, 1, j]) for j in (0, 1)], axis=-1)
    for r in range(int(rank.max()) - 1, -1, -1):
        here = ranks[bounds[r] : bounds[r + 1]]
        here = here[following[here] >= 0]
        nxt = following[here]
        leave[here] = np.logaddexp(over[nxt, :, 0] + leave[nxt, 0:1], over[nxt, :, 1] + leave[nxt, 1:2])
    return enter, leave


def _first_ends(z: np.ndarray, start: np.ndarray, length: np.ndarray, rank: np.ndarray, going: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The log weights of the last line of each chain's first segment; zero for other segments."""
    out = np.zeros((len(start), 2))
    for t in range(len(going)):
        pick = np.flatnonzero(rank[: going[t]] == 0)
        if t:
            out[pick] = _through(out[pick], pairs)
        out[pick, 1] += z[start[pick] + t]
    return out


def train(sample: list[tuple[str, int]], steps: int = 150, rate: float = 0.08, shrink: float = 1e-3) -> Model:
    y = np.array([label for _, label in sample], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        weights = np.zeros(WIDTH)
        weights[-1] = 0.0 if not len(y) else (40.0 if y[0] else -40.0)
        return Model(weights, np.zeros((2, 2)), np.zeros(WIDTH), np.ones(WIDTH))
    x, counts, _ = Lines().features([t for t, _ in sample])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[-1], scale[-1] = 0.0, 1.0
    scale[scale == 0] = 1.0
    x = (x - mean) / scale
    truth = np.repeat(y, counts)
    # each document counts once, however many lines it has; both labels weigh alike
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    weight = np.repeat(share / counts, counts)
    w, pairs = np.zeros(WIDTH), np.zeros((2, 2))
    state = [np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)]
    inner = counts - 1
    pair_share = 1.0 / max(1, inner.sum())
    same = np.diag([(inner * (1 - y)).sum(), (inner * y).sum()])
    for t in range(1, steps + 1):
        p, _, expected = marginals(x @ w, counts, pairs)
        grad = np.concatenate([x.T @ (weight * (p - truth)) + shrink * w, ((expected - same) * pair_share).ravel() + 0.05 * pairs.ravel()])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad * grad
        step = rate * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-8)
        w, pairs = w - step[:WIDTH], pairs - step[WIDTH:].reshape(2, 2)
    return Model(w, pairs, mean, scale)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.lines = model, Lines()

    def lines_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each line's chance to be good, the lines of each text and the lines' weights."""
        lines, again, counts = split_lines(texts)
        w = self.model.weights / self.model.scale
        parts = np.stack([w[:OWN], w[OWN : 2 * OWN], w[2 * OWN : 3 * OWN]], axis=1)
        # what a line adds to its own score, to that of the next one and to that of the one before
        adds = np.concatenate([self.lines.own(lines[k : k + BLOCK_LINES], again[k : k + BLOCK_LINES]) @ parts for k in range(0, len(lines), BLOCK_LINES)])
        first, last = edges(counts)
        z = adds[:, 0] + first * w[-3] + last * w[-2] + w[-1] - self.model.mean @ w
        z += np.where(first, 0.0, np.roll(adds[:, 1], 1)) + np.where(last, 0.0, np.roll(adds[:, 2], -1))
        return marginals(z, counts, self.model.pairs)[0], counts, np.fromiter(map(len, lines), dtype=np.float64, count=len(lines)) + 1.0


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` of ``docs``, and ``score, n_lines, n_bad_lines`` of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    slim = carried(docs, carry)

    def step():
        scorer = Scorer(sent.value)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            p, counts, size = scorer.lines_of(texts_of(batch))
            at = np.cumsum(counts) - counts
            scores = np.clip(np.add.reduceat(p * size, at) / np.add.reduceat(size, at), 0.0, 1.0)
            bad = np.add.reduceat((p < 0.5).astype(np.int64), at)
            return extended(batch, carry, score=pa.array(scores, pa.float64()), n_lines=pa.array(counts, pa.int64()), n_bad_lines=pa.array(bad, pa.int64()))

        return run

    return map_texts(slim, step, f"{columns_of(slim, carry)}, score double, n_lines long, n_bad_lines long", 2 << 20)


def fit(docs: DataFrame, marks: DataFrame, keep, max_docs: int = 2000, max_chars: int = 40_000) -> Model:
    return train(labelled_sample(docs, marks, "quality", keep, max_docs, max_chars))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = held_out(3, 1)
    model = fit(docs, labels(spark, sf_dir), ~out)
    return score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines", "n_bad_lines")
