"""Operator 4: SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A chunk of text starts as single characters. Its *agenda* holds every adjacent pair whose
concatenation is a piece, with that piece's score; the best-scoring pair (the leftmost of equals)
is merged, and the pairs it touched are entered anew, until no pair is left. What is not a piece
then falls back to bytes. The agenda comes in two forms with the same results: ``merge_heap``, a
priority queue for one chunk of any length in n log n steps, and ``merge_rows``, which keeps the
agendas of many short chunks as rows of one score matrix and pops the best pair of every row at
once.

No piece of such a vocabulary has the space mark after another character, so merges never cross
the place before a run of spaces, and a text's ids are those of its chunks (``splits_at_marks``
checks this on the vocabulary; a vocabulary without it is merged text by text). Each distinct
chunk of an Arrow batch is also encoded by the sentencepiece library, and the two answers are
compared; the library's stands where they differ, and ``n_mismatched`` counts those chunks of a text
(none in any table of the tests).

Defined results: null and empty texts have the end id alone and decode to the empty string.
Special symbols written in a text are ordinary text. Repeated rows give equal rows.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.chunked_tokens import Recent
from skyledger.llm.common import documents, map_texts, texts_of

MARK = "▁"
#: What is remembered of a chunk: its ids as text, and as numbers.
AS_TEXT, NUMBERS = itemgetter(0), itemgetter(1)
#: Chunks up to this many characters are merged as rows of a matrix, longer ones by the heap.
ROW_CHARS = 32


class Merges:
    """The vocabulary of a SentencePiece model and the agenda over it."""

    def __init__(self, path: str, keep: int = 300_000):
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=path)
        self.end = sp.eos_id()
        self.known = Recent(keep)  # chunk: its ids as text and as numbers, and whether the library's were others
        self.differed = False  # whether any chunk's were
        self.id_of, self.score, self.bytes_of = {}, np.zeros(len(sp), dtype=np.float64), {}
        for i in range(len(sp)):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_of[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id_of[piece], self.score[i] = i, sp.get_score(i)
        self.splits_at_marks = not any(MARK in p.lstrip(MARK) for p in self.id_of)
        self.line_end = MARK + "\n" if not any("\n" in p for p in self.id_of) else "\n"
        pairs = [
            (self.id_of[p[:k]] << 32 | self.id_of[p[k:]], i) for p, i in self.id_of.items() for k in range(1, len(p)) if p[:k] in self.id_of and p[k:] in self.id_of
        ]
        pairs.sort()
        self.pair_key, self.pair_id = (np.array([x[c] for x in pairs] or [-1], dtype=np.int64) for c in (0, 1))
        self._hash_pairs()

    def _hash_pairs(self) -> None:
        """The pairs in an open table of twice-the-pairs slots, probed linearly."""
        bits = max(4, (2 * len(self.pair_key)).bit_length())
        self.slot_shift, self.slot_mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key = np.full(1 << bits, -1, dtype=np.int64)
        self.slot_id = np.full(1 << bits, -1, dtype=np.int64)
        self.probes = 1
        for key, i, slot in zip(self.pair_key.tolist(), self.pair_id.tolist(), self._slot(self.pair_key).tolist(), strict=True):
            n = 1
            while self.slot_key[slot] != -1:
                slot, n = (slot + 1) & self.slot_mask, n + 1
            self.slot_key[slot], self.slot_id[slot], self.probes = key, i, max(self.probes, n)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.slot_shift).astype(np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids that pairs merge to, -1 where they don't."""
        keys = (left << 32) | right
        keys[(left < 0) | (right < 0)] = -2
        slot, out = self._slot(keys), np.full(keys.shape, -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            found = self.slot_key[slot]
            hit = found == keys
            out[open_[hit]] = self.slot_id[slot[hit]]
            more = ~hit & (found != -1)
            if not more.any():
                break
            open_, keys, slot = open_[more], keys[more], (slot[more] + 1) & self.slot_mask
        return out

    def spell(self, symbols: list[str]) -> tuple[int, ...]:
        out: list[int] = []
        for s in symbols:
            i = self.id_of.get(s)
            out += [i] if i is not None else [self.bytes_of[b] for b in s.encode()]
        return tuple(out)

    def merge_heap(self, chunk: str) -> tuple[int, ...]:
        symbols: list[str] = list(chunk)
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        agenda: list[tuple[float, int, int, int]] = []

        def enter(a: int, b: int) -> None:
            if 0 <= a and b < len(symbols) and (i := self.id_of.get(symbols[a] + symbols[b])) is not None:
                heapq.heappush(agenda, (-self.score[i], a, b, len(symbols[a]) + len(symbols[b])))

        for a in range(len(symbols) - 1):
            enter(a, a + 1)
        while agenda:
            _, a, b, size = heapq.heappop(agenda)
            if not symbols[a] or not symbols[b] or len(symbols[a]) + len(symbols[b]) != size:
                continue
            symbols[a], symbols[b] = symbols[a] + symbols[b], ""
            after[a] = after[b]
            if after[a] < len(symbols):
                before[after[a]] = a
            enter(before[a], a)
            enter(a, after[a])
        return self.spell([s for s in symbols if s])

    def merge_rows(self, chunks: list[str]) -> list[tuple[int, ...]]:
        """``merge_heap`` of many chunks of at most ``ROW_CHARS`` characters."""
        if not chunks:
            return []
        n, width = len(chunks), max(map(len, chunks))
        flat = "".join(chunks)
        size = np.fromiter(map(len, chunks), dtype=np.int64, count=n)
        held = np.arange(width)[None, :] < size[:, None]
        points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        distinct, which = np.unique(points, return_inverse=True)
        ids = np.full((n, width), -1, dtype=np.int64)
        ids[held] = np.array([self.id_of.get(chr(c), -1) for c in distinct], dtype=np.int64)[which]
        length = held.astype(np.int64)  # characters in the symbol that starts here, 0 inside one
        after = np.where(held, np.arange(1, width + 1)[None, :], width)
        before = np.broadcast_to(np.arange(-1, width - 1)[None, :], (n, width)).copy()
        to = np.full((n, width), -1, dtype=np.int64)  # what the symbol here and the next one merge to
        rows, cols = np.nonzero(held[:, 1:])
        to[rows, cols] = self.joined(ids[rows, cols], ids[rows, cols + 1])
        best = np.where(to >= 0, self.score[to], -np.inf)
        live = np.flatnonzero((to >= 0).any(axis=1))
        while len(live):
            a = best[live].argmax(axis=1)
            b = after[live, a]
            ids[live, a] = to[live, a]
            length[live, a] += length[live, b]
            length[live, b] = 0
            best[live, b] = -np.inf
            nxt = after[live, b]
            after[live, a] = nxt
            has = nxt < size[live]
            before[live[has], nxt[has]] = a[has]
            for r, left, right, ok in ((live, a, nxt, has), (live, before[live, a], a, before[live, a] >= 0)):
                r1, l1, r2 = r[ok], left[ok], right[ok]
                merged = self.joined(ids[r1, l1], ids[r1, r2])
                to[r1, l1] = merged
                best[r1, l1] = np.where(merged >= 0, self.score[merged], -np.inf)
            best[live[~has], a[~has]] = -np.inf
            live = live[best[live].max(axis=1) > -np.inf]
        kept = length > 0
        r, c = np.nonzero(kept)
        symbols, out = ids[r, c].tolist(), []
        ends = np.cumsum(kept.sum(axis=1)).tolist()
        unknown = {}
        for k in np.flatnonzero(ids[r, c] < 0).tolist():
            unknown[k] = tuple(self.bytes_of[x] for x in chunks[r[k]][c[k]].encode())
        at = 0
        if not unknown:
            for end in ends:
                out.append(tuple(symbols[at:end]))
                at = end
            return out
        for end in ends:
            row = symbols[at:end]
            out.append(tuple(row) if min(row) >= 0 else tuple(chain.from_iterable(unknown[at + k] if s < 0 else (s,) for k, s in enumerate(row))))
            at = end
        return out

    def cut(self, text: str) -> list[str]:
        """Chunks as they are spelled with the space mark; the first has the mark put before it.

        If no piece holds a line end, nothing merges with one, and a chunk ends there too: each
        line end gets a mark of its own for the cut, which is no part of the chunk after it.
        """
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if not self.splits_at_marks:
            return [marked]
        parts = marked.replace("\n", self.line_end).split(MARK)[1:]
        if self.line_end == "\n":
            bare = lambda p: False
        else:
            bare = lambda p: p[0] == "\n"
        if "" not in parts:
            return [p if bare(p) else MARK + p for p in parts]
        out, marks = [], MARK
        for p in parts[:-1]:
            if not p:
                marks += MARK
                continue
            if bare(p):
                out += [marks[1:], p] if len(marks) > 1 else [p]
            else:
                out.append(marks + p)
            marks = MARK
        p = parts[-1]
        if p and bare(p):
            out += [marks[1:], p] if len(marks) > 1 else [p]
        else:
            out.append(marks + p)
        return out

    def learn(self, chunks: set[str]) -> None:
        """Merge chunks that aren't known yet and compare them with the library's."""
        missing = sorted(self.known.lacking(chunks), key=len)
        short = [c for c in missing if len(c) <= ROW_CHARS]
        mine: list[tuple[int, ...]] = []
        for k in range(0, len(short), 4096):
            mine += self.merge_rows(short[k : k + 4096])
        mine += [self.merge_heap(c) for c in missing[len(short) :]]
        # the library puts the first mark itself: to a chunk that has one in place of it, to one that begins a line as a piece of its own
        theirs = self.library.encode([(c[1:] if c[0] == MARK else c).replace(MARK, " ") for c in missing], num_threads=1)
        for chunk, own, ids in zip(missing, mine, theirs, strict=True):
            right = tuple(ids if chunk[0] == MARK else ids[1:])
            differs = own != right and len(chunk) > 1
            self.differed |= differs
            self.known[chunk] = (" ".join(map(str, right if differs else own)), right if differs else own, differs)

    def encode(self, texts: list[str]) -> tuple[list[list[str]], list[int]]:
        """Chunks of each text, all of them known then, and how many of each text's differed."""
        cut = [self.cut(t) for t in texts]
        self.learn(set(chain.from_iterable(cut)))
        return cut, [sum(self.known[c][2] for c in chunks) for chunks in cut] if self.differed else [0] * len(cut)


@lru_cache(maxsize=1)
def worker_merges(model: str) -> Merges:
    """The vocabulary and the chunks known of this Python process, which serves many tasks."""
    return Merges(model)


def encode_texts(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids array<int>, decoded string, n_mismatched int`` of every whole text."""

    def step():
        merges = worker_merges(model)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            cut, bad = merges.encode(texts_of(batch))
            ids = [[*chain.from_iterable(merges.known[c][1] for c in chunks), merges.end] for chunks in cut]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(merges.library.decode(ids, num_threads=1), pa.string()), pa.array(bad, pa.int32())],
                names=["doc_id", "ids", "decoded", "n_mismatched"],
            )

        return run

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_texts(slim, step, "doc_id long, ids array<int>, decoded string, n_mismatched int")


def digest_texts(docs: DataFrame, model: str) -> DataFrame:
    """As ``encode_texts``, with the ids' and the decoded text's digests in place of both."""

    def step():
        merges = worker_merges(model)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            cut, bad = merges.encode(texts_of(batch))
            known = merges.known
            ids, spelled = [], []
            for chunks in cut:
                found = list(map(known.__getitem__, chunks))
                ids.append([*chain.from_iterable(map(NUMBERS, found)), merges.end])
                spelled.append(" ".join([*map(AS_TEXT, found), str(merges.end)]))
            decoded = merges.library.decode(ids, num_threads=1)
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            columns = [[len(x) for x in ids], [sha(s) for s in spelled], [sha(s) for s in decoded], bad]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int32()), strict=True)]],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_mismatched"],
            )

        return run

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_texts(slim, step, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_mismatched int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_texts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
