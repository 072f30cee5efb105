"""Operator 7: SimHash near-duplicates by a binary-trie self-join.

Equal fingerprints make one class, found by a grouping that combines before it shuffles. Distinct
fingerprints are then joined with themselves at a Hamming distance of at most ``budget``:

* The 64 bits are cut into ``budget + 2`` blocks. Two fingerprints within the budget agree on two
  whole blocks at least, so each pair of blocks gives a key, and linked fingerprints meet under a
  key. Keys that one fingerprint alone has are dropped, and each other key is a unit of work.
* The fingerprints of a key with more than ``unit_rows`` of them differ in the bits outside its
  two blocks only. Those bits are cut into ``budget + 2`` blocks in turn, and pairs of these give
  longer keys; and so on, until no unit is crowded (few bits left allow few fingerprints). Each
  such step makes a fixed number of rows of one, so the work stays in proportion, and no link is lost.
* The sorted fingerprints of a unit are a binary trie: a node is a range of rows that share their
  leading bits. The join walks pairs of nodes together from the roots down, adds one to the
  differing bits of a pair whose branches differ, and prunes it beyond the budget. Small pairs
  are leaves and are compared bit by bit. A pair whose rows are all connected already is pruned
  too, so a unit gives a spanning forest of its links and never all pairs of a dense group.

Keys that hold a large share of the rows (``common.hot_keys``) are not shuffled to one task.

Components of the forest's edges give the rest. Defined results: null texts and texts without a
word have fingerprint zero and are linked like any others; a null ``doc_id`` keeps its row, and a
component's id is its smallest non-null one; repeated rows give repeated rows; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import documents, join_spread, map_texts, stash
from skyledger.llm.components import components

SEED = 42
#: Node pairs that one step of the walk expands, and rows of a pair of leaves.
STEP_PAIRS, LEAF_ROWS = 1 << 18, 4
#: Bits outside a key that make it small: 2 to the 12th fingerprints at most.
FREE_BITS = 12


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """The hashes of a text's shingles, repeats included; of a text of fewer words, that of all of
    them, and none of a text without a word."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    if len(words) < width:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], dtype="<u8")
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    return np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8", count=len(words) - width + 1)


def votes_of(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as an unsigned number."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: bytes, width: int) -> int:
    """The fingerprint of a text in UTF-8, as an unsigned number."""
    return votes_of(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's 64 bits as a signed long) of every whole text. Bytes A-Z
    are lower-cased and words end at ASCII white space, which is what ``bytes`` does."""

    def step():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            fps = np.array([simhash(t or b"", width) for t in texts], dtype="<u8").view("<i8")
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

        return run

    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), step, "doc_id long, fp long")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Forest:
    """Which rows are connected, and the edges that connected them."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.edges: list[np.ndarray] = []
        self._mark()

    def _mark(self) -> None:
        self.changes = np.concatenate([[0], np.cumsum(self.of[1:] != self.of[:-1])]) if len(self.of) else np.zeros(0, dtype=np.int64)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        linked = False
        while True:
            x, y = self.of[a], self.of[b]
            apart = x != y
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            high, low = np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart])
            roots, first = np.unique(high, return_index=True)
            self.edges.append(np.stack([a[first], b[first]]))
            to = np.arange(len(self.of))
            to[roots] = low[first]
            while True:
                onward = to[to]
                if (onward == to).all():
                    break
                to = onward
            self.of, linked = to[self.of], True
        if linked:
            self._mark()

    def joined(self, lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
        """Pairs of ranges whose rows are all in one component."""
        same = self.of[lo] == self.of[lo2]
        return same & (self.changes[lo] == self.changes[hi - 1]) & (self.changes[lo2] == self.changes[hi2 - 1])


def trie_links(fps: np.ndarray, starts: np.ndarray, budget: int) -> np.ndarray:
    """Edges ``(2, n)`` of row numbers: a spanning forest of the links within each unit.

    ``fps`` is unsigned and sorted within units; ``starts`` has where each unit starts.
    """
    n = len(fps)
    forest = Forest(n)
    ends = np.append(starts[1:], n)
    keep = ends - starts > 1
    lo, hi = starts[keep], ends[keep]
    zero = np.zeros(len(lo), dtype=np.int64)
    # a pair of nodes: two ranges of rows, the depth of both, the bits that differ above
    stack = [(lo, hi, lo, hi, zero, zero)]
    while stack:
        pairs = stack.pop()
        if len(pairs[0]) > STEP_PAIRS:
            half = len(pairs[0]) // 2
            stack += [tuple(p[half:] for p in pairs), tuple(p[:half] for p in pairs)]
            continue
        lo, hi, lo2, hi2, depth, bits = pairs
        open_ = ~forest.joined(lo, hi, lo2, hi2) if len(lo) else np.zeros(0, dtype=bool)
        lo, hi, lo2, hi2, depth, bits = (p[open_] for p in pairs)
        leaf = ((hi - lo <= LEAF_ROWS) & (hi2 - lo2 <= LEAF_ROWS)) | (depth == 64)
        if leaf.any():
            _compare(fps, forest, lo[leaf], hi[leaf], lo2[leaf], hi2[leaf], budget)
        if leaf.all():
            continue
        lo, hi, lo2, hi2, depth, bits = (p[~leaf] for p in (lo, hi, lo2, hi2, depth, bits))
        bit = (63 - depth).astype(np.uint64)
        mid, mid2 = _split(fps, lo, hi, bit), _split(fps, lo2, hi2, bit)
        own = lo == lo2
        children = [
            (lo, mid, lo2, mid2, bits),
            (mid, hi, mid2, hi2, bits),
            (lo, mid, mid2, hi2, bits + 1),
            (mid, hi, lo2, mid2, np.where(own, budget + 1, bits + 1)),  # of a node with itself, the same as the one before
        ]
        a, b, c, d, e = (np.concatenate(x) for x in zip(*children, strict=True))
        deep = np.tile(depth + 1, 4)
        ok = (e <= budget) & (b > a) & (d > c) & ~((a == c) & (b - a < 2))
        if ok.any():
            stack.append((a[ok], b[ok], c[ok], d[ok], deep[ok], e[ok]))
    return np.concatenate(forest.edges, axis=1) if forest.edges else np.zeros((2, 0), dtype=np.int64)


def _split(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where the rows of each range that have the bit set begin, by bisection of all ranges at once."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        going = lo < hi
        if not going.any():
            return lo
        mid = (lo + hi) >> 1
        one = ((fps[np.minimum(mid, len(fps) - 1)] >> bit) & np.uint64(1)).astype(bool)
        hi = np.where(going & one, mid, hi)
        lo = np.where(going & ~one, mid + 1, lo)


def _compare(fps: np.ndarray, forest: Forest, lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray, budget: int) -> None:
    wide, wide2 = int((hi - lo).max()), int((hi2 - lo2).max())
    for i in range(wide):
        for j in range(wide2):
            a, b = lo + i, lo2 + j
            ok = (a < hi) & (b < hi2) & (a != b)
            a, b = a[ok], b[ok]
            near = differing(fps[a], fps[b]) <= budget
            forest.link(a[near], b[near])


def block_masks(budget: int, mask: int = 0) -> list[int]:
    """The bits that ``mask`` leaves free are cut into ``budget + 2`` blocks; for each two of them,
    their bits and the mask's, as a signed long."""
    free = [i for i in range(64) if not mask >> i & 1]
    n = budget + 2
    cuts = [round(len(free) * k / n) for k in range(n + 1)]
    blocks = [sum(1 << i for i in free[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [m - (1 << 64) if m >> 63 else m for m in sorted({mask | x | y for x, y in combinations(blocks, 2)})]


def keyed(fps: DataFrame, masks: list[int], budget: int) -> DataFrame:
    """``mask, key, fp`` of fingerprints under all masks that follow theirs (``mask``, of ``masks``)."""
    follow = fps.sparkSession.createDataFrame([(m, block_masks(budget, m & ((1 << 64) - 1))) for m in masks], "mask long, masks array<long>")
    longer = fps.join(F.broadcast(follow), "mask").select("fp", F.explode("masks").alias("mask"))  # as many rows as masks
    return longer.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def near_links(distinct: DataFrame, budget: int = 4, unit_rows: int = 4096) -> DataFrame:
    """``a, b``: edges that connect the distinct fingerprints ``fp`` as their links do."""
    keys, masks = ["mask", "key"], [0]
    fps, found = distinct.select("fp", F.lit(0).cast("long").alias("mask")), None
    # a key with few bits left free has few distinct fingerprints, however many texts there are
    crowded = (F.col("n") > unit_rows) & (F.bit_count("mask") < 64 - FREE_BITS)
    while True:
        rows = keyed(fps, masks, budget)
        sizes = stash(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "keys")
        met = join_spread(rows, sizes, keys)
        links = _unit_links(met.where(~crowded).select(*keys, "fp"), budget)
        found = links if found is None else found.unionByName(links)
        masks = [r["mask"] for r in sizes.where(crowded).select("mask").distinct().collect()]  # 15 for one of the step before, at a budget of 4
        if not masks:
            return found
        fps = stash(met.where(crowded).select("fp", "mask").distinct(), "crowded")


def _unit_links(units: DataFrame, budget: int) -> DataFrame:
    """Edges ``a, b`` within each key (``mask, key``) of ``units``."""
    flipped = F.col("fp").bitwiseXOR(F.lit(-(1 << 63)))  # in this order, signed numbers stand as unsigned ones

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(rows: np.ndarray) -> pa.RecordBatch:
            new = np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)])
            fps = rows[2].view(np.uint64)
            edges = trie_links(fps, np.flatnonzero(new), budget)
            return pa.RecordBatch.from_arrays([pa.array(rows[2][e], pa.int64()) for e in edges], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            if sum(h.shape[1] for h in held) < 100_000:
                continue
            rows = np.concatenate(held, axis=1)
            last = np.flatnonzero((rows[:2] != rows[:2, -1:]).any(axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last unit may go on
            held = [rows[:, cut:]]
            if cut:
                yield links(rows[:, :cut])
        if held and (rows := np.concatenate(held, axis=1)).shape[1]:
            yield links(rows)

    dealt = units.repartition("mask", "key").sortWithinPartitions("mask", "key", flipped)
    return dealt.mapInArrow(run, "a long, b long")


def link_fingerprints(marked: DataFrame, budget: int = 4, unit_rows: int = 4096) -> DataFrame:
    """``marked`` (``doc_id, fp``, a written table) with ``component_id``."""
    classes = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "classes")
    roots = components(near_links(classes.select("fp"), budget, unit_rows))
    grouped = stash(classes.select("fp", "first_id").join(roots.select(F.col("node").alias("fp"), "root"), "fp"), "grouped")
    least = stash(grouped.groupBy("root").agg(F.min("first_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "least")
    joined = join_spread(grouped.select("fp", "root"), least, ["root"]).select("fp", "least_id")
    named = stash(classes.join(joined, "fp", "left").select("fp", "n", F.coalesce("least_id", "first_id").alias("component_id")), "named")
    return join_spread(marked, named, ["fp"]).drop("n")


def near_duplicates(docs: DataFrame, width: int = 4, budget: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every document."""
    marked = stash(fingerprints(docs, width), "fingerprints")
    return link_fingerprints(marked, budget).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
