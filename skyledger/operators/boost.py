"""Boosted trees out of histograms, for many models in shared passes.

A model is one fold, one 0/1 target and one list of features. Rows are dealt to the folds that they
train, validate or test, their features are binned once to bytes (a number by the quantiles of its
fold's training rows, a category by its rank among them, null to a bin of its own), and blocks of
rows are written as files. Every further pass runs over the training rows of the blocks, with features
packed to bundles of a byte: a task adds up gradients by model, node, feature and bin for all models,
Spark sends what belongs to a node to one task, which adds it up and looks for the best split, and the
driver gets one row a node. So a level of the trees of all models is one pass, whatever the rows are. Of
two siblings only the rows of the one with the lesser sum of second derivatives are added up: the sums are whole numbers, so
the other's are what is left of their parent's, exactly.

Nulls go to the side that gains more; categories are ordered by their gradients and cut like
numbers. Gradients are whole multiples of ``1 / UNIT``, so that sums do not depend on their order.
The loss on the validation rows is measured in the pass that starts the next tree; a model ends
after ``patience`` trees without a better one, and keeps the trees up to its best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import prod

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.sources.raw import materialised

TRAIN, VALID, TEST = 0, 1, 2
#: Gradients are whole multiples of 1 / UNIT. Label of rows without one.
UNIT, NO_LABEL = float(1 << 20), 255
#: Bin of nulls, and how many categories of a column have a bin of their own; all others share the last one.
NULL_BIN, MOST_CATEGORIES = 0, 254
#: Bins that a byte can tell apart.
N_BINS = 256
#: Rows whose derivatives are added up as one number, and the bits of the second one in it: 4095 times 2 ** 18
#: fits in them, and 4095 times 2 ** 20 in those above, with a sign.
PACKED_ROWS, LOW_BITS = 4095, 31
#: Rows that a task adds up at a time, and bytes of sums that the driver holds for the nodes' siblings.
LEVEL_ROWS, HELD_BYTES = 32_768, 64 << 20
#: Whole units of a margin, and how many of them a bin of margins has.
MARGIN_UNIT, MARGIN_BIN = 1_000_000_000, 15_625_000
#: Distinct numbers that a task holds, of all years and columns, before it hands them on.
HELD_VALUES = 2_000_000
#: Rows of which a task holds the margins of one permuted column at a time.
CHUNK_ROWS = 200_000


@dataclass(frozen=True)
class Settings:
    """``trees`` at most, of ``depth`` levels; ``rate`` shrinks each; numbers have ``bins`` bins; a side
    of a split has at least ``least_weight`` of second derivatives; ``columns`` is the share of features
    that a tree sees; margins are written anew after ``stored_every`` trees."""

    trees: int = 20
    depth: int = 5
    rate: float = 0.2
    bins: int = 64
    least_weight: float = 20.0
    l2: float = 1.0
    columns: float = 1.0
    patience: int = 5
    stored_every: int = 5
    seed: int = 7


@dataclass
class Tree:
    """Nodes in heap order: the feature that splits one (-1: none), the bins that go left, its value."""

    feature: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (2 << depth) - 1
        return cls(np.full(n, -1, np.int32), np.zeros((n, N_BINS // 8), np.uint8), np.zeros(n), np.zeros(n))

    def nodes(self, x: np.ndarray, levels: int) -> np.ndarray:
        """The node that each column of ``x`` (features by rows) has come to after ``levels`` splits."""
        return Walk(self, levels).nodes(x)

    def values(self, x: np.ndarray) -> np.ndarray:
        return Walk(self).values(x)


class Walk:
    """The first ``levels`` splits of a tree (all of them by default) as flat tables, made once for many
    blocks: the node that follows a node and a bin, itself where the node has no split."""

    def __init__(self, tree: Tree, levels: int | None = None):
        self.levels = len(tree.feature).bit_length() - 1 if levels is None else levels
        here = np.arange(len(tree.feature))[:, None]
        goes_left = np.unpackbits(tree.left, axis=1, bitorder="little").astype(np.intp)
        self.following = np.where(tree.feature[:, None] >= 0, 2 * here + 2 - goes_left, here).ravel()
        self.feature, self.value = tree.feature, tree.value
        self.read = np.maximum(tree.feature, 0).astype(np.intp)

    def path(self, x: np.ndarray, rows: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """The nodes of the columns of ``x`` (of ``rows`` those), from the root on."""
        n, flat = x.shape[1], x.ravel()
        rows, start = np.arange(n) if rows is None else rows, self.read * n
        at = np.zeros(len(rows), np.intp)
        yield at
        for _ in range(self.levels):
            at = self.following.take(at * N_BINS + flat.take(start.take(at) + rows))
            yield at

    def nodes(self, x: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        for at in self.path(x, rows):
            pass
        return at

    def values(self, x: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        return self.value.take(self.nodes(x, rows))

    def asked(self, x: np.ndarray) -> np.ndarray:
        """The features that the columns of ``x`` are asked for on their way to a leaf."""
        return np.stack([self.feature.take(at) for at in self.path(x)]).astype(np.int16)


@dataclass
class Blocks:
    """The binned rows and what they mean. ``rows`` has ``fold, role, n, ids, x, y, margin``."""

    rows: DataFrame
    folds: list[str]
    targets: list[str]
    lists: dict[str, list[str]]
    features: list[str]
    categorical: list[str]
    base: np.ndarray
    n_bins: int
    borders: list[dict[str, np.ndarray]]
    #: For each fold and feature, how many bins its training rows can be in.
    widths: np.ndarray

    @property
    def per_fold(self) -> int:
        return len(self.targets) * len(self.lists)

    def models(self) -> list[tuple[str, str, str]]:
        """(fold, target, list) of each model by its number."""
        return [(f, t, name) for f in self.folds for t in self.targets for name in self.lists]

    def columns(self, model: int) -> np.ndarray:
        return np.array([self.features.index(c) for c in list(self.lists.values())[model % len(self.lists)]], dtype=int)


def _roles(folds: list, years: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each fold and role, which rows of these years have it."""
    for k, f in enumerate(folds):
        for role, part in ((TRAIN, f.train), (VALID, (f.valid,)), (TEST, f.test)):
            yield k, role, np.isin(years, part)


def _of_folds(counts: DataFrame, folds: list) -> DataFrame:
    """Counts by year, with a row for each fold that trains on the year, as ``fold``."""
    pairs = counts.sparkSession.createDataFrame([(k, y) for k, f in enumerate(folds) for y in f.train], "fold int, year int")
    return counts.join(F.broadcast(pairs), "year").drop("year")  # a row a fold and year


def _trained(typed: DataFrame, folds: list) -> DataFrame:
    """The rows that any fold trains on."""
    return typed.where(F.col("year").isin(sorted({y for f in folds for y in f.train})))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The numbers of a batch, columns by rows; NaN is null."""
    values = batch.column("_v").flatten()
    return np.ascontiguousarray(values.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).T)


def _ranks(typed: DataFrame, folds: list, categorical: list[str]) -> dict[tuple[int, str], dict[str, int]]:
    """For each fold and category column, the rank from 1 of its most frequent values in training."""
    if not categorical:
        return {}
    long = _trained(typed, folds).select("year", F.posexplode("_s").alias("c", "v"))
    counts = long.where("v is not null").groupBy("year", "c", "v").agg(F.count(F.lit(1)).alias("n"))
    counts = _of_folds(counts, folds).groupBy("fold", "c", "v").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("fold", "c").orderBy(F.desc("n"), "v"))
    out: dict[tuple[int, str], dict[str, int]] = {}
    for r in counts.withColumn("k", rank).where(F.col("k") <= MOST_CATEGORIES).collect():
        out.setdefault((r["fold"], categorical[r["c"]]), {})[r["v"]] = r["k"]
    return out


def _borders(typed: DataFrame, folds: list, numeric: list[str], bins: int) -> list[dict[str, np.ndarray]]:
    """For each fold and number column, the exact quantiles of its training rows: the values at whole
    ``bins``-ths of the rows in order. A task counts the distinct values that it meets by year; those of
    one span of numbers (sign, exponent and eight bits more) are then put in order by one task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        size = 0
        for batch in batches:
            years, values = batch.column("year").to_numpy(zero_copy_only=False), _matrix(batch)
            for y in np.unique(years):
                for i, v in enumerate(values.compress(years == y, axis=1)):
                    v, n = np.unique(v[~np.isnan(v)] + 0.0, return_counts=True)
                    held.setdefault((int(y), i), []).append((v, n))
                    size += len(v)
            if size > HELD_VALUES:
                held, size = merged(held)
                if size > HELD_VALUES // 2:
                    yield from out(held)
                    held, size = {}, 0
        yield from out(merged(held)[0])

    def merged(held: dict) -> tuple[dict, int]:
        done, size = {}, 0
        for key, parts in held.items():
            v, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            done[key] = [(v, np.bincount(of, np.concatenate([p[1] for p in parts]), len(v)).astype(np.int64))]
            size += len(v)
        return done, size

    def out(held: dict) -> Iterator[pa.RecordBatch]:
        for (y, i), parts in held.items():
            for v, n in parts:
                bits = v.view(np.int64)
                span = np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits) >> 44
                same = [pa.array(np.full(len(v), x), pa.int32()) for x in (y, i)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(span), pa.array(v), pa.array(n, pa.int64())], names=["year", "c", "span", "v", "n"])

    borders = [{c: np.zeros(0) for c in numeric} for _ in folds]
    if not numeric:
        return borders
    keys = ["fold", "c", "span"]
    counts = _trained(typed, folds).select("year", "_v").mapInArrow(count, "year int, c int, span long, v double, n long").groupBy("year", "c", "span", "v").agg(F.sum("n").alias("n"))
    counts = materialised(_of_folds(counts, folds).groupBy(*keys, "v").agg(F.sum("n").alias("n")), "values")  # read twice
    whole = Window.partitionBy("fold", "c")
    before = F.coalesce(F.sum("n").over(whole.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counts.groupBy(*keys).agg(F.sum("n").alias("n")).select(*keys, before.alias("before"), F.sum("n").over(whole).alias("all"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    met = counts.join(spans, keys).withColumn("upto", upto)
    parts = lambda rows: F.floor(rows * bins / F.col("all"))
    found = met.where(F.least(parts(F.col("upto")), F.lit(bins - 1)) > parts(F.col("upto") - F.col("n"))).select("fold", "c", "v")
    for r in found.collect():  # at most bins - 1 for each fold and column
        k, c = r["fold"], numeric[r["c"]]
        borders[k][c] = np.append(borders[k][c], r["v"])
    return [{c: np.sort(v) for c, v in of.items()} for of in borders]


def binned(rows: DataFrame, folds: list, targets: list[str], lists: dict[str, list[str]], categorical: list[str], settings: Settings, row_id: str = "leg_id") -> Blocks:
    """Blocks of ``rows`` (``row_id``, ``year``, features and targets) for all models. Rows of a fold are
    ordered by a hash of their id, so a block is a random group of them. They are dealt to folds as they
    are binned, so that bytes are shuffled and not the features."""
    features = list(dict.fromkeys(c for columns in lists.values() for c in columns))
    numeric = [c for c in features if c not in categorical]
    coded = [c for c in features if c in categorical]
    # numbers, categories and labels are one array each: Spark hands those on in less than half the time of as many columns
    gathered = lambda name, columns, kind: F.array(*[F.col(c).cast(kind) for c in columns]).cast(f"array<{kind}>").alias(name)
    typed = rows.select(
        F.col(row_id).cast("string").alias("_id"), F.col("year").cast("int").alias("year"), F.xxhash64(F.lit(settings.seed), F.col(row_id).cast("string")).alias("_h"),
        gathered("_v", numeric, "double"), gathered("_s", coded, "string"), gathered("_y", targets, "byte"),
    )
    borders = _borders(typed, folds, numeric, settings.bins)
    sums = typed.groupBy("year").agg(*[e for i in range(len(targets)) for e in (F.sum(F.col("_y")[i]).alias(f"s{i}"), F.count(F.col("_y")[i]).alias(f"n{i}"))])
    per_year = {r["year"]: r for r in sums.collect()}
    rates = np.zeros((len(folds), len(targets)))
    for k, f in enumerate(folds):
        for i in range(len(targets)):
            of = [per_year[y] for y in f.train if y in per_year]
            rates[k, i] = sum(r[f"s{i}"] or 0 for r in of) / max(1, sum(r[f"n{i}"] for r in of))
    rates = np.clip(rates, 1e-6, 1 - 1e-6)
    base = np.repeat(np.log(rates / (1 - rates)).ravel(), len(lists))
    ranks = _ranks(typed, folds, coded)
    n_bins = max([settings.bins + 1, *(max(rank.values()) + 2 for rank in ranks.values())])
    # a training row's category has a rank, or is one of those beyond the ranks, in the last bin
    in_rank = [max([0, *ranks.get((k, c), {}).values()]) for k in range(len(folds)) for c in features]
    widths = np.array([(len(borders[k][c]) + 2 if c in numeric else n_bins if most == MOST_CATEGORIES else most + 1) for (k, c), most in zip(((k, c) for k in range(len(folds)) for c in features), in_rank, strict=True)], dtype=int).reshape(len(folds), -1)
    per_fold, wide, at = len(targets) * len(lists), len(features), {c: j for j, c in enumerate(features)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            years = batch.column("year").fill_null(-1).to_numpy(zero_copy_only=False)
            values, labels = _matrix(batch), batch.column("_y").flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.uint8).reshape(batch.num_rows, -1)
            texts = batch.column("_s").flatten().dictionary_encode()
            met = texts.dictionary.to_pylist()
            codes = texts.indices.fill_null(len(met)).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for k, role, has in _roles(folds, years):
                here = np.flatnonzero(has)
                if not len(here):
                    continue
                cells = np.empty((len(here), wide + len(targets)), np.uint8)
                for i, c in enumerate(numeric):
                    v = values[i].take(here)
                    cells[:, at[c]] = np.where(np.isnan(v), NULL_BIN, 1 + np.searchsorted(borders[k][c], v, side="left"))
                for i, c in enumerate(coded):
                    rank = ranks.get((k, c), {})
                    cells[:, at[c]] = np.array([*(rank.get(v, n_bins - 1) for v in met), NULL_BIN], np.uint8).take(codes[here, i])
                cells[:, wide:] = labels[here]
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(cells.shape[1]), len(cells), [None, pa.py_buffer(cells)])
                same = [pa.array(np.full(len(cells), v), pa.int32()) for v in (k, role)]
                rows_ = pa.array(here)
                yield pa.RecordBatch.from_arrays([*same, batch.column("_h").take(rows_), batch.column("_id").take(rows_), packed.cast(pa.binary())], names=["fold", "role", "_h", "_id", "cells"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, role = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "role"))
            edges = [0, *(np.flatnonzero((np.diff(fold) != 0) | (np.diff(role) != 0)) + 1), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                part, k = batch.slice(a, b - a), int(fold[a])
                packed = part.column("cells").cast(pa.binary())
                starts = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + b - a + 1]
                cells = np.frombuffer(packed.buffers()[2], np.uint8)[starts[0] : starts[-1]].reshape(b - a, -1).T
                ids = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), part.column("_id").cast(pa.string()))
                margin = np.repeat(base[k * per_fold : (k + 1) * per_fold], b - a).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([int(role[a])], pa.int32()), pa.array([b - a], pa.int32()), ids, *[pa.array([m.tobytes()], pa.binary()) for m in (cells[:wide], cells[wide:], margin)]],
                    names=["fold", "role", "n", "ids", "x", "y", "margin"],
                )

    each = typed.mapInArrow(deal, "fold int, role int, _h long, _id string, cells binary")
    # fold, role and the high bits of the hash as one number, by which most rows are told apart at once
    first = (F.col("fold") * 3 + F.col("role")).cast("long") * (1 << 48) + F.shiftright("_h", 16) + (1 << 47)
    placed = each.repartition("fold", F.pmod("_h", F.lit(64))).sortWithinPartitions(first, "fold", "role", "_h", "_id").drop("_h")
    packed = placed.mapInArrow(pack, "fold int, role int, n int, ids array<string>, x binary, y binary, margin binary")
    return Blocks(materialised(packed, "blocks"), [f.name for f in folds], targets, lists, features, categorical, base, n_bins, borders, widths)


def _block(row: dict, i: int, per_fold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = row["n"][i].as_py()
    x = np.frombuffer(row["x"][i].as_buffer(), np.uint8).reshape(-1, n)
    y = np.frombuffer(row["y"][i].as_buffer(), np.uint8).reshape(-1, n)
    return x, y, np.frombuffer(row["margin"][i].as_buffer(), np.float32).reshape(per_fold, n).astype(float)


def gradients(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the logistic loss, in units."""
    p = 1 / (1 + np.exp(-margin))
    return np.round((p - label) * UNIT), np.round(p * (1 - p) * UNIT)


def best_split(sums: np.ndarray, is_category: np.ndarray, settings: Settings) -> tuple[float, int, np.ndarray, np.ndarray] | None:
    """The split of a node with the greatest gain out of ``sums`` (features by 2 by bins; units): its
    gain, the feature, the bins that go left (bool), and the left side's two sums. Of equal ones the first
    feature is taken, and of its cuts the first, nulls to the right before to the left."""
    n_features, _, n_bins = sums.shape
    g, h = sums[:, 0] / UNIT, sums[:, 1] / UNIT
    whole_g, whole_h = g.sum(axis=1), h.sum(axis=1)
    order = np.tile(np.arange(n_bins), (n_features, 1))
    for j in np.flatnonzero(is_category):  # nulls are a category like the others
        seen = h[j] > 0
        order[j] = np.lexsort((np.arange(n_bins), np.where(seen, g[j] / (h[j] + settings.l2), np.inf)))
    if (~is_category).any():
        order[~is_category] = np.r_[np.arange(1, n_bins), NULL_BIN]
    og, oh = np.take_along_axis(g, order, 1), np.take_along_axis(h, order, 1)
    left_g, left_h = np.cumsum(og, axis=1), np.cumsum(oh, axis=1)
    null_g, null_h = np.where(is_category, 0.0, g[:, NULL_BIN])[:, None], np.where(is_category, 0.0, h[:, NULL_BIN])[:, None]

    def gains(lg: np.ndarray, lh: np.ndarray) -> np.ndarray:
        rg, rh = whole_g[:, None] - lg, whole_h[:, None] - lh
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = lg**2 / (lh + settings.l2) + rg**2 / (rh + settings.l2) - (whole_g**2 / (whole_h + settings.l2))[:, None]
        return np.where((lh >= settings.least_weight) & (rh >= settings.least_weight), gain, -np.inf)

    both = np.stack([gains(left_g, left_h), np.where(is_category[:, None], -np.inf, gains(left_g + null_g, left_h + null_h))], axis=2).reshape(n_features, -1)
    cut = both.argmax(axis=1)
    best = both[np.arange(n_features), cut]
    j = int(best.argmax())
    if not best[j] > 1e-9:
        return None
    k, with_nulls = divmod(int(cut[j]), 2)
    left = np.zeros(N_BINS, bool)
    left[order[j, : k + 1]] = True
    if with_nulls:
        left[NULL_BIN] = True
    return float(best[j]), j, left, sums[j][:, left[:n_bins]].sum(axis=1)


def whole_bins(sums: np.ndarray, widths: np.ndarray, n_bins: int) -> np.ndarray:
    """A node's ``sums`` (2 by the bins of all features in turn) as features by 2 by ``n_bins``."""
    out = np.zeros((len(widths), 2, n_bins))
    ends = np.cumsum(widths)
    for j, (end, width) in enumerate(zip(ends, widths, strict=True)):
        out[j, :, :width] = sums[:, end - width : end]
    return out


class Joint:
    """Features of one fold in bundles. A bundle has a cell for each combination of its features' bins, as many as
    a byte can tell apart, so a row is read and added up once a bundle and not once a feature; a feature's sums are those of
    its cells. A category's bin that no training row has is one more. Features that other lists have (``kinds``) are not mixed."""

    def __init__(self, widths: np.ndarray, category: np.ndarray, n_bins: int, kinds: list):
        self.widths, self.n_bins, self.bundles = widths.tolist(), n_bins, []
        self.codes = [w + 1 if c and w < n_bins else w for w, c in zip(self.widths, category, strict=True)]
        for f in sorted(range(len(self.codes)), key=lambda f: (-self.codes[f], f)):
            fits = (b for b in self.bundles if kinds[b[0]] == kinds[f] and self.size(b) * self.codes[f] <= N_BINS)
            if (b := next(fits, None)) is None:
                self.bundles.append([f])
            else:
                b.append(f)
        self.starts = np.cumsum([0, *map(self.size, self.bundles)]).tolist()
        self.place = {f: (k, i) for k, b in enumerate(self.bundles) for i, f in enumerate(b)}

    def size(self, bundle: list[int]) -> int:
        return prod(self.codes[f] for f in bundle)

    def shape(self, k: int) -> list[int]:
        return [self.codes[f] for f in self.bundles[k]]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cells of rows (bundles by rows) out of their bins (features by rows)."""
        out = np.zeros((len(self.bundles), x.shape[1]), np.uint8)
        for cell, b in zip(out, self.bundles, strict=True):
            for f in b:
                cell *= np.uint8(self.codes[f] & 255)  # 256 codes have a bundle of their own, which is 0 up to here
                cell += np.minimum(x[f], self.codes[f] - 1).astype(np.uint8)
        return out

    def holding(self, columns: np.ndarray) -> list[int]:
        """The bundles that have any of these features."""
        return sorted({self.place[f][0] for f in columns.tolist()})

    def tree(self, tree: Tree) -> Tree:
        """``tree`` over cells: each node asks for a bundle, and the cells go where their bins went."""
        out = Tree(tree.feature.copy(), tree.left.copy(), tree.value, tree.gain)
        for node in np.flatnonzero(tree.feature >= 0):
            f = int(tree.feature[node])
            k, i = self.place[f]
            of = np.unravel_index(np.arange(self.starts[k + 1] - self.starts[k]), self.shape(k))[i]
            of = np.where(of < self.widths[f], of, self.n_bins - 1)
            left = np.zeros(N_BINS, bool)
            left[: len(of)] = np.unpackbits(tree.left[node], bitorder="little")[of]
            out.feature[node], out.left[node] = k, np.packbits(left, bitorder="little")
        return out

    def apart(self, sums: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """``sums`` (nodes by 2 by cells) as nodes by 2 by the bins of ``columns`` in turn."""
        out = []
        for f in columns.tolist():
            k, i = self.place[f]
            whole = sums[:, :, self.starts[k] : self.starts[k + 1]].reshape(*sums.shape[:2], *self.shape(k))
            out.append(whole.sum(axis=tuple(2 + j for j in range(len(self.bundles[k])) if j != i))[:, :, : self.widths[f]])
        return np.concatenate(out, axis=2).astype(float)


class Sums:
    """Gradients of one model by node and cell. Both derivatives are one number while at most
    ``PACKED_ROWS`` rows of a node are in it, and are then taken apart, so a row is added once for both."""

    def __init__(self, n_nodes: int, joint: Joint, columns: np.ndarray):
        self.joint, self.columns, self.n_cells = joint, columns, joint.starts[-1]
        self.bundles = joint.holding(columns)
        self.packed = np.zeros((n_nodes, self.n_cells), np.int64)
        self.whole = np.zeros((n_nodes, 2, self.n_cells), np.int64)
        self.held = np.zeros(n_nodes, np.int64)

    def add(self, cells: np.ndarray, rows: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
        """``rows`` of ``cells``, each with its node's place and its derivatives in units."""
        packed, flat = (g.astype(np.int64) << LOW_BITS) + h.astype(np.int64), self.packed.ravel()
        for a in range(0, len(rows), PACKED_ROWS):
            part = slice(a, a + PACKED_ROWS)
            here, both = rows[part], packed[part]
            n = np.bincount(slot[part], minlength=len(self.held))
            for k in np.flatnonzero((n > 0) & (self.held + n > PACKED_ROWS)):
                self.unpack(k)
            self.held += n
            base = slot[part] * self.n_cells
            for k in self.bundles:
                np.add.at(flat[self.joint.starts[k] :], base + cells[k].take(here), both)

    def unpack(self, k: int) -> None:
        self.whole[k, 0] += self.packed[k] >> LOW_BITS
        self.whole[k, 1] += self.packed[k] & ((1 << LOW_BITS) - 1)
        self.packed[k], self.held[k] = 0, 0

    def done(self) -> np.ndarray:
        """The sums as nodes by 2 by the bins of the features in turn."""
        for k in np.flatnonzero(self.held):
            self.unpack(k)
        return self.joint.apart(self.whole, self.columns)


def _joints(blocks: Blocks) -> list[Joint]:
    category = np.array([c in blocks.categorical for c in blocks.features])
    kinds = [tuple(c in found for found in blocks.lists.values()) for c in blocks.features]
    return [Joint(widths, category, blocks.n_bins, kinds) for widths in blocks.widths]


def _chunks(blocks: Blocks, joints: list[Joint], role: int, models: set[int]) -> RDD:
    """The blocks of ``role`` as ``(fold, cells, y, margins of models)``, neighbours of a fold together as far as
    ``LEVEL_ROWS`` rows. They are read a hundred times and more, so they are kept as bytes that Spark hands on as they are,
    on the executors' disks; a lost part is made anew."""
    per_fold = blocks.per_fold

    def joined(fold: int, held: list[tuple]) -> tuple:
        x, y, margin = (np.concatenate(part, axis=1) for part in zip(*held, strict=True))
        return fold, joints[fold].cells(x), y, {m: margin[m % per_fold] for m in range(fold * per_fold, (fold + 1) * per_fold) if m in models}

    def run(rows: Iterator) -> Iterator[tuple]:
        held, last, n = [], -1, 0
        for r in rows:
            if held and (r["fold"] != last or n + r["n"] > LEVEL_ROWS):
                yield joined(last, held)
                held, n = [], 0
            held.append(tuple(np.frombuffer(r[c], kind).reshape(-1, r["n"]) for c, kind in (("x", np.uint8), ("y", np.uint8), ("margin", np.float32))))
            last, n = r["fold"], n + r["n"]
        if held:
            yield joined(last, held)

    folds = sorted({m // per_fold for m in models})
    rows = blocks.rows.where(F.col("fold").isin(folds) & (F.col("role") == role)).select("fold", "n", "x", "y", "margin")
    return rows.rdd.mapPartitions(run).persist(StorageLevel.DISK_ONLY)


def _stored(chunks: RDD, joints: list[Joint], pending: dict[int, list[Tree]], per_fold: int) -> RDD:
    """The chunks with the margins after the trees in ``pending``, of its models alone."""

    def run(found: Iterator[tuple]) -> Iterator[tuple]:
        walks = {m: [Walk(joints[m // per_fold].tree(tree)) for tree in trees] for m, trees in pending.items()}
        for fold, x, y, margins in found:
            new = {}
            for m, margin in margins.items():
                if m in walks:
                    margin = margin.astype(float)
                    for walk in walks[m]:
                        margin += walk.values(x)
                    new[m] = margin.astype(np.float32)
            if new:
                yield fold, x, y, new

    return chunks.mapPartitions(run).persist(StorageLevel.DISK_ONLY)


def _level(blocks: Blocks, joints: list[Joint], train: RDD, valid: RDD | None, trees: dict[int, Tree], pending: dict[int, list[Tree]], open_: dict[int, list[int]], parents: dict[tuple[int, int], np.ndarray], seen: dict[int, np.ndarray], level: int, settings: Settings) -> list[dict]:
    """One pass: for every open node of every model its sums and best split, and with ``valid`` the
    validation loss of each model in ``pending`` (node -1). A node whose parent's sums are in ``parents`` stands for its
    sibling too, which has what it leaves of them. Sums that are split are given back for the next level, as long as all are
    below ``HELD_BYTES``; they have, for each feature, only the bins that its fold's rows can be in, one feature after the other."""
    per_fold, n_lists, columns = blocks.per_fold, len(blocks.lists), {m: blocks.columns(m)[seen[m]] for m in open_}
    category = np.array([c in blocks.categorical for c in blocks.features])
    n_bins = blocks.n_bins
    wide = {m: blocks.widths[m // per_fold][columns[m]] for m in open_}
    n_nodes = {m: sum(1 + ((m, (node - 1) // 2) in parents) for node in nodes) for m, nodes in open_.items()}
    keep = level + 1 < settings.depth and 16 * sum(int(wide[m].sum()) * n for m, n in n_nodes.items()) <= HELD_BYTES

    def walked(models: dict) -> dict[int, list[Walk]]:
        return {m: [Walk(joints[m // per_fold].tree(tree)) for tree in pending[m]] for m in models}

    def loss(found: Iterator[tuple]) -> Iterator[tuple]:
        before, losses = walked(pending), {}
        for _, x, y, margins in found:
            for m, margin in margins.items():
                if m not in before:
                    continue
                used = np.flatnonzero(y[m % per_fold // n_lists] != NO_LABEL)
                label, margin = y[m % per_fold // n_lists].take(used), margin.take(used).astype(float)
                for walk in before[m]:
                    margin = margin + walk.values(x, used)
                own = np.logaddexp(0, margin) - label * margin
                losses[m] = losses.get(m, 0) + np.array([own.sum(), len(own)])
        for m, value in losses.items():
            yield (m, -1), value

    def add(found: Iterator[tuple]) -> Iterator[tuple]:
        before, last, sums = walked(open_), -1, {}
        grown = {m: Walk(joints[m // per_fold].tree(trees[m]), level) for m in open_} if level else {}
        slots = {m: np.full(len(trees[m].feature), -1) for m in open_}
        for m, slot in slots.items():
            slot[open_[m]] = np.arange(len(open_[m]))
        for fold, x, y, margins in found:
            if fold != last:
                yield from done(sums)
                last, sums = fold, {m: Sums(len(open_[m]), joints[fold], columns[m]) for m in margins if m in open_}
            for m, of in sums.items():
                label = y[m % per_fold // n_lists]
                used = label != NO_LABEL
                if level:
                    at = slots[m].take(grown[m].nodes(x))
                    used &= at >= 0
                here = np.flatnonzero(used)
                margin = margins[m].take(here).astype(float)
                for walk in before[m]:
                    margin = margin + walk.values(x, here)
                of.add(x, here, at.take(here) if level else np.zeros(len(here), np.intp), *gradients(margin, label.take(here)))
        yield from done(sums)

    def done(sums: dict[int, Sums]) -> Iterator[tuple]:
        for m, of in sums.items():
            yield from (((m, node), value.copy()) for node, value in zip(open_[m], of.done(), strict=True))

    def split(found: Iterator[tuple]) -> Iterator[dict]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for at, value in found:
            sums[at] = sums[at] + value if at in sums else value
        for (m, node), value in sums.items():
            if node < 0:
                yield {"model": m, "node": node, "whole": value}
                continue
            both, parent = [(node, value)], (m, (node - 1) // 2)
            if parent in parents:
                both.append((node + 1 if node % 2 else node - 1, parents[parent] - value))
            for node_, value_ in both:
                whole = whole_bins(value_, wide[m], n_bins)
                gain, j, left, side = best_split(whole, category[columns[m]], settings) or (0.0, -1, np.zeros(N_BINS, bool), np.zeros(2))
                yield {"model": m, "node": node_, "whole": whole[0].sum(axis=1), "gain": gain, "feature": int(columns[m][j]) if j >= 0 else -1, "left": np.packbits(left, bitorder="little"), "side": side, "sums": value_ if j >= 0 and keep else None}

    parts = [rows.mapPartitions(run) for rows, run in ((train if open_ else None, add), (valid, loss)) if rows is not None]
    # a node's sums are small, so one wave of tasks is enough
    n = max(1, min(train.context.defaultParallelism, sum(map(len, open_.values())) + len(pending) * (valid is not None)))
    met = train.context.union(parts).partitionBy(n, lambda at: 31 * at[0] + at[1])
    return met.mapPartitions(split).collect()  # a row for each open node, with at most HELD_BYTES of sums in all


def boost(blocks: Blocks, settings: Settings, only: set[int] | None = None) -> dict[int, list[Tree]]:
    """The trees of each model (of ``only`` those, by number)."""
    trees: dict[int, list[Tree]] = {m: [] for m in range(len(blocks.models())) if only is None or m in only}
    if not trees:
        return {}
    joints = _joints(blocks)
    chunks = [_chunks(blocks, joints, role, set(trees)) for role in (TRAIN, VALID)]
    spent: list[RDD] = []
    try:
        return _grown(blocks, joints, settings, trees, chunks, spent)
    finally:
        for rdd in (*spent, *chunks):
            rdd.unpersist()


def _grown(blocks: Blocks, joints: list[Joint], settings: Settings, trees: dict[int, list[Tree]], chunks: list[RDD], spent: list[RDD]) -> dict[int, list[Tree]]:
    """``trees``, grown; ``chunks`` (training and validation) and those ``spent`` are kept up to date."""
    pending: dict[int, list[Tree]] = {m: [] for m in trees}
    best: dict[int, tuple[float, int]] = {}
    rng = np.random.default_rng(settings.seed)
    for n in range(settings.trees + 1):
        last = n == settings.trees
        grown = {m: Tree.empty(settings.depth) for m in pending}
        seen = {m: np.sort(rng.permutation(k)[: max(1, round(settings.columns * k))]) for m in pending for k in [len(blocks.columns(m))]}
        open_ = {} if last else {m: [0] for m in pending}
        parents: dict[tuple[int, int], np.ndarray] = {}
        for level in range(1 if last else settings.depth):
            following: dict[int, list[int]] = {}
            held: dict[tuple[int, int], np.ndarray] = {}
            for r in _level(blocks, joints, chunks[0], None if level else chunks[1], grown, pending, open_, parents, seen, level, settings):
                m, node = r["model"], r["node"]
                if node < 0:
                    loss = r["whole"][0] / max(r["whole"][1], 1)
                    if m not in best or loss < best[m][0]:
                        best[m] = (loss, n)
                    continue
                tree, worth = grown[m], lambda s: -settings.rate * (s[0] / UNIT) / (s[1] / UNIT + settings.l2)
                tree.value[node] = worth(r["whole"])
                if r["feature"] >= 0:
                    tree.feature[node], tree.gain[node], tree.left[node] = r["feature"], r["gain"], r["left"]
                    left, right = r["side"], r["whole"] - r["side"]
                    tree.value[2 * node + 1], tree.value[2 * node + 2] = worth(left), worth(right)
                    if r["sums"] is not None and min(left[1], right[1]) > 0:  # rows of the lesser side are added up; the other has what they leave
                        held[m, node] = r["sums"]
                        following.setdefault(m, []).append(2 * node + (1 if left[1] <= right[1] else 2))
                    else:
                        following.setdefault(m, []).extend((2 * node + 1, 2 * node + 2))
            open_, parents = {m: sorted(nodes) for m, nodes in following.items()}, held
            while spent:  # the chunks made of these stand now
                spent.pop().unpersist()
            if not open_:
                break
        if last:
            break
        over = {m for m in pending if m in best and n - best[m][1] >= settings.patience} | {m for m in pending if grown[m].feature[0] < 0}
        for m in pending:
            if m not in over:
                trees[m].append(grown[m])
                pending[m].append(grown[m])
        pending = {m: p for m, p in pending.items() if m not in over}
        if not pending:
            break
        if (n + 1) % settings.stored_every == 0 and n + 1 < settings.trees:
            spent += chunks
            chunks[:] = [_stored(part, joints, pending, blocks.per_fold) for part in chunks]
            pending = {m: [] for m in pending}
    return {m: found[: best[m][1]] if m in best else found for m, found in trees.items()}


def scores(blocks: Blocks, trees: dict[int, list[Tree]], role: int = TEST) -> DataFrame:
    """``fold, target, horizon, id, y, p`` of each row of ``role`` and model in ``trees``."""
    per_fold, n_lists, named = blocks.per_fold, len(blocks.lists), blocks.models()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = {m: [Walk(tree) for tree in found] for m, found in trees.items()}
        for batch in batches:
            row = {c: batch.column(c) for c in ("n", "x", "y", "margin")}
            for i in range(batch.num_rows):
                fold, ids = batch.column("fold")[i].as_py(), batch.column("ids")[i].values
                x, y, margins = _block(row, i, per_fold)
                for k in range(per_fold):
                    m = fold * per_fold + k
                    if m not in trees:
                        continue
                    label, margin = y[k // n_lists], margins[k]
                    for walk in walks[m]:
                        margin = margin + walk.values(x)
                    n = len(label)
                    names = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), [v]).cast(pa.string()) for v in named[m]]
                    yield pa.RecordBatch.from_arrays([*names, ids, pa.array(label.astype(np.int32), pa.int32(), mask=label == NO_LABEL), pa.array(1 / (1 + np.exp(-margin)))], names=["fold", "target", "horizon", "id", "y", "p"])

    return blocks.rows.where(F.col("role") == role).mapInArrow(run, "fold string, target string, horizon string, id string, y int, p double")


def permuted_margins(blocks: Blocks, trees: dict[int, list[Tree]], repeats: int, seed: int) -> DataFrame:
    """``model, feature, repeat, bin, rows``: the margins of the test rows with each feature that a model
    uses dealt anew among the rows of its block, ``repeats`` times; and without (feature -1). A block is
    a random group of rows, so rows are not shuffled for that. ``rows`` has four bytes for each row whose
    margin is in the bin: twice the whole units above the bin's lower end, and the label."""
    per_fold, n_lists = blocks.per_fold, len(blocks.lists)

    def packed(m: int, f: int, r: int, margin: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
        units = np.rint(margin * MARGIN_UNIT).astype(np.int64)
        bins = units // MARGIN_BIN
        low = ((units - bins * MARGIN_BIN) * 2 + label).astype("<u4")
        order = np.argsort(bins, kind="stable")
        bins, low = bins[order], low[order]
        edges = [0, *(np.flatnonzero(np.diff(bins)) + 1).tolist(), len(bins)]
        n = len(edges) - 1
        parts = [pa.array(np.full(n, v), pa.int32()) for v in (m, f, r)]
        return pa.RecordBatch.from_arrays([*parts, pa.array(bins[edges[:-1]], pa.int64()), pa.array([low[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())], names=["model", "feature", "repeat", "bin", "rows"])

    def of_chunk(fold: int, chunk: list[tuple[np.ndarray, np.ndarray, np.ndarray]], walks: dict[int, list[Walk]]) -> Iterator[pa.RecordBatch]:
        for k in range(per_fold):
            m, parts = fold * per_fold + k, []
            if m not in walks:
                continue
            for x, y, margins in chunk:
                known = np.flatnonzero(y[k // n_lists] != NO_LABEL)
                xs = x.take(known, axis=1)
                values = [walk.values(xs) for walk in walks[m]]
                parts.append((xs, y[k // n_lists, known], margins[k, known] + sum(values), values, [walk.asked(xs) for walk in walks[m]]))
            label = np.concatenate([p[1] for p in parts])
            if not len(label):
                continue
            yield packed(m, -1, 0, np.concatenate([p[2] for p in parts]), label)
            for f in sorted({int(f) for walk in walks[m] for f in walk.feature[walk.feature >= 0]}):
                new: list[list[np.ndarray]] = [[] for _ in range(repeats)]
                for xs, _, whole, values, asked in parts:
                    # a row whose way through a tree does not ask for the column keeps the tree's value
                    users = [(walk, rows, value[rows]) for walk, value, a in zip(walks[m], values, asked, strict=True) for rows in [np.flatnonzero((a == f).any(axis=0))] if len(rows)]
                    kept, n = xs[f].copy(), xs.shape[1]
                    for r in range(repeats):
                        margin = whole.copy()
                        xs[f] = kept[np.random.default_rng([seed, r, f, n, int(kept.sum())]).permutation(n)]
                        for walk, rows, value in users:
                            margin[rows] += walk.values(xs, rows) - value
                        new[r].append(margin)
                    xs[f] = kept
                for r in range(repeats):
                    yield packed(m, f, r, np.concatenate(new[r]), label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks, chunk, held = {m: [Walk(tree) for tree in found] for m, found in trees.items()}, [], 0
        last = None
        for batch in batches:
            row = {c: batch.column(c) for c in ("n", "x", "y", "margin")}
            for i in range(batch.num_rows):
                fold, n = batch.column("fold")[i].as_py(), row["n"][i].as_py()
                if chunk and (fold != last or held + n > CHUNK_ROWS):
                    yield from of_chunk(last, chunk, walks)
                    chunk, held = [], 0
                chunk.append(_block(row, i, per_fold))
                held, last = held + n, fold
        if chunk:
            yield from of_chunk(last, chunk, walks)

    return blocks.rows.where(F.col("role") == TEST).mapInArrow(run, "model int, feature int, repeat int, bin long, rows binary")


def _named(blocks: Blocks, m: int, f: int) -> tuple[str, str, str]:
    return (*blocks.models()[m][1:], blocks.features[f] if f >= 0 else "")


def permuted_counts(blocks: Blocks, trees: dict[int, list[Tree]], repeats: int, seed: int) -> DataFrame:
    """``target, horizon, feature, repeat, p, pos, neg``: the rows of ``permuted_margins`` by score; the
    feature is empty where none is permuted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, f, r, b, rows in zip(*[batch.column(c).to_pylist() for c in ("model", "feature", "repeat", "bin", "rows")], strict=True):
                margins, pos, neg = _steps(np.frombuffer(rows, "<u4"))
                n = len(margins)
                names = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), [v]).cast(pa.string()) for v in _named(blocks_, m, f)]
                p = 1 / (1 + np.exp(-(b * MARGIN_BIN + margins) / MARGIN_UNIT))
                yield pa.RecordBatch.from_arrays([*names, pa.array(np.full(n, r), pa.int32()), pa.array(p), pa.array(pos), pa.array(neg)], names=["target", "horizon", "feature", "repeat", "p", "pos", "neg"])

    blocks_ = replace(blocks, rows=None)  # without the table, which tasks cannot have
    return permuted_margins(blocks, trees, repeats, seed).mapInArrow(run, "target string, horizon string, feature string, repeat int, p double, pos double, neg double")


def _steps(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct margins of a bin in order, and how many rows of either class have each."""
    rows = np.sort(rows)
    margins = (rows >> 1).astype(np.int64)
    edges = np.r_[0, np.flatnonzero(np.diff(margins)) + 1]
    pos = np.add.reduceat((rows & 1).astype(float), edges)
    return margins[edges], pos, np.diff(np.r_[edges, len(rows)]) - pos


def permuted_areas(blocks: Blocks, trees: dict[int, list[Tree]], repeats: int, seed: int) -> DataFrame:
    """``target, horizon, feature, repeat, auc``: the exact area under the curve of ``permuted_margins``.
    What belongs to a bin meets in one task as packed numbers, which are ordered there; a window runs down the
    bins. No task sees all margins, and Spark no row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("model", "feature", "repeat", "bin")
        key, held = None, []
        for batch in batches:
            for at, rows in zip(zip(*[batch.column(c).to_pylist() for c in names], strict=True), batch.column("rows"), strict=True):
                if at != key and held:
                    yield summed(key, held)
                    held = []
                key = at
                held.append(np.frombuffer(rows.as_buffer(), "<u4").copy())
        if held:
            yield summed(key, held)

    def summed(key: tuple, held: list[np.ndarray]) -> pa.RecordBatch:
        _, pos, neg = _steps(np.concatenate(held))
        won = (pos * (np.cumsum(neg) - neg / 2)).sum()  # a positive beats the negatives below it and half of those that tie
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, pos.sum(), neg.sum(), won), strict=True))], schema=schema)

    schema = pa.schema([("model", pa.int32()), ("feature", pa.int32()), ("repeat", pa.int32()), ("bin", pa.int64()), *[(c, pa.float64()) for c in ("pos", "neg", "won")]])
    keys = ["model", "feature", "repeat"]
    met = permuted_margins(blocks, trees, repeats, seed).repartition(*keys, "bin").sortWithinPartitions(*keys, "bin")
    bins = met.mapInArrow(run, "model int, feature int, repeat int, bin long, pos double, neg double, won double")
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = bins.withColumn("won", F.col("won") + F.col("pos") * below).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "won")])
    named = blocks.rows.sparkSession.createDataFrame([(m, f, *_named(blocks, m, f)) for m in trees for f in (-1, *blocks.columns(m).tolist())], "model int, feature int, target string, horizon string, name string")
    area = F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("won") / (F.col("pos") * F.col("neg")))
    return sums.join(named, ["model", "feature"]).select("target", "horizon", F.col("name").alias("feature"), "repeat", area.alias("auc"))


def gains(blocks: Blocks, trees: dict[int, list[Tree]]) -> list[tuple[str, str, str, str, float]]:
    """(fold, target, list, feature, sum of the gains of its splits) of every feature of every model."""
    out = []
    for m, found in trees.items():
        total = dict.fromkeys((blocks.features[f] for f in blocks.columns(m)), 0.0)
        for tree in found:
            for node in np.flatnonzero(tree.feature >= 0):
                total[blocks.features[tree.feature[node]]] += float(tree.gain[node])
        out += [(*blocks.models()[m], name, gain) for name, gain in total.items()]
    return out
