"""Near copies by SimHash and word shingles, for stages that no contract binds to four words and bits.

A text's set has its distinct shingles of ``WIDTH`` words (of a shorter text, the whole of it).
Texts of equal sets make one class. Candidates come from two sources, and each is confirmed by the
exact similarity of both sets:

* the links of ``op7_simhash``, its trie self-join over fingerprints of ``WIDTH``-word shingles;
* classes that agree on ``ROWS`` least hashes in one of ``BANDS`` bands. Two texts of similarity 0.8
  differ in about ten of 64 bits of a fingerprint, and no block scheme finds those without nearly
  all other pairs, so SimHash alone gives the nearest copies only; two sets of similarity 0.8 miss
  each other in all bands three times in 100,000.

Within a band's bucket of up to ``BESIDE + 1`` classes all pairs are candidates. In a larger one each
class first stands beside the next one in an order that differs by bucket, in chunks of about
``UNIT_ROWS``. As a class has many bands, that connects dense groups, with few pairs that say the same
again; a bucket whose classes are one group then needs no more pairs. Where one group has most classes of
a bucket, but not all, each class stands beside the two next ones in another order, of which those of its
own group are passed by: that joins to the group most of what is left of it.
The classes of buckets that still hold several groups meet in an exact join, so that no
pair is left out: shingles are put in one order for all, those that few classes have first, and each
class has keys of its first ones, as many as leave less than ``LEAST`` of its set. Two sets of that
similarity share one of these, and where the first that they share stands bounds what they can share at
all; so texts that only have a passage in common, which stands last, do not become pairs. All pairs of a
key's groups that can reach the similarity are candidates. Where that many texts are that close to each
other and yet no group, the pairs are as many as the exact job has; tasks hold ``PAIR_ROWS`` rows of them.

The components of confirmed pairs are the groups.

Defined results: null texts and texts without a word have the empty set and are one class; rows
without an id are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import drop, join_spread, map_texts, stash
from skyledger.llm.components import components
from skyledger.llm.op7_simhash import SEED, near_links, shingle_hashes, votes_of

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 20, 4
BESIDE, UNIT_ROWS = 8, 4096
#: Rows of a key that meet the same number in one task, and places of the table by which shingles are put in order.
PAIR_ROWS, PLACES = 1024, 1 << 16


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted. Words are those of ``op7_simhash``."""
    return np.unique(shingle_hashes(text, width))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed number for each band; none of an empty set."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return []
    draw = np.random.default_rng(SEED).integers(0, 1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64)
    a, b = draw[0] | np.uint64(1), draw[1]
    least = np.min([(hashes[k : k + 2048, None] * a + b).min(axis=0) for k in range(0, len(hashes), 2048)], axis=0)
    keys = [xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def identified(docs: DataFrame) -> DataFrame:
    """``doc_id, text, h`` of the rows with an id; ``doc_id, h`` stand for the row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.where("doc_id is not null").withColumn("h", F.xxhash64("text"))


def marked_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, h, cls, n, fp, keys``: each row's class, its set's size, its fingerprint and its band
    keys. Rows of a class may have several fingerprints, as these count repeats of a shingle."""

    def step():
        from xxhash import xxh64_intdigest

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes = [shingle_hashes(t or b"", WIDTH) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            fps, sets = np.array([votes_of(h) for h in hashes], dtype="<u8").view("<i8"), [np.unique(h) for h in hashes]
            cls = np.array([xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
            columns = [batch.column("doc_id"), batch.column("h"), pa.array(cls, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(fps, pa.int64()), pa.array(map(band_keys, sets), pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "cls", "n", "fp", "keys"])

        return run

    return map_texts(identified(docs), step, "doc_id long, h long, cls long, n int, fp long, keys array<long>")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """``cls, hashes`` of rows with ``cls, text``."""

    def step():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t or b"").view("<i8") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "hashes"])

        return run

    return map_texts(rows.select("cls", "text"), step, "cls long, hashes array<long>")


def candidates(keyed: DataFrame, salt: int = 0) -> DataFrame:
    """``a, b``: classes (``cls, n, root``, and a ``key``) that meet in a bucket, are not in one group
    yet, and whose sizes allow the similarity. In large buckets a class meets the next one in the first
    order (``salt`` 0), and the two next ones in the second (1)."""
    shared = stash(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "band-keys")
    order = F.xxhash64("cls", "key", F.lit(salt)) if salt else F.xxhash64("cls", "key")
    reach = F.when(F.col("n") > BESIDE + 1, 1 + salt).otherwise(BESIDE)
    met = join_spread(keyed.withColumnRenamed("n", "size"), shared, ["key"])
    dealt = met.select("key", "cls", "root", F.col("size").alias("n"), reach.alias("reach"), order.alias("order"), F.pmod(F.xxhash64("key", "cls"), F.ceil(F.col("n") / UNIT_ROWS)).alias("chunk"))
    along = Window.partitionBy("key", "chunk").orderBy("order", "cls").rowsBetween(1, BESIDE)
    beside = dealt.withColumn("beside", F.collect_list(F.struct("cls", "n", "root")).over(along))
    pairs = beside.select("cls", "n", "root", F.explode(F.slice("beside", 1, F.col("reach"))).alias("o")).where((F.least("n", "o.n") >= LEAST * F.greatest("n", "o.n")) & (F.col("root") != F.col("o.root")))
    return pairs.select(F.least("cls", "o.cls").alias("a"), F.greatest("cls", "o.cls").alias("b")).where("a <> b").distinct()


def crowded(keyed: DataFrame) -> DataFrame:
    """The rows of keys that more than ``BESIDE + 1`` classes of several groups have, and whether one
    group has most of these (``led``)."""
    groups = keyed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    keys = groups.groupBy("key").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.count(F.lit(1)).alias("groups"))
    found = keys.where((F.col("all") > BESIDE + 1) & (F.col("groups") > 1))
    return keyed.join(found.select("key", (2 * F.col("most") > F.col("all")).alias("led")), "key")


def first_shingles(sets: DataFrame) -> DataFrame:
    """``cls, size, key, at``: of each class the first shingles, as many as leave less than ``LEAST`` of
    its set, each with its place from 0, in an order that is the same for all classes: by how many sets
    have a shingle of its place in a table of ``PLACES`` counts, few first. Those that no other has are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PLACES, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("hashes").flatten().to_numpy() & (PLACES - 1), minlength=PLACES)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], names=["place", "n"])

    counts = np.zeros(PLACES, np.int64)
    for r in sets.mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():  # at most PLACES
        counts[r["place"]] = r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, hashes in zip(batch.column("cls").to_pylist(), batch.column("hashes"), strict=True):
                h = hashes.values.to_numpy()
                often = counts[h & (PLACES - 1)]
                first = np.lexsort((h, often))[: len(h) - math.ceil(LEAST * len(h) - 1e-6) + 1]
                at = np.flatnonzero(often[first] > 1)
                same = [np.full(len(at), v, np.int64) for v in (cls, len(h))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*same, h[first[at]], at)], names=["cls", "size", "key", "at"])

    return sets.mapInArrow(run, "cls long, size long, key long, at long")


def pairs_of_groups(keyed: DataFrame) -> DataFrame:
    """``a, b``: classes (``cls, size, root, key, at``) of one key and two groups whose sets can have
    the similarity, if the key is the first that they share. The rows of a key's largest group meet those of the others only."""
    groups = keyed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    keys = stash(groups.groupBy("key").agg(F.sum("n").alias("n"), F.max_by("root", F.struct("n", "root")).alias("largest"), F.count(F.lit(1)).alias("groups")).where("groups > 1"), "shingle-keys")
    chunks = F.ceil(F.col("n") / PAIR_ROWS).cast("int")
    rows = join_spread(keyed, keys, ["key"]).withColumns({"chunk": F.pmod(F.xxhash64("key", "cls"), chunks).cast("int"), "all": F.sequence(F.lit(0), chunks - 1)})
    side = lambda p, own, other: [F.col(c).alias(f"{p}_{c}") for c in ("cls", "size", "root", "at")] + [F.col("chunk").alias(own), F.explode("all").alias(other)]
    left, right = rows.where("root <> largest").select("key", *side("l", "i", "j")), rows.select("key", "largest", *side("r", "j", "i"))
    once = (F.col("l_root") != F.col("r_root")) & ((F.col("r_root") == F.col("largest")) | (F.col("l_cls") < F.col("r_cls")))
    enough = LEAST / (1 + LEAST) * (F.col("l_size") + F.col("r_size")) - 1e-6
    near = F.least(F.col("l_size") - F.col("l_at"), F.col("r_size") - F.col("r_at")) >= enough
    pairs = left.join(right, ["key", "i", "j"]).where(once & near & (F.least("l_size", "r_size") >= LEAST * F.greatest("l_size", "r_size")))
    return pairs.select(F.least("l_cls", "r_cls").alias("a"), F.greatest("l_cls", "r_cls").alias("b")).distinct()


def linked_classes(classes: DataFrame) -> DataFrame:
    """``a, b``: classes (``cls, fp``) that ``op7_simhash`` links, each fingerprint stood for by its
    least class."""
    heads = stash(classes.groupBy("fp").agg(F.min("cls").alias("head"), F.count(F.lit(1)).alias("n")), "heads")
    equal = join_spread(classes.select("cls", "fp"), heads, ["fp"]).select(F.col("cls").alias("a"), F.col("head").alias("b"))
    one, other = heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), heads.select(F.col("fp").alias("b"), F.col("head").alias("y"))
    near = near_links(heads.select("fp")).join(one, "a").join(other, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    both = equal.unionByName(near).where("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def in_groups(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` of classes with the ``root`` of the group that each is in, its own one if it has none."""
    return rows.drop("root").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def near_copies(docs: DataFrame) -> DataFrame:
    """``cls, least, root`` for each class of the rows with an id: its least row ``(doc_id, h)`` and
    the group it is in, a class's own one if it has no near copy."""
    marked = stash(marked_rows(docs), "shingle-classes")
    classes = stash(marked.groupBy("cls").agg(F.min(F.struct("doc_id", "h")).alias("least"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("keys").alias("keys")), "classes")
    keyed = classes.select("cls", "n", F.col("cls").alias("root"), F.explode("keys").alias("key"))
    pairs = stash(candidates(keyed).unionByName(linked_classes(classes)).distinct(), "candidates")
    sets = stash(sets_of(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()), "shingle-sets")
    links = confirmed(pairs, sets)
    drop(pairs, sets)
    roots = components(links).select(F.col("node").alias("cls"), "root")
    rest = stash(crowded(in_groups(keyed, roots)), "crowded")
    if not rest.isEmpty():
        pairs, sets = stash(candidates(rest.where("led").drop("led"), 1), "candidates"), stash(sets_of(docs, classes, rest.select("cls").distinct()), "shingle-sets")
        links = links.unionByName(confirmed(pairs, sets))
        drop(pairs)
        roots = components(links).select(F.col("node").alias("cls"), "root")
        apart = stash(crowded(in_groups(rest.drop("led"), roots)).select("cls").distinct(), "crowded")
        if not apart.isEmpty():
            shingles = stash(in_groups(first_shingles(sets.join(apart, "cls", "left_semi")), roots), "first-shingles")
            pairs = stash(pairs_of_groups(shingles), "candidates")
            roots = components(links.unionByName(confirmed(pairs, sets))).select(F.col("node").alias("cls"), "root")
            drop(pairs, shingles)
        drop(sets, apart)
    named = classes.select("cls", "least").join(roots, "cls", "left")
    return named.select("cls", "least", F.coalesce("root", "cls").alias("root"))


def sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``shingle_sets`` of the classes in ``wanted``."""
    rows = classes.join(wanted, "cls").select("cls", "least.doc_id", "least.h")
    # repeated rows go where the join has brought them together, so the sets are not shuffled for that
    return shingle_sets(identified(docs).join(rows, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The candidates ``a, b`` whose sets have a similarity of ``LEAST`` or more."""
    left, right = sets.select(F.col("cls").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("cls").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return stash(pairs.join(left, "a").join(right, "b").where(both >= LEAST * (F.size("x") + F.size("y") - both)).select("a", "b"), "links")
