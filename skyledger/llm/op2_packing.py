"""Operator 2: best-fit decreasing packing of documents into sequences of bounded length.

Three steps, none of which gathers documents:

1. Each task encodes its texts, cuts those longer than a sequence, and numbers its pieces of each
   length; the pieces are written as a table (``lane`` is the task's number).
2. Best-fit decreasing needs only how many pieces there are of each length, at most ``capacity``
   numbers whatever the rows. It takes lengths in falling order and puts each piece in the open
   bin with the least room that still holds it. A segment tree over remaining capacities finds
   that room in logarithmic time. Bins with equal contents so far stand together as one run, and
   the pieces of equal length that go to a run are placed at once; the result is that of placing
   one after the other.
3. A piece's number within its length (its number in its lane, plus the pieces of that length in
   lanes before) picks its bin and its offset from the plan by a broadcast join: the plan has a
   few rows for each length, and its size does not follow the rows.

Defined results: a null text is an empty one, its document the end id alone; repeated ids are
packed like any others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.llm.chunked_tokens import worker_encoder
from skyledger.llm.common import documents, stash, text_slices, texts_of

PIECE_SCHEMA = "doc_id long, piece int, start long, length int, lane int, lane_rank long, ids binary"
PLAN_SCHEMA = "length int, rank_from long, rank_to long, first_bin long, per_bin long, at long"


class RoomTree:
    """Segment tree over remaining capacities 0..top: the number of open bins at each leaf, and
    whether a subtree has any above it."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, bins: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += bins
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest room of at least ``need`` that an open bin has."""
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """The plan hangs on how many lengths there are and hardly on how many pieces (4050 rows on the 0.1
    scale, 4774 with every count times 100,000). Rows ``(length, rank_from, rank_to, first_bin, per_bin, at)``: the pieces of ``length``
    numbered ``rank_from .. rank_to - 1`` go ``per_bin`` to a bin, from ``first_bin`` on, the
    first of each bin at offset ``at``."""
    tree, runs, plan, bins = RoomTree(capacity), defaultdict(list), [], 0

    def open_run(room: int, first: int, n: int) -> None:
        if room and n:
            runs[room].append((first, n))
            tree.add(room, n)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = runs[room].pop()
                tree.add(room, -n)
            each = room // length
            full = min(n, left // each)
            rest = min(left - full * each, each) if full < n else 0
            if full:
                plan.append((length, rank, rank + full * each, first, each, capacity - room))
                open_run(room - each * length, first, full)
            if rest:
                plan.append((length, rank + full * each, rank + full * each + rest, first + full, rest, capacity - room))
                open_run(room - rest * length, first + full, 1)
            used = full + bool(rest)
            open_run(room, first + used, n - used)
            rank, left = rank + full * each + rest, left - full * each - rest
    return plan


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, kind: str = "byte", end_id: int = 0) -> DataFrame:
    """Encode every whole text and cut it: ``doc_id, piece, start, length, lane, lane_rank, ids``
    (little-endian unsigned 32-bit), as a written table. The first piece takes what is over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_encoder(tokenizer, kind)
        lane = TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        seen = defaultdict(int)
        for batch in batches:
            for part in text_slices(batch):
                rows: list[tuple] = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), coder.encode(texts_of(part)), strict=True):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        rows.append((doc, k, a, b - a, lane, seen[b - a], ids[4 * a : 4 * b]))
                        seen[b - a] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                names = [x.split(" ")[0] for x in PIECE_SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stash(slim.mapInArrow(run, PIECE_SCHEMA), "pieces")


def place(pieces: DataFrame, counted: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces. ``counted`` is the written table they come
    from, of which only ``lane`` and ``length`` are read."""
    spark = pieces.sparkSession
    counts = counted.groupBy("lane", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = counts.select("lane", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # a row for each length: at most ``capacity`` of them reach the driver
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(best_fit_plan(totals, capacity), PLAN_SCHEMA)
    ranked = pieces.join(lanes, ["lane", "length"]).withColumn("rank", F.col("lane_rank") + F.col("before"))
    within = (ranked["length"] == plan["length"]) & (ranked["rank"] >= plan["rank_from"]) & (ranked["rank"] < plan["rank_to"])
    step = F.col("rank") - F.col("rank_from")
    nth = F.pmod(step, F.col("per_bin"))
    return (
        ranked.join(F.broadcast(plan), within)
        .drop(plan["length"])
        .withColumn("sequence_id", F.expr("first_bin + (rank - rank_from) div per_bin"))
        .withColumn("offset", (F.col("at") + nth * F.col("length")).cast("long"))
        .drop("lane", "lane_rank", "before", "rank", "rank_from", "rank_to", "first_bin", "per_bin", "at")
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, kind: str = "byte", end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset`` for every piece of every document."""
    table = cut_pieces(docs, tokenizer, capacity, kind, end_id)
    return place(table, table, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids: ``sequence_id, n_ids, ids``. A group is one sequence, so its size is bounded."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_ids"), F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    table = cut_pieces(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    slim = table.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(slim, table).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"
    )
