"""Operator 1: token ids as compressed planes of fixed-size blocks.

Format (a Parquet table, so any store that Spark reaches can hold it). Documents are dealt by
ranges of ``doc_id`` (of equal ids by a hash of the text); each range is a *shard*, a stream of ids in ascending ``doc_id`` order. The
stream is cut into blocks of ``block_ids`` ids. A block is transposed into byte planes (or bit
planes), each plane is compressed with zstandard, and the row holds:

* ``shard, block, first, n_ids``: where the block stands in its shard's stream;
* ``unit, plane_end, planes``: the planes one after the other and where each one ends;
* ``doc_id, doc_row, doc_len, doc_start, doc_from, seg_len``: arrays, an entry for each document
  that has ids in the block: which it is, its ids in all, its place in the shard, and which of
  its ids are here.

All columns but ``planes`` make the chunk index; Parquet reads them without the planes.

Defined results: a null text is an empty one and stores the end id alone; null ids of documents
come first; repeated ``doc_id`` stay separate documents, in any order among themselves; an empty
table gives an empty file and an empty result; a document of any length spans blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.llm.chunked_tokens import worker_encoder
from skyledger.llm.common import documents, scratch_path, text_slices, texts_of

BLOCK_SCHEMA = (
    "shard int, block int, first long, n_ids int, unit string, plane_end array<int>, planes binary, "
    "doc_id array<long>, doc_row array<int>, doc_len array<long>, doc_start array<long>, doc_from array<long>, seg_len array<int>"
)
SEGMENT_SCHEMA = "shard int, doc_row int, doc_id long, doc_len long, doc_start long, doc_from long, ids binary"


def to_planes(ids: np.ndarray, unit: str, compress) -> tuple[list[int], bytes]:
    """Transpose a block of ids into planes, lowest first, and compress each one.

    Planes above the highest bit in use are left out.
    """
    top = int(ids.max()).bit_length() if len(ids) else 0
    if unit == "byte":
        planes = [ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, k] for k in range((top + 7) // 8)]
    elif unit == "bit":
        planes = [np.packbits(((ids >> np.uint32(k)) & np.uint32(1)).astype(np.uint8)) for k in range(top)]
    else:
        raise ValueError(f"unknown unit of planes: {unit}")
    parts = [compress(np.ascontiguousarray(p).tobytes()) for p in planes]
    return np.cumsum([len(p) for p in parts], dtype=np.int64).tolist(), b"".join(parts)


def from_planes(n: int, unit: str, ends: list[int], planes: bytes, decompress) -> np.ndarray:
    """The ids of a block from its planes."""
    ids = np.zeros(n, dtype="<u4")
    at = 0
    for k, end in enumerate(ends):
        plane = np.frombuffer(decompress(planes[at:end]), dtype=np.uint8)
        if unit == "byte":
            ids |= plane.astype("<u4") << np.uint32(8 * k)
        else:
            ids |= np.unpackbits(plane, count=n).astype("<u4") << np.uint32(k)
        at = end
    return ids


def write_planes(
    docs: DataFrame, path: str, tokenizer: str, kind: str = "word", end_id: int = 1, block_ids: int = 65536, unit: str = "byte", level: int = 3
) -> None:
    """Encode every whole text and write the format to ``path``.

    Texts, not ids, are dealt by range: Spark samples the keys of a range by running what is
    below it, and so the texts are encoded once.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=level).compress
        coder = worker_encoder(tokenizer, kind)
        shard = TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        held: list[np.ndarray] = []
        segments: list[list] = []
        room, first, block, row, total = block_ids, 0, 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, segments, room, first, block
            ids = np.concatenate(held)
            ends, planes = to_planes(ids, unit, compress)
            columns = list(zip(*segments, strict=True))
            record = [[shard], [block], [first], [len(ids)], [unit], [ends], [planes], *[[list(c)] for c in columns]]
            held, segments, room, first, block = [], [], block_ids, first + len(ids), block + 1
            return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(record, fields, strict=True)], schema=pa.schema(fields))

        fields = _arrow_fields()
        for batch in batches:
            for part in text_slices(batch):
                for doc, ids in zip(part.column("doc_id").to_pylist(), coder.encode(texts_of(part)), strict=True):
                    stream = np.frombuffer(ids + end, dtype="<u4")
                    done = 0
                    while done < len(stream):
                        piece = stream[done : done + room]
                        held.append(piece)
                        segments.append([doc, row, len(stream), total, done, len(piece)])
                        done, room = done + len(piece), room - len(piece)
                        if not room:
                            yield flush()
                    total, row = total + len(stream), row + 1
        if held:
            yield flush()

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # a repeated or null id is dealt on by the text, so that no shard gets all of its rows
    dealt = slim.withColumn("h", F.xxhash64("text")).repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("h").asc()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").drop("h")
    # the planes are compressed already
    dealt.mapInArrow(pack, BLOCK_SCHEMA).write.option("compression", "none").parquet(path)


def _arrow_fields() -> list[pa.Field]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    out = []
    for item in BLOCK_SCHEMA.split(", "):
        name, kind = item.split(" ")
        out.append(pa.field(name, pa.list_(kinds[kind[6:-1]]) if kind.startswith("array") else kinds[kind]))
    return out


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """Where every block stands, without reading a plane."""
    return _read(spark, path).drop("planes")


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def read_segments(blocks: DataFrame) -> DataFrame:
    """Decode blocks; a row for each document's ids in each block. Blocks may be any choice of
    them: each is decoded by itself."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        decompress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for b in batch.to_pylist():
                ids = from_planes(b["n_ids"], b["unit"], b["plane_end"], b["planes"], decompress).tobytes()
                cuts = np.concatenate([[0], np.cumsum(b["seg_len"])]) * 4
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b["shard"]] * len(b["doc_id"]), pa.int32()),
                        pa.array(b["doc_row"], pa.int32()),
                        *[pa.array(b[c], pa.int64()) for c in ("doc_id", "doc_len", "doc_start", "doc_from")],
                        pa.array([ids[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    ],
                    names=["shard", "doc_row", "doc_id", "doc_len", "doc_start", "doc_from", "ids"],
                )

    return blocks.mapInArrow(unpack, SEGMENT_SCHEMA)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the file: ``doc_id, start, n_tokens, ids`` (little-endian unsigned
    32-bit). Only documents that span blocks are shuffled to put them together again. The
    offsets of shards are a row for each shard and are broadcast: as many as the writer had
    partitions, whatever the rows."""
    blocks = _read(spark, path)
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids_here"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", F.coalesce(F.sum("ids_here").over(before), F.lit(0)).alias("base"))
    whole = F.expr("doc_from = 0 and octet_length(ids) = 4 * doc_len")
    # decoded in either branch, each from its own blocks
    spans = F.exists(F.arrays_zip("doc_len", "seg_len"), lambda x: x["doc_len"] != x["seg_len"])
    single = read_segments(blocks).where(whole).select("shard", "doc_id", "doc_start", "doc_len", "ids")
    joined = (
        read_segments(blocks.where(spans))
        .where(~whole)
        .groupBy("shard", "doc_row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("doc_start").alias("doc_start"),
            F.first("doc_len").alias("doc_len"),
            F.sort_array(F.collect_list(F.struct("doc_from", "ids"))).alias("parts"),
        )
        .select(
            "shard", "doc_id", "doc_start", "doc_len", F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids")
        )
    )
    return (
        single.unionByName(joined)
        .join(F.broadcast(bases), "shard")
        .select("doc_id", (F.col("base") + F.col("doc_start")).alias("start"), F.col("doc_len").alias("n_tokens"), "ids")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "planes")
    write_planes(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
