"""Helpers that the text operators share: scratch tables, Arrow loops and hashing of ids.

Every operator selects the columns it needs by name (``doc_id`` and ``text``), so further
columns of the input, whatever they are called, never reach its plan.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one inner step of an Arrow loop looks at, unless one text alone is longer.
SLICE_BYTES = 4 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder that ``spark.checkpoint.dir`` names.

    The setting is read from the session; where it is unset, a local temporary folder is taken if
    driver and executors are one process, and on a cluster that is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-skyledger-")
    return f"{root.rstrip('/')}/skyledger-{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a scratch table and return the table: it cuts the lineage, and a lost
    executor costs no more than its unfinished tasks. ``drop`` removes it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def drop(*tables: DataFrame | None) -> None:
    """Remove scratch tables that nothing reads any more. What ``stash`` did not write stays."""
    for table in tables:
        if path := table is not None and table.__dict__.get("_scratch"):
            where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Keys of a join that may be taken apart as hot ones, and rows below which no key is one.
MOST_HOT, LEAST_HOT = 10_000, 256


def hot_keys(sizes: DataFrame, least: int = LEAST_HOT) -> DataFrame | None:
    """The rows of ``sizes`` (a row for each key, ``n`` rows that have it) whose keys hold more than
    one in ``MOST_HOT`` of all rows and more than ``least`` rows, None if there are none. They are
    at most ``MOST_HOT``, whatever the rows are, and so they may be broadcast."""
    found = sizes.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    limit = max((found["total"] or 0) // MOST_HOT, least)
    return sizes.where(F.col("n") > limit) if (found["most"] or 0) > limit else None


def join_spread(rows: DataFrame, table: DataFrame, keys: list[str], least: int = LEAST_HOT) -> DataFrame:
    """``rows`` joined with ``table``, a written table of one row for each key that also has ``n``,
    how many of ``rows`` have the key. Rows of hot keys meet theirs by a broadcast of those few and
    stay where they are; the others are shuffled."""
    hot = hot_keys(table, least)
    if hot is None:
        return rows.join(table, keys)
    few = F.broadcast(hot)
    return rows.join(few, keys).unionByName(rows.join(few.select(*keys), keys, "left_anti").join(table, keys))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of an id written as decimal text (null: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def held_out(modulus: int, remainder: int, column: str = "doc_id") -> Column:
    """True for rows kept out of training; a null id is never held out."""
    return F.coalesce(id_crc(column) % modulus == remainder, F.lit(False))


def text_slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no slice has many more bytes of ``column`` than ``limit``."""
    if batch.num_rows == 0:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += int(n)
    yield batch.slice(at)


def map_texts(df: DataFrame, step: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """Run ``step()``, made once a task, on bounded slices of each Arrow batch.

    ``df`` must have a string column ``text``; ``step()`` returns a function from a slice to
    the batch that takes its place. Nothing is kept between slices except what that function
    holds on purpose.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = step()
        for batch in batches:
            for part in text_slices(batch, limit):
                yield work(part)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch) -> list[str]:
    """The texts of a slice; null counts as empty."""
    return [t or "" for t in batch.column("text").to_pylist()]


def carried(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """The columns ``carry`` and ``text``, the text as a string."""
    return docs.select(*[F.col(f"`{c}`") for c in carry if c != "text"], F.col("text").cast("string").alias("text"))


def columns_of(slim: DataFrame, carry: tuple[str, ...]) -> str:
    """The schema of ``carry`` as text."""
    return ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in carry)


def extended(batch: pa.RecordBatch, carry: tuple[str, ...], **new: pa.Array) -> pa.RecordBatch:
    """The columns ``carry`` of a batch and new ones after them."""
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], *new.values()], names=[*carry, *new])
