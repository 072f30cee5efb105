"""Raw schedule files in two layouts, staged legs, manifests and sinks. All fields are read as text
by position, and typed afterwards; what cannot be read becomes null."""

from __future__ import annotations

import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from skyledger.functions import columns as C
from skyledger.operators.fact import label_carriers


@dataclass(frozen=True, eq=False)
class Layout:
    """``places`` has the position of each meaning among ``width`` fields."""

    name: str
    separator: str
    encoding: str
    width: int
    places: dict[str, int]
    cause_is_code: bool


_LEGACY = ("airline", "flight_number", "di", "line_type", "origin_icao", "dest_icao", "sched_dep", "actual_dep", "sched_arr", "actual_arr", "status", "cause")
LEGACY = Layout("legacy", ",", "ISO-8859-1", 12, {n: k for k, n in enumerate(_LEGACY)}, True)
WIDE = Layout(
    "wide", ";", "UTF-8", 20,
    {"airline": 0, "flight_number": 2, "di": 3, "line_type": 4, "origin_icao": 7, "sched_dep": 9, "actual_dep": 10, "dest_icao": 11, "sched_arr": 13, "actual_arr": 14, "status": 15, "cause": 16},
    False,
)


def layout_for(year: int, wide_from: int = 2010) -> Layout:
    return WIDE if year >= wide_from else LEGACY


def lines_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, path, block, at, raw``: the lines of files as bytes. Spark cuts files into blocks of bytes
    that end with a line; ``at`` rises along a block."""
    found = spark.read.text(paths).select(F.col("value").cast("binary").alias("raw"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return found.withColumn("at", F.monotonically_increasing_id())


def _read(spark: SparkSession, paths: str | list[str], layout: Layout) -> DataFrame:
    """``lines_of`` with ``fields`` and ``reason``: why a line is none of the layout (null for one that is
    and for headers, whose fields are null). A file's first line is its header, and so are its repeats."""
    lines = lines_of(spark, paths)
    headers = lines.groupBy("path").agg(F.min_by("raw", F.struct("block", "at")).alias("header"))  # a row a file
    bare = F.when(F.substring("raw", -1, 1) == F.lit(b"\r"), F.expr("substring(raw, 1, octet_length(raw) - 1)")).otherwise(F.col("raw"))
    rows = lines.join(F.broadcast(headers), "path")
    legible = F.is_valid_utf8(bare.cast("string")) if layout.encoding == "UTF-8" else F.lit(True)
    fields = F.split(F.decode(F.when(legible, bare), layout.encoding), f"\\Q{layout.separator}\\E", -1)
    why = F.when(~legible, "encoding").when(F.size(fields) != layout.width, "width")
    is_header = F.col("raw") == F.col("header")
    return rows.withColumns({"fields": F.when(~is_header, fields), "reason": F.when(~is_header, why)}).drop("header")


def scan(spark: SparkSession, paths: str | list[str], layout: Layout) -> DataFrame:
    """The fields of well-formed rows. Quotes are ordinary characters."""
    rows = _read(spark, paths, layout).where("fields is not null and reason is null")
    return rows.select(*[F.nullif(F.get("fields", F.lit(k)), F.lit("")).alias(n) for n, k in layout.places.items()])


def rejects(spark: SparkSession, paths: str | list[str], layout: Layout) -> DataFrame:
    """``file, path, line, reason, text`` of the lines that ``scan`` leaves out, headers aside: those that
    are not in the layout's encoding or have another number of fields. Lines are counted from 1 over
    all blocks of a file."""
    rows = _read(spark, paths, layout)
    blocks = rows.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))  # a row a block
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    bad = rows.where("reason is not null").join(starts, ["path", "block"])
    return bad.select("file", "path", (F.col("start") + F.col("at") - F.col("first") + 1).alias("line"), "reason", F.decode("raw", "ISO-8859-1").alias("text"))


def typed(raw: DataFrame, layout: Layout, causes: DataFrame | None = None) -> DataFrame:
    """Typed legs of raw text. ``causes`` (text_key, cancelled, code) turns free text into codes; it
    is a reference table of some dozens of rows and is broadcast."""
    blank = lambda c: F.nullif(F.upper(F.trim(F.col(c))), F.lit(""))
    rows = raw.select(
        blank("airline").alias("airline"),
        F.trim("flight_number").try_cast("int").alias("flight_number"),
        C.clean_line("line_type").alias("line_type"),
        C.clean_di("di").alias("di"),
        blank("origin_icao").alias("origin_icao"),
        blank("dest_icao").alias("dest_icao"),
        C.clean_status("status").alias("status"),
        (C.clean_code("cause") if layout.cause_is_code else F.lit(None).cast("string")).alias("cause_code"),
        C.cause_key("cause").alias("text_key"),
        *[C.parse_time(c).alias(c) for c in ("sched_dep", "actual_dep", "sched_arr", "actual_arr")],
    )
    if not layout.cause_is_code and causes is not None:
        rows = cause_codes(rows.drop("cause_code"), causes)
    return rows.drop("text_key")


def cause_codes(rows: DataFrame, causes: DataFrame) -> DataFrame:
    """``cause_code`` by normalized text and whether the leg was cancelled (one text has two codes)."""
    table = causes.select("text_key", F.col("cancelled").alias("_cancelled"), F.col("code").alias("cause_code"))
    keyed = rows.withColumn("_cancelled", F.col("status") == "cancelled")
    return keyed.join(F.broadcast(table), ["text_key", "_cancelled"], "left").drop("_cancelled")


def staged(rows: DataFrame, metro: dict[str, str], groups: DataFrame | None = None) -> DataFrame:
    """The staged legs: reference clock, nodes, delays, universes, and carrier labels if given."""
    dep, arr = F.coalesce("sched_dep", "actual_dep"), F.coalesce("sched_arr", "actual_arr")
    day = F.to_date(dep)
    out = rows.withColumns(
        {
            "flight_date": day, "year": F.year(day).cast("short"), "month": F.month(day).cast("byte"), "ym": C.ym_of(day),
            "origin_node": C.node_of("origin_icao", metro), "dest_node": C.node_of("dest_icao", metro),
            "dep_delay_min": C.minutes_between("sched_dep", "actual_dep"), "arr_delay_min": C.minutes_between("sched_arr", "actual_arr"),
            "sched_block_min": C.block_minutes("sched_dep", "sched_arr"), "actual_block_min": C.block_minutes("actual_dep", "actual_arr"),
            "dep_hour": F.hour(dep).cast("byte"), "arr_hour": F.hour(arr).cast("byte"), "dow": F.weekday(day).cast("byte"),
            "is_realized": F.col("status") == "realized", "universe_repl": C.in_replication(),
        }
    )
    out = out.withColumns(
        {
            "route": C.route_of("origin_node", "dest_node"),
            "universe_ml": F.col("universe_repl") & F.col("is_realized"),
            "actual_time_suspect": C.suspect("dep_delay_min", "arr_delay_min"),
        }
    )
    return label_carriers(out, groups) if groups is not None else out


def stage_legs(spark: SparkSession, paths: dict[Layout, list[str]], metro: dict[str, str], groups: DataFrame | None = None, causes: DataFrame | None = None) -> DataFrame:
    """Both layouts in one plan."""
    out = None
    for layout, where in [(k, v) for k, v in ((LEGACY, paths.get(LEGACY)), (WIDE, paths.get(WIDE))) if v]:
        rows = typed(scan(spark, where, layout), layout, causes).select(*sorted(("airline", "flight_number", "line_type", "di", "origin_icao", "dest_icao", "status", "cause_code", "sched_dep", "actual_dep", "sched_arr", "actual_arr")))
        out = rows if out is None else out.unionByName(rows)
    return staged(out, metro, groups)


#: Rows of a staged file, level of its compression, and bytes of its row groups.
FILE_ROWS, LEVEL, GROUP_BYTES = 2_000_000, 9, 16 << 20


def write_staged(legs: DataFrame, path: str, file_rows: int = FILE_ROWS, level: int = LEVEL) -> None:
    """Parquet by the year a file came from; the column ``year`` in the rows is the flight's own. Rows are
    dealt to tasks by ranges of year, route and time, sorted in them, and cut into files of at most
    ``file_rows``, so the least and greatest values that files and their row groups keep let filters on these
    skip most. The driver finds the ranges out of a sample of each; there are as many as tasks, not as files."""
    rows, n = legs.withColumn("src_year", F.col("year")), legs.count()
    tasks = min(math.ceil(n / file_rows), max(legs.sparkSession.sparkContext.defaultParallelism, math.ceil(n / FILE_ROWS)))
    ordered = rows.repartitionByRange(max(1, tasks), "src_year", "route", "sched_dep").sortWithinPartitions("src_year", "route", "sched_dep")
    options = {"maxRecordsPerFile": file_rows, "compression": "zstd", "parquet.compression.codec.zstd.level": level, "parquet.block.size": GROUP_BYTES}
    ordered.write.options(**options).partitionBy("src_year").mode("overwrite").parquet(path)


def files_for(staged: DataFrame, route: str) -> DataFrame:
    """``n_files, n_needed, n_rows``: how many files there are, how many may hold the route by the least and
    greatest one in them, and the rows of the route. A check of the layout, not a way to read."""
    each = staged.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min("route").alias("low"), F.max("route").alias("high"), F.count_if(F.col("route") == route).alias("n"))
    return each.agg(F.count(F.lit(1)).alias("n_files"), F.count_if((F.col("low") <= route) & (F.col("high") >= route)).alias("n_needed"), F.sum("n").alias("n_rows"))


def read_staged(spark: SparkSession, path: str, years: tuple[int, ...] | None = None) -> DataFrame:
    """Folder names are not data: files are read for what is in them, and years filter by column."""
    out = spark.read.option("recursiveFileLookup", True).parquet(path)
    return out.where(F.col("year").isin(*years)) if years else out


def scan_reference(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A reference table kept as CSV with a header: columns by name, whatever their order in the file
    and whatever others it has; an empty field is null. A column that the file lacks is an error."""
    text = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    wanted = StructType.fromDDL(schema)
    if lacking := [f.name for f in wanted if f.name not in text.columns]:
        raise ValueError(f"{path}: no column {', '.join(lacking)}")
    return text.select(*[F.nullif(F.trim(F.col(f"`{f.name}`")), F.lit("")).try_cast(f.dataType).alias(f.name) for f in wanted])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names; where that is unset, a local
    one if driver and executors are one process, else an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-skyledger-")
    return f"{root.rstrip('/')}/skyledger-{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch table and read from it, for what is read many times."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_csv_gz(df: DataFrame, path: str, keys: list[str], digits: int = 6) -> None:
    floats = {f.name: F.bround(F.col(f.name).cast("double"), digits) for f in df.schema if f.dataType.simpleString() in ("double", "float")}
    df.withColumns(floats).orderBy(*keys).write.option("compression", "gzip").option("header", True).mode("overwrite").csv(path)


#: Bytes up to which a file is hashed as one value, and names whose files Spark would unpack as lines.
WHOLE_BYTES, PACKED = 128 << 20, r"\.(gz|bz2|zst|lz4|snappy|deflate|lzo)$"


class Sha256:
    """SHA-256 with a state that one task can hand to the next: the context of the library below hashlib."""

    CONTEXT_BYTES = 112

    def __init__(self, state: bytes | None = None):
        import _hashlib

        self.library = ctypes.CDLL(_hashlib.__file__)
        self.context = ctypes.create_string_buffer(state or b"", self.CONTEXT_BYTES)
        if state is None:
            self.library.SHA256_Init(self.context)

    def update(self, data: bytes) -> None:
        self.library.SHA256_Update(self.context, data, ctypes.c_size_t(len(data)))

    def state(self) -> bytes:
        return self.context.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.library.SHA256_Final(out, ctypes.create_string_buffer(self.context.raw, self.CONTEXT_BYTES))
        return out.raw.hex()


def unglobbed(path: str) -> str:
    """The path of one file, whatever signs it has."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def sha256_by_parts(spark: SparkSession, path: str, size: int) -> str:
    """The SHA-256 of a file of any size. It depends on the bytes in order, so a task for each split of the
    file takes up the state that the one before it left; 112 bytes pass through the driver. Bytes are read as lines, which
    Spark splits, and a line must be below 2 GB."""
    lines = spark.read.option("lineSep", "\n").text(unglobbed(path)).select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_block_start").alias("start"))
    parts = lines.rdd.getNumPartitions()

    def step(state: bytes, begun: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            digest, n, going, start = Sha256(state), 0, begun, None
            for batch in batches:
                if batch.num_rows:
                    start = batch.column("start")[0].as_py() if start is None else start
                    block = (b"\n" if going else b"") + b"\n".join(batch.column("line").to_pylist())
                    digest.update(block)
                    n, going = n + len(block), True
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((digest.state(), pa.binary()), (n, pa.int64()), (going, pa.bool_()), (start, pa.int64()))], names=["state", "n", "begun", "start"])

        return lines.mapInArrow(run, "state binary, n long, begun boolean, start long")

    for mark in (b"", b"\xef\xbb\xbf"):  # of a file that begins with the second one, the reader leaves it out
        digest, n, begun, last = Sha256(), len(mark), False, -1
        digest.update(mark)
        for k in range(parts):
            (r,) = spark.sparkContext.runJob(step(digest.state(), begun).rdd, list, [k])
            if r["start"] is not None and r["start"] <= last:
                raise ValueError(f"{path}: its splits are not in order")
            digest, n, begun, last = Sha256(bytes(r["state"])), n + r["n"], r["begun"], last if r["start"] is None else r["start"]
        if n == size - 1:  # the end of the last line
            digest.update(b"\n")
        if n in (size, size - 1):
            return digest.hexdigest()
    raise ValueError(f"{path}: {n} bytes read, {size} listed")


def manifest(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """``file, path, bytes, sha256`` of each file, read by the executors: files of more than ``WHOLE_BYTES``
    split by split, a few at a time, and others as one value. Packed ones (``PACKED``) are one value always, below 2 GB."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    shown = lambda rows: rows.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "path", F.col("length").alias("bytes"), "sha256")
    whole = lambda rows: shown(rows.withColumn("sha256", F.sha2("content", 256)))
    large = files.where(F.col("length") > WHOLE_BYTES).select("path", "length").collect()  # a row a large file, without its content
    if not large:
        return whole(files)
    out = whole(files.where(F.col("length") <= WHOLE_BYTES))  # the reader takes this filter, so others' content is not read
    if packed := [unglobbed(r["path"]) for r in large if re.search(PACKED, r["path"])]:
        out = out.unionByName(whole(spark.read.format("binaryFile").load(packed)))
    with ThreadPoolExecutor(8) as pool:
        sums = list(pool.map(lambda r: (*r, sha256_by_parts(spark, *r)), [r for r in large if not re.search(PACKED, r["path"])]))
    return out.unionByName(shown(spark.createDataFrame(sums, "path string, length long, sha256 string")))


def new_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files whose name, size and content are not in the manifest before."""
    return now.join(before.select("file", "bytes", "sha256"), ["file", "bytes", "sha256"], "left_anti")


def layout_profile(spark: SparkSession, path: str, separators: tuple[str, ...] = (",", ";", "\t", "|")) -> DataFrame:
    """How many lines of each file have how many fields by which separator, and how many a quote."""
    lines = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), "[^/]+$", 0).alias("file"), "value")
    counts = F.array(*[F.struct(F.lit(s).alias("separator"), F.size(F.split("value", f"\\Q{s}\\E")).alias("n_fields")) for s in separators])
    rows = lines.select("file", F.contains("value", F.lit('"')).cast("int").alias("quoted"), F.explode(counts).alias("c"))
    return rows.groupBy("file", "c.separator", "c.n_fields").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("quoted").alias("n_quoted"))
