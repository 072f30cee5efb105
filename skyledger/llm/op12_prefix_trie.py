"""Operator 12: the prefix trie of conversations, by van Emde Boas recursion.

A trie of height 2**k is cut at half depth. The segments of turns above the cut are named, each by
the smallest conversation that has it: they are the sequences of the *upper* trie, and a name is the
root of a *lower* trie, which the rest of the segments below the cut make up. Upper and lower tries
of all roots are cut again in the same round, in parallel, until they are one turn high: then every
segment is a node and the root of its trie is the node's parent. Equal segments are one row from the
first cut at which they are equal, so that copies and shared prompts cost no more than one conversation.

Segments are compared by fingerprints of blocks of 2**k turns (16 bytes of SHA-256, a block's from
those of its halves), so no row is longer than a turn, however long a conversation is.

Totals of subtrees are *grafted* upward over the same cuts. All that stands in a lower trie is added
up once, over the roots that each node has met on its way; then, from the greatest height down, the
sum below a cut is hung on the end of the segment above it, and what hangs on a segment is handed on
to its lower part, or to its upper one where it ends there. A node's total is its own weight and what
hangs on it. For turns of depth d there are three rounds for each binary digit of d.

Places within conversations come from one sort of all turns, and the hash of the ids that end in a
node from blocks of sorted ids, so no group is gathered in memory.

Defined results: rows without a conversation id are left out; null roles and texts are empty; turns of
equal number stand in order of role and text, and repeated rows are turns of their own. A table
without conversations has no nodes, and one of turnless conversations a root that is its own leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.llm.common import drop, stash

#: Fixed values of the rebuilding: conversations of a family share the first turns of one of them.
FAMILY, MOST_SHARED = 5, 9
#: Bytes of ids that are joined to one text.
IDS_BYTES = 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()


def _short_hash(content: Column) -> Column:
    return F.substring(F.unhex(F.sha2(content, 256)), 1, 16)


def placed_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, i, name, bytes`` of every turn: its place from 1, a fingerprint of role and text, and the
    bytes of the text. All turns are sorted together; a conversation may stretch over many partitions."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn"), text("role").alias("role"), text("text").alias("text"))
    name = _short_hash(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    ordered = turns.orderBy("conv_id", F.asc_nulls_first("turn"), "role", "text")
    rows = stash(ordered.select("conv_id", name.alias("name"), F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("at")), "turns")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy("part", "conv_id").agg(F.count(F.lit(1)).alias("n")).groupBy("part").agg(F.min(F.struct("conv_id", "n")).alias("first"), F.max(F.struct("conv_id", "n")).alias("last"))
    before: list[tuple[int, int, int]] = []
    open_, length = None, 0
    for r in sorted(parts.collect(), key=lambda r: r["part"]):  # a row for each partition of the sort
        carried = length if r["first"]["conv_id"] == open_ else 0
        before.append((r["part"], r["first"]["conv_id"], carried))
        alone = r["first"]["conv_id"] == r["last"]["conv_id"]
        open_, length = r["last"]["conv_id"], r["last"]["n"] + (carried if alone else 0)
    table = F.broadcast(rows.sparkSession.createDataFrame(before, "part long, conv_id long, carried long"))
    inside = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy("at"))
    numbered = rows.withColumn("inside", inside).join(table, ["part", "conv_id"], "left")
    return stash(numbered.select("conv_id", (F.coalesce("carried", F.lit(0)) + F.col("inside")).alias("i"), "name", "bytes"), "placed")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns ``conv_id, j, name, bytes`` (``j`` from 0) of rebuilt conversations, and all ids.

    A conversation has the first turns of its family's first one, as many as its id's checksum says,
    and then its own turns after as many."""
    convs = stash(placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "ids")
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).alias("h")
    base = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")
    heads = placed.where(F.col("i") < MOST_SHARED).select(F.col("conv_id").alias("base"), "i", "name", "bytes")
    taken = convs.select("conv_id", base, shared).join(heads, "base").where("i <= h").select("conv_id", (F.col("i") - 1).alias("j"), "name", "bytes")
    sizes = convs.select(F.col("conv_id").alias("base"), "n")
    own = placed.select("conv_id", "i", "name", "bytes", base, shared).where("i > h").join(sizes, "base", "left")
    kept = own.select("conv_id", (F.col("i") - 1 - F.col("h") + F.least("h", F.coalesce("n", F.lit(0)))).alias("j"), "name", "bytes")
    return stash(taken.unionByName(kept), "rebuilt"), convs.select("conv_id")


def named_blocks(turns: DataFrame, height: int) -> list[DataFrame]:
    """For k = 1 .. ``height``: ``c, j, left, right`` of every block of 2**k turns, the names of its
    halves; ``right`` is null if the conversation does not reach it. An element 0 holds the turns' names."""
    levels = [turns.select(F.col("conv_id").alias("c"), "j", "name")]
    names = levels[0]
    for k in range(1, height + 1):
        odd = F.col("j") % 2 == 1
        halves = names.groupBy("c", F.shiftright("j", 1).alias("h")).agg(F.max(F.when(~odd, F.col("name"))).alias("left"), F.max(F.when(odd, F.col("name"))).alias("right"))
        levels.append(stash(halves.withColumnRenamed("h", "j"), f"blocks{k}"))
        names = levels[-1].select("c", "j", whole_name().alias("name"))
    return levels


def whole_name() -> Column:
    """The name of a block out of those of its halves."""
    return F.when(F.col("right").isNull(), F.col("left")).otherwise(_short_hash(F.concat("left", "right")))


def ends_hashes(ids: DataFrame) -> DataFrame:
    """For each ``name`` of ``ids`` (``name, conv_id``): ``e``, the smallest id, and the SHA-256 of all
    ids in order, comma-joined. Sorted ids are joined in blocks, which are then hashed one after the other."""

    def join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first, texts, held = None, None, [], 0
        done: list[tuple] = []
        for batch in batches:
            for n, c in zip(batch.column("name").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if n != name or held >= IDS_BYTES:
                    if texts:
                        done.append((name, first, ",".join(texts)))
                    name, first, texts, held = n, c, [], 0
                texts.append(text := str(c))
                held += len(text) + 1
                if len(done) >= 1024 or held >= IDS_BYTES and done:
                    yield pa.RecordBatch.from_pylist([dict(zip(("name", "first", "ids"), d, strict=True)) for d in done], schema=schema)
                    done = []
        if texts:
            done.append((name, first, ",".join(texts)))
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("name", "first", "ids"), d, strict=True)) for d in done], schema=schema)

    def hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, e, state = None, None, None
        done: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                n, first, ids = (batch.column(c)[i].as_py() for c in ("name", "first", "ids"))
                if n == name:
                    state.update(b",")
                else:
                    if state is not None:
                        done.append((e, state.hexdigest()))
                    name, e, state = n, first, hashlib.sha256()
                state.update(ids.encode())
            if len(done) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["e", "ends_sha256"])
                done = []
        if state is not None:
            done.append((e, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["e", "ends_sha256"])

    schema = pa.schema([("name", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    blocks = ids.orderBy("name", "conv_id").mapInArrow(join_blocks, "name binary, first long, ids string")
    return blocks.repartition("name").sortWithinPartitions("name", "first").mapInArrow(hash_blocks, "e long, ends_sha256 string")


def cut(trie: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """One round: every segment ``j, g, c, n, e, roots`` of height 2**k (its block, the root of its trie,
    its smallest conversation, how many have it, the one that ends with it, the roots of lower tries
    met so far) with ``further``, whether it reaches below the cut, and of the part above the cut
    ``top``, its name, ``top_n`` and ``top_e``."""
    pieces = stash(trie.join(blocks, ["c", "j"]), f"pieces{k}")
    # written, so that both sides of the join are plain tables and a crowded name can be split
    tops = pieces.groupBy("j", "g", "left").agg(F.min("c").alias("top"), F.sum("n").alias("top_n"), F.max(F.when(F.col("right").isNull(), F.col("e"))).alias("top_e"))
    tops = stash(tops, f"tops{k}")
    found = stash(pieces.join(tops, ["j", "g", "left"]).withColumn("further", F.col("right").isNotNull()).drop("left", "right"), f"cut{k}")
    drop(pieces, tops)
    return found


def parts_of(found: DataFrame, k: int) -> DataFrame:
    """The segments of half the height: above the cut those of equal name once, below it all."""
    above = found.where("c = top").select((F.col("j") * 2).alias("j"), "g", "c", F.col("top_n").alias("n"), F.col("top_e").alias("e"), "roots")
    met = F.array(F.struct(F.lit(k).alias("k"), F.col("top").alias("root")))
    below = found.where("further").select((F.col("j") * 2 + 1).alias("j"), F.col("top").alias("g"), "c", "n", "e", F.concat("roots", met).alias("roots"))
    return above.unionByName(below)


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (``conv_id, j, name, bytes``) of all conversations ``ids``."""
    spark = turns.sparkSession
    whole = ids.agg(F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n")).first()
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not whole["n"]:
        return spark.createDataFrame([], schema)
    deepest = turns.agg(F.max("j")).first()[0]
    height = 0 if deepest is None else int(deepest).bit_length()
    blocks = named_blocks(turns, height)
    sequences = blocks[height].select("c", (whole_name() if height else F.col("name")).alias("name"))
    named = sequences.select(F.col("c").alias("conv_id"), "name")
    turnless = ids.join(named, "conv_id", "left_anti").select("conv_id", F.lit(b"").alias("name"))
    hashes = stash(ends_hashes(named.unionByName(turnless)), "ends")

    # cut from the greatest height down: at height 1 a segment is a node
    trie = sequences.groupBy("name").agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n"))
    roots = F.array().cast("array<struct<k:int,root:bigint>>")
    whole_trie = trie = stash(trie.select(F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("g"), "c", "n", F.col("c").alias("e"), roots.alias("roots")), "trie")
    cuts: dict[int, DataFrame] = {}
    for k in range(height, 0, -1):
        cuts[k] = cut(trie, blocks[k], k)
        trie = parts_of(cuts[k], k)

    # weights of nodes
    texts = turns.select(F.col("conv_id").alias("c"), "j", "bytes")
    nodes = stash(trie.join(texts, ["c", "j"]), "nodes")
    children = nodes.where("j > 0").groupBy(F.col("g").alias("c"), (F.col("j") - 1).alias("j")).agg(F.count(F.lit(1)).alias("n_children"))
    weighed = nodes.join(children, ["c", "j"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    weighed = stash(weighed.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n") - 1) * F.col("bytes")}), "weighed")

    # all that stands in each lower trie, then what hangs on each segment
    met = weighed.select("j", "leaf", "saved", F.explode("roots").alias("r")).select("leaf", "saved", "r.k", "r.root", F.expr("shiftright(j, r.k - 1)").alias("block"))
    sums = stash(met.groupBy("k", "block", "root").agg(F.sum("leaf").alias("all_leaves"), F.sum("saved").alias("all_saved")), "sums") if height else None
    zero = F.lit(0).cast("long")
    hung = weighed.select("j", "c", zero.alias("leaves_below"), zero.alias("saved_below")) if not height else None
    for k in range(height, 0, -1):
        segments = cuts[k].select("j", "c", "top", "further")
        held = segments.withColumns({"leaves_below": zero, "saved_below": zero}) if hung is None else segments.join(hung, ["j", "c"])
        tops = held.groupBy("j", "top").agg(F.sum("leaves_below").alias("leaves_below"), F.sum("saved_below").alias("saved_below"))
        lower = sums.where(F.col("k") == k).select(F.shiftright("block", 1).alias("j"), F.col("root").alias("top"), "all_leaves", "all_saved")
        grafted = tops.join(lower, ["j", "top"], "left")
        above = grafted.select((F.col("j") * 2).alias("j"), F.col("top").alias("c"), *[(F.col(f"{w}_below") + F.coalesce(f"all_{w}", zero)).alias(f"{w}_below") for w in ("leaves", "saved")])
        below = held.where("further").select((F.col("j") * 2 + 1).alias("j"), "c", "leaves_below", "saved_below")
        last, hung = hung, stash(above.unionByName(below), f"hung{k}")
        drop(last, cuts[k])

    done = weighed.join(hung, ["j", "c"]).join(hashes, "e", "left")
    done = done.select(
        F.col("c").alias("conv_id"), (F.col("j") + 1).alias("depth"), F.when(F.col("j") == 0, F.lit(whole["least"])).otherwise(F.col("g")).alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        (F.col("leaf") + F.col("leaves_below")).alias("n_leaves"), (F.col("saved") + F.col("saved_below")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
    done = stash(done, "done")
    top = done.where("depth = 1").agg(F.count(F.lit(1)), F.sum("n_leaves"), F.sum("saved_tokens")).first()
    least = turnless.agg(F.min("conv_id")).first()[0]
    none = None if least is None else hashes.where(F.col("e") == least).first()["ends_sha256"]
    drop(*blocks, whole_trie, nodes, weighed, sums, hung, hashes)
    root = [(whole["least"], 0, None, whole["n"], top[0], top[1] or 1, top[2] or 0, none or EMPTY)]
    return done.unionByName(spark.createDataFrame(root, schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = placed_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    turns, ids = rebuilt(placed)
    drop(placed)
    found = prefix_trie(turns, ids)
    drop(turns)
    return found
