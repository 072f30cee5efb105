"""Operator 13: winnowing fingerprints of documents, in DataFrame and SQL functions alone.

A text is cut into words (runs that are no white space, at most ``PIECE`` characters of one at a
time, so that text without spaces has words too). Every run of ``k`` words is hashed, the run
rolling on by one word; of every window of ``w`` successive hashes the least is chosen, of equal
ones the rightmost. Any two texts that share ``w + k - 1`` successive words share a chosen hash,
and no hash of fewer than ``k`` shared words can tell on them. A text of fewer than ``k`` words has
one hash, of all its words, and a text of fewer than ``w`` hashes one window.

A chosen hash is kept as one number, a *mark*: the hash in the upper bits, below it the place counted
backwards, so that the least mark of a window is its least hash and of equal ones the rightmost.
Window minima come by doubling: minima of two successive marks, of four of these, and so on.

The next document (``with_next``) is found without a window over all rows: documents are dealt to
ranges of ids, and the first rows of a range are sent to the range before it too. The texts are
shuffled once, with their marks.

Defined results: a null or empty text has no marks; two texts without marks have likeness 1.0, and
one has 0.0 with any other. Documents stand in descending order of id, null ids last, and of equal
ids in the order of their texts' hashes; the first follows the last, so a single row follows itself.
Repeated rows follow one another. Columns other than ``doc_id`` and ``text`` never reach the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.llm.common import documents

#: Words of a hash, and hashes of a window (a power of 2).
K, W = 5, 8
#: Characters of a word that are taken at once.
PIECE = 16
#: Low bits of a mark that hold the place.
PLACE_BITS = 24
#: Rows of a range of ids, and ranges that one step tells apart; two steps tell ``MOST_RANGES`` squared apart.
RANGE_ROWS, MOST_RANGES = 2000, 1000


def bound(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` made once and called ``name``. A column of its own would be made anew
    for each mention if a filter on the result is pushed below it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def marks(text: str, k: int = K, w: int = W) -> str:
    """SQL for the marks of a text, in order of their places: an array of longs."""
    if w < 1 or w & (w - 1):
        raise ValueError("the window must be a power of 2")
    last = (1 << PLACE_BITS) - 1
    words = f"regexp_extract_all({text}, '[^\\\\x20\\\\x09-\\\\x0D]{{1,{PIECE}}}', 0)"
    run = ", ".join(["x", *[f"get(words, i + {j})" for j in range(1, k)]])
    hashed = f"transform(slice(words, 1, greatest(size(words) - {k - 1}, least(size(words), 1))), (x, i) -> (xxhash64({run}) & {~last}L) | ({last} - (i & {last})))"
    least = "g"
    step = 1
    while step < w:
        least = bound("m", least, f"zip_with(slice(m, 1, size(m) - {step}), slice(m, {step + 1}, size(m) - {step}), (x, y) -> least(x, y))")
        step *= 2
    chosen = f"if(size(g) <= {w}, filter(array(array_min(g)), x -> x is not null), array_distinct({least}))"
    return bound("words", words, bound("g", hashed, chosen))


def hashes(mark_array: str) -> str:
    """SQL for the distinct hashes of an array of marks."""
    return f"array_distinct(transform({mark_array}, x -> shiftright(x, {PLACE_BITS})))"


def places(mark_array: str) -> str:
    """SQL for the marks as structs of ``hash`` and ``place``, the index of the first of the k words."""
    last = (1 << PLACE_BITS) - 1
    return f"transform({mark_array}, x -> struct(shiftright(x, {PLACE_BITS}) as hash, int({last} - (x & {last})) as place))"


def likeness(a: str, b: str) -> str:
    """SQL for the Jaccard similarity of two arrays of distinct hashes."""
    return bound("met", f"size(array_intersect({a}, {b}))", f"if(size({a}) + size({b}) = 0, 1.0D, met / (size({a}) + size({b}) - met))")


def digest(mark_array: str) -> str:
    """SQL for a short name of a fingerprint: the same for equal hashes at equal places."""
    return f"md5(array_join({mark_array}, ','))"


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """``doc_id, n_chars`` and ``fingerprint``, an array of ``hash, place``, of every document."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.expr(bound("f", marks("text", k, w), places("f"))).alias("fingerprint"))


def _range_ends(docs: DataFrame, rows: int, most: int) -> list[int]:
    """Ids at which ranges of about ``rows`` documents begin, greatest first: ids of the table, at most
    ``most`` squared of them."""
    n = docs.where("doc_id is not null").count()
    wanted = min(most, -(-n // rows))
    if wanted < 1:
        return []
    share = lambda parts: F.percentile_approx("doc_id", F.array(*[F.lit(i / parts) for i in range(1, parts + 1)]), 10 * most)
    ends = sorted({*docs.agg(share(wanted).alias("e")).first()["e"]})
    inner = min(most, -(-n // (rows * wanted)))
    if inner > 1:
        upper = F.expr(f"size(filter(array({', '.join(f'{e}L' for e in ends)}), e -> e < doc_id))")
        finer = docs.where("doc_id is not null").groupBy(upper.alias("r")).agg(share(inner).alias("e"))
        ends = sorted({*ends, *(e for r in finer.collect() for e in r["e"])})
    top = docs.agg(F.max("doc_id")).first()[0]
    return sorted({*ends, top}, reverse=True)


def with_next(rows: DataFrame, columns: list[str], order: Column, range_rows: int = RANGE_ROWS, most: int = MOST_RANGES) -> DataFrame:
    """``rows`` (``doc_id`` and others) with ``next``, a struct of ``columns`` of the row after it in
    descending order of id, equal ids in that of ``order``; the first comes after the last."""
    spark = rows.sparkSession
    ends = _range_ends(rows.select("doc_id"), range_rows, most)
    # ranges in blocks of ``most``: a row looks for its block in one short list, and for its range in another
    blocks = [ends[i : i + most] for i in range(0, len(ends), most)] or [[]]
    heads = f"array({', '.join(f'{b[0]}L' for b in blocks if b)})" if ends else "cast(array() as array<bigint>)"
    table = spark.createDataFrame([(i, i * most, b) for i, b in enumerate(blocks)], "block int, start int, ends array<long>")
    block = F.expr(f"greatest(if(doc_id is null, {len(blocks)}, size(filter({heads}, e -> e >= doc_id))), 1) - 1")
    placed = rows.withColumn("block", block).join(F.broadcast(table), "block")  # at most ``most`` squared numbers
    last = max(len(ends), 1)
    placed = placed.withColumn("range", F.expr(f"if(doc_id is null, {last}, start + size(filter(ends, e -> e >= doc_id)))"))
    first = f"(doc_id <=> {f'{ends[0]}L' if ends else 'null'})"
    begins = f"(array_contains(ends, doc_id) and not {first})" if ends else "false"
    # a row stands in its range, and where it begins one also at the end of the range before
    copies = f"filter(array(struct(range as at, false as copy), if({begins}, struct(range - 1 as at, true as copy), null), if({first}, struct({last} as at, true as copy), null)), c -> c is not null)"
    dealt = placed.select(*rows.columns, F.explode(F.expr(copies)).alias("c")).select(*rows.columns, "c.at", "c.copy")
    window = Window.partitionBy("at").orderBy("copy", F.desc_nulls_last("doc_id"), order)
    led = dealt.withColumn("next", F.lead(F.struct(*columns)).over(window))
    return led.where("not copy").drop("at", "copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = docs.select("doc_id", "text", F.expr(marks("text")).alias("marks"))
    pairs = with_next(rows, ["text", "marks"], F.xxhash64("text"))
    n = "int(length(text) div 3)"
    edited = f"concat(left(text, length(text) - {n}), left(next.text, {n}))"
    made = bound("e", edited, f"struct(length(text) as n_chars, sha2(e, 256) as edited_sha256, {marks('e')} as edited)")
    likes = bound("own", hashes("marks"), f"struct({bound('h', hashes('m.edited'), likeness('own', 'h'))} as near_edited, {bound('h', hashes('next.marks'), likeness('own', 'h'))} as near_next)")
    found = bound("m", made, f"struct(bigint(m.n_chars) as n_chars, m.edited_sha256 as edited_sha256, {digest('marks')} as fingerprint, {digest('m.edited')} as edited_fingerprint, {likes} as likes)")
    return pairs.select("doc_id", F.expr(found).alias("r")).select("doc_id", "r.n_chars", "r.edited_sha256", "r.fingerprint", "r.edited_fingerprint", "r.likes.near_edited", "r.likes.near_next")
