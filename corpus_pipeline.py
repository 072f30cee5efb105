"""From raw documents to packed training sequences, in five stages.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents
it keeps, with the columns of ``documents`` and no others, and the last one the packed pieces.
Each stage works on all that the one before it kept. ``run`` writes what a stage returns to the
shared scratch folder and gives the next stage the table, so every stage starts from files.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import near_copies, op2_packing, op3_pseudonyms, op6_language, op8_quality
from skyledger.llm.common import documents, held_out, labels, stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that have letters and whose language is likelier than not. A null text goes."""
    model = op6_language.fit(docs, ~held_out(5, 0))
    found = op6_language.identify(docs, model, COLUMNS)
    return found.where((F.col("lang_pred") != op6_language.UNKNOWN) & (F.col("score") >= 0.5)).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the line field takes for good ones. A null or empty text has the score of
    one empty line."""
    model = op8_quality.fit(docs, labels(spark, sf_dir), ~held_out(3, 1))
    return op8_quality.score(docs, model, COLUMNS).where("score >= 0.5").select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row of the smallest id of each group of near copies: texts whose sets of
    five-word shingles have a similarity of 0.8 or more, and what such pairs connect. Of rows with
    equal id and text one stays, and rows with equal id and other texts are judged each by its own;
    a row without an id is nobody's copy and stays."""
    groups = stash(near_copies.near_copies(docs), "groups")
    first = groups.groupBy("root").agg(F.min("least").alias("row")).select("row.doc_id", F.col("row.h").alias("__h"))
    rows = docs.select(*COLUMNS).withColumn("__h", F.xxhash64(F.col("text").cast("string")))
    kept = rows.join(first, ["doc_id", "__h"], "left_semi").dropDuplicates(["doc_id", "__h"])
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by pseudonyms; no document goes. A null text stays null."""
    return op3_pseudonyms.pseudonymise(docs, op3_pseudonyms.session_key(spark), COLUMNS).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of 2048 tokens; a row for each piece, with its ids. A null or
    empty text is the end id alone."""
    pieces = op2_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_copies", one_of_near_copies),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: SQL can express neither the models nor the tokenizer; the stages are tested one by one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
