"""Operators for large training corpora. Nothing else in the package imports this one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyledger.llm import op1_planes, op2_packing, op3_pseudonyms, op4_sentencepiece, op5_toxicity, op6_language, op7_simhash, op8_quality, op9_flac, op10_divergence, op11_whitening, op12_prefix_trie, op13_winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bit_planes": op1_planes.query,
    "op2_best_fit": op2_packing.query,
    "op3_feistel_pseudonyms": op3_pseudonyms.query,
    "op4_sentencepiece": op4_sentencepiece.query,
    "op5_toxicity": op5_toxicity.query,
    "op6_language": op6_language.query,
    "op7_simhash": op7_simhash.query,
    "op8_line_field": op8_quality.query,
    "op9_flac": op9_flac.query,
    "op10_divergence": op10_divergence.query,
    "op11_whitening": op11_whitening.query,
    "op12_prefix_trie": op12_prefix_trie.query,
    "op13_winnowing": op13_winnowing.query,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {"op10_divergence": op10_divergence.ORACLE}
