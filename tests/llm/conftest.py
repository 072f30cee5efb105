import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing names."""
    long_text = "alpha beta gamma. " * 6000 + "\n" + "x" * 30_000
    rows = [
        (1, "One plain text, and another sentence.\nA second line here.", "en", "a"),
        (1, "One plain text, and another sentence.\nA second line here.", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "b"),
        (4, "  double  spaces \n\n and\ttabs  ", "en", "b"),
        (5, long_text, "en", "a"),
        (6, "日本語 テキスト ééà 🎉 ZWJ 👩‍👩‍👧 ́x", None, "c"),
        (None, "a row without an id", "fr", None),
        (7, "12 34 !!! ### %%%", "de", "a"),
    ]
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(rows, schema)
    return docs.selectExpr("*", "length(text) AS n_chars", "'extra' AS score", "1 AS ids", "'x' AS component_id", "2.5 AS piece")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
