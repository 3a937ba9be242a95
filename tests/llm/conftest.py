from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, extra and clashing columns."""
    long = " ".join(f"word{i % 977} und{i}" for i in range(6000))
    rows = [
        (1, None, "en", "a", 9, 7.0, "x"),
        (2, "", "en", "a", 9, 7.0, "x"),
        (3, " \t\n ", None, None, None, None, None),
        (4, long, "en", "b", 1, None, "y"),
        (5, "one two three", "de", "b", 1, 1.0, "y"),
        (5, "one two three", "de", "b", 1, 1.0, "y"),
        (None, "no id at all here", "de", "", 1, 1.0, "z"),
        (7, "Ünïcode ✓ 中文字 <|endoftext|> 😀 don't", "fr", "c", 1, 1.0, "z"),
        (8, "one two three", "de", "b", 1, 1.0, "y"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_words bigint, score double, host string")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
