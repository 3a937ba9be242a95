"""Documents of every language, and every copy of a text."""

from __future__ import annotations

from lodestar.operators import matching
from lodestar.plans import matching_queries, text_queries

SF = "/root/testdata/sf0.001"


def test_documents_of_all_languages(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for node in (matching_queries.TEXTS, text_queries.TEXTS):
        assert node.spark(spark, SF).count() == n


def test_minhash_duplicates_name_every_copy(spark):
    text = "one two three four five six seven"
    rows = [(3, text), (5, text), (9, text), (1, "too short"), (2, "too short"), (4, None), (6, None), (7, text + " eight")]
    got = {tuple(x) for x in matching.minhash_duplicates(spark.createDataFrame(rows, "id bigint, text string"), 0.7, tables=40).collect()}
    assert got == {(3, 5, 1.0, True), (3, 9, 1.0, True), (1, 2, 1.0, True), (3, 7, 0.75, False)}
