"""Phrases are counted where their page is, with the rows of the SQL form."""

from __future__ import annotations

from lodestar.operators.matching import primary_keyword, primary_keywords


def test_phrases_do_not_move(spark):
    rows = [(1, "Red bolt, red bolt; a red bolt"), (1, "red bolt a b"), (2, "one"), (3, None), (4, ""), (5, "a b c a b c"), (None, "x y"), (None, "x y z"), (6, "É a b İ k")]
    pages = spark.createDataFrame(rows, "id bigint, text string")
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert order(primary_keywords(pages)) == order(primary_keyword(pages=pages))
    plan = primary_keywords(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "phrase" not in plan.split("MapInArrow")[-1].split("\n", 1)[1]
