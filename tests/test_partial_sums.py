"""Partial sums and tables made once give the rows of the SQL, nulls included."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestar.operators import graph, health, text


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_links(spark):
    r = random.Random(4)
    links = spark.createDataFrame([(r.choice([None, 1, 2]), r.choice([None, "A/", "a?x", "b#"]), r.choice([None, "", "go", "of", "long"])) for _ in range(80)], "page bigint, href string, anchor string")
    assert rows(health.first_links(links)) == rows(health.dedupe_links(links=links))
    assert "Window" not in plan(health.first_links(links))


def test_bands_and_lists(spark):
    r = random.Random(5)
    scores = spark.createDataFrame([(r.choice([None, i]), r.choice([None, -1.0, 4.995, round(r.uniform(0, 20), 1)])) for i in range(90)], "id bigint, fk_grade double")
    assert rows(text.grade_bands(scores)) == rows(text.grade_distribution(scores=scores))
    assert "Join" not in plan(text.grade_bands(scores))
    nodes = spark.range(120).select(F.col("id").alias("node"), (F.col("id") * 7 % 11).alias("in_degree"), (F.col("id") * 5 % 9).alias("out_degree"), (F.col("id") / 7).alias("pagerank"), (F.col("id") % 13 / 5e2).alias("betweenness"))
    assert rows(graph.lists_of_graph(nodes, 3)) == rows(graph.graph_lists(nodes=nodes, classes=graph.node_classes(nodes=nodes), min_links=3))
