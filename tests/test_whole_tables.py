"""Fixtures hand the whole of their tables to the queries."""

from __future__ import annotations

import pytest

from lodestar.operators import graph
from lodestar.plans import cluster_queries, graph_queries, text_queries
from lodestar.plans.registry import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("node", "found", "table", "wanted"),
    [
        (cluster_queries.WORDS, "count(DISTINCT page)", "documents", "count(DISTINCT CASE WHEN text RLIKE '(?i)[a-z]' THEN doc_id END)"),
        (graph_queries.SUPPLIES, "count(DISTINCT CASE WHEN dst >= 100000 THEN struct(src, dst) END)", "lineitem", "count(DISTINCT struct(l_partkey, l_suppkey))"),
        (graph_queries.SUPPLIES, "count(DISTINCT CASE WHEN src >= 100000 THEN src END)", "lineitem", "count(DISTINCT l_suppkey)"),
        (graph_queries.SPARSE, "count(*)", "orders", "count(DISTINCT struct(o_custkey, o_orderkey % 997))"),
        (text_queries.SENTIMENT, "count(*)", "events", "count(*)"),
        (text_queries.QUESTIONS, "count(*)", "part", "count(*) * 3"),
    ],
)
def test_no_row_is_left_out(spark, node, found, table, wanted):
    got = node.spark(spark, SF).selectExpr(f"{found} AS n").first()["n"]
    assert got == spark.read.parquet(f"{SF}/{table}.parquet").selectExpr(f"{wanted} AS n").first()["n"] > 0


def test_every_query_of_several_pages_is_judged(spark):
    from lodestar.plans import fixtures as fx
    from lodestar.operators import clusters

    want = clusters.cannibalization_severity(gsc=fx.QUERY_PAGE.spark(spark, SF))
    assert queries()["b15_cannibalization_severity"](spark, SF).count() == want.count() > 40


def test_pagerank_runs_to_its_own_stop(spark):
    edges = graph_queries.SUPPLIES.spark(spark, SF)
    links: dict[int, dict[int, int]] = {}
    for s, t, w in edges.collect():
        links.setdefault(s, {})[t] = w
    nodes = sorted(links.keys() | {t for out in links.values() for t in out})
    n = len(nodes)
    rank = dict.fromkeys(nodes, 1 / n)
    for _ in range(100):
        lost = sum(rank[v] for v in nodes if v not in links)
        after = dict.fromkeys(nodes, 0.15 / n + 0.85 * lost / n)
        for s, out in links.items():
            for t, w in out.items():
                after[t] += 0.85 * rank[s] * w / sum(out.values())
        moved = sum(abs(after[v] - rank[v]) for v in nodes)
        rank = after
        if moved < n * 1e-6:
            break
    got = {x["node"]: x["pagerank"] for x in queries()["d3_pagerank"](spark, SF).collect()}
    assert got.keys() == rank.keys()
    assert max(abs(got[v] - rank[v]) for v in nodes) < 1e-6


def test_exact_betweenness_is_never_sampled(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (2, 4), (4, 5)], "src bigint, dst bigint")
    want = {x["node"]: x["betweenness"] for x in graph.betweenness(edges).collect()}
    monkeypatch.setattr(graph, "SAMPLED_SOURCES", 1)
    got = {x["node"]: x["betweenness"] for x in graph.betweenness(edges, exact_nodes=None).collect()}
    assert got == want
