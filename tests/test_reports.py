"""Report parts and scans, against rows worked out by hand."""

from __future__ import annotations

from lodestar.operators import clusters, graph, text
from lodestar.sources import exports as x


def test_duplicate_and_empty_anchors(spark):
    rows = [("s", f"https://h/{i}", "Hyperlink", " Red Bolts ") for i in range(7)] + [("s", "https://h/1", "", "red bolts"), ("s", "https://h/9", "", "Click here"), ("s", "https://h/8", "", "click here"), ("s", "https://h/8", "", "one"), ("s", "https://h/2", "", ""), ("t", "https://h/2", "", " "), ("t", "https://h/3", "", "")]
    links = spark.createDataFrame(rows, "source string, target string, type string, anchor string")
    got = sorted(map(tuple, graph.duplicate_anchors(links=links).select("anchor", "targets", "target_rank", "target").collect()))
    assert got == [("red bolts", 7, i + 1, f"https://h/{i}") for i in range(5)]
    assert list(map(tuple, graph.empty_anchors(links=links).orderBy("target").collect())) == [("https://h/2", 2), ("https://h/3", 1)]


def test_graph_lists(spark):
    nodes = spark.createDataFrame([("a", 9, 0, 0.5, 0.2), ("b", 0, 1, 0.1, 0.0), ("c", 1, 1, 0.3, 0.0), ("d", 0, 6, 0.1, 0.0)], "node string, in_degree bigint, out_degree bigint, pagerank double, betweenness double")
    classes = spark.createDataFrame([("a", False, True, False, True, True), ("b", True, False, False, False, False), ("c", False, False, False, False, False), ("d", True, False, True, False, False)], "node string, orphan boolean, dead_end boolean, hub boolean, authority boolean, bridge boolean")
    got = sorted((r["list"], r["rank"], r["node"]) for r in graph.graph_lists(nodes=nodes, classes=classes, min_links=5).collect())
    assert got == [("authorities", 1, "a"), ("bridges", 1, "a"), ("dead_ends", 1, "a"), ("hubs", 1, "d"), ("orphans", 1, "b"), ("orphans", 2, "d"), ("top_pages", 1, "a"), ("top_pages", 2, "b"), ("top_pages", 3, "d")]


def test_cluster_summary(spark):
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)], "node bigint, root bigint")
    pairs = spark.createDataFrame([(1, 2, 0.8, None), (2, 3, 0.9, None), (8, 9, 0.2, 96.0)], "left_id bigint, right_id bigint, similarity double, minhash_pct double")
    got = {r["root"]: (r["size"], r["max_similarity"], r["avg_similarity"], r["class"], r["advice"]) for r in clusters.cluster_summary(members=members, pairs=pairs).collect()}
    assert got == {1: (3, 0.9, 0.85, "SEMANTICALLY_SIMILAR", "REVIEW"), 8: (2, 0.2, 0.2, "EXACT_DUPLICATE", "CANONICAL")}


def test_passage_extremes_and_grades(spark):
    scored = spark.createDataFrame([(i, 10 * i, "u", 2) for i in range(7)] + [(9, 50, "v", 1)], "id bigint, total bigint, url string, weight bigint")
    got = {(r["url"], r["id"]): (r["is_top"], r["is_bottom"]) for r in text.passage_extremes(scored=scored).collect()}
    assert got[("u", 6)] == (True, False) and got[("u", 3)] == (True, True) and got[("u", 0)] == (False, True) and got[("v", 9)] == (True, False)
    scores = spark.createDataFrame([(1, 9.0, 9.0), (2, 12.0, 1.0), (3, 18.0, 2.0)], "id bigint, fk_grade double, minutes double")
    assert tuple(text.grade_assessment(scores=scores, audience="b2b").select("pages", "mean_grade", "assessment", "long_pages", "long_percentage").first()) == (3, 13.0, "above", 1, 33)
    assert text.grade_assessment(scores=scores.limit(0)).count() == 0


def test_scans_of_seeds_and_keywords(spark):
    queries = spark.createDataFrame([("b", 1), (" a ", 2), ("b", 3), ("", 0), (None, 4)], "query string, row_id int")
    assert [r["query"] for r in x.ordered_queries(queries).collect()] == ["b", "a"]
    table = spark.createDataFrame([("id1", "", "q"), ("id2", "k", "q"), ("id3", None, " "), (None, None, None)], "id string, keyword string, query string")
    assert [r["seed"] for r in x.seeds(table).collect()] == ["q", "k", "id3"]
    item = lambda kw, more: '{"keyword_data": {"keyword": "%s"%s' % (kw, more)
    one = '{"tasks": [{"result": [{"items": [' + item("a", ', "keyword_info": {"search_volume": 7}}, "ranked_serp_element": {"serp_item": {"url": "u", "rank_group": 3}}}') + "," + item("b", "}}") + "]}]}]}"
    two = '{"tasks": [{"result": [{"items": [' + item("a", "}}") + "," + item("c", ', "keyword_info": {"search_volume": null}}}') + "]}]}]}"
    df = spark.createDataFrame([(one, 1), (two, 2), ("{}", 3), (None, 4)], "json string, file_order int")
    assert sorted(map(tuple, x.ranked_keywords(df).collect())) == [("a", 7, "u", 3), ("b", 0, "", 99), ("c", 0, "", 99)]
