"""Pairs within clusters alone give the coherence of the SQL; many components go through one group."""

from __future__ import annotations

import random

from lodestar.operators import clusters, matching


def test_pairs_within_clusters(spark):
    r = random.Random(8)
    serp = spark.createDataFrame([(r.choice([None, *"abcdefghij"]), r.choice([None, *"uvwxyz"])) for _ in range(120)], "keyword string, url string").distinct().localCheckpoint()
    # keywords of several clusters, twice in one, in none; clusters without a name
    members = spark.createDataFrame([(r.choice([None, *"abcdefgh"]), r.choice([None, 1, 2, 3])) for _ in range(25)], "keyword string, cluster int")
    pairs = clusters.serp_jaccard(overlap=clusters.serp_overlap(serp=serp), serp=serp)
    within = clusters.jaccard_within(members, serp)
    rows = lambda jaccard: sorted(map(str, clusters.cluster_coherence(members=members, jaccard=jaccard).collect()))
    assert rows(within) == rows(pairs)
    of = {}
    for x in members.collect():
        of.setdefault(x["keyword"], set()).add(x["cluster"])
    got = [(x["keyword_a"], x["keyword_b"]) for x in within.collect()]
    assert got and len(set(got)) == len(got) and all((of[a] & of[b]) - {None} for a, b in got)


def test_query_forms_no_pairs_between_clusters(spark):
    from lodestar.plans import cluster_queries, registry

    assert "serp" in cluster_queries.COHERENCE.kernel_inputs
    got = registry.queries()["b24_cluster_coherence"](spark, "/root/testdata/sf0.001").collect()
    whole = clusters.cluster_coherence(members=cluster_queries.MEMBERS, jaccard=cluster_queries.JACCARD).spark(spark, "/root/testdata/sf0.001").collect()
    assert got and sorted(map(str, got)) == sorted(map(str, whole))


def test_components_share_groups(spark):
    r = random.Random(9)
    rows = [(f"{chr(97 + r.randrange(6))}{c}", f"{c}/{r.randrange(9)}") for c in range(40) for _ in range(40)]
    serp = spark.createDataFrame(sorted(set(rows)), "keyword string, url string")
    overlap = clusters.serp_overlap(serp=serp)
    for method in ("clique", "core"):
        got = matching.greedy_clusters(overlap, serp, method, 2)
        # the tasks are given, as they are long for their few bytes
        assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
        found = {tuple(x) for x in got.collect()}
        assert len(found) == serp.select("keyword").distinct().count()
        for c in (0, 13):  # each component by itself gives the same clusters
            own = serp.filter(f"url LIKE '{c}/%'")
            assert {tuple(x) for x in matching.greedy_clusters(clusters.serp_overlap(serp=own), own, method, 2).collect()} <= found
