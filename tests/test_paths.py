"""The graph stays out of the driver, and shares are those of all shortest paths."""

from __future__ import annotations

import random
from collections import deque

import pytest
from pyspark.sql import DataFrame

from lodestar.operators.graph import betweenness


def slowly(edges):
    nodes = sorted({v for e in edges for v in e})
    ahead = {v: [t for s, t in set(edges) if s == v] for v in nodes}
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        depth, paths, order, queue = {s: 0}, {s: 1}, [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in ahead[v]:
                if w not in depth:
                    depth[w], paths[w] = depth[v] + 1, 0
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in order:
                if w in ahead[v] and depth[w] == depth[v] + 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                total[w] += share[w]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) for v, x in total.items()}


def test_paths_without_the_driver(spark, monkeypatch):
    pick = random.Random(5)
    edges = [(f"n{pick.randrange(40)}", f"n{pick.randrange(40)}") for _ in range(110)] + [("a", "b"), ("a", "b"), ("self", "self")]
    df = spark.createDataFrame(edges, "src string, dst string")
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "collect", lambda self: pytest.fail("rows came to the driver"))
        found = betweenness(df)
    got = {r["node"]: r["betweenness"] for r in found.collect()}
    assert got == pytest.approx(slowly(edges))
