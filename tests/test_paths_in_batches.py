"""D4 with many sources at once: as source by source, over the edges between nodes that edges lead to."""

from __future__ import annotations

import random
from collections import deque

import pytest

from lodestar.operators import graph


def by_source(edges):
    ahead: dict = {}
    for a, b in edges:
        ahead.setdefault(a, []).append(b)
    nodes = {x for e in edges for x in e}
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        depth, paths, order, queue = {s: 0}, {s: 1.0}, [], deque([s])
        while queue:
            order.append(u := queue.popleft())
            for v in ahead.get(u, ()):
                if v not in depth:
                    depth[v], paths[v] = depth[u] + 1, 0.0
                    queue.append(v)
                if depth[v] == depth[u] + 1:
                    paths[v] += paths[u]
        share = dict.fromkeys(order, 0.0)
        for u in reversed(order):
            share[u] = sum(paths[u] / paths[v] * (1 + share[v]) for v in ahead.get(u, ()) if depth[v] == depth[u] + 1)
            if u != s:
                total[u] += share[u]
    n = len(nodes)
    return {x: t / max((n - 1) * (n - 2), 1) for x, t in total.items()}


@pytest.mark.parametrize("batch,cells,long", [(128, 4_000_000, 256), (3, 50, 2)])
def test_paths_in_batches(spark, monkeypatch, batch, cells, long):
    # two parts, loops, sources and ends without further edges
    r = random.Random(3)
    edges = sorted({(r.randrange(90), r.randrange(40, 110)) for _ in range(260)} | {(200 + r.randrange(30), 200 + r.randrange(12)) for _ in range(70)} | {(5, 5), (205, 205)})
    monkeypatch.setattr(graph, "BATCH_SOURCES", batch)
    monkeypatch.setattr(graph, "BATCH_CELLS", cells)
    monkeypatch.setattr(graph, "LONG_LIST", long)
    want = by_source(edges)
    got = {x["node"]: x["betweenness"] for x in graph.betweenness(spark.createDataFrame(edges, "src bigint, dst bigint"), exact_nodes=None).collect()}
    assert got == pytest.approx(want) and max(want.values()) > 0
