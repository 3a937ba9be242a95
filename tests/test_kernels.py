"""What SQL can't check: plain Python twins on small inputs."""

from __future__ import annotations

import random
from itertools import permutations

import pytest

from lodestar.operators import clusters, graph, health, html, matching, passages


def test_token_sort_ratio():
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choices("abcd ", k=r.randint(0, 14))) for _ in range(2))
        assert matching.common_length(a, b) == lcs(a, b)
    assert matching.token_sort_ratio("red bolt", "Bolt  RED") == 100.0 and matching.token_sort_ratio("", "") == 100.0


def test_betweenness_by_all_paths(spark):
    r = random.Random(2)
    edges = sorted({(r.randint(0, 7), r.randint(0, 7)) for _ in range(18)} - {(i, i) for i in range(8)})
    nodes = sorted({n for e in edges for n in e})
    dist = {(a, b): 1 if (a, b) in set(edges) else 0 if a == b else 99 for a in nodes for b in nodes}
    for k in nodes:
        for a in nodes:
            for b in nodes:
                dist[a, b] = min(dist[a, b], dist[a, k] + dist[k, b])
    paths = {}

    def count(a, b):
        if a == b:
            return 1
        if (a, b) not in paths:
            paths[a, b] = sum(count(a, c) for c, d in edges if d == b and dist[a, c] + 1 == dist[a, b]) if dist[a, b] < 99 else 0
        return paths[a, b]

    want = dict.fromkeys(nodes, 0.0)
    for s, t in permutations(nodes, 2):
        if dist[s, t] < 99:
            for v in nodes:
                if v not in (s, t) and dist[s, v] + dist[v, t] == dist[s, t]:
                    want[v] += count(s, v) * count(v, t) / count(s, t)
    n = len(nodes)
    got = {x["node"]: x["betweenness"] for x in graph.betweenness(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == pytest.approx({v: b / ((n - 1) * (n - 2)) for v, b in want.items()})


def test_pagerank_sums_to_one_and_spreads_dangling_mass(spark):
    edges = spark.createDataFrame([("a", "b", 2), ("a", "c", 1), ("b", "c", 1)], "src string, dst string, weight bigint")
    got = {x["node"]: x["pagerank"] for x in graph.pagerank(edges, tolerance=1e-9).collect()}
    assert sum(got.values()) == pytest.approx(1.0) and got["c"] > got["b"] > got["a"]


def test_passages_keep_every_word_and_their_bounds():
    r = random.Random(3)
    for _ in range(100):
        lines = []
        for _ in range(r.randint(0, 12)):
            lines.append("# Head" + str(r.randint(0, 3)) if r.random() < 0.2 else " ".join(r.choice(["word", "more.", "why?", "so"]) for _ in range(r.randint(1, 200))) + " end.")
        text = "\n".join(lines)
        found = passages.passages(text)
        words = sum(len(body.split()) for _, body in passages.sections(text))
        assert sum(len(t.split()) for _, t in found) >= words
        assert all(len(t.split()) <= passages.MOST for _, t in found[:-1])


def test_passages_by_hand():
    assert passages.passages("") == [] and passages.passages("few words here now.") == [("Continuation", "few words here now.")]
    long = " ".join(["w"] * 200 + ["end."] + ["v"] * 100)
    (_, a), (_, b) = passages.passages(long)
    assert a.endswith("end.") and len(a.split()) == 201 and b.split()[:30] == a.split()[-30:] and len(b.split()) == 130


def test_parse_page():
    page = html.parse_page('<html lang="nl"><head><title>A &amp; B</title><meta name="description" content="d"><link rel="canonical" href="/c"><script type="application/ld+json">{"@type": ["X", "Y"]}</script></head><body><nav>no</nav><h1>H <b>1</b></h1><p>Text <a href="/in">in</a> <a href="https://o.test/">out</a><img src="i" alt="a"></p><h2>Q</h2><ul><li>x</li></ul>', "https://x.test/p")
    assert page["title"] == "A & B" and page["canonical"] == "/c" and page["lang"] == "nl" and page["meta_description"] == "d"
    assert page["headings"] == [{"level": 1, "text": "H 1"}, {"level": 2, "text": "Q"}]
    assert page["internal_links"] == [{"href": "https://x.test/in", "text": "in", "rel": []}] and page["external_links"][0]["href"] == "https://o.test/"
    assert page["images"] == [{"src": "https://x.test/i", "alt": "a", "width": None, "height": None, "loading": None}] and [b["heading"] for b in page["blocks"]] == ["H 1", "Q"] and "no" not in page["text"].split()
    assert html.jsonld_types(page["jsonld"][0]) == ["X", "Y"] and html.jsonld_types("{") == []
    assert html.parse_page("")["word_count"] == 0


def test_minhash_pairs_by_brute_force(spark):
    r = random.Random(4)
    base = [[r.choice("abcdefghijklmnopqrstuvwxyz") * r.randint(1, 4) for _ in range(120)] for _ in range(12)]
    rows = []
    for i, words in enumerate(base):
        rows.append((3 * i, " ".join(words)))
        rows.append((3 * i + 1, " ".join(words[:-2] + ["zz", "yy"])))
        rows.append((3 * i + 2, " ".join(r.choice("klmno") * r.randint(1, 5) for _ in range(90))))
    sets = {i: {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.9 * len(sets[a] | sets[b])}
    got = {(x["id_a"], x["id_b"]) for x in matching.minhash_duplicates(spark.createDataFrame(rows, "id bigint, text string")).collect()}
    assert got == want and len(want) == 12


def test_greedy_clusters_partition(spark):
    serp = spark.createDataFrame([(k, u) for k, us in {"a": "123", "b": "123", "c": "23", "d": "9", "e": "34"}.items() for u in us], "keyword string, url string")
    overlap = clusters.serp_overlap(serp=serp)
    for method in ("clique", "core"):
        got = {x["keyword"]: x["cluster"] for x in matching.greedy_clusters(overlap, serp, method, 2).collect()}
        assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}  # those without a partner stand alone


def test_breadcrumbs_and_fuzzy_titles(spark):
    pages = spark.createDataFrame([(1, "red bolt", "Red Bolt"), (2, "blue nut", "green"), (3, "x", "blue nut small")], "url bigint, title string, last_part string")
    got = {x["url"]: x for x in matching.check_breadcrumbs(pages).collect()}
    assert not got[1]["mismatch"] and got[2]["suggestion"] == "blue nut small"
    own = spark.createDataFrame([(1, "red steel bolt 10mm")], "id bigint, title string")
    other = spark.createDataFrame([(7, "bolt steel red x 10mm"), (8, "nut")], "id bigint, title string")
    assert [x["other_id"] for x in matching.fuzzy_matches(own, other).collect()] == [7]


def test_weights_sum_to_a_hundred():
    assert sum(health.rescaled({}).values()) == 100 and health.rescaled({"thin_content": 50})["thin_content"] == 40


def test_cosine_blocks_meet_all_pairs(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>")
    got = {(x[0], x[1]) for x in clusters.similar_pairs(df, df, 0.4, block=20).collect()}
    norm = lambda v: sum(a * a for a in v) ** 0.5
    want = {(i, j) for i, a in rows for j, b in rows if sum(p * q for p, q in zip(a, b, strict=True)) / norm(a) / norm(b) >= 0.4}
    assert got == want
