"""Sequential rules in rounds, chains and set joins, against plain loops on random input."""

from __future__ import annotations

import random

import pytest

from lodestar.operators import assignment, chains, matching, products, setjoin


def in_turn(own, other, ratio):
    key = lambda x: "".join(c for c in (x or "").lower() if c not in " -_/.\t\n").lstrip("0")
    index = {}
    for o in other:
        for f in (1, 2, 3):
            if (o[f] or "").strip() and key(o[f]):
                index.setdefault(key(o[f]), o[0])
    taken, out = set(), []
    for o in own:
        hit = None
        for place, f in enumerate((1, 2, 3)):
            t = index.get(key(o[f])) if (o[f] or "").strip() and key(o[f]) else None
            if t is not None and t not in taken:
                hit = (t, place)
                break
        if hit is None and ratio is not None and o[4] is not None:
            rated = [(-matching.token_sort_ratio(o[4], c[4]), c[0]) for c in other if c[0] not in taken and c[4] is not None]
            best = min(rated, default=(0, None))
            hit = (best[1], 3) if -best[0] >= ratio else None
        if hit:
            taken.add(hit[0])
            out.append((o[0], *hit))
    return sorted(out)


@pytest.mark.parametrize("seed,ratio", [(1, None), (2, 90.0), (3, 70.0), (4, 60.0)])
def test_matches_in_row_order(spark, seed, ratio):
    rnd = random.Random(seed)
    words = ["red", "blue", "bolt", "nut", "xl", "pro"]
    some = lambda i, n: (i, *[rnd.choice([None, "", " ", f"00A-{rnd.randrange(n)}", f"a{rnd.randrange(n)}"]) for _ in range(3)], rnd.choice([None, " ".join(rnd.choices(words, k=4))]))
    own, other = [some(i, 25) for i in range(60)], [some(i, 25) for i in range(45)]
    schema = "id bigint, mpn string, sku string, gtin string, title string"
    got = products.match_products(spark.createDataFrame(own, schema), spark.createDataFrame(other, schema), ratio).collect()
    assert sorted(map(tuple, got)) == in_turn(own, other, ratio)


def test_a_chain_of_wishes_and_empty_feeds(spark):
    edges = [(i, i + k, k) for i in range(12) for k in (0, 1)] + [(i, 0, -1) for i in range(12)]
    got = {(r.row, r.target) for r in assignment.assign_in_order(spark.createDataFrame(edges, "row bigint, target bigint, choice int")).collect()}
    taken, want = set(), set()
    for i in range(12):
        t = next((t for t in (0, i, i + 1) if t not in taken), None)
        taken.add(t)
        want.add((i, t))
    assert got == want
    empty = spark.createDataFrame([], "id bigint, mpn string, sku string, gtin string, title string")
    assert products.match_products(empty, empty).count() == 0


def test_keep_in_order(spark):
    rnd = random.Random(9)
    n = 80
    places = {i: (rnd.randrange(20), i) for i in range(n)}
    pairs = {tuple(sorted(rnd.sample(range(n), 2))) for _ in range(120)}
    near = {i: {b for p in pairs for b in p if i in p and b != i} for i in range(n)}
    kept, by = set(), {}
    for i in sorted(range(n), key=places.get):
        held = sorted((places[b], b) for b in near[i] & kept)
        by[i] = held[0][1] if held else None
        if not held:
            kept.add(i)
    nodes = spark.createDataFrame([(i, p) for i, p in places.items()], "id bigint, place struct<p:int,i:int>")
    got = {r.id: r.kept_by for r in assignment.keep_in_order(nodes, spark.createDataFrame(sorted(pairs), "a bigint, b bigint")).collect()}
    assert got == by
    alone = assignment.keep_in_order(nodes, spark.createDataFrame([], "a bigint, b bigint")).collect()
    assert len(alone) == n and all(r.kept_by is None for r in alone)
    assert assignment.keep_in_order(nodes.limit(0), spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_chains(spark):
    rnd = random.Random(4)
    n = 300
    step = {i: rnd.choice([i + 1, i + 1, i + 1, rnd.randrange(n), 10_000 + i]) for i in range(n)} | {1000 + i: 1001 + i for i in range(70)} | {7: 7}
    got = {r.node: (r.final, r.hops, r.is_loop) for r in chains.follow(spark.createDataFrame(list(step.items()), "node bigint, next bigint")).collect()}
    paths = {r.node: r.path for r in chains.first_steps(spark.createDataFrame(list(step.items()), "node bigint, next bigint"), 9).collect()}
    for i in step:
        at, seen, path = i, {i}, []
        while at in step:
            at = step[at]
            path.append(at)
            if at in seen and len(path) > n + 80:
                break
            seen.add(at)
        loop = at in step
        assert got[i] == ((None, None, True) if loop else (at, len(path), False)), i
        assert paths[i] == path[:9]
    assert chains.follow(spark.createDataFrame([], "node bigint, next bigint")).count() == 0


@pytest.mark.parametrize("measure,share", [("longer", 0.8), ("longer", 0.5), ("jaccard", 0.8), ("jaccard", 0.5), ("jaccard", 1.0), ("count", 3)])
def test_similar_sets(spark, measure, share):
    rnd = random.Random(7)
    sets = {i: sorted({rnd.choice("abcdefghijkl") + str(rnd.randrange(2)) for _ in range(rnd.randrange(9))} | {"the"}) for i in range(150)}
    sets |= {200 + i: sorted(set(sets[i]) ^ {"zz"}) for i in range(40)} | {300: [], 301: []}
    got = {(r.a, r.b): r.common for r in setjoin.similar_sets(spark.createDataFrame(list(sets.items()), "id bigint, tokens array<string>"), share, measure).collect()}
    want = {}
    for a, x in sets.items():
        for b, y in sets.items():
            common = len(set(x) & set(y))
            if a < b and x and y and (common >= share if measure == "count" else common > share * max(len(x), len(y)) + 1e-9 if measure == "longer" else common >= share * len(set(x) | set(y)) - 1e-9):
                want[a, b] = common
    assert got == want


@pytest.mark.parametrize("edges_a_range,most", [(4_000_000, 2), (90, 44)])
def test_rows_that_want_the_same(spark, monkeypatch, edges_a_range, most):
    """Rows of one list of wishes take a round for each range of them, not for each row, and end as the loop does."""
    monkeypatch.setattr(assignment, "RANGE_EDGES", edges_a_range, raising=False)
    tables, settled = [], assignment.settled
    monkeypatch.setattr(assignment, "settled", lambda df: tables.append(1) or settled(df))
    edges = [(row, target, (target * 7 + row % 2) % 5) for row in range(45) for target in range(40)]
    got = {(r.row, r.target) for r in assignment.assign_in_order(spark.createDataFrame(edges, "row bigint, target bigint, choice int")).collect()}
    taken, want = set(), set()
    for row in range(45):
        wishes = sorted((c, t) for r, t, c in edges if r == row and t not in taken)
        if wishes:
            taken.add(wishes[0][1])
            want.add((row, wishes[0][1]))
    assert got == want and len(tables) <= most


@pytest.mark.parametrize("edges_a_range,block", [(4_000_000, 0), (60, 2_048)])
def test_products_of_one_title_are_not_paired_off(spark, monkeypatch, edges_a_range, block):
    """As the loop, in one range and in many; the 120 by 100 pairs of one title are in no table."""
    monkeypatch.setattr(assignment, "RANGE_EDGES", edges_a_range)
    monkeypatch.setattr(products, "BLOCK_TITLES", block, raising=False)
    sizes, settled = [], products.settled

    def noted(df):
        sizes.append((kept := settled(df)).count())
        return kept

    monkeypatch.setattr(products, "settled", noted)
    monkeypatch.setattr(assignment, "settled", noted)
    rnd = random.Random(11)
    some = lambda i, n: (i, rnd.choice([None, f"a{rnd.randrange(n)}"]), None, "", rnd.choice(["red bolt", "bolt red", "Bolt red", "red bolts", None]))
    own, other = [some(i, 30) for i in range(120)], [some(i, 30) for i in range(100)]
    schema = "id bigint, mpn string, sku string, gtin string, title string"
    got = products.match_products(spark.createDataFrame(own, schema), spark.createDataFrame(other, schema)).collect()
    assert sorted(map(tuple, got)) == in_turn(own, other, 90.0) and max(sizes) < 400
