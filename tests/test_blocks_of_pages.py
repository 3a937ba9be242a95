"""B17 in blocks of pages: as in SQL, whatever the size of a block, and no task with the pairs of a whole group."""

from __future__ import annotations

import random
from itertools import combinations

from lodestar.operators import matching


def test_shared_headings_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_PAGES", 7)
    monkeypatch.setattr(matching, "SENT_PAIRS", 5)
    r = random.Random(5)
    rows = [(p, r.choice([" A", "a", "b ", "c", "d", f"own {p}", "", None])) for p in range(40) for _ in range(6)] + [(None, "a"), (99, "lone")]
    sets: dict[int, set[str]] = {}
    for p, h in rows:
        if p is not None and h and h.strip():
            sets.setdefault(p, set()).add(h.strip().lower())
    want = sorted((a, b, "High", len(sets[a] & sets[b])) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 3)
    assert sorted(map(tuple, matching.shared_headings(spark.createDataFrame(rows, "page bigint, h2 string")).collect())) == want and want
    few = spark.createDataFrame([], "page bigint, h2 string")
    assert matching.shared_headings(few).count() == 0


def test_no_block_is_copied_for_those_it_meets(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_PAGES", 4)
    rows = [(p, f"h{p % 3 + k}") for p in range(60) for k in range(4)]
    found = matching.shared_headings(spark.createDataFrame(rows, "page bigint, h2 string"))
    sets = {p: {h for q, h in rows if q == p} for p in range(60)}
    assert found.count() == sum(len(sets[a] & sets[b]) >= 3 for a, b in combinations(range(60), 2))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan


def test_keywords_of_one_stem_meet_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_ROWS", 16)
    monkeypatch.setattr(matching, "TASK_PAIRS", 500)
    r = random.Random(6)
    words = ["Run", "runs", "running", "run fast", "fast", "fast fast", "", None, "jumped", "jump"]
    pages = spark.createDataFrame([(r.choice([None, r.randrange(150)]), r.choice(words), r.choice(["x", "y", None])) for _ in range(300)], "page bigint, keyword string, kind string")
    found = matching.cannibalizing_keywords(pages)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(found) == rows(matching.local_cannibalization(pages=pages))
    sizes = matching._met(*[pages.filter("page IS NOT NULL").selectExpr("page", "1 AS one")] * 2, "one", once=True).groupBy("of", "x", "y").count().agg({"count": "max"}).first()[0]
    assert sizes < 150 * 150 / 9
