"""B12 with one list of terms for each page: as over rows of terms, repeated ids and pairs included."""

from __future__ import annotations

import random

import pytest

from lodestar.operators import clusters as c


@pytest.mark.parametrize("most", [0, 1_000])
def test_lists_are_as_rows_of_terms(spark, monkeypatch, most):
    monkeypatch.setattr(c, "MOST_TERMS", most)
    r = random.Random(8)
    text = lambda n: r.choice([None, "", " ".join(r.choice(["Red", "bolt", "nut", "x1", "ä", f"own{r.randrange(99)}"]) for _ in range(n))])
    pages = spark.createDataFrame([(r.choice([i, i, 3, None]), text(3), text(2), text(4), text(30)) for i in range(40)], "id bigint, title string, h1 string, meta string, body string")
    pairs = spark.createDataFrame([(r.choice([k, k, 5, None]), r.randrange(44), r.choice([k, r.randrange(44)])) for k in range(40)] + [(900 + k, k, k) for k in range(40)], "pair bigint, left_id bigint, right_id bigint")
    rows = lambda df: sorted(map(str, df.select("pair", *c.PARTS).collect()))
    got = rows(c.cosines_of_parts(pages, pairs))
    assert got == rows(c.component_cosines(pairs=pairs, weights=c.tfidf_weights(pages=pages)))
    assert any("body=1.0" in x for x in got)


def test_terms_beyond_half_a_million_stay_lists(spark, monkeypatch):
    """Many terms make no rows of terms, and terms of one hash are told apart by another one."""
    assert c.MOST_TERMS >= 3_000_000
    monkeypatch.setattr(c, "tfidf_weights", lambda **_: 1 / 0)
    seeds, plain = [], c._term_hash

    def clashing(term, seed):
        seeds.append(seed)
        return c.F.lit(1).cast("bigint") if seed < 2 else plain(term, seed)

    monkeypatch.setattr(c, "_term_hash", clashing)
    pages = spark.createDataFrame([(1, "a b", "a", "", "x y y"), (2, "b a", "c", "", "x z"), (3, None, "c", "q", "z")], "id bigint, title string, h1 string, meta string, body string")
    pairs = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 3)], "pair bigint, left_id bigint, right_id bigint")
    got = {r["pair"]: (r["title"], r["h1"], r["meta"]) for r in c.cosines_of_parts(pages, pairs).collect()}
    assert got == {1: (1.0, 0.0, 0.0), 2: (0.0, 1.0, 0.0), 3: (0.0, 1.0, 1.0)} and max(seeds) == 2
