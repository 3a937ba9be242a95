"""Titles that are alike without a common token."""

from __future__ import annotations

import random

from lodestar.operators import matching


def test_best_title_is_that_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_TITLES", 16)
    r = random.Random(3)
    word = lambda: r.choice(["bolt", "nut", "screw", "red", "blue", "x", "ä"]) + r.choice(["", "s", "ed", ","])
    title = lambda: "  ".join(word() for _ in range(r.randint(0, 4))) + " long tail of a title" * (r.random() < 0.1) * 4
    own = [(i, title()) for i in range(40)] + [(40, "bolts"), (41, "reds bolt"), (42, None)]
    other = [(i, title()) for i in range(40)] + [(40, "bolt"), (41, "red bolts"), (42, None)]
    want = {}
    for i, a in own:
        rated = [(-matching.token_sort_ratio(a, b), j) for j, b in other if a is not None and b is not None]
        if rated and -min(rated)[0] >= 80:
            want[i] = (min(rated)[1], round(-min(rated)[0], 4))
    frame = lambda rows: spark.createDataFrame(rows, "id bigint, title string")
    got = {x["own_id"]: (x["other_id"], x["ratio"]) for x in matching.fuzzy_matches(frame(own), frame(other), 80.0).collect()}
    assert got == want and {40, 41} <= want.keys()


def test_suggested_part_needs_no_common_token(spark):
    pages = spark.createDataFrame([(1, "bolts", "zzz"), (2, "green", "bolt")], "url bigint, title string, last_part string")
    got = {x["url"]: x["suggestion"] for x in matching.check_breadcrumbs(pages).collect()}
    assert got[1] == "bolt"
