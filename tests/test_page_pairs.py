"""B15 by pages: the sums over pairs of rows, without the pairs."""

from __future__ import annotations

import random

from lodestar.operators import clusters as c


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_pages_pair_as_their_rows_do(spark, monkeypatch):
    pick = random.Random(3)
    rows = [(f"q{pick.randrange(9)}", f"/{pick.randrange(40)}", pick.choice([None, 1.0, 2.5, 7.25, 40.0]), pick.choice([None, 3, 10, 400])) for _ in range(700)] + [(None, "/x", 1.0, 1), ("q1", None, 1.0, 1), ("alone", "/1", 1.0, 5)]
    gsc = spark.createDataFrame(rows, "query string, page string, position double, impressions bigint")
    want = rows_of(c.cannibalization_severity(gsc=gsc))
    for block in (512, 7):
        monkeypatch.setattr(c, "BLOCK_PAGES", block)
        got = rows_of(c.cannibalizing_pages(gsc))
        assert len(got) == len(want)
        for g, w in zip(got, want, strict=True):
            assert g[:3] == w[:3] and g[4] == w[4] and (g[3] == w[3] or abs(g[3] - w[3]) < 0.011)


def test_no_pairs_of_rows_are_formed(spark):
    """A million pairs of rows stand behind each of these three pairs of pages."""
    gsc = spark.range(3_000).selectExpr("'q' AS query", "concat('/', id % 3) AS page", "CAST(id % 25 AS DOUBLE) AS position", "id AS impressions")
    got = rows_of(c.cannibalizing_pages(gsc))
    assert [r[:3] for r in got] == [("/0", "/1", 1_000_000), ("/0", "/2", 1_000_000), ("/1", "/2", 1_000_000)]


def test_tiles_of_blocks_that_move_seldom(spark, monkeypatch):
    """A page moves once for each block of its query, and blocks are wide; tiles within them give the same pairs."""
    assert c.BLOCK_PAGES >= 8_192
    pick = random.Random(4)
    gsc = spark.createDataFrame([(f"q{pick.randrange(3)}", f"/{pick.randrange(60)}", pick.choice([None, 1.0, 2.5, 40.0]), pick.choice([None, 3, 10])) for _ in range(400)], "query string, page string, position double, impressions bigint")
    want = rows_of(c.cannibalization_severity(gsc=gsc))
    for block in (8_192, 20):
        monkeypatch.setattr(c, "BLOCK_PAGES", block)
        monkeypatch.setattr(c, "TILE_PAGES", 9)
        got = rows_of(c.cannibalizing_pages(gsc))
        assert [g[:3] for g in got] == [w[:3] for w in want] and want
        assert all(g[4] == w[4] and (g[3] == w[3] or abs(g[3] - w[3]) < 0.011) for g, w in zip(got, want, strict=True))
