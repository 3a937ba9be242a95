"""Order statistics and running sums against sorted lists."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import order


@pytest.mark.parametrize("values", ["many", "few", "one", "skewed"])
def test_value_at(spark, values, monkeypatch):
    monkeypatch.setattr(order, "FEW_ROWS", 20)
    monkeypatch.setattr(order, "RANGES", 7)
    rnd = random.Random(3)
    x = {"many": [rnd.random() for _ in range(900)], "few": [float(rnd.randrange(5)) for _ in range(500)], "one": [2.5] * 100, "skewed": [1.0] * 400 + [rnd.random() * 1e6 for _ in range(100)]}[values]
    df = spark.createDataFrame([(v,) for v in x + [None] * 9], "v double")
    for place in (1, 2, len(x) // 3, len(x) * 3 // 4, len(x)):
        assert order.value_at(df, "v", place) == sorted(x)[place - 1]
    assert order.value_at(df, "v", len(x) + 1) is None and order.value_at(df.limit(0), "v", 1) is None


def test_running_sums_and_places(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, 1, 2, 3]), rnd.randrange(50)) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, level int, words bigint").repartition(7)
    got = {r.id: r.upto for r in order.running_sum(df, [F.col("level"), F.col("id")], F.col("words"), "upto").collect()}
    upto, want = 0, {}
    for i, _, w in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        upto += w
        want[i] = upto
    assert got == want
    places = {r.id: r.n for r in order.place_in(df, [F.col("words").desc(), F.col("id")], "n").collect()}
    assert places == {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
    assert order.place_in(df.limit(0), [F.col("id")], "n").count() == 0
