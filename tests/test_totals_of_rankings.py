"""Totals without positions are those of the SQL over all rankings, nulls and unknown suppliers included."""

from __future__ import annotations

import random

from lodestar.operators import search
from lodestar.plans import fixtures as fx


def test_totals_without_windows(spark, tmp_path):
    r = random.Random(7)
    lines = [(r.choice([None, *range(40)]), r.choice([None, *range(30)]), r.choice([None, 1.0, 2.5, 7.9]), 3.25) for _ in range(150)]
    spark.createDataFrame([*lines, (99, 1000, 4.0, 1.0)], "l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, r.choice([None, "a", f"s{k}"])) for k in [*range(0, 30, 2), 4, None]], "s_suppkey bigint, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    given = {n: x.spark(spark, str(tmp_path)) for n, x in fx.RANKING_INPUTS.items()}
    got = fx.totals_of_rankings(given["lineitem"], given["supplier"])
    want = search.sov_meta(rankings=fx.RANKINGS).spark(spark, str(tmp_path))
    assert got.collect() == want.collect() and got.dtypes == want.dtypes
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    none = fx.totals_of_rankings(given["lineitem"].limit(0), given["supplier"]).collect()
    assert [tuple(x) for x in none] == [(0, None, 0)]


def test_query_has_no_windows(spark):
    from lodestar.plans import registry

    assert "Window" not in registry.queries()["a22_sov_meta"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
