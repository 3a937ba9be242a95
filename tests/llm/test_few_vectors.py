"""Tables of few distinct vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import multi_index


@pytest.mark.parametrize("n", [2, 8, 21, 25])
def test_small_tables_give_all_or_k_neighbours(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = multi_index.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.lit(True))
    per = {r["query_id"]: r["n"] for r in got.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert per == dict.fromkeys(range(n), min(20, n - 1))
