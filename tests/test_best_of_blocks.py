"""Pairs that cannot be among the best leave where they are made, and no other."""

from __future__ import annotations

import numpy as np

from lodestar.operators.clusters import similar_pairs


def test_the_best_of_each_row_stay(spark):
    pick = np.random.default_rng(2)
    vectors = lambda n: spark.createDataFrame([(i, [float(x) for x in pick.normal(size=8)]) for i in range(n)] + [(n, [1.0] + [0.0] * 7), (n + 1, [1.0] + [0.0] * 7)], "id bigint, vector array<float>")
    a, b = vectors(60), vectors(300)
    whole = similar_pairs(a, b, -0.1).toPandas()
    for side, other in (("left", "right"), ("right", "left")):
        few = similar_pairs(a, b, -0.1, block=16, best=(side, 3, 0.05)).toPandas()
        assert len(few) < len(whole) / 2
        whole["kth"] = whole.groupby(f"{side}_id")["similarity"].transform(lambda s: s.nlargest(3).min())
        wanted = whole[whole.similarity >= whole.kth - 0.05]
        pairs = lambda df: set(zip(df.left_id, df.right_id))
        assert pairs(wanted) <= pairs(few) <= pairs(whole)
