"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import discard, materialize

#: Far above what the alternation needs (about the logarithm of the number of nodes).
MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node can reach.

    ``links``: two columns of one sortable type; null ends and loops are left out, repeated
    links count once. Both steps attach neighbours to a node's smallest neighbour, and sums
    of a node's links are taken before they meet, so a node with many links costs no more
    than its share. Every round's links are written to the shared folder.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = materialize(edges, "links")
    state = None
    for _ in range(MOST_ROUNDS):
        # large star: every larger neighbour goes to the smallest neighbour (or the node itself)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = edges.join(least, edges["v"] == least["c"]).select("u", F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # small star: the smaller neighbours and the node itself go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.withColumnRenamed("u", "c"), F.col("u") == F.col("c")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, edges = edges, materialize(small.filter("u <> v").distinct(), "links")
        discard(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
