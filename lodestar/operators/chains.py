"""Chains of a functional graph (each node has one successor at most) by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.graph import settled


def follow(steps: DataFrame) -> DataFrame:
    """(node, final, hops, is_loop): where each node of ``steps`` (node, next; one row for each node) ends, however far.

    Every round a node takes over the pointer of the node that it points at, so a chain of n hops
    takes log2(n) rounds of one join. Nodes that run into a loop never end; they are what is left
    when a round brings no further node to its end, because on a chain that ends the nodes with
    more than half of the distance covered so far always do. Their final and hops are null.
    """
    state = settled(steps.filter("node IS NOT NULL AND next IS NOT NULL").select("node", F.col("next").alias("at"), F.lit(1).cast("bigint").alias("hops"), F.lit(True).alias("open")))
    before = state.count()
    while True:
        onward = state.select(F.col("node").alias("n"), F.col("at").alias("n_at"), F.col("hops").alias("n_hops"), F.col("open").alias("n_open"))
        moving = state.filter("open").join(onward, F.col("at") == F.col("n"), "left")
        # a pointer at a node without a successor has come to its end
        moved = moving.select("node", F.coalesce("n_at", "at").alias("at"), (F.col("hops") + F.coalesce("n_hops", F.lit(0))).alias("hops"), F.coalesce("n_open", F.lit(False)).alias("open"))
        state = settled(state.filter("NOT open").unionByName(moved))
        still = state.filter("open").count()
        if still in (0, before):
            break
        before = still
    end = lambda c: F.when(~F.col("open"), F.col(c))
    return state.select("node", end("at").alias("final"), end("hops").alias("hops"), F.col("open").alias("is_loop"))


def first_steps(steps: DataFrame, most: int) -> DataFrame:
    """(node, path): the nodes that each node of ``steps`` (node, next) leads to in turn, ``most`` at most; paths double each round."""
    state = settled(steps.filter("node IS NOT NULL AND next IS NOT NULL").select("node", F.array("next").alias("path")))
    length = 1
    while length < most:
        onward = state.select(F.col("node").alias("n"), F.col("path").alias("more"))
        far = F.when(F.size("path") == length, F.element_at("path", -1))
        step = state.join(onward, far == F.col("n"), "left").select("node", F.concat("path", F.coalesce("more", F.array().cast(state.schema["path"].dataType))).alias("path"))
        length *= 2
        state = settled(step.select("node", F.slice("path", 1, min(length, most)).alias("path")))
    return state
