"""Choices in rounds: sequential rules (first come, first served; keep the first, drop what resembles it) as joins over edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.graph import settled
from lodestar.sources.shipping import ship

#: Edges of a range of rows that choose in one task.
RANGE_EDGES = 4_000_000


def assign_in_order(edges: DataFrame) -> DataFrame:
    """One-to-one choice in row order: ``edges`` (row, target, choice, ...), each row takes its first choice that is still free.

    The rows choose one after another, by ``row``; lower ``choice`` goes first, then the smaller target.
    In a round, each range of rows chooses by itself, as the loop would, and a target turns away all rows behind the first
    of those that took it. What is struck so is never had by that row in the loop, and once no two rows take one
    target, the outcome is that of the loop. The k-th range is settled after k rounds at the latest. Each round is a written table.
    """
    ship(edges.sparkSession)
    left, kinds = settled(edges), dict(edges.dtypes)

    def choose(batches):
        taken, done = set(), None
        for batch in batches:
            keep = []
            for k, (row, target) in enumerate(zip(batch["row"].to_pylist(), batch["target"].to_pylist(), strict=True)):
                if row != done and target not in taken:
                    taken.add(target)
                    done = row
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64()))

    while True:
        ranges = max(1, -(-left.count() // RANGE_EDGES))
        asks = left.repartitionByRange(ranges, "row").sortWithinPartitions("row", "choice", "target")
        asks = settled(asks.mapInArrow(choose, ", ".join(f"`{c}` {t}" for c, t in kinds.items())))
        held = asks.groupBy(F.col("target").alias("t")).agg(F.min("row").alias("holder"))
        if asks.count() == held.count():
            return asks
        left = settled(left.join(held, F.col("target") == F.col("t"), "left").filter("holder IS NULL OR row <= holder").select(edges.columns))


def assign_with_groups(edges: DataFrame, wishes: DataFrame, alike: DataFrame, members: DataFrame) -> DataFrame:
    """``assign_in_order`` of ``edges`` (row, target, choice) and of those that lead from ``wishes`` (row, wish) over ``alike`` (wish, of, choice) to ``members`` (target, of), which are not formed.

    A target is a member of one group at most, a row has one wish at most, and a wish has a choice for each group. Rows
    come in ascending order and what is taken or struck stays so, hence a range of rows goes through each group's targets once. A range none
    of whose targets has an earlier holder need not choose again; the first that has one is settled by the next round.
    """
    from lodestar.operators.order import running_sum

    ship(edges.sparkSession)
    kind, target = dict(edges.dtypes)["row"], dict(edges.dtypes)["target"]
    groups = settled(alike.select("of").distinct().select("of", F.monotonically_increasing_id().alias("group")))
    known = settled(alike.select("wish").distinct().select("wish", F.monotonically_increasing_id().alias("a")))
    ways = settled(alike.join(groups, "of").join(known, "wish").select("a", "group", F.col("choice").cast("double").alias("choice")))
    members = settled(members.join(groups, "of").select("group", "target"))
    lists = edges.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("choice").cast("double").alias("choice"), "target"))).alias("wants"))
    rows = lists.join(wishes.join(known, "wish").select("row", "a"), "row", "full").join(ways.groupBy("a").agg(F.count(F.lit(1)).alias("ways")), "a", "left")
    rows = running_sum(rows, [F.col("row")], F.greatest(F.size(F.coalesce("wants", F.array())), F.lit(0)) + F.coalesce("ways", F.lit(0)) + 1, "until")
    rows = settled(rows.select("row", "a", "wants", F.floor(F.col("until") / RANGE_EDGES).cast("int").alias("range")))

    def choose(mine: pa.Table, given: pa.Table) -> pa.Table:
        kinds = given["kind"].to_numpy()
        part = lambda k, *columns: zip(*(given.filter(pa.array(kinds == k))[c].to_pylist() for c in columns), strict=True)
        holder = dict(part(2, "target", "holder"))
        ranked: dict[int, dict[float, list[int]]] = {}
        for a, group, choice in part(0, "a", "group", "choice"):
            ranked.setdefault(a, {}).setdefault(choice, []).append(group)
        ordered = {a: sorted(ways.items()) for a, ways in ranked.items()}
        queues: dict[int, list] = {}
        for group, t in part(1, "group", "target"):
            queues.setdefault(group, []).append(t)
        for queue in queues.values():
            queue.sort(reverse=True)
        taken, out = set(), []
        mine = mine.sort_by("row")
        for row, a, wants in zip(mine["row"].to_pylist(), mine["a"].to_pylist(), mine["wants"].to_pylist(), strict=True):
            free = lambda t: t not in taken and holder.get(t, row) >= row  # noqa: B023, E731
            hit = next(((w["target"], w["choice"]) for w in wants or () if free(w["target"])), None)
            for choice, of in ordered.get(a, ()) if hit is None else ():
                heads = []
                for group in of:
                    queue = queues.get(group, [])
                    while queue and not free(queue[-1]):
                        queue.pop()
                    heads += queue[-1:]
                if heads:
                    hit = min(heads), choice
                    break
            if hit:
                taken.add(hit[0])
                out.append((row, *hit))
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        at = pa.array(np.full(len(out), mine["range"][0].as_py() if len(mine) else 0), pa.int32())
        return pa.table({"row": pa.array(columns[0], mine["row"].type), "target": pa.array(columns[1], given["target"].type), "choice": pa.array(columns[2], pa.float64()), "range": at})

    none = lambda t: F.lit(None).cast(t)
    asks, held, open_ = None, None, settled(rows.select("range").distinct())
    while True:
        left = rows.join(F.broadcast(open_), "range")
        used = settled(left.filter("a IS NOT NULL").select("range", "a").distinct().join(ways, "a"))
        given = used.select("range", F.lit(0).alias("kind"), "a", "group", "choice", none(target).alias("target"), none(kind).alias("holder"))
        reached = used.select("range", "group").distinct().join(members, "group")
        given = given.unionByName(reached.select("range", F.lit(1).alias("kind"), none("bigint").alias("a"), "group", none("double").alias("choice"), "target", none(kind).alias("holder")))
        if asks is not None:
            # a target that was asked for stays with its first holder or an earlier one
            strikes = open_.crossJoin(held.select("target", "holder"))
            given = given.unionByName(strikes.select("range", F.lit(2).alias("kind"), none("bigint").alias("a"), none("bigint").alias("group"), none("double").alias("choice"), "target", "holder"))
        got = left.groupBy("range").cogroup(given.groupBy("range")).applyInArrow(choose, f"row {kind}, target {target}, choice double, range int")
        asks = settled(got if asks is None else got.unionByName(asks.join(F.broadcast(open_), "range", "left_anti").select("row", "target", "choice", "range")))
        now = asks.groupBy("target").agg(F.min("row").alias("holder"))
        held = settled(now if held is None else now.unionByName(held).groupBy("target").agg(F.min("holder").alias("holder")))
        open_ = settled(asks.join(held, "target").filter("holder < row").select("range").distinct())
        if open_.isEmpty():
            return asks.select("row", "target", "choice")


def keep_in_order(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, kept_by): ``nodes`` (id, place) are taken by place, and one stays unless a pair of it stays already; null if it stays.

    ``pairs`` (a, b) are undirected. A node goes with the first of its pairs that stays. In a round, a node all of
    whose earlier pairs have gone stays, and one with an earlier pair that stays goes.
    """
    place = nodes.select("id", "place")
    both = pairs.select("a", "b").union(pairs.select("b", "a")).distinct()
    ahead = settled(both.join(place.toDF("a", "pa"), "a").join(place.toDF("b", "pb"), "b").filter("pb < pa").select("a", "b", "pb"))
    state = settled(place.select("id", F.lit(None).cast("boolean").alias("stays")))
    while True:
        known = state.select(F.col("id").alias("b"), F.col("stays").alias("b_stays"))
        seen = ahead.join(known, "b")
        if state.filter("stays IS NULL").isEmpty() and not state.isEmpty():
            by = seen.filter("b_stays").groupBy(F.col("a").alias("id")).agg(F.min_by("b", F.struct("pb", "b")).alias("kept_by"))
            return state.join(by, "id", "left").select("id", F.when(~F.col("stays"), F.col("kept_by")).alias("kept_by"))
        if state.isEmpty():
            return state.select("id", F.col("id").alias("kept_by"))
        seen = seen.groupBy(F.col("a").alias("id")).agg(F.count_if(F.col("b_stays").isNull()).alias("open"), F.count_if("b_stays").alias("held"))
        stays = F.when(F.coalesce("held", F.lit(0)) > 0, F.lit(False)).when(F.coalesce("open", F.lit(0)) == 0, F.lit(True))
        state = settled(state.join(seen, "id", "left").select("id", F.coalesce("stays", stays).alias("stays")))
