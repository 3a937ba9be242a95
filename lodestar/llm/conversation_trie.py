"""Operator 13. Prefix trie of conversations, summed by peeling its leaves.

A node is the sequence of a conversation's first d turns. Its key is the exclusive or of 128-bit
hashes of (turn, place), so prefixes can be keyed part by part: turns are range-sorted by
conversation and order, numbered and keyed within each sorted part, and the parts of one
conversation are joined up by their counts and keys. No conversation is held in one task.

Totals of subtrees go up by messages. Every node holds a counter of children still to come; nodes
whose counter is zero are complete and send their totals to their parents, round by round, until
only the root is left to finish. Runs of nodes with one child and no end of a conversation are
put behind the run's last node before the first round. Where a round completes few nodes (long
spines whose side branches are gone), what has become a chain is put behind its last node by
pointer doubling, so rounds grow with the logarithm of the trie. Chain nodes get their totals at
the end, from the node that they stand behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import col, discard, materialize, word_count

#: Turns of one number in one conversation go by role, then by so many characters of text, then by digest.
HEAD = 48
#: Parents with more than 1 / so many of all nodes as children are broadcast when children learn their parents' ids.
HOT_PARENTS = 1000
#: A round that completes less than this share of the pending nodes is followed by a contraction of chains.
FEW = 0.25
MOST_ROUNDS = 500

_NONE = hashlib.sha256(b"").hexdigest()


def _hashes(key: Column, depth: Column) -> tuple[Column, Column]:
    return F.xxhash64(key, depth), F.xxhash64(F.lit("second"), depth, key)


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _before(by: Window, value: Column) -> Column:
    return F.coalesce(value.over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def rebuilt_turns(turns: DataFrame, base: Callable[[Column], Column] | None, borrowed: Callable[[Column], Column] | None, most_borrowed: int, names: list[str]) -> DataFrame:
    """(c, part, d, k, p, words, last): one row for each prefix of each rebuilt conversation, the empty one included.

    k and p: keys of the prefix and of the prefix before it; words: of its last turn; last: nothing follows.
    """
    conv, turn, role, text = map(col, names)
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    said = turns.filter(conv.isNotNull()).select(conv.cast("bigint").alias("c"), turn.alias("t"), role.alias("r"), F.substring(text, 1, HEAD).alias("head"), digest.alias("key"), word_count(text).alias("words"))
    said = materialize(said.withColumn("row", F.monotonically_increasing_id()), "turns")  # without texts
    order = [F.col("c"), F.col("t").asc_nulls_first(), F.col("r"), F.col("head"), F.col("key"), F.col("row")]  # equal rows are parted by their number
    placed = said.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.select("c", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "key", "words"), "placed")
    # parts of a conversation: as many as the range sort made, whatever its length
    parts = placed.groupBy("c", "part").agg(F.count(F.lit(1)).alias("n"))
    parts = materialize(parts.withColumn("ahead", _before(Window.partitionBy("c").orderBy("part"), F.sum("n"))), "parts")
    within = Window.partitionBy("c", "part").orderBy("at")
    numbered = placed.join(parts.select("c", "part", "ahead"), ["c", "part"]).withColumn("i", F.col("ahead") + F.row_number().over(within) - 1)
    # the turns that other conversations borrow: the first few of each
    convs = parts.groupBy("c").agg(F.sum("n").alias("n"))
    convs = convs.select("c", "n", (base(F.col("c")) if base else F.lit(None).cast("bigint")).alias("from"), (borrowed(F.col("c")).cast("bigint") if borrowed else F.lit(0).cast("bigint")).alias("h"))
    heads = numbered.filter(F.col("i") < most_borrowed)
    heads = heads.groupBy(F.col("c").alias("from")).agg(F.array_sort(F.collect_list(F.struct("i", "key", "words"))).alias("head"))
    taken = F.filter(F.coalesce("head", F.array().cast("array<struct<i:bigint,key:binary,words:bigint>>")), lambda e: e["i"] < F.col("h"))
    convs = convs.join(heads, "from", "left").select("c", "n", "h", taken.alias("head"))
    first_hash, second_hash = (F.transform("head", lambda e: _hashes(e["key"], e["i"] + 1)[0]), F.transform("head", lambda e: _hashes(e["key"], e["i"] + 1)[1]))
    convs = convs.withColumn("x1", first_hash).withColumn("x2", second_hash).withColumn("total", F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = materialize(convs, "borrowers")
    upto = lambda xs, d: F.aggregate(F.slice(xs, F.lit(1), d), F.lit(0).cast("bigint"), _xor)
    first = convs.select("c", "head", "x1", "x2", "total", F.explode(F.sequence(F.lit(0), F.size("head"))).alias("d"))
    d, earlier = F.col("d"), F.greatest(F.col("d") - 1, F.lit(0))
    first = first.select(
        "c", F.lit(-1).alias("part"), d.cast("bigint").alias("d"), F.struct(upto("x1", d).alias("x"), upto("x2", d).alias("y")).alias("k"),
        F.when(d > 0, F.struct(upto("x1", earlier).alias("x"), upto("x2", earlier).alias("y"))).alias("p"), F.when(d > 0, F.get("head", earlier)["words"]).otherwise(0).alias("words"), (d == F.col("total")).alias("last"),
    )
    # own turns behind the borrowed ones; what a row needs of its conversation comes with its part
    every = F.size("head")
    known = parts.join(convs.select("c", "h", "total", every.cast("bigint").alias("nh"), upto("x1", every).alias("b1"), upto("x2", every).alias("b2")), "c").drop("n", "ahead")
    own = numbered.join(known, ["c", "part"]).filter("i >= h").withColumn("d", F.col("nh") + F.col("i") - F.col("h") + 1)
    own = own.withColumn("x1", _hashes(F.col("key"), F.col("d"))[0]).withColumn("x2", _hashes(F.col("key"), F.col("d"))[1])
    upto_row = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("u1", F.bit_xor("x1").over(upto_row)).withColumn("u2", F.bit_xor("x2").over(upto_row))
    own = materialize(own.select("c", "part", "d", "words", (F.col("d") == F.col("total")).alias("last"), "x1", "x2", _xor(F.col("u1"), F.col("b1")).alias("u1"), _xor(F.col("u2"), F.col("b2")).alias("u2")), "own-turns")
    by_part = own.groupBy("c", "part").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
    earlier_parts = Window.partitionBy("c").orderBy("part")
    by_part = by_part.select("c", "part", _before(earlier_parts, F.bit_xor("s1")).alias("s1"), _before(earlier_parts, F.bit_xor("s2")).alias("s2"))
    own = own.join(by_part, ["c", "part"]).withColumn("k", F.struct(_xor(F.col("u1"), F.col("s1")).alias("x"), _xor(F.col("u2"), F.col("s2")).alias("y")))
    own = own.select("c", "part", "d", "k", F.struct(_xor(F.col("k.x"), F.col("x1")).alias("x"), _xor(F.col("k.y"), F.col("x2")).alias("y")).alias("p"), "words", "last")
    return first.unionByName(own)


def _joined_runs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Put runs of nodes with one child and no end behind their last node.

    A run lies on the path of one conversation (the smallest member of all its nodes) and within
    one sorted part of it. Gives (k, down, leaves, saved) of the nodes put behind ``down``, and
    the nodes left: (k, up, ahead_leaves, ahead_saved, remaining, leaves, saved), where the
    ``ahead`` sums are of the run between a node and ``up``.
    """
    path = Window.partitionBy("c", "part").orderBy("depth")
    through = (F.col("n_children") == 1) & (F.col("n_ends") == 0) & F.lead("k").over(path).isNotNull()
    runs = nodes.withColumn("through", through).withColumn("run", _before(path, F.sum(F.when(F.col("through"), 0).otherwise(1))))
    run = Window.partitionBy("c", "part", "run").orderBy("depth")
    whole, below = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), run.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    own = F.last("saved").over(whole)
    runs = runs.select("k", "through", "n_children", "saved", F.last("k").over(whole).alias("down"), F.first("p").over(whole).alias("up"), (F.sum("saved").over(below) - own).alias("between"), (F.sum("saved").over(whole) - own).alias("all"))
    runs = materialize(runs, "runs")
    behind = runs.filter("through").select("k", "down", F.lit(0).cast("bigint").alias("leaves"), F.col("between").alias("saved"))
    left = runs.filter("not through").select(
        "k", "up", F.lit(0).cast("bigint").alias("ahead_leaves"), F.col("all").alias("ahead_saved"), F.col("n_children").alias("remaining"), (F.col("n_children") == 0).cast("bigint").alias("leaves"), "saved"
    )
    return behind, left


def _contract(pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Put pending nodes with one child to come behind the next node below that isn't one, by pointer doubling."""
    one = pending.filter("remaining = 1")
    kids = pending.groupBy(F.col("up").alias("over")).agg(F.min("k").alias("down"), F.min("ahead_leaves").alias("between_leaves"), F.min("ahead_saved").alias("between_saved"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    links = one.join(kids, F.col("k") == F.col("over")).select("k", "up", "down", (F.col("leaves") + F.col("between_leaves")).alias("leaves"), (F.col("saved") + F.col("between_saved")).alias("saved"))
    links = materialize(links, "chains")
    while True:
        nxt = links.select(F.col("k").alias("b"), F.col("down").alias("b_down"), F.col("leaves").alias("b_leaves"), F.col("saved").alias("b_saved"))
        step = links.join(nxt, F.col("down") == F.col("b"), "left").select(
            "k", "up", F.coalesce("b_down", "down").alias("down"), (F.col("leaves") + F.coalesce("b_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("b_saved", F.lit(0))).alias("saved"), F.col("b").isNotNull().alias("moved")
        )
        step = materialize(step, "chains")
        discard(links)
        links = step.drop("moved")
        links._lodestar_path = step._lodestar_path
        if step.filter("moved").isEmpty():
            break
    tops = links.join(links.select(F.col("k").alias("b")), F.col("up") == F.col("b"), "left_anti")
    tops = tops.select(F.col("down").alias("b"), F.col("up").alias("top"), F.col("leaves").alias("t_leaves"), F.col("saved").alias("t_saved"))
    left = pending.filter("remaining <> 1").join(tops, F.col("k") == F.col("b"), "left")
    moved = F.col("b").isNotNull()
    left = left.select(
        "k", F.when(moved, F.col("top")).otherwise(F.col("up")).alias("up"), F.when(moved, F.col("t_leaves")).otherwise(F.col("ahead_leaves")).alias("ahead_leaves"),
        F.when(moved, F.col("t_saved")).otherwise(F.col("ahead_saved")).alias("ahead_saved"), "remaining", "leaves", "saved",
    )
    return links.select("k", "down", "leaves", "saved"), materialize(left, "pending")


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """(k, leaves, saved) of every node's subtree, by peeling leaves."""
    behind, pending = _joined_runs(nodes)
    pending = materialize(pending, "pending")
    deferred, complete, n = [behind], [], pending.count()
    for _ in range(MOST_ROUNDS):
        if not n:
            break
        ready = pending.filter("remaining = 0")
        complete.append(ready.select("k", "leaves", "saved"))
        sent = ready.filter("up is not null").groupBy(F.col("up").alias("to")).agg(F.count(F.lit(1)).alias("came"), F.sum(F.col("leaves") + F.col("ahead_leaves")).alias("l"), F.sum(F.col("saved") + F.col("ahead_saved")).alias("s"))
        left = pending.filter("remaining > 0").join(sent, F.col("k") == F.col("to"), "left").select(
            "k", "up", "ahead_leaves", "ahead_saved", (F.col("remaining") - F.coalesce("came", F.lit(0))).alias("remaining"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")
        )
        pending, before = materialize(left, "pending"), n
        n = pending.count()
        if n and before - n < FEW * before:
            chains, shorter = _contract(pending)
            discard(pending)
            deferred.append(chains)
            pending, n = shorter, shorter.count()
    else:
        raise RuntimeError(f"the trie was not peeled in {MOST_ROUNDS} rounds")
    totals = reduce(DataFrame.unionByName, complete) if complete else nodes.select("k", F.lit(0).cast("bigint").alias("leaves"), "saved")
    for chains in reversed(deferred):
        known = totals.select(F.col("k").alias("b"), F.col("leaves").alias("b_leaves"), F.col("saved").alias("b_saved"))
        found = chains.join(known, F.col("down") == F.col("b")).select("k", (F.col("leaves") + F.col("b_leaves")).alias("leaves"), (F.col("saved") + F.col("b_saved")).alias("saved"))
        totals = materialize(totals.unionByName(found), "totals")
    return totals


def id_digests(ends: DataFrame) -> DataFrame:
    """(k, ends_sha256): digest of the ids ``c`` that share ``k``, ascending, joined by commas.

    Ids are range-sorted and joined into one text for each sorted part first. SHA-256 takes its
    input in order, so the texts of one node go through one task, as a stream that holds one of them.
    """
    sorted_ids = ends.select("k.x", "k.y", "c").repartitionByRange("x", "y", "c").select("x", "y", "c", F.spark_partition_id().alias("part"))
    blocks = sorted_ids.groupBy("x", "y", "part").agg(F.array_sort(F.collect_list("c")).alias("ids"))
    blocks = blocks.select("x", "y", "part", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    streams = blocks.repartition("x", "y").sortWithinPartitions("x", "y", "part").select("x", "y", "ids")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for x, y, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (x, y) != node:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (x, y), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["x", "y", "ends_sha256"])
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([state.hexdigest()])], ["x", "y", "ends_sha256"])

    return streams.mapInArrow(digests, "x bigint, y bigint, ends_sha256 string").select(F.struct("x", "y").alias("k"), "ends_sha256")


def prefix_trie(turns: DataFrame, base: Callable[[Column], Column] | None = None, borrowed: Callable[[Column], Column] | None = None, most_borrowed: int = 3, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The nodes of the prefix trie of all conversations.

    ``base`` and ``borrowed`` give, of a conversation's id, the conversation whose first turns it
    begins with and their number (``most_borrowed`` at most); its own turns behind that number
    follow. Without them conversations are taken as they are.

    conv_id: smallest member; depth; parent_conv_id: the parent's conv_id, null at the root; n_convs:
    members; n_children; n_leaves: childless nodes of the subtree; saved_tokens: words of last turns
    times members but one, summed over the subtree; ends_sha256: digest of the members that end here.

    Turns go by their number, null first; turns of one number by role, text's first 48 characters and
    digest. Null roles and texts are empty. Rows without a conversation's id belong to none and are left out.
    Repeated rows are turns of their own. Other columns are ignored; an empty table gives no rows. Texts of
    any length are digested in one row, and conversations of any length are spread over sorted parts.
    """
    rows = materialize(rebuilt_turns(turns, base, borrowed, most_borrowed, [conv, turn, role, text]), "prefixes")
    nodes = rows.groupBy("k").agg(F.min(F.struct("c", "part")).alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.max("d").alias("depth"), F.max("p").alias("p"), F.max("words").alias("words"), F.count_if("last").alias("n_ends"))
    nodes = materialize(nodes.select("k", "p", "rep.c", "rep.part", "depth", "n_convs", "n_ends", ((F.col("n_convs") - 1) * F.col("words")).alias("saved")), "nodes")
    kids = nodes.filter("p is not null").groupBy(F.col("p").alias("of")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = materialize(nodes.join(kids, F.col("k") == F.col("of"), "left").drop("of").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "counted")
    discard(nodes)
    totals = subtree_totals(counted)
    # children learn their parent's conversation: of parents with many children by broadcast (HOT_PARENTS at most), of others by a join
    many = counted.count() / HOT_PARENTS
    parents = counted.filter("n_children > 0").select(F.col("k").alias("of"), F.col("c").alias("parent_conv_id"), "n_children")
    hot = F.broadcast(parents.filter(F.col("n_children") > many).drop("n_children"))
    below = counted.filter("p is not null").select("k", "p")
    of_hot = below.join(hot, F.col("p") == F.col("of")).select("k", "parent_conv_id")
    of_others = below.join(hot, F.col("p") == F.col("of"), "left_anti").join(parents.filter(F.col("n_children") <= many), F.col("p") == F.col("of")).select("k", "parent_conv_id")
    digests = id_digests(rows.filter("last").select("k", "c"))
    out = counted.join(totals.withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"}), "k").join(of_hot.unionByName(of_others), "k", "left").join(digests, "k", "left")
    return out.select(F.col("c").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"))
