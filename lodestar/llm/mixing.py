"""Operator 2. Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Documents are shuffled by a hash of id and text. Within its source a document finishes at the
virtual time (words of the source up to and with it) / (weight of the source); its second
copy follows a whole source later. All copies are range-sorted by finish time over all
sources, and the queue is truncated where its words reach the budget. A source whose copies
are used up leaves the queue, so the others share what it would have had by weight: just the
targets.

Running totals never gather a source in one task: they are summed in 4,096 hash ranges of
each source, and a repeated document by slices of the stored table. The queue is cut into
ranges by sampled quantiles of its whole key, so that its ranges are even however finish
times are spread; only the range in which the budget ends is summed row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import col, fresh, materialize, md5_bits, running_totals, same_rows, sliced, word_count

WEIGHTS = (5, 2, 1)
#: The budget is this share of all words, as a fraction, and no source gives more than MOST_COPIES of itself.
BUDGET = (3, 2)
MOST_COPIES = 2
SEED = "mix-2"
#: So many sources are ordered in one task, and their figures broadcast; more are sorted by ranges, and joined.
MOST_SOURCES = 50_000
#: Copies of one row that a task writes out at a time.
COPIES_AT_ONCE = 1_024


def _ahead(df: DataFrame, order: list[Column], sums: dict[str, Column], few: bool) -> DataFrame:
    """Add the sums over the rows before each row, by ``order``: in one task, or by sampled ranges if there are not ``few``."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if few:
        return df.withColumns({n: F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in sums.items()})
    ranged = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "mix-ranges")
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    ranges = ranged.groupBy("__range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    ranges = ranges.select("__range", *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"__{n}") for n in sums])
    found = ranged.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()}).join(F.broadcast(ranges), "__range")
    return found.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop("__range", *[f"__{n}" for n in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: tuple[int, int] = BUDGET, few_sources: int = MOST_SOURCES) -> DataFrame:
    """(source_key, source_rank, weight, source_size, total, target) of each source, a stored table.

    ``sizes``: source_key, source, size. Sources stand in code point order, null last, and
    take the weights in turn. The water level is where weight * level, at most MOST_COPIES
    times the source's size, sums to the budget.
    """
    per = materialize(sizes.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), "mix-sizes-of-sources")
    seen = per.agg(F.count(F.lit(1)).alias("n"), F.sum("source_size").alias("total")).first()
    few, total = seen["n"] <= few_sources, seen["total"] or 0
    per = _ahead(per, [F.col("source").asc_nulls_last()], {"rank": F.lit(1).cast("bigint")}, few).withColumn("source_rank", F.col("rank").cast("int") + 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    full = F.col("source_size") * MOST_COPIES
    per = per.withColumns({"total": F.lit(total).cast("bigint"), "full": full, "at_full": full / F.col("weight")})
    per = materialize(_ahead(per, [F.col("at_full"), F.col("source_rank")], {"before": F.col("full"), "lighter": F.col("weight").cast("bigint")}, few), "mix-sources")
    everything = per.agg(F.sum("weight").alias("w")).first()["w"] or 0
    # the level is right at the first source that it doesn't fill; before that one, sources are full
    level = (F.col("total") * budget[0] / budget[1] - F.col("before")) / (F.lit(everything) - F.col("lighter"))
    right = per.withColumn("level", level).filter("level < at_full").agg(F.min(F.struct("at_full", "source_rank", "level")).alias("m")).first()["m"]
    if total == 0:
        target = F.lit(0.0)
    elif right is None:
        target = F.col("full").cast("double")
    else:
        target = F.least(F.col("full").cast("double"), F.col("weight") * F.lit(right["level"]))
    return materialize(per.select("source_key", "source_rank", "weight", "source_size", "total", target.alias("target")), "mix-targets")


def _source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), col(source)), F.lit(""))


def _order(docs: DataFrame, doc_id: str, text: str) -> dict[str, Column]:
    """Place within a source: hash of id and text, id, size, and a key of the whole row."""
    h = md5_bits(F.lit(SEED), F.coalesce(col(doc_id).cast("string"), F.lit("")), F.lit(" "), F.coalesce(col(text), F.lit("")))
    return {"h": h, "doc_id": col(doc_id), "size": word_count(col(text)), "row": same_rows(docs)["x"]}


def _queue_key(time: Column, copy: int) -> Column:
    """Place in the queue: finish time, then ties by source, hash, id, size and row."""
    return F.struct(time.alias("time"), "source_rank", "h", "doc_id", "size", "row", F.lit(copy).alias("copy"))


def _queued(docs: DataFrame, doc_id: str, source: str, text: str, weights: tuple[int, ...], budget: tuple[int, int], few_sources: int) -> DataFrame:
    """The rows of ``docs`` in short (a stored table), with their place and copies."""
    order = _order(docs, doc_id, text)
    rows = docs.select(col(source).alias("source"), _source_key(source).alias("source_key"), *[c.alias(n) for n, c in order.items()], sliced().alias("slice"))
    rows = materialize(rows.withColumn("part", F.shiftright("h", 48).cast("int")), "mix-sizes")
    per = source_targets(rows, weights, budget, few_sources)
    per = F.broadcast(per) if per.count() <= few_sources else per
    # words of the source up to and with each document
    placed = running_totals(rows.select("source_key", "part", *order, "slice"), ["source_key"], "part", list(order), F.col("size")).join(per, "source_key")
    placed = placed.select("source_key", *order, "source_rank", "weight", "source_size", "total", "target", (F.col("ahead") + F.col("size")).alias("upto"))
    rows = materialize(placed, "mix-order")

    times = [(F.col("upto") + F.col("source_size") * i) / F.col("weight") for i in range(MOST_COPIES)]
    total = rows.agg(F.max("total").alias("t")).first()["t"]
    cut = None
    if total:
        queue = rows.filter("size > 0").select("size", F.explode(F.array(*[_queue_key(t, i) for i, t in enumerate(times)])).alias("key"))
        queue = queue.repartitionByRange("key").withColumn("range", F.spark_partition_id())
        queue = materialize(queue, "mix-queue")
        # one row for each partition: the ranges up to the one in which the budget ends
        ranges = queue.groupBy("range").agg(F.sum("size").alias("words"), F.max("key").alias("last")).orderBy("range").collect()
        ahead = 0
        for r in ranges:
            if (ahead + r["words"]) * budget[1] <= total * budget[0]:
                ahead, cut = ahead + r["words"], r["last"]
                continue
            along = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
            within = queue.filter(F.col("range") == r["range"]).withColumn("words", F.sum("size").over(along) + F.lit(ahead))
            # words only rise along the queue, so the last place within the budget is its end
            cut = within.filter(F.col("words") * budget[1] <= total * budget[0]).agg(F.max("key").alias("key")).first()["key"] or cut
            break
    if cut is None:
        return rows.withColumn("copies", F.lit(0))
    kinds = dict(rows.dtypes) | {"time": "double", "copy": "int"}
    last = F.struct(*[F.lit(cut[n]).cast(kinds[n]).alias(n) for n in ("time", "source_rank", "h", "doc_id", "size", "row", "copy")])
    return rows.withColumn("copies", sum(((_queue_key(t, i) <= last).cast("int") for i, t in enumerate(times)), F.lit(0)))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, budget: tuple[int, int] = BUDGET, few_sources: int = MOST_SOURCES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken, copies.

    copies (0 to MOST_COPIES) is how often the mix takes the document, taken is copies * size.
    A null text has size 0; a null source is a source, the last; a null id is ordered first.
    Rows with one id and text are queued one after another, by a hash of the whole row; wholly
    equal rows are as good as each other. Documents of size 0 are taken or not without effect on
    the words. Columns of ``docs`` may have any names; an empty table gives no rows. Runs agree
    however the table is partitioned.
    """
    rows = _queued(docs, doc_id, source, text, weights, budget, few_sources)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, budget: tuple[int, int] = BUDGET, few_sources: int = MOST_SOURCES) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: left out, once, or repeated; columns as in ``docs``.

    Nulls, ties, repeated rows, empty texts and empty tables as in ``mix``. Finish times rise
    with the place within a source, so a source's copies end at one place each: these places
    are all that is joined, and texts are not shuffled. Of wholly equal rows at such a place
    some may be taken and others not; those taken are written from one of them.
    """
    rows = _queued(docs, doc_id, source, text, weights, budget, few_sources)
    rows = rows.withColumn("at", F.struct("h", "doc_id", "size", "row"))
    ends = rows.groupBy("source_key").agg(*[F.max(F.when(F.col("copies") > i, F.col("at"))).alias(f"end{i}") for i in range(MOST_COPIES)])
    ends = materialize(ends, "mix-last")  # one row for each source
    few = ends.count() <= few_sources
    # rows at an end: how many there are, and how many of them are taken
    at_end = [F.col("at").eqNullSafe(F.col(f"end{i}")) for i in range(MOST_COPIES)]
    met = rows.join(F.broadcast(ends) if few else ends, "source_key").groupBy("source_key").agg(
        *[F.first(f"end{i}").alias(f"end{i}") for i in range(MOST_COPIES)],
        *[F.count_if(c).alias(f"rows{i}") for i, c in enumerate(at_end)],
        *[F.count_if(c & (F.col("copies") > i)).alias(f"some{i}") for i, c in enumerate(at_end)],
    )
    met = materialize(met.withColumnRenamed("source_key", "of_source"), "mix-ends")

    names = fresh(docs, "mix_order", "mix_key", "mix_copies", "mix_all")
    order, key, copies, everything = names
    packed = docs.select(F.struct(*map(col, docs.columns)).alias(everything), F.struct(*[c.alias(n) for n, c in _order(docs, doc_id, text).items()]).alias(order), _source_key(source).alias(key))
    packed = packed.join(F.broadcast(met) if few else met, F.col(key) == F.col("of_source"))
    at = F.col(order)
    here = [at.eqNullSafe(F.col(f"end{i}")) & (F.col(f"some{i}") < F.col(f"rows{i}")) for i in range(MOST_COPIES)]
    whole = sum((F.coalesce((F.col(f"end{i}").isNotNull() & (at <= F.col(f"end{i}")) & ~here[i]).cast("int"), F.lit(0)) for i in range(MOST_COPIES)), F.lit(0))
    taken = packed.withColumn(copies, whole).filter(F.col(copies) > 0).select(F.explode(F.array_repeat(F.col(everything), F.col(copies))).alias(everything))
    if met.filter(F.greatest(*[F.col(f"rows{i}") - F.col(f"some{i}") for i in range(MOST_COPIES)]) > 0).isEmpty():
        return taken.select(*[F.col(everything).getField(c).alias(c) for c in docs.columns])
    # at most MOST_COPIES places of a source
    part = [packed.filter(here[i]).groupBy(key).agg(F.first(everything).alias(everything), F.first(f"some{i}").alias(copies)) for i in range(MOST_COPIES)]
    rest = part[0]
    for p in part[1:]:
        rest = rest.unionByName(p)
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col(copies) - 1).cast("bigint"), F.lit(COPIES_AT_ONCE).cast("bigint"))).alias("mix_block")
    rest = rest.select(everything, copies, blocks).repartition("mix_block")
    rest = rest.select(F.explode(F.array_repeat(F.col(everything), F.least(F.lit(COPIES_AT_ONCE), F.col(copies) - F.col("mix_block")).cast("int"))).alias(everything))
    return taken.unionByName(rest).select(*[F.col(everything).getField(c).alias(c) for c in docs.columns])
