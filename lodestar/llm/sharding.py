"""Operator 10. Sharding by vector bin packing over bytes, tokens and rows.

Documents of one text form a group and stay together. Every group has a vector of its shares
of all bytes, tokens and rows; vectors are placed one after another, the largest first, each
in the shard where its dot product with the residual capacity is highest.

Placing is sequential, so it works on a bounded number of vectors: groups with a share above
1 / (shards * FINE) of any measure stand alone (at most 3 * shards * FINE of them), all
others are bundled by hash into BUNDLES bundles. A group that would fill more than half a
shard is split: its rows are alike but for their ids, so they are numbered by a hash of the
id and cut into runs of equal length, PER_SHARD for each shard that the group could fill.
Equal rows are numbered too, so they part like any others. The law that holds is ``bytes``:
shards' sizes are near equal.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import col, materialize, running_totals, sliced, word_count

FINE, BUNDLES, PER_SHARD = 128, 8_192, 8


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each vector (rows of shares, in the order of placing)."""
    room = np.full((shards, vectors.shape[1]), 1.0 / shards)
    chosen = np.empty(len(vectors), dtype=np.int64)
    for i, v in enumerate(vectors):
        chosen[i] = s = int(np.argmax(room @ v))
        room[s] -= v
    return chosen


def pack_shards(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, tokens, text_crc32, shard, slot.

    size is the UTF-8 length of the text plus 1; a null or empty text has no bytes, no tokens and
    the CRC of the empty text; null texts are a group, empty ones another. Slots count from 0
    without gaps within a shard: first the runs of split groups, then the other rows in the
    order of a hash of id and text. Null ids, ties and repeated rows are rows like any other, each
    with a slot of its own; a repeated row's places are the same in every run. Columns but id and
    text are not read, so no name can clash. Shards can stay empty; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(col(text)), F.lit(0)) + 1).cast("bigint").alias("size"),
        word_count(col(text)).alias("tokens"),
        F.crc32(F.coalesce(col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(col(text)), F.lit("")).alias("same"),
        F.xxhash64(col(doc_id), col(text)).alias("h"),
        sliced().alias("slice"),
    )
    rows = materialize(rows.withColumn("bundle", F.pmod(F.xxhash64("same"), F.lit(BUNDLES)).cast("int")), "shard-rows")
    measures = ["size", "tokens", "n"]
    sums = [F.sum(m).alias(m) for m in measures]
    # sums of a hot group are taken before it meets in one task
    groups = materialize(rows.groupBy("same", "bundle").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "shard-groups")
    total = groups.agg(*sums).first()
    if total["n"] is None:
        return rows.select("doc_id", "size", "tokens", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    whole = [max(total[m], 1) for m in measures]
    groups = groups.withColumn("share", F.greatest(*[F.col(m) / F.lit(t) for m, t in zip(measures, whole, strict=True)]))
    bound = 1 / (shards * FINE)

    # at most 3 * shards * FINE groups and BUNDLES bundles come to the driver
    heavy = groups.filter(F.col("share") > bound).select("same", "share", *measures).collect()
    light = groups.filter(F.col("share") <= bound).groupBy("bundle").agg(*sums).collect()
    items: list[tuple] = [("bundle", r["bundle"], 0, r["size"], r["tokens"], r["n"]) for r in light]
    runs: dict[str, int] = {}  # of split groups, at most 6 * shards of them
    for r in heavy:
        n = min(r["n"], math.ceil(r["share"] * shards * PER_SHARD)) if r["share"] * shards > 0.5 else 1
        if n > 1:
            runs[r["same"]] = n
        for i in range(n):
            here = (i + 1) * r["n"] // n - i * r["n"] // n  # rows of a group are equal in size and tokens
            items.append(("run" if n > 1 else "group", r["same"], i, *(r[m] * here // r["n"] for m in measures)))
    vectors = np.array([i[3:] for i in items], dtype=float) / whole
    order = sorted(range(len(items)), key=lambda i: (-vectors[i].max(), str(items[i][:3])))
    where = dict(zip(order, place(vectors[order], shards).tolist(), strict=True))

    # where the runs begin in their shards; the other rows follow
    filled, starts = [0] * shards, []
    for k, (kind, name, i, _, _, n) in enumerate(items):
        if kind == "run":
            starts.append((name, i, where[k], filled[where[k]]))
            filled[where[k]] += n
    alone = spark.createDataFrame([(i[1], where[k]) for k, i in enumerate(items) if i[0] == "group"], "same string, w1 int")
    rest = spark.createDataFrame([(i[1], where[k]) for k, i in enumerate(items) if i[0] == "bundle"], "bundle int, w2 int")
    split = spark.createDataFrame([(s, n, next(r["n"] for r in heavy if r["same"] == s)) for s, n in runs.items()], "same string, runs bigint, group_rows bigint")
    begins = spark.createDataFrame([(s, i, w, at) for s, i, w, at in starts], "same string, run bigint, w3 int, run_start bigint")
    offsets = F.array(*[F.lit(n).cast("bigint") for n in filled])

    placed = rows.join(F.broadcast(alone), "same", "left").join(F.broadcast(split), "same", "left").join(F.broadcast(rest), "bundle", "left")
    placed = placed.withColumn("shard", F.when(F.col("runs").isNull(), F.coalesce("w1", "w2")))
    placed = placed.withColumns({"bucket": F.coalesce(F.col("shard").cast("string"), "same"), "range": F.shiftrightunsigned("h", 52).cast("int")})
    placed = running_totals(placed.select("doc_id", "size", "tokens", "text_crc32", "same", "h", "slice", "runs", "group_rows", "shard", "bucket", "range"), ["bucket"], "range", ["h"], F.lit(1).cast("bigint"))
    # the run of a row of a split group is the last one that begins at or before its number
    run = F.expr("((ahead + 1) * runs - 1) div group_rows")  # null for the other rows
    placed = placed.withColumn("run", run).join(F.broadcast(begins), ["same", "run"], "left")
    slot = F.when(F.col("runs").isNull(), F.col("ahead") + F.get(offsets, F.col("shard"))).otherwise(F.expr("ahead - run * group_rows div runs + run_start"))
    return placed.select("doc_id", "size", "tokens", "text_crc32", F.coalesce("shard", "w3").alias("shard"), slot.cast("bigint").alias("slot"))
