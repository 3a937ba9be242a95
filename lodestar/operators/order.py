"""Places and running sums over a whole table, by range sorting instead of one global window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.graph import settled

#: Ranges that an order statistic is narrowed down by in one pass, and the rows that are then simply sorted.
RANGES, FEW_ROWS = 1_000, 50_000


def running_sum(rows: DataFrame, order: Sequence[Column], measure: Column, to: str) -> DataFrame:
    """Add ``to``: the sum of ``measure`` over the rows up to and with each, by ``order`` (which leaves no ties).

    Rows are range-sorted and written; each sorted part is summed on its own, and the sums of the parts before it
    are added: as many numbers as there are parts.
    """
    placed = rows.withColumn("__m", measure).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settled(placed.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    parts = placed.groupBy("__part").agg(F.sum("__m").alias("__s"))
    before = F.coalesce(F.sum("__s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("__part", before.alias("__before"))
    within = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.join(F.broadcast(parts), "__part").select(*rows.columns, (F.col("__before") + F.sum("__m").over(within)).alias(to))


def place_in(rows: DataFrame, order: Sequence[Column], to: str) -> DataFrame:
    """Add ``to``: the place of each row by ``order`` (which leaves no ties), from 1."""
    return running_sum(rows, order, F.lit(1).cast("bigint"), to)


def value_at(rows: DataFrame, column: str, place: int) -> object:
    """The value at ``place`` (from 1) of the ordered, non-null values of ``column``; None if there are fewer.

    Each pass counts the rows of a thousand ranges between approximate quantiles and goes on with the one that holds
    the place, until it has few rows or a single value.
    """
    left = rows.select(F.col(column).alias("v")).filter("v IS NOT NULL")
    while True:
        n, least, most = left.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
        if place < 1 or place > n:
            return None
        if least == most:
            return least
        if n <= FEW_ROWS:
            return left.orderBy("v").limit(place).agg(F.max("v")).first()[0]
        cuts = sorted(set(left.select(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 10 * RANGES)).first()[0]) - {most})
        if not cuts:
            cuts = [least]
        # range i holds the values above cut i - 1 up to cut i
        number = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("v")))
        counts = dict(left.groupBy(number.alias("i")).agg(F.count(F.lit(1)).alias("n")).collect())
        i = 0
        while place > counts.get(i, 0):
            place -= counts.get(i, 0)
            i += 1
        left = left.filter((F.col("v") > F.lit(cuts[i - 1]) if i else F.lit(True)) & (F.col("v") <= F.lit(cuts[i]) if i < len(cuts) else F.lit(True)))
