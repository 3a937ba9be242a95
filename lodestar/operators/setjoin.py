"""Exact similarity joins of sets by length and prefix filters on rare tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.graph import settled


def similar_sets(sets: DataFrame, share: float, measure: str = "longer") -> DataFrame:
    """(a, b, common): pairs a < b of ``sets`` (id, tokens: distinct) that are alike enough.

    measure "longer": more than ``share`` of the larger set's tokens are common; "jaccard": at least
    ``share`` of the union's; "count": at least ``share`` tokens. Every such pair has a least number of common tokens, so with
    tokens in one order, rarest first, it has one among the first few of either set: only sets
    that meet there, with sizes near enough, are compared, and none is missed. Frequent tokens come
    last and are looked up by none but sets without rare ones. Empty sets are like none.

    Equal sets should be one row (see ``one_of_each``): groups of copies would square.
    """
    if measure not in ("longer", "jaccard", "count") or share <= 0 or (measure != "count" and share > 1):
        raise ValueError("measure is longer, jaccard or count, share above 0 and, but for counts, at most 1")
    sets = sets.select("id", "tokens").filter(F.size("tokens") > 0)
    tokens = sets.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1")  # a token of one set meets none
    ranked = tokens.join(counts, "token", "left").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("uses", F.lit(1)).alias("uses"), "token"))).alias("ordered"))
    ranked = settled(ranked.select("id", "n", F.transform("ordered", lambda x: x["token"]).alias("ordered"), F.transform("ordered", lambda x: x["uses"]).alias("uses")))
    eps = 1e-9
    if measure == "longer":  # common > share * larger >= share * n
        least: Column = F.floor(F.col("n") * share + eps) + 1
    elif measure == "count":
        least = F.lit(int(share))
    else:  # common >= share * union >= share * n
        least = F.ceil(F.col("n") * share - eps)
    first = (F.col("n") - least + 1).cast("int")
    heads = ranked.select("id", "n", F.explode(F.arrays_zip(F.slice("ordered", F.lit(1), F.greatest(first, F.lit(0))).alias("t"), F.slice("uses", F.lit(1), F.greatest(first, F.lit(0))).alias("u"))).alias("h"))
    heads = heads.filter("h.u > 1").select("id", "n", F.col("h.t").alias("token"))
    left, right = heads.toDF("a", "na", "token"), heads.toDF("b", "nb", "token")
    near = F.lit(True) if measure == "count" else F.least("na", "nb") > share * F.greatest("na", "nb") - (eps if measure == "jaccard" else 0)
    met = settled(left.join(right, "token").filter("a < b").filter(near).select("a", "b").distinct())
    whole = ranked.select("id", "ordered")
    both = met.join(whole.toDF("a", "ta"), "a").join(whole.toDF("b", "tb"), "b").withColumn("common", F.size(F.array_intersect("ta", "tb")))
    if measure == "longer":
        alike = F.col("common") > share * F.greatest(F.size("ta"), F.size("tb")) + eps
    elif measure == "count":
        alike = F.col("common") >= share
    else:
        alike = F.col("common") >= share * (F.size("ta") + F.size("tb") - F.col("common")) - eps
    return both.filter(alike).select("a", "b", "common")


def one_of_each(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``sets`` (id, tokens) with the smallest id of each distinct set, and (id, as_id) of all of them."""
    keyed = sets.select("id", F.array_sort("tokens").alias("tokens"))
    keyed = keyed.withColumn("key", F.md5(F.to_json(F.struct("tokens"))))
    firsts = keyed.groupBy("key").agg(F.min(F.struct("id", "tokens")).alias("f")).select("key", F.col("f.id").alias("as_id"), F.col("f.tokens").alias("tokens"))
    return firsts.select(F.col("as_id").alias("id"), "tokens"), keyed.select("id", "key").join(firsts.select("key", "as_id"), "key").select("id", "as_id")
