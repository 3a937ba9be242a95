"""Pairs of one template leave the join of bands only if the threshold is within reach, and hashes are those of SQL."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestar.operators import matching


def test_pairs_of_a_template_stay_behind(spark, monkeypatch):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    template = [word() for _ in range(60)]
    rows = [(i, " ".join(template + [word() for _ in range(20)])) for i in range(60)]
    rows += [(100 + i, t + " more") for i, t in rows[:5]] + [(200, "four words of it"), (201, None)]
    tables = []
    kept = matching.settled
    monkeypatch.setattr(matching, "settled", lambda df: tables.append(kept(df)) or tables[-1])
    got = {(x["id_a"], x["id_b"]) for x in matching.minhash_duplicates(spark.createDataFrame(rows, "id bigint, text string"), 0.8).collect()}
    assert got == {(i, 100 + i) for i in range(5)}
    # 65 texts have 2,080 pairs, all but five 0.55 alike
    assert tables[0].count() == 65 and 5 <= tables[1].count() < 100


def test_hashes_are_those_of_sql(spark):
    texts = ["One two, two three\tfour_5 six seven seven seven seven seven seven", "é naïve İstanbul 1 2 3 4 5 ÅÄÖ x y z", "too short", "a b c d e"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", F.lower("text").alias("text"))
    words = F.filter(F.split("text", r"\W+"), lambda w: w != "")
    sets = df.withColumn("w", words).filter("size(w) >= 5").select("id", F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 5), " ")))).alias("s"))
    want = {x["id"]: (set(x["s"]), x["least"]) for x in sets.withColumn("least", F.array(*[F.array_min(F.transform("s", lambda x: F.xxhash64(x, F.lit(t)))) for t in range(4)])).collect()}
    got = {x["id"]: (set(x["s"]), x["least"]) for x in matching._sketches(df, 5, 4).collect()}
    assert got == want and len(got) == 3
