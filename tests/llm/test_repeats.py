"""Repeated rows, null ids and unlike sources: mixing and sharding against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestar.llm import mixing, sharding
from lodestar.llm.queries import ORACLE_SQL

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def slow_mix(rows):
    """Weighted fair queueing over a list of rows; how often each (id, text, lang, source) is taken."""
    size = lambda r: len((r[1] or "").split())
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    whole = Counter()
    for r in rows:
        whole[r[3]] += size(r)
    budget, queue = sum(whole.values()) * 3 / 2, []
    for s in names:
        mine = [r for r in rows if r[3] == s]
        # rows with one id and text stand in any order here: the test has only equal ones of these
        mine.sort(key=lambda r: (int(hashlib.md5((mixing.SEED + ("" if r[0] is None else str(r[0])) + " " + (r[1] or "")).encode()).hexdigest()[:15], 16), r[0] is not None, r[0] or 0, size(r)))
        upto = 0
        for n, r in enumerate(mine):
            upto += size(r)
            queue += [((upto + whole[s] * c) / weight[s], names.index(s), n, c, r) for c in range(2)]
    queue.sort(key=lambda q: q[:4])
    taken, words = Counter(), 0
    for *_, r in queue:
        words += size(r)
        if words > budget:
            break
        taken[r[:4]] += 1
    return taken


def shared_rows():
    rows = [(1, "one two three", "en", s, 13) for s in ("a", "a", "a", "b", "c", "c")]
    rows += [(i, " ".join(["w"] * (1 + i % 7)) + f" x{i}", "de", "abc"[i % 3], 5) for i in range(2, 40)]
    rows += [(None, "no id here", "en", "b", 10)] * 9 + [(None, f"none {i}", "en", "b", 6) for i in range(8)] + [(50, "null source", None, None, 4)] * 3
    return rows


@pytest.mark.parametrize("few", [mixing.MOST_SOURCES, 0])
def test_one_text_in_several_sources(spark, few):
    rows = shared_rows()
    want = slow_mix(rows)
    for parts in (1, 5) if few else (3,):
        docs = spark.createDataFrame(rows, SCHEMA).repartition(parts, F.rand(parts))
        got = mixing.mixed_documents(docs, few_sources=few)
        assert got.columns == docs.columns
        assert Counter(tuple(r)[:4] for r in got.collect() if len((r["text"] or "").split())) == want
        each = Counter()
        for r in mixing.mix(docs, few_sources=few).collect():
            each[r["doc_id"]] += r["copies"]
        by_id = Counter()
        for key, n in want.items():
            by_id[key[0]] += n
        assert +each == by_id


def test_unlike_rows_of_one_text_agree_over_partitionings(spark):
    rows = [(1, "one two three", lang, "a", n) for n, lang in enumerate(("en", "de", "fr", None, "en"))] + shared_rows()
    out = []
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, SCHEMA).repartition(parts, F.rand(parts))
        out.append(sorted(map(str, mixing.mixed_documents(docs).collect())))
    assert out[0] == out[1]


def test_two_speeds(spark, tmp_path):
    """One large source and many small ones: the sources' words and SQL agree, and no range of the queue holds most of it."""
    rows = [(i, "w " * 50, "en", "big", 100) for i in range(3000)] + [(10_000 + i, f"w {i}", "en", f"s{i:04d}", 3) for i in range(1500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    ranges = []
    real = mixing.materialize
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would be joined
    try:
        mixing.materialize = lambda df, name: ranges.append(real(df, name)) or ranges[-1] if name == "mix-queue" else real(df, name)
        got = sorted(tuple(r) for r in mixing.mix(docs, few_sources=0).select("doc_id", "size", "taken").collect())
    finally:
        mixing.materialize = real
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = [r["count"] for r in ranges[0].groupBy("range").count().collect()]
    assert max(held) < 0.6 * sum(held) and len(held) > 2
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(f"SELECT doc_id, size, taken FROM ({ORACLE_SQL['op2_mixing']})").fetchall())


@pytest.mark.parametrize("rows", [[(7, "hot text " * 30)] * 400, [(None, "hot text " * 30)] * 401, [(i, None) for i in range(300)] + [(3, "")] * 90])
def test_rows_of_one_hot_text_are_spread(spark, rows):
    docs = spark.createDataFrame(rows + [(i, f"other {i}") for i in range(1000, 1048)], "doc_id bigint, text string")
    out = []
    for parts in (1, 5):
        got = sharding.pack_shards(docs.repartition(parts, F.rand(parts)), 16).toPandas()
        assert len(got) == docs.count()
        for _, g in got.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))
        loads = got.groupby("shard")["size"].sum()
        assert len(loads) == 16 and loads.max() - loads.min() <= 2 * got["size"].max()
        out.append(sorted(map(str, got.values.tolist())))
    assert out[0] == out[1]


def test_equal_rows_differ_by_a_row(spark):
    got = sharding.pack_shards(spark.createDataFrame([(1, "a b c")] * 400, "doc_id bigint, text string"), 16).groupBy("shard").count().collect()
    assert [r["count"] for r in got] == [25] * 16
