"""Extra columns of any name, for every operator and stage."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestar.llm import bpe, classifier, common, fim, license_scan, mixing, multi_index, quality_rules, sharding, simhash, substring_dedup, unigram, url_filter

NAMES = ["doc", "__doc", "copies", "m", "__n", "__key", "__cutoffs", "__text", "a.b", "Host", "Stratum", "size", "h", "fp", "slice", "mix_key", "text_read", "of_doc", "c`d", "row", "v", "near_key", "quality_key", "spans"]


@pytest.fixture(scope="module")
def clashing(spark, odd_documents):
    docs = odd_documents.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))
    return docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)], F.create_map(F.lit("k"), F.lit(1)).alias("a map"), F.lit("2024-01-01 10:00:00").cast("timestamp").alias("when"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1), (4, 0), (3, 1), (None, 1), (8, None)], "doc_id bigint, quality int")


def rows(df):
    return sorted(map(str, df.collect()))


OPERATORS = {
    "op1": lambda d, labels: quality_rules.apply_quality_rules(d, labels),
    "op1_kept": lambda d, labels: quality_rules.keep_good(d, labels),
    "op2_documents": lambda d, labels: mixing.mixed_documents(d),
    "op3": lambda d, labels: bpe.bpe_encode(d, public_tokenizers.path("byte_bpe_50k.json"), decoded="decoded"),
    "op4": lambda d, labels: substring_dedup.dedup_substrings(d),
    "op6": lambda d, labels: classifier.score_quality(d, labels),
    "op7": lambda d, labels: url_filter.filter_urls(d, [("block", "com/x")], "text"),
    "op7_joined": lambda d, labels: url_filter.filter_urls(d, [("block", "com/x")], "text", most_bytes=0),
    "op8_documents": lambda d, labels: simhash.drop_near_duplicates(d),
    "op9": lambda d, labels: unigram.count_tokens(d, unigram.rank_scores([f"<0x{b:02X}>" for b in range(256)])),
    "op10": lambda d, labels: sharding.pack_shards(d, 3),
    "op11": lambda d, labels: license_scan.scan_licenses(d),
    "op12": lambda d, labels: fim.fill_in_middle(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_change_nothing(spark, clashing, labels, name):
    plain = clashing.select("doc_id", "text", "lang", "source", "n_chars")
    got, want = OPERATORS[name](clashing, labels), OPERATORS[name](plain, labels)
    assert set(want.columns) <= set(got.columns)
    if name != "op2_documents":  # the place of rows with one id and text goes by the whole row
        assert rows(got.select(want.columns)) == rows(want)
    got = got.cache()
    for c in ("a map", "when", "a.b", "c`d"):
        if c in got.columns:
            assert len({str(r[0]) for r in got.select(common.col(c)).collect()}) == 1


def test_vectors_with_extra_columns(spark):
    df = spark.range(30).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"), *[F.lit(1).alias(n) for n in NAMES])
    assert rows(multi_index.search(df, F.col("vec_id") % 20 == 0)) == rows(multi_index.search(df.select("vec_id", "embedding"), F.col("vec_id") % 20 == 0))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, clashing, name, stage, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns, empty tables."""
    labels = spark.createDataFrame([(4, 1), (5, 0)], "doc_id bigint, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = stage(spark, clashing, str(tmp_path))
    n = len(got.collect())
    assert n == {"quality_rules": 1, "near_dedup": 5, "substring_dedup": 9, "bpe": 9}.get(name, n)
    assert stage(spark, clashing.limit(0), str(tmp_path)).count() == 0
    if name != "bpe":
        assert got.columns == corpus_pipeline.COLUMNS


def test_keys_that_two_rows_share_are_parted(spark, monkeypatch):
    """With keys of eight bits every document still gets its own, and equal ones share it."""
    real = common.same_rows
    small = lambda df, *c: F.struct((real(df, *c)["x"] % 300).alias("x"), real(df, *c)["y"].alias("y"))
    monkeypatch.setattr(common, "same_rows", small)
    docs = spark.createDataFrame([(i % 12, f"t{i % 18}") for i in range(80)], "id bigint, text string")
    keyed = docs.select("id", "text", common.unique_keys(docs, "id", "text").alias("k")).toPandas()
    assert keyed.k.nunique() == len(keyed[["id", "text"]].drop_duplicates()) == keyed.drop_duplicates().shape[0]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(Session())
