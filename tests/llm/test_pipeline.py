from __future__ import annotations

import hashlib

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from lodestar.llm import simhash
from lodestar.llm.common import materialize
from tests.llm.conftest import SF


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, SF), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        kept[name] = docs.toPandas()
        assert docs.select("doc_id").distinct().join(before, "doc_id", "left_anti").isEmpty()
    assert (kept["quality_rules"].text.map(lambda t: len(t.split())) >= 50).all()
    assert simhash.near_duplicates(spark.createDataFrame(kept["near_dedup"])).groupBy("component_id").count().filter("count > 1").isEmpty()
    assert len(kept["substring_dedup"]) == len(kept["near_dedup"]) and (kept["substring_dedup"].n_chars == kept["substring_dedup"].text.str.len()).all()
    assert kept["mixing"].doc_id.value_counts().max() == 2
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest(), len(t.encode(r.text, add_special_tokens=False).ids)) for r in kept["mixing"].itertuples())
    assert sorted(zip(last.doc_id, last.decoded_sha256, last.n_tokens, strict=True)) == want
    ran = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(map(tuple, ran.values.tolist())) == sorted(map(tuple, last.values.tolist()))


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
    assert entry.oracle_sql().keys() <= names.keys()
