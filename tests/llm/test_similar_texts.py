"""The pipeline links texts of five-word Jaccard 0.8, whose fingerprints lie far apart."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lodestar.llm import simhash


def test_near_dedup_stage_catches_similar_texts(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows, far = [], 0
    for g in range(40):
        base = [word() for _ in range(150)]
        copy = [*base]
        for at in (40, 100):
            copy[at] = word()
        other = [*base]
        for at in range(5, 150, 14):
            other[at] = word()
        for k, w in enumerate((base, copy, other)):
            rows.append((3 * g + k, " ".join(w), "en", "web", 1))
        sets = [{tuple(w[i : i + 5]) for i in range(146)} for w in (base, copy, other)]
        assert len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]) and len(sets[0] & sets[2]) < 0.5 * len(sets[0] | sets[2])
        far += (simhash.fingerprint(rows[-3][1], 5) ^ simhash.fingerprint(rows[-2][1], 5)).bit_count() > 4
    assert far > 30
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert got == {i for i in range(120) if i % 3 != 1}


def template_texts(n: int, shared: int, own: int, seed: int = 3):
    """Texts of one template and words of their own, in runs of ten."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    template = [word() for _ in range(shared)]
    rows = []
    for i in range(n):
        w = template + [word() for _ in range(own)]
        rows.append((i, " ".join(w), "en", "web", 1))
    return rows


def jaccard(a: str, b: str) -> float:
    s, t = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(s & t) / len(s | t)


@pytest.mark.parametrize("shared", [200, 345])
def test_texts_of_one_template_stay(spark, shared):
    """Similarity of about 0.49 and 0.63 among all: SimHash may bring them together, and nothing unites them."""
    rows = template_texts(1500, shared, 100)
    assert 0.4 < jaccard(rows[0][1], rows[1][1]) < 0.7
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert corpus_pipeline.near_dedup(spark, docs, "").count() == len(rows)


@pytest.mark.parametrize("exact", [False, True])
def test_recall_among_template_texts(spark, exact):
    r = random.Random(11)
    rows, pairs = template_texts(300, 200, 100), 0
    for i in range(60):
        w = rows[i][1].split()
        for at in r.sample(range(10, 290), 4 if i % 2 else 5):
            w[at] = "changed"
        rows.append((1000 + i, " ".join(w), "en", "web", 1))
    close = {1000 + i for i in range(60) if jaccard(rows[i][1], rows[300 + i][1]) >= 0.8}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = {x.doc_id for x in simhash.drop_near_duplicates(docs, shingle_words=5, similarity=0.8, exact=exact).collect()}
    assert set(range(300)) <= left and {1000 + i for i in range(60)} - close <= left
    assert len(close) >= 40 and len(left & close) <= (0 if exact else 0.1 * len(close))


def test_every_similar_text_of_a_template_goes(spark):
    """Texts of one template with close copies: none stays beside a text it is 0.8 like, whatever their groups propose."""
    r = random.Random(11)
    rows = template_texts(300, 200, 100)
    for i in range(60):
        w = rows[i][1].split()
        for at in r.sample(range(10, 290), 4 if i % 2 else 5):
            w[at] = "changed"
        rows.append((1000 + i, " ".join(w), "en", "web", 1))
    close = {1000 + i for i in range(60) if jaccard(rows[i][1], rows[300 + i][1]) >= 0.8}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert left == {x[0] for x in rows} - close
    keyed = docs.select(F.md5("text").alias("doc_key"), "text")
    sketched = simhash.sketches(keyed, 5)
    texts = sketched.select("t", "doc_key", "fp", "n", "bands")
    none = spark.createDataFrame([], "a binary, b binary")
    pairs = {frozenset((bytes(x.t).hex(), bytes(x.c).hex())) for x in simhash.pairs_across(keyed, texts, none, 5, 0.8).collect()}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    assert {frozenset((md5(rows[c - 1000][1]), md5(rows[300 + c - 1000][1]))) for c in close} <= pairs
