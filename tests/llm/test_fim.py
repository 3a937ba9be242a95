"""Fill-in-the-middle: against slices of Python strings, and back."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import fim, queries

SF = "/root/testdata/sf0.001"


def expected(doc_id, text):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    if not text or any(m in text for m in fim.SENTINELS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200), st.integers(0, 200), st.sampled_from(["char", "word", "line"]))
def test_offsets(text, at, unit):
    text = text.encode("utf-8", "ignore").decode()
    data = text.encode()
    mask = fim.starts(data, unit)
    begins = {
        "char": list(range(len(text))),
        "word": [i for i, c in enumerate(text) if c not in " \t\n\v\f\r" and (i == 0 or text[i - 1] in " \t\n\v\f\r")],
        "line": [i for i in range(len(text)) if i == 0 or text[i - 1] == "\n"],
    }[unit]
    assert mask.bit_count() == len(begins)
    if begins:
        k = at % (len(begins) + 1)
        want = 0 if k == 0 else len(data) if k == len(begins) else len(text[: begins[k]].encode())
        assert fim.offset(mask, k, len(begins), len(data)) == want


def test_whole_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op12_fill_in_middle(spark, SF).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == len(docs)
    for r in got:
        n, form, a, m, out = expected(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, a, m, sha(out), sha(docs[r.doc_id] or ""))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_odd_rows(spark, odd_documents, no_documents):
    more = [(i, t, "en", "a", 1, 1.0, "x") for i, t in enumerate(["a<P>b", "<", "<<<S", "x<M", "�\U0001f600é", "<S", "\n\n", "a" * 300_000], 100)]
    docs = odd_documents.unionByName(spark.createDataFrame(more, odd_documents.schema)).withColumn("form", F.lit("old")).withColumn("data_read", F.lit(3))
    got = fim.fill_in_middle(docs)
    assert got.columns == ["doc_id", "lang", "source", "n_words", "score", "host", "data_read", "n", "form", "prefix_units", "middle_units", "output"]
    back = got.select("doc_id", "n", "form", "prefix_units", "middle_units", "output", fim.restore(F.col("output"), F.col("form")).alias("back")).collect()
    want = sorted((str(r.doc_id), *map(str, expected(r.doc_id, r.text)), r.text or "") for r in docs.collect())
    assert sorted((str(r.doc_id), str(r.n), r.form, str(r.prefix_units), str(r.middle_units), r.output, r.back) for r in back) == want
    assert fim.fill_in_middle(no_documents).count() == 0


@pytest.mark.parametrize("unit", ["word", "line"])
def test_other_units_and_marks(spark, unit):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    got = fim.fill_in_middle(docs, unit=unit, sentinels=marks, plain=0, spm=50, seed=7)
    assert got.filter("form = 'spm'").count() > 20 < got.filter("form = 'psm'").count()
    back = got.select("doc_id", fim.restore(F.col("output"), F.col("form"), marks).alias("back"))
    assert docs.join(back, "doc_id").filter("not (coalesce(text, '') <=> back)").count() == 0


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("aba", "x", "y"), ("ab", "bc", "d"), ("a", "ab", "c"), ("", "x", "y")])
def test_sentinels_that_could_be_misread(marks):
    with pytest.raises(ValueError):
        fim.check_sentinels(marks)
