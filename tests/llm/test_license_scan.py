"""License scans: base phrases against a plain search, near notices, odd rows, no Python in the plan."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestar.llm import license_scan as scan
from lodestar.llm import queries

SF = "/root/testdata/sf0.001"
MIT = scan.TEMPLATES[0][2]


def words(text):
    return re.findall(scan.WORD, (text or "").translate(scan._LOWER))


def base(text):
    w = words(text)
    return [(i, label) for phrase, label in scan.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]


def check(got, text):
    at = base(text)
    starts = [i for i, _ in at]
    assert (got.n_words, got.n_base, got.first_word, got.last_word) == (len(words(text)), len(at), min(starts, default=None), max(starts, default=None))
    assert got.base_labels == ",".join(sorted({x for _, x in at}))
    assert set(got.base_labels.split(",")) - {""} <= set(got.labels.split(",")) and 0 <= got.score <= 1


def test_whole_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    df = queries.op11_license_scan(spark, SF)
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())
    got = df.collect()
    assert len(got) == len(docs)
    for r in got:
        check(r, docs[r.doc_id])
        assert ("gpl-3" in r.labels) == ("GNU General Public License, version 3" in (docs[r.doc_id] or ""))
    assert any(r.labels for r in got)


def test_odd_rows(spark, odd_documents, no_documents):
    rnd = random.Random(3)
    pool = "under the mit license apache version 2 cc by nc under the mit É".split()
    more = [(i, " ".join(rnd.choice(pool) for _ in range(60)), "en", "a", 1, 1.0, "x") for i in range(100, 140)]
    more += [(200, "cc by nc " * 5000, "en", "a", 1, 1.0, "x"), (201, "UNDER-the.MIT\nLicense", "en", "a", 1, 1.0, "x"), (202, "under the mit licenseé", "en", "a", 1, 1.0, "x"), (203, "worK under the mité license", "en", "a", 1, 1.0, "x")]
    docs = odd_documents.unionByName(spark.createDataFrame(more + more[:2], odd_documents.schema)).withColumn("salt", F.lit(1)).withColumn("gram", F.lit("g"))
    got = scan.scan_licenses(docs)
    assert {"salt", "gram", "text", "host"} <= set(got.columns)
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        check(r, r.text)
    assert next(r for r in rows if r.doc_id == 200).n_base == 5000
    assert scan.scan_licenses(no_documents).count() == 0


def near(words_, put_in=(), left_out=(), changed=()):
    out = [f"x{i}" if i in changed else w for i, w in enumerate(words_) if i not in left_out]
    for i in put_in:
        out.insert(i, f"new{i}")
    return " ".join(out)


@pytest.mark.parametrize("phrases", [scan.PHRASES, []])
def test_near_notices(spark, phrases):
    w = MIT.split()
    gpl2, gpl3 = scan.TEMPLATES[7][2], scan.TEMPLATES[5][2]
    cases = {
        "exact": (MIT, "mit"),
        "word put in": ("a b c " + near(w, put_in=(20, 41)) + " d e f", "mit"),
        "words left out": (near(w, left_out=(22, 50)), "mit"),
        "words changed": (near(w, changed=(22, 50)), "mit"),
        "half": (" ".join(w[:33]), ""),
        "telling phrase broken": (near(w, changed=(3,)), ""),
        "gpl 2": (gpl2, "gpl-2"),
        "gpl 3": (gpl3, "gpl-3"),
        "two": (f"{gpl3} and then some more words {MIT}", "gpl-3,mit"),
        "cc by": ("This work is licensed under a Creative Commons Attribution 4.0 International License", ""),
        "cc by nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
        "clean": ("a software that is free of charge and the license of which anyone may obtain a copy " * 20, ""),
    }
    docs = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "name string, text string")
    got = {r.name: r for r in scan.scan_licenses(docs, phrases=phrases).collect()}
    assert {k: r.labels for k, r in got.items()} == {k: want for k, (_, want) in cases.items()}
    assert [(s.label, s.first_word, s.last_word) for s in got["two"].spans] == [("gpl-3", 0, len(words(gpl3)) - 1), ("mit", len(words(gpl3)) + 5, len(words(gpl3)) + 4 + len(words(MIT)))]
    assert got["exact"].score == 1 and 0.8 <= got["words changed"].score < 1


def test_templates_are_joined_when_many(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = sorted(map(str, scan.scan_licenses(docs).select("doc_id", "labels", "score", "n_base").collect()))
    monkeypatch.setattr(scan, "MOST_GRAMS", 0)
    assert sorted(map(str, scan.scan_licenses(docs).select("doc_id", "labels", "score", "n_base").collect())) == want


def test_bad_templates(spark):
    with pytest.raises(ValueError):
        scan.template_grams(spark, [("two words", "x")], [])
    with pytest.raises(ValueError):
        scan.template_grams(spark, [], [("x", "not in the text", "some other text here")])
