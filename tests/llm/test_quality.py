from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lodestar.llm import classifier, quality_rules as q
from lodestar.llm.queries import ORACLE_SQL
from tests.llm.conftest import SF


def counts_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered), len(re.findall("[A-Z]", text))


@pytest.mark.parametrize("text", ["", "a", "a b c a b c a b", "x\nx\n\n x\nx", "a a a a a", "# | < é É", "\x0b\x1c a\x85b"])
def test_counts(text):
    assert q.text_counts(text) == counts_by_hand(text)


def test_counts_of_documents(documents):
    for text in documents.text:
        assert q.text_counts(text or "") == counts_by_hand(text or "")


def test_binomial_tail():
    for k, n, p in ((0, 10, 0.1), (3, 50, 0.02), (7, 7, 0.5)):
        assert q.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def made(spark):
    """2,000 good documents and 500 shouting ones in one language; ten labels in another."""
    plain = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{plain} t{i}", "en", 1) for i in range(2000)] + [(5000 + i, f"{plain.upper()} T{i}", "en", 0) for i in range(500)] + [(9000 + i, f"{plain.upper()} u{i}", "xx", i % 2) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, quality int")
    return df.select("doc_id", "text", "lang"), df.select("doc_id", "quality")


def test_certified_rules_reject_and_uncertified_do_not(spark, tmp_path):
    docs, labels = made(spark)
    found = {r["doc_id"]: r for r in q.apply_quality_rules(docs, labels).collect()}
    assert all(found[i]["kept"] for i in range(2000))
    assert not any(found[5000 + i]["kept"] for i in range(500)) and found[5000]["failed_rule"] == "capitals_per_char"
    assert all(found[9000 + i]["kept"] for i in range(10))  # too few labels to certify a cutoff
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = {r[0]: r for r in con.sql(f"SELECT doc_id, kept, failed_rule FROM ({ORACLE_SQL['op1_quality_rules']})").fetchall()}
    assert all((r["kept"], r["failed_rule"]) == want[i][1:] for i, r in found.items())


def test_false_rejection_stays_below_the_risk(spark):
    """Cutoffs certified on noisy good documents reject no more of fresh ones than the risk (with room for chance)."""
    r = np.random.default_rng(5)
    def text(i):
        n = 120
        caps = r.beta(1, 30)
        return " ".join(("WORD" if r.random() < caps else "word") + str(k) for k in range(n)) + f" {i}"
    docs = spark.createDataFrame([(i, text(i), "en") for i in range(4000)], "doc_id bigint, text string, lang string")
    labels = docs.filter("doc_id < 2000").selectExpr("doc_id", "1 AS quality")
    fresh = q.apply_quality_rules(docs, labels).filter("doc_id >= 2000").selectExpr("avg(CASE WHEN kept THEN 0 ELSE 1 END) AS rejected").first()["rejected"]
    assert fresh <= q.RISK + 0.01  # all rules together


def test_a_rule_is_certified_on_the_small_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = q.apply_quality_rules(docs, labels).join(labels, "doc_id", "left")
    assert judged.filter("failed_rule IS NOT NULL AND NOT base_failed").count() > 0
    good = judged.filter("quality = 1 AND NOT base_failed").selectExpr("avg(CASE WHEN kept THEN 0 ELSE 1 END) AS r").first()["r"]
    assert good <= q.RISK


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None)], "doc_id bigint, quality int")
    rows = q.apply_quality_rules(odd_documents, labels).collect()
    assert len(rows) == odd_documents.count() and not any(r["kept"] for r in rows if r["n_words"] < 50)
    assert {r["doc_id"]: r["kept"] for r in rows}[4] is True
    assert q.apply_quality_rules(no_documents, labels).count() == 0
    assert q.apply_quality_rules(odd_documents, labels.limit(0)).count() == len(rows)
    assert q.keep_good(odd_documents, labels).select("doc_id").collect()[0][0] == 4


def test_isotonic_by_hand():
    at, share = classifier.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 3, 1, 4]), np.array([4.0, 4, 4, 4]))
    assert share.tolist() == [0, 0, 0.5, 0.5, 1, 1] and at.tolist() == [0, 0, 1, 2, 3, 3]


def test_fourier_features_approximate_the_kernel():
    phi = classifier.FourierMap([0.0] * 3, [1.0] * 3, features=20_000, bandwidth=2.0)
    x = np.random.default_rng(1).normal(size=(6, 3))
    z = phi(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 2.0**2))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = classifier.score_quality(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (scored.predicted == scored.quality).mean() > 0.95 and scored.score.between(0, 1).all()


def test_labels_of_held_out_rows_are_not_seen(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("held", classifier.remainder(labels["doc_id"]) == 1).selectExpr("doc_id", "CASE WHEN held THEN 1 - quality ELSE quality END AS quality")
    a, b = (sorted(map(tuple, classifier.score_quality(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_classifier_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(5, 1), (4, 0), (3, 1), (2, 0), (8, 1), (7, 5)], "doc_id bigint, quality int")
    rows = classifier.score_quality(odd_documents, labels).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert {r["score"] for r in classifier.score_quality(odd_documents, labels.limit(0)).collect()} == {0.5}
    assert classifier.score_quality(no_documents, labels).count() == 0


def test_normal_equations_and_scores_against_numpy(spark):
    """Sums in levels are those of one matrix product, and the ridge weights those of a direct solve."""
    r = np.random.default_rng(3)
    x, y = r.normal(size=(700, 3)), r.integers(0, 2, 700)
    phi = classifier.FourierMap([0.0] * 3, [1.0] * 3, features=16)
    train = spark.createDataFrame([(v, int(t)) for v, t in zip(x.tolist(), y, strict=True)], "x array<double>, y int").repartition(23)
    zz, zy, n = classifier.normal_equations(train, phi, fan=3)
    z = phi(x)
    assert n == 700 and np.allclose(zz, z.T @ z) and np.allclose(zy, z.T @ y)
    ridge = np.linalg.solve(zz + 0.5 * np.eye(17), zy)
    direct, *_ = np.linalg.lstsq(np.vstack([z, np.sqrt(0.5) * np.eye(17)]), np.concatenate([y, np.zeros(17)]), rcond=None)
    assert np.allclose(ridge, direct)
