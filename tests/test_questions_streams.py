"""Question trees against a recursion, the anomaly stream against the batch operator, sitemaps against files made by hand."""

from __future__ import annotations

import gzip
import random
import re

import pytest

from lodestar.operators import questions, search
from lodestar.sources import sitemaps


def key(q):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", q.lower().strip()))


def forest(seeds, edges, most):
    asked = {}
    for of, place, q in sorted(edges):
        asked.setdefault(key(of), []).append((place, q))
    seen, out = set(), []

    def expand(path, said, depth):
        for place, q in asked.get(key(said), []):
            here = [*path, place]
            dup = key(q) in seen
            seen.add(key(q))
            out.append((".".join(map(str, here)), depth, said, q, dup))
            if not dup and depth < most:
                expand(here, q, depth + 1)

    for place, q in sorted(seeds):
        expand([place], q, 1)
    return sorted(out)


@pytest.mark.parametrize("seed,n,most", [(1, 12, 4), (2, 40, 3), (3, 6, 6), (4, 60, 5)])
def test_question_forest(spark, seed, n, most):
    rnd = random.Random(seed)
    spelt = lambda i: rnd.choice([f"What is {i}?", f" what  is {i}", f"WHAT IS {i}!!"])
    edges = [(f"what is {i}", k, spelt(rnd.randrange(n))) for i in range(n) for k in rnd.sample(range(9), rnd.randrange(4))]
    seeds = [(i, spelt(rnd.randrange(n))) for i in range(3)]
    s, e = spark.createDataFrame(seeds, "place int, question string"), spark.createDataFrame([*edges, (None, 1, "x"), ("what is 1", 77, None)], "parent string, place int, question string")
    want = forest(seeds, edges, most)
    assert sorted(map(tuple, questions.question_forest(s, e, most).collect())) == want
    if seed == 1:
        assert sorted(map(tuple, questions.question_forest(s, e, most, keep_duplicates=False).collect())) == [r for r in want if not r[4]]
        assert questions.question_forest(s, e.limit(0), most).count() == 0


def test_anomaly_stream_equals_batch_on_shuffled_months(spark, tmp_path):
    from lodestar.streaming import trends

    rnd = random.Random(6)
    rows = [(f"/p{p}", f"20{20 + m // 12}-{m % 12 + 1:02d}", rnd.choice([100, 110, 90, 5 if m % 7 == 6 else 105])) for p in range(12) for m in range(rnd.randrange(2, 24))]
    schema = "page string, month string, clicks bigint"
    rnd.shuffle(rows)
    for i in range(4):
        spark.createDataFrame(rows[i::4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = trends.anomalies(stream).writeStream.outputMode("update").format("memory").queryName("anomalies").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        got = spark.sql("SELECT page, month, clicks, round(delta, 1), round(rolling_avg_before, 1), round(drop_percentage, 1) FROM (SELECT *, max(version) OVER (PARTITION BY page) AS last FROM anomalies) WHERE version = last AND month IS NOT NULL").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = search.detect_anomalies(monthly=spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 5


def test_sitemaps(spark, tmp_path):
    folder = tmp_path / "site"
    (folder / "deep").mkdir(parents=True)
    urlset = lambda *locs: '<?xml version="1.0"?>\n<!-- c --><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' + "".join(f"<url><loc> {x} </loc><lastmod>2024-01-0{i + 1}</lastmod></url>" for i, x in enumerate(locs)) + "</urlset>"
    (folder / "a.xml").write_text(urlset("https://x.test/1", "https://x.test/2&amp;a"))
    (folder / "deep" / "b.xml.gz").write_bytes(gzip.compress(urlset("https://x.test/3").encode()))
    (folder / "alone.xml").write_text(urlset("https://x.test/4", ""))
    (folder / "index.xml").write_text('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' + "".join(f"<sitemap><loc>https://x.test/{x}</loc></sitemap>" for x in ("a.xml", "deep/b.xml.gz", "index2.xml", "gone.xml")) + "</sitemapindex>")
    (folder / "index2.xml").write_text("<sitemapindex><sitemap><loc>https://x.test/alone.xml</loc></sitemap></sitemapindex>")
    (folder / "broken.xml").write_text("<urlset><url><loc>https://x.test/5</loc></url>")
    (folder / "page.xml").write_text("<html><url>x</url></html>")
    files = sitemaps.read_sitemaps(spark, str(folder), "https://x.test/").cache()
    kinds = {r.address.rsplit("/", 1)[1]: r.kind for r in files.collect()}
    assert kinds == {"a.xml": "sitemap", "b.xml": "sitemap", "alone.xml": "sitemap", "index.xml": "index", "index2.xml": "index", "broken.xml": "malformed", "page.xml": "malformed"}
    got = sorted((r.sitemap[15:], r.from_index and r.from_index[15:], r["loc"], r.lastmod) for r in sitemaps.sitemap_urls(files).collect())
    assert got == [("a.xml", "index.xml", "https://x.test/1", "2024-01-01"), ("a.xml", "index.xml", "https://x.test/2&a", "2024-01-02"), ("alone.xml", "index2.xml", "https://x.test/4", "2024-01-01"), ("deep/b.xml", "index.xml", "https://x.test/3", "2024-01-01")]
    assert {r.kind: (r["files"], r.entries, r.missing) for r in sitemaps.sitemap_report(files).collect()} == {"sitemap": (3, 5, 0), "index": (2, 5, 1), "malformed": (2, 0, 0)}
