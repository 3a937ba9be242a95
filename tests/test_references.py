"""Character references as the oracles of H1 and S28 read them."""

from __future__ import annotations

from collections import Counter

import duckdb
from lodestar.operators.html import parse_page
from lodestar.plans import registry

PAGE = '<html lang="en"><head><title>{t}</title><script type="application/ld+json">{{"a": "x&y"}}</script></head><body><h1>{t}</h1><article><p>{t}</p></article></body></html>'
TEXTS = ["a &lt; b &amp; c &gt; d", "cut at &amp", "token = &quot;77", "&quot;x&quot; &#x27;y&#x27;", "&ampx &lt &copy; R&D &amp;lt;", "plain"]


def check(spark, tmp_path, name):
    rows = [(i, f"http://x.test/{i}", PAGE.format(t=t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = registry.queries()[name](spark, str(tmp_path)).select(*columns).collect()
    assert Counter(map(tuple, got)) == Counter(found.fetchall())


def test_titles_match_their_sql(spark, tmp_path):
    check(spark, tmp_path, "h1_parse_html")


def test_main_texts_match_their_sql(spark, tmp_path):
    check(spark, tmp_path, "s28_main_text")


def test_scripts_keep_their_text():
    page = parse_page(PAGE.format(t="a &quot; b"), references=("lt", "gt", "amp"))
    assert page["jsonld"] == ['{"a": "x&y"}'] and page["title"] == "a &quot; b"


def test_pages_are_parsed_a_few_at_a_time(spark, monkeypatch):
    from lodestar.operators import html

    monkeypatch.setattr(html, "PARSED_PAGES", 3)
    pages = spark.range(20).coalesce(1).selectExpr("id AS page_id", "CAST(NULL AS STRING) AS url", "concat('<title>', id, '</title><p>a b</p>') AS html", "id AS title_id")
    got = html.parse_pages(pages).select("page_id", "url", "title_id", "title", "word_count").collect()
    assert sorted(map(tuple, got)) == [(i, None, i, str(i), 3) for i in range(20)]
