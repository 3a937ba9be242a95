"""Rows worked out by hand from the rules, not from the operators' own SQL."""

from __future__ import annotations

import pytest

from lodestar.operators import clusters, health, html, matching, migration
from lodestar.operators import portfolio as p
from lodestar.sources import exports

KEYS = {
    "https://h/": "https://h/",
    "https://h": "https://h/",
    "HTTP://Shop.Test/A/": "https://shop.test/A",
    "http://h:80/x": "https://h/x",
    "http://h:8080/x": "https://h:8080/x",
    "h/x?b=2&a=1&utm_source=q#top": "https://h/x?a=1&b=2",
    "//h/x//": "https://h/x",
    "https://h/a%2Fb%20c": "https://h/a/b c",
    "https://h/a+b%zz": "https://h/a+b%zz",
    "https://u:p@h/x": "https://h/x",
    "https://h/?gclid=1": "https://h/",
    "  https://h/x  ": "https://h/x",
    "": "",
}


def test_url_keys(spark):
    rows = [(u,) for u in KEYS] + [(None,)]
    got = {r["url"]: r["url_key"] for r in migration.normalize_urls(urls=spark.createDataFrame(rows, "url string")).collect()}
    assert got == KEYS | {None: ""}


def redirects(spark, rows):
    schema = "url string, status_code string, redirect_url string, row_id bigint"
    return migration.redirect_map(crawl=spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema))


def test_redirects_meet_by_key(spark):
    table = redirects(spark, [
        ("https://h/a/", "301", "http://H/b"), ("h/a", "200", ""), ("http://h/b", "200", ""), ("https://h/c", "302", "h/a/"), ("h/loop1", "301", "h/loop2"), ("h/loop2", "301", "https://h/loop1/"),
        ("h/self", "301", "https://H/self/"), ("h/gone", "404", ""), *[(f"h/{i}", "301", f"h/{i + 1}") for i in range(100, 115)],
    ])
    chains = migration.redirect_chains(map=table)
    got = {r["start"].removeprefix("https://h/"): (r["final_url"].removeprefix("https://h/"), r["hops"], r["is_loop"]) for r in chains.collect()}
    assert got["a"] == ("b", 1, False) and got["c"] == ("b", 2, False)  # the first row of a key counts
    assert got["loop1"] == ("loop1", 2, True) and got["self"] == ("self", 1, True) and "gone" not in got
    assert got["100"] == ("109", 9, False) and got["113"] == ("115", 2, False)
    spec = [("http://h/a", "h/b", "301"), ("h/a/", "h/b", ""), ("h/a", "h/b", "302"), ("h/a", "h/x", None), ("h/c", "h/a", ""), ("h/none", "h/b", ""), ("h/gone", "h/b", ""), ("h/loop1", "h/b", "")]
    found = migration.validate_redirects(spec=spark.createDataFrame(spec, "old_url string, new_url string, type string"), map=table, chains=chains)
    assert sorted((r["old_url"], r["finding"]) for r in found.collect()) == sorted([
        ("http://h/a", "match"), ("h/a/", "match"), ("h/a", "wrong_type"), ("h/a", "wrong_destination"), ("h/c", "chain"), ("h/c", "match"), ("h/none", "missing"), ("h/gone", "missing"), ("h/loop1", "loop"),
    ])


def test_long_lists_of_redirects_need_no_recursion(spark):
    """More start urls and hops than a recursive query may have rows."""
    crawl = spark.range(150_000).selectExpr("concat('https://h/', id) AS url_key", "'301' AS status_code", "concat('https://h/', id + 1) AS redirect_key")
    row = migration.redirect_chains(map=crawl).selectExpr("count(*) AS n", "sum(hops) AS hops", "count_if(is_loop) AS loops").first()
    assert (row["n"], row["hops"], row["loops"]) == (150_000, 150_000 * 9 - 36, 0)


def test_crawls_meet_by_key(spark):
    schema = "url string, title string, h1 string, status_code string, indexability string, canonical string, word_count bigint, row_id bigint"
    old = spark.createDataFrame([("https://a/x", "old", "h", "200", "Indexable", "", 100, 0), ("https://a/x", "T", "h", "200", "Indexable", "", 100, 1), ("https://a/gone", "G", "h", "200", "Indexable", "", 900, 2)], schema)
    new = spark.createDataFrame([("http://A/x/", "T2", "h", "404", "Non-Indexable", "", 60, 0), ("https://a/moved", "", "", "301", "", "", 0, 1), ("https://a/new", "N", "", "200", "", "", 5, 2)], schema)
    o, n = migration.crawl_by_key(crawl=old), migration.crawl_by_key(crawl=new)
    assert sorted(map(tuple, migration.compare_crawls(old=o, new=n).collect())) == [("https://a/gone", "removed", True), ("https://a/new", "new", False), ("https://a/x", "matched", False)]
    changes = {r["field"]: (r["old_value"], r["new_value"], r["critical"]) for r in migration.field_changes(old=o, new=n).collect()}
    assert changes == {"title": ("T", "T2", False), "status_code": ("200", "404", True), "indexability": ("Indexable", "Non-Indexable", True), "word_count": ("100", "60", True)}


@pytest.mark.parametrize("source,headings", [
    ('<h2><a href="/x">Linked title</a></h2>', [(2, "Linked title")]),
    ("<h3>plain <a href='/y'>b</a> tail</h3>", [(3, "plain b tail")]),
    ("<h1>One</h1><p>text</p><h2>Two <b>bold</b></h2>", [(1, "One"), (2, "Two bold")]),
    ("<h2></h2>", [(2, "")]),
    ("<h1>unclosed <p>x</p>", [(1, "unclosed x")]),
    ("<h2>one<h3>two", [(2, "onetwo"), (3, "two")]),
])
def test_headings_keep_the_text_of_links(source, headings):
    page = html.parse_page(source, "https://a.test/")
    assert [(h["level"], h["text"]) for h in page["headings"]] == headings


def test_blocks_stand_under_headings_with_links():
    page = html.parse_page('<title>T</title><h2><a href="/x">Linked</a></h2><p>some <a href="https://b.test/y">more</a> text</p>', "https://a.test/")
    assert page["blocks"] == [{"heading": "Linked", "text": "some more text"}] and page["title"] == "T"
    assert page["internal_links"] == [{"href": "https://a.test/x", "text": "Linked", "rel": []}] and page["external_links"] == [{"href": "https://b.test/y", "text": "more", "rel": []}]


@pytest.mark.parametrize("method", ["clique", "core"])
def test_keywords_without_a_partner_are_clusters(spark, method):
    serp = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "2"), ("c", "2"), ("d", "9")], "keyword string, url string")
    overlap = spark.createDataFrame([("a", "b", 2), ("a", "c", 1), ("b", "c", 1)], "keyword_a string, keyword_b string, shared bigint")
    assert sorted(map(tuple, matching.greedy_clusters(overlap, serp, method).collect())) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")]


def test_question_levels(spark):
    seeds = spark.createDataFrame([("What?",), ("what",)], "question string")
    edges = spark.createDataFrame([("What", "Who?"), ("who", "What?"), ("who", "When"), ("when", "Where"), ("x", "y")], "parent string, question string")
    got = {r["question_key"]: r["depth"] for r in p.question_tree(seeds=seeds, edges=edges, depth=2).collect()}
    assert got == {"what": 0, "who": 1, "when": 2}


def test_exports_are_split_unless_quotes_hold_line_ends(spark, tmp_path):
    for name, cell in (("plain", '"a ""b"" c"'), ("lines", '"a\nb"')):
        (tmp_path / f"{name}.csv").write_text(f"Address,Title\nhttps://x/,{cell}\nhttps://y/,z\n")
    titles = [[r["title"] for r in exports.read_export(spark, str(tmp_path / f"{n}.csv"), exports.TableSpec("pages", {"url": ["address"], "title": ["title"]}, ["url"])).orderBy("url").collect()] for n in ("plain", "lines")]
    assert titles == [['a "b" c', "z"], ["a\nb", "z"]]


PAGE = """<html lang="nl"><head><title> A &amp; B </title><meta name="Description" content="d"><meta name="ROBOTS" content="noindex"><meta property="OG:Title" content="og">
<meta name="twitter:card" content="summary"><meta name="empty" content=""><link rel="Canonical" href="/c"><link rel="alternate" hreflang="de" href="/de"><link rel="alternate" href="/feed"></head>
<body><header>head</header><nav>menu <a href="/n">n</a></nav><div id="my-app"><p>short</p></div><noscript>no js</noscript><img src="i.png" width="10" loading="lazy"><img alt="">
<a href="https://o.test/" rel="nofollow  sponsored">Out</a><a href="#x">skip</a><a href="javascript:void(0)">skip</a><a>none</a><script>var a = 1</script><h4>Last"""


def test_every_field_of_a_page():
    page = html.parse_page(PAGE, "https://x.test/a/b")
    assert {k: v for k, v in page.items() if k not in ("text", "blocks")} == {
        "title": "A & B", "meta_description": "d", "meta_robots": "noindex", "canonical": "/c", "lang": "nl",
        "meta": {"description": "d", "robots": "noindex", "og:title": "og", "twitter:card": "summary"}, "og": {"og:title": "og"}, "twitter": {"twitter:card": "summary"},
        "hreflang": [{"lang": "de", "href": "/de"}], "headings": [{"level": 4, "text": "Last"}], "jsonld": [], "server_rendered": False,
        "images": [{"src": "https://x.test/a/i.png", "alt": None, "width": "10", "height": None, "loading": "lazy"}, {"src": "", "alt": "", "width": None, "height": None, "loading": None}],
        "internal_links": [{"href": "https://x.test/n", "text": "n", "rel": []}], "external_links": [{"href": "https://o.test/", "text": "Out", "rel": ["nofollow", "sponsored"]}],
        "word_count": 10, "words": 11,
    }
    assert page["text"] == "A & B short no js Outskipskipnone Last".replace("Outskipskipnone", "Out skip skip none")
    assert html.parse_page(f"<div id=root>{'x' * 50}</div>")["server_rendered"] and html.parse_page("<div>x</div>")["server_rendered"]
    assert not html.parse_page("<div id=__NEXT_data><script>long script text that is not shown at all, at all</script>y</div>")["server_rendered"]


def test_security_headers(spark):
    rows = [(1, {"strict-transport-security": "max-age=1", "X-FRAME-OPTIONS": "DENY", "Server": "s"}), (2, None), (3, {})]
    got = {r.id: r for r in html.security_headers(spark.createDataFrame(rows, "id int, headers map<string,string>")).collect()}
    assert got[1].strict_transport_security == "max-age=1" and got[1].x_frame_options == "DENY"
    assert got[1].missing_headers == ["Content-Security-Policy", "X-Content-Type-Options", "Referrer-Policy", "Permissions-Policy"]
    assert got[2].missing_headers == got[3].missing_headers == html.SECURITY_HEADERS


def test_jsonld_by_variant(spark):
    block = lambda *xs: "".join(f"<script type='application/ld+json'> {x} </script>" for x in xs)
    pages = [
        (1, block('{"@context": "https://schema.org", "@type": "Product", "offers": {"@type": "Offer", "seller": [{"@type": ["Store", "Brand"]}]}}')),
        (2, block("{not json", '{"@type": "HowTo"}')),
        (3, block('[{"@context": "http://schema.org", "@type": "FAQPage"}, {"@context": "x", "name": "[City] please replace"}, 7]')),
        (4, block('{"@context": "https://schema.org", "@graph": [{"@type": "ClaimReview"}, {"@graph": [{"@type": "Deep"}]}]}')),
        (5, "<p>none</p>"),
        (6, None),
        (7, block("", "null", '"text"')),
        (8, block('{"@context": ["https://schema.org"], "@type": ["HowTo", "Recipe"]}')),
    ]
    got = {r.id: tuple(r)[1:] for r in html.validate_jsonld(spark.createDataFrame(pages, "id int, html string")).collect()}
    assert got == {
        # blocks, invalid, objects, no_context, wrong_context, no_type, placeholders, retired, restricted, types, critical
        1: (1, 0, 1, 0, 0, 0, 0, 0, 0, "Brand,Offer,Product,Store", False),
        2: (2, 1, 1, 1, 0, 0, 0, 1, 0, "HowTo", True),
        3: (1, 0, 2, 0, 1, 1, 2, 0, 1, "FAQPage", True),
        4: (1, 0, 1, 0, 0, 1, 0, 0, 0, "ClaimReview,Deep", False),
        7: (3, 1, 0, 0, 0, 0, 0, 0, 0, "", False),
        8: (1, 0, 1, 0, 1, 0, 0, 1, 0, "HowTo,Recipe", True),
    }
    assert html.validate_jsonld(spark.createDataFrame(pages[4:5], "id int, html string")).count() == 0


def test_plus_signs_in_queries(spark):
    urls = ["https://x.test/a+b?q=a+b&utm_source=c+d", "x.test/a+b?q=a%20b", "x.test/a+b?q=a%2Bb", "x.test/a+b"]
    got = {r.url: r.url_key for r in migration.normalize_urls(urls=spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert got == {urls[0]: "https://x.test/a+b?q=a b", urls[1]: "https://x.test/a+b?q=a b", urls[2]: "https://x.test/a+b?q=a+b", urls[3]: "https://x.test/a+b"}
    crawl = spark.createDataFrame([("https://x.test/s?q=a+b", "301", "https://x.test/t", 1)], "url string, status_code string, redirect_url string, row_id int")
    rules = migration.redirect_map(crawl=crawl)
    spec = spark.createDataFrame([("https://x.test/s?q=a%20b", "https://x.test/t", "301")], "old_url string, new_url string, type string")
    assert [r.finding for r in migration.validate_redirects(spec=spec, map=rules, chains=migration.follow_redirects(rules)).collect()] == ["match"]


def test_canonicals(spark):
    rows = [("a", "b", 200), ("b", "c", 200), ("c", "", 200), ("d", "e", 200), ("e", "d", 200), ("f", "c", 200), ("g", "gone", 200), ("h", "x", 200), ("x", "x", 404), ("i", "p", 200), ("i", "q", 200), ("j", "d", 200), ("k", None, 200), (None, "a", 200), ("a", "b", 200)]
    got = {r.url: (r.final, r.hops, r.verdict) for r in health.canonical_paths(spark.createDataFrame(rows, "url string, canonical string, status int")).collect()}
    assert got == {
        "a": ("c", 2, "chain"), "b": ("c", 1, "ok"), "c": (None, None, "missing"), "d": (None, None, "loop"), "e": (None, None, "loop"), "f": ("c", 1, "ok"), "g": ("gone", 1, "not_crawled"),
        "h": ("x", 1, "to_error"), "x": (None, None, "self"), "i": ("p", 1, "conflict"), "j": (None, None, "loop"), "k": (None, None, "missing"),
    }


def test_component_cosines(spark):
    pages = spark.createDataFrame([(1, "red bolt", "x", "", "a a b"), (2, "red bolt", "y", "m", "a b b"), (3, "nut", "x", "m", "c")], "id int, title string, h1 string, meta string, body string")
    pairs = spark.createDataFrame([(12, 1, 2), (13, 1, 3), (23, 2, 3), (33, 3, 3)], "pair int, left_id int, right_id int")
    got = {r.pair: tuple(r)[1:] for r in clusters.component_cosines(pairs=pairs, weights=clusters.tfidf_weights(pages=pages)).collect()}
    # a and b are in the same two of three pages, so their weights differ by counts alone: (2, 1) and (1, 2)
    assert got == {12: (1.0, 0.0, 0.0, 0.8), 13: (0.0, 1.0, 0.0, 0.0), 23: (0.0, 0.0, 1.0, 0.0), 33: (1.0, 1.0, 1.0, 1.0)}


def test_titles_that_stand_for_others(spark):
    rows = [(1, "one two three four five six", 10), (2, "six five four three two one", 20), (3, "one two three four five seven", 30), (4, "one two three four five", 5), (5, None, 1), (6, "", 1), (7, "other words", None), (8, "Other, words!", None)]
    got = {r.id: r.kept_by for r in clusters.drop_similar_titles(spark.createDataFrame(rows, "id int, title string, length int")).collect()}
    # 3 and 4 share five words of six and five; 2 shares five of six with 3
    assert got == {3: None, 2: 3, 1: 3, 4: 3, 5: None, 6: None, 7: None, 8: 7}


@pytest.mark.parametrize("source,want", [
    ("<body>a<nav>n</nav><main>b <p>c&amp;d</p><aside>x</aside></main>e</body>", "b c&d"),
    ("<div class='big post-body'>p<div>q</div></div><article>r", "r"),
    ("<div class='big post-body'>p<div>q</div></div> tail", "p q"),
    ("<div role=main>m<span>n</div>o<article><script>no</script>", ""),
    ("<header><main>no</main></header><div role=main>m<br>n</div>", "m n"),
    ("<p>no body<footer>f</footer> at all", "no body at all"),
    ("<body>x<section><b>y</section>z", "x y z"),
    ("", ""),
])
def test_main_text(source, want):
    assert html.main_text_of(source) == want


def test_main_text_of_pages(spark):
    rows = [(1, "<main>one two three</main>"), (2, None), (3, "<main>one</main>")]
    pages = spark.createDataFrame(rows, "id int, html string")
    assert sorted(map(tuple, html.main_text(pages).collect())) == [(1, "one two three", 3), (2, "", 0), (3, "one", 1)]
    assert [r.id for r in html.main_text(pages, min_words=2).collect()] == [1]


def test_passage_text(spark):
    rows = [(1, "<form id=f>no</form><p>a<b>b</b>\n c</p><svg>x</svg><SCRIPT >y</SCRIPT>"), (2, "<formula>kept</formula>")]
    assert {r.id: r.text for r in html.passage_text(pages=spark.createDataFrame(rows, "id int, html string")).collect()} == {1: "a b c", 2: "kept"}


def test_filter_counts(spark):
    names = "address string, title string, h1 string, meta_desc string, h2 string, word_count int, canonical string, canonical_indexable boolean, status_code string, directives string, seconds double, jsonld_blocks int, hsts boolean"
    rows = [("http://a", "", "x", "m", " ", 10, "", True, "301", "", 2.0, 0, True), ("https://b", "t" * 61, "t" * 61, "", "h", 300, "https://b", True, "200", "noindex, nofollow", 0.5, 2, False)]
    got = {r.tab_filter: r.pages for r in health.filter_counts(crawl=spark.createDataFrame(rows, names)).collect() if r.pages}
    assert got == {
        "titles:missing": 1, "titles:over_60": 1, "titles:same_as_h1": 1, "meta:missing": 1, "meta:below_70": 1, "h2:missing": 1, "response_codes:success_2xx": 1, "response_codes:redirection_3xx": 1, "response_codes:redirection_301": 1,
        "canonicals:missing": 1, "canonicals:self_referencing": 1, "directives:none": 1, "directives:noindex": 1, "directives:nofollow": 1, "content:low_content_pages": 1, "page_speed:slow_over_1s": 1,
        "structured_data:contains": 1, "structured_data:missing": 1, "security:http_urls": 1, "security:missing_hsts": 1,
    }
