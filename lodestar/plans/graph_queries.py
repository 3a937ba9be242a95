"""Queries of the link graph and migration operators."""

from __future__ import annotations

from dataclasses import replace

from lodestar.operators import graph as g
from lodestar.operators import migration as m
from lodestar.plans import fixtures as fx
from lodestar.plans.registry import declare, query

LINKS = fx.shaped(
    "fixture_inlinks",
    """SELECT 'https://X.test/part/' || CAST(l_partkey % 400 AS STRING) || CASE WHEN l_linenumber % 2 = 0 THEN '/?utm_source=a' ELSE '' END AS source, 'https://x.test/' || CASE WHEN l_suppkey % 3 = 0 THEN 'shop' ELSE 'part' END || '/' || CAST(l_suppkey % 300 AS STRING) || '#top' AS target,
    CASE l_linenumber % 4 WHEN 0 THEN 'Hyperlink' WHEN 1 THEN 'AHref' WHEN 2 THEN '' ELSE 'Image' END AS type,
    CASE l_orderkey % 6 WHEN 0 THEN 'Click Here' WHEN 1 THEN '' WHEN 2 THEN 'Shop now' WHEN 3 THEN l_returnflag || ' part' WHEN 4 THEN 'lees meer' ELSE 'Part ' || CAST(l_suppkey % 7 AS STRING) END AS anchor FROM @l@""",
    l=fx.LINEITEM,
)
EDGES = g.build_edges(links=LINKS)
DEGREES = g.degrees(edges=EDGES)
RATED = fx.shaped("fixture_rated_nodes", "SELECT node, in_degree, out_degree, round(in_degree / 1000e0, 6) AS pagerank, round(out_degree * in_degree / 100000e0, 6) AS betweenness FROM @d@", d=DEGREES)
CLASSES = replace(g.node_classes(nodes=RATED), kernel=lambda given: g.classify_nodes(g.settled(given["nodes"])))
REVENUE = fx.shaped("fixture_revenue", "SELECT 'https://x.test/part/' || CAST(o_custkey % 350 AS STRING) AS page, o_orderkey % 17 AS transactions, CASE WHEN o_custkey % 5 = 0 THEN 0e0 ELSE o_totalprice END AS revenue, o_orderkey AS row_id FROM @o@", o=fx.ORDERS)
EARNED = g.revenue_links(links=LINKS, revenue=REVENUE)
BLOCKS = fx.shaped("fixture_blocks", "SELECT p_brand AS site, p_type || CAST(p_size AS STRING) AS block, CAST(p_partkey % 9 AS BIGINT) AS links FROM @p@", p=fx.PART)
SUPPLIES = fx.shaped("fixture_supplies", "SELECT l_partkey AS src, 100000 + l_suppkey AS dst, CAST(count(*) AS BIGINT) AS weight FROM @l@ GROUP BY l_partkey, l_suppkey UNION ALL SELECT DISTINCT 100000 + l_suppkey AS src, l_suppkey * 20 AS dst, CAST(1 AS BIGINT) AS weight FROM @l@", l=fx.LINEITEM)
SPARSE = fx.shaped("fixture_sparse_pairs", "SELECT DISTINCT o_custkey * 2 AS a, o_orderkey % 997 * 2 + 1 AS b FROM @o@", o=fx.ORDERS)

declare("d1_build_edges", EDGES)
declare("d2_degrees", DEGREES)
declare("d5_d6_node_classes", CLASSES)
declare("d7_graph_lists", replace(g.graph_lists(nodes=RATED, classes=CLASSES, min_links=3), kernel=lambda given: g.lists_of_graph(given["nodes"], 3), kernel_inputs={"nodes": RATED}))
declare("d7_graph_summary", g.graph_summary(edges=EDGES, degrees=DEGREES))
declare("d8_analyze_anchors", g.analyze_anchors(links=LINKS))
declare("d9_duplicate_anchors", g.duplicate_anchors(links=LINKS))
declare("d10_generic_anchors", g.generic_anchors(links=LINKS))
declare("d10_empty_anchors", g.empty_anchors(links=LINKS))
declare("d11_d12_revenue_links", EARNED)
declare("d12_revenue_lists", g.revenue_lists(joined=EARNED))
declare("d13_link_blocks", g.link_blocks(blocks=BLOCKS, client="Brand#2"))


@query(
    "b7_b20_connected_components",
    oracle=SPARSE.duck().replace("SELECT * FROM n0_fixture_sparse_pairs", "")
    + """,
both_ways AS (SELECT a AS x, b AS y FROM n0_fixture_sparse_pairs UNION SELECT b, a FROM n0_fixture_sparse_pairs),
reach AS (SELECT * FROM (WITH RECURSIVE r(node, far) AS (SELECT x, x FROM both_ways UNION SELECT r.node, e.y FROM r JOIN both_ways e ON r.far = e.x) SELECT * FROM r) AS q)
SELECT node, min(far) AS root FROM reach GROUP BY node""",
)
def b20_components(spark, sf_dir):
    """Smallest node that each node reaches."""
    return g.connected_components(SPARSE.spark(spark, sf_dir))


def _pagerank_sql(rounds: int, tolerance: float = 1e-6) -> str:
    """Ranks stay as they are from the round on that moves them by less than n * tolerance in sum."""
    parts = [SUPPLIES.duck().replace("SELECT * FROM n0_fixture_supplies", "")]
    parts.append(",\nlinks AS (SELECT src, dst, weight / CAST(sum(weight) OVER (PARTITION BY src) AS DOUBLE) AS share FROM n0_fixture_supplies)")
    parts.append(",\nnodes AS (SELECT DISTINCT node, node IN (SELECT src FROM links) AS leads FROM (SELECT src AS node FROM links UNION ALL SELECT dst FROM links) AS u), total AS (SELECT count(*) AS n FROM nodes)")
    parts.append(",\nr0 AS MATERIALIZED (SELECT node, leads, 1.0::DOUBLE / n AS pr, 1e9::DOUBLE AS moved FROM nodes, total)")
    for i in range(rounds):
        parts.append(
            f",\nr{i + 1} AS MATERIALIZED (SELECT node, leads, CASE WHEN moved < n * {tolerance} THEN was ELSE pr END AS pr, CASE WHEN moved < n * {tolerance} THEN moved ELSE sum(abs(pr - was)) OVER () END AS moved FROM"
            f" (SELECT v.node, v.leads, v.moved, n, v.pr AS was, (1 - 0.85::DOUBLE) / n + 0.85::DOUBLE * (SELECT coalesce(sum(pr), 0) FROM r{i} WHERE NOT leads) / n + 0.85::DOUBLE * coalesce(s.got, 0) AS pr"
            f" FROM r{i} v CROSS JOIN total LEFT JOIN (SELECT dst, sum(pr * share) AS got FROM links JOIN r{i} ON src = node GROUP BY dst) AS s ON v.node = s.dst) AS a)"
        )
    return "".join(parts) + f"\nSELECT node, round(pr, 6) AS pagerank FROM r{rounds}"


@query("d3_pagerank", oracle=_pagerank_sql(100))
def d3_pagerank(spark, sf_dir):
    """D3: to its own stop, which the oracle has in each of its rounds."""
    ranks = g.pagerank(SUPPLIES.spark(spark, sf_dir))
    return ranks.selectExpr("node", "round(pagerank, 6) AS pagerank")


@query("d4_betweenness")
def d4_betweenness(spark, sf_dir):
    """Exact at any number of nodes, over the supply graph."""
    return g.betweenness(SUPPLIES.spark(spark, sf_dir), exact_nodes=None).selectExpr("node", "round(betweenness, 9) AS betweenness")


# --- migration ---------------------------------------------------------------------------

RAW_URLS = fx.shaped(
    "fixture_raw_urls",
    """SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN 'HTTP://' WHEN 1 THEN 'https://' WHEN 2 THEN '' ELSE 'http://' END || 'Shop.Test' || CASE o_orderkey % 3 WHEN 0 THEN ':443' WHEN 1 THEN ':8080' ELSE '' END || '/' || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN '/' ELSE '' END
    || CASE o_orderkey % 7 WHEN 0 THEN '?b=2&utm_source=x&a=1' WHEN 1 THEN '#part' WHEN 2 THEN '?gclid=7' WHEN 3 THEN '?q=a+b%2Bc' WHEN 4 THEN '?q=a%20b%2Bc' ELSE '' END AS url FROM @o@""",
    o=fx.ORDERS,
)


def _spelt(key: str, of: str) -> str:
    """One url in several spellings: scheme, case, port, slash, tracking, fragment, percent signs."""
    return f"""CASE {of} % 5 WHEN 0 THEN 'HTTP://X.test/p/' || {key} || '/' WHEN 1 THEN 'https://x.test:443/p/' || {key} WHEN 2 THEN 'x.test/%70/' || {key} || '?utm_source=a' WHEN 3 THEN '//x.test/p/' || {key} || '#top' ELSE 'http://x.test/p/' || {key} END"""


_TARGET = _spelt("CAST(p_partkey * 7 % 2000 AS STRING)", "(p_partkey + 2)")
CRAWL = fx.shaped("fixture_redirect_crawl", f"SELECT {_spelt('CAST(p_partkey AS STRING)', 'p_partkey')} AS url, CASE WHEN p_partkey % 7 < 3 THEN '301' WHEN p_partkey % 11 = 0 THEN '404' WHEN p_partkey % 13 = 0 THEN '302' ELSE '200' END AS status_code, CASE WHEN p_partkey % 7 < 3 OR p_partkey % 13 = 0 THEN {_TARGET} ELSE '' END AS redirect_url, p_partkey AS row_id FROM @p@", p=fx.PART)
_MAP = m.redirect_map(crawl=CRAWL)
#: Keys are computed once: the map is written, and chains and findings read it.
REDIRECTS = replace(_MAP, kernel=lambda given: g.settled(m.redirect_map(crawl=given["crawl"])))
CHAINS = replace(m.redirect_chains(map=REDIRECTS), kernel=lambda given: m.follow_redirects(given["map"]))
SPEC = fx.shaped("fixture_spec", f"SELECT {_spelt('CAST(p_partkey AS STRING)', 'p_size')} AS old_url, {_spelt('CAST((p_partkey * 7 + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END) % 2000 AS STRING)', '(p_size + 1)')} AS new_url, CASE WHEN p_size % 3 = 0 THEN '' ELSE '301' END AS type FROM @p@ WHERE p_partkey % 3 = 0", p=fx.PART)
FINDINGS = m.validate_redirects(spec=SPEC, map=REDIRECTS, chains=CHAINS)


def _crawl(shift: int, start: str) -> str:
    return f"""SELECT '{start}/p/' || CAST(p_partkey + {shift} AS STRING) AS url, p_name || CASE WHEN (p_partkey + {shift}) % 9 = 0 THEN ' {shift}' ELSE '' END AS title, p_type AS h1, CASE WHEN (p_partkey * 3 + {shift}) % 7 = 0 THEN '404' WHEN (p_partkey + {shift}) % 19 = 0 THEN '301' ELSE '200' END AS status_code,
    CASE WHEN (p_partkey + {shift}) % 8 = 0 THEN 'Non-Indexable' ELSE 'Indexable' END AS indexability, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END AS canonical, CAST((p_partkey * 31 + {shift} * 97) % 1500 AS BIGINT) AS word_count, p_partkey AS row_id FROM @p@"""


OLD, NEW = fx.shaped("fixture_old_crawl", _crawl(0, "https://x.test"), p=fx.PART), fx.shaped("fixture_new_crawl", _crawl(100, "http://X.test:80"), p=fx.PART)
OLD_KEYED, NEW_KEYED = m.crawl_by_key(crawl=OLD), m.crawl_by_key(crawl=NEW)
SNAPSHOTS = fx.shaped("fixture_snapshots", "SELECT replace(substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 10), '-', '') || '120000' AS timestamp, 'https://x.test/' || o_orderpriority || '/' || CAST(o_custkey % (o_orderkey % 90 + 1) AS STRING) || '/x' AS original, CAST(o_custkey % 40 AS STRING) AS digest FROM @o@", o=fx.ORDERS)
SITEMAP = fx.shaped("fixture_sitemap", "SELECT 'http://X.test:80/p/' || CAST(p_partkey AS STRING) AS loc FROM @p@ WHERE p_partkey % 4 > 0", p=fx.PART)
SITE = fx.shaped("fixture_sitemap_crawl", "SELECT url, status_code, indexability = 'Indexable' AS indexable FROM @n@", n=NEW)
SITEMAPS = fx.shaped("fixture_sitemap_urls", "SELECT p_brand AS sitemap, CASE WHEN p_partkey % 6 = 0 THEN 'http' ELSE 'https' END || '://x.test/' || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 10 = 0 THEN '?a=1' ELSE '' END AS loc, CASE WHEN p_size > 25 THEN '2024-01-01' ELSE '2024-02-02' END AS lastmod FROM @p@", p=fx.PART)
HREFLANG = fx.shaped(
    "fixture_hreflang",
    "SELECT 'https://x.test/' || CAST(p_partkey % 500 AS STRING) AS page_url, CASE p_size % 5 WHEN 0 THEN 'nl' WHEN 1 THEN 'en-GB' WHEN 2 THEN 'x-default' WHEN 3 THEN 'english' ELSE 'de' END AS lang, CASE WHEN p_partkey % 17 = 0 THEN 'http' ELSE 'https' END || '://x.test/' || CAST(CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 500 ELSE 499 - p_partkey % 500 END AS STRING) AS href, CASE WHEN p_partkey % 23 = 0 THEN 'https://x.test/1' ELSE '' END AS canonical FROM @p@",
    p=fx.PART,
)

declare("e1_normalize_urls", m.normalize_urls(urls=RAW_URLS))
declare("e2_redirect_map", REDIRECTS)
declare("e3_e13_redirect_chains", CHAINS)
declare("e13_redirect_report", replace(m.redirect_walks(map=REDIRECTS), kernel=lambda given: m.redirect_report(given["map"])))
declare("e4_validate_redirects", FINDINGS)
declare("e5_extra_redirects", m.extra_redirects(map=REDIRECTS, spec=SPEC))
declare("e6_redirect_summary", m.redirect_summary(findings=FINDINGS))
declare("e7_e9_compare_crawls", m.compare_crawls(old=OLD_KEYED, new=NEW_KEYED))
declare("e8_e14_field_changes", m.field_changes(old=OLD_KEYED, new=NEW_KEYED))
declare("e10_archive_timeline", m.archive_timeline(snapshots=SNAPSHOTS))
declare("e11_structural_changes", m.structural_changes(snapshots=SNAPSHOTS))
declare("e12_robots_versions", m.robots_versions(snapshots=SNAPSHOTS))
declare("e15_sitemap_cross_reference", m.sitemap_cross_reference(sitemap=SITEMAP, crawl=SITE))
declare("e16_sitemap_checks", m.sitemap_checks(urls=SITEMAPS))
declare("e17_hreflang_checks", m.hreflang_checks(hreflang=HREFLANG))
