"""Queries of the similarity, cluster and page health operators."""

from __future__ import annotations

from dataclasses import replace

from lodestar.operators import clusters as c
from lodestar.operators import health as h
from lodestar.operators.graph import settled
from lodestar.plans import fixtures as fx
from lodestar.plans.dialect import SPARK, run
from lodestar.plans.registry import declare, query

VECTORS = fx.shaped("fixture_vectors", "SELECT vec_id AS id, embedding AS vector, label FROM @e@ WHERE vec_id % 5 > 0", e=fx.EMBEDDINGS)
QUESTIONS = fx.shaped("fixture_questions", "SELECT vec_id AS id, embedding AS vector FROM @e@ WHERE vec_id % 5 = 0", e=fx.EMBEDDINGS)


def blocked(a, b, threshold: float, **options):
    """Pairs by blocks of matrix products in Spark; the oracle multiplies them one by one."""
    node = c.cosine_pairs(a=a, b=b, threshold=threshold)
    return replace(node, kernel=lambda given: c.similar_pairs(given["a"], given["b"], threshold, **options).selectExpr("left_id", "right_id", "round(similarity, 6) AS similarity"))


def with_best(node, pairs, side: str, k: int, slack: float = 0.0):
    """``node`` with ``pairs`` (the one with the oracle of PAIRS) in Spark reduced to what can be among the ``k`` best of each row of a side, all told; rounding included."""
    fewer = blocked(QUESTIONS, VECTORS, 0.2, best=(side, k, slack + 2e-6))

    def swap(n):
        return fewer if n is pairs else replace(n, inputs={name: swap(x) for name, x in n.inputs.items()}) if n.inputs else n

    reduced = {name: swap(x) for name, x in node.inputs.items()}
    return replace(node, kernel=lambda given: run(next(iter(given.values())).sparkSession, node.body(SPARK), given), kernel_inputs=reduced)


def coherent(node, members, serp):
    """``node``, coherence of clusters, in Spark over stored ``members`` and only those pairs of keywords that share a cluster."""

    def kernel(given):
        stored = settled(given["members"])
        return run(stored.sparkSession, node.body(SPARK), {"members": stored, "jaccard": c.jaccard_within(stored, given["serp"])})

    return replace(node, kernel=kernel, kernel_inputs={"members": members, "serp": serp})


PAIRS = blocked(QUESTIONS, VECTORS, 0.2)
NAMED = fx.shaped("fixture_named_pairs", "SELECT 'red bolt ' || CAST(left_id AS STRING) AS keyword, '/shop/red-widget-' || CAST(right_id AS STRING) || '/pricing' AS url, similarity FROM @p@", p=PAIRS)
NAMES = fx.shaped("fixture_keyword_names", "SELECT 'red bolt ' || CAST(id AS STRING) AS keyword, CASE WHEN id % 10 = 0 THEN '/shop/red-widget-' || CAST(id + 1 AS STRING) || '/pricing' ELSE '' END AS actual_url, CAST(id % 40 AS BIGINT) AS actual_rank FROM @q@", q=QUESTIONS)
#: A boost adds 0.05 at most, so the five best of a keyword lie within that of its fifth best cosine.
MAPPING = with_best(c.keyword_mapping(pairs=NAMED, threshold=0.3, top_n=5), PAIRS, "left", 5, 0.05)
WHOLE = fx.shaped("fixture_every_vector", "SELECT vec_id AS id, embedding AS vector, label FROM @e@", e=fx.EMBEDDINGS)
SELF = blocked(WHOLE, WHOLE, 0.3, block=2 * c.BLOCK)
CLOSEST = fx.shaped("fixture_closest", "SELECT id AS url, id + 5 AS closest_match, CAST(80 + id % 20 AS DOUBLE) AS similarity_pct, id + 7 AS closest_semantic_match, round(id % 100 / 100e0, 2) AS semantic_score FROM @v@", v=WHOLE)
GROUPED = fx.shaped("fixture_grouped", "SELECT p_partkey AS node, p_partkey % 50 AS root FROM @p@", p=fx.PART)
GROUPED_PAIRS = fx.shaped("fixture_grouped_pairs", "SELECT p_partkey AS left_id, p_partkey + 50 AS right_id, CAST(p_partkey * 7 % 100 - p_partkey % 50 % 3 * 10 AS DOUBLE) / 100e0 AS similarity, CASE WHEN p_partkey % 50 % 5 = 0 THEN CAST(60 + p_partkey % 50 % 40 AS DOUBLE) END AS minhash_pct FROM @p@", p=fx.PART)
SHARED = c.serp_overlap(serp=fx.SERP)
JACCARD = c.serp_jaccard(overlap=SHARED, serp=fx.SERP)
MEMBERS = fx.shaped("fixture_members", "SELECT DISTINCT keyword, CAST(CAST(keyword AS BIGINT) % 100 AS BIGINT) AS cluster FROM @s@", s=fx.SERP)
COHERENCE = coherent(c.cluster_coherence(members=MEMBERS, jaccard=JACCARD), replace(MEMBERS, inputs={"s": fx.STORED_SERP}), fx.STORED_SERP)
DOCS = fx.shaped("fixture_docs", "SELECT doc_id AS id, text FROM @d@", d=fx.DOCUMENTS)
PARTS = fx.shaped("fixture_components", "SELECT l_orderkey * 10 + l_linenumber AS pair, l_discount * 10 AS title, l_tax * 12 AS h1, l_discount * 5 AS meta, l_quantity / 50 AS body FROM @l@", l=fx.LINEITEM)
PASSAGES = fx.shaped("fixture_passages", "SELECT right_id AS passage, CAST(left_id AS STRING) AS query, similarity FROM @p@", p=PAIRS)
TOPICS = fx.shaped("fixture_topics", "SELECT p_type || p_brand AS cluster, p_name AS keyword, CAST(p_partkey % 1000 AS BIGINT) AS volume FROM @p@", p=fx.PART)
WORDS = fx.shaped("fixture_words", lambda d: f"SELECT doc_id AS page, word FROM (SELECT doc_id, {d.explode(d.extract_all('lower(text)', '[a-z]+'))} AS word FROM @d@) AS w", d=fx.DOCUMENTS)
ITEMS = fx.shaped("fixture_items", "SELECT event_id AS id, 'https://x.test/' || event_type || '/' || CAST(user_id AS STRING) || CASE WHEN event_id % 2 = 0 THEN '/?a=1' ELSE '' END AS url, CAST(event_id % 3 AS BIGINT) AS priority, CAST(event_id % 997 AS BIGINT) AS length FROM @e@", e=fx.EVENTS)

declare("b1_cosine_pairs", PAIRS)
declare("b2_b3_url_keyword_boost", fx.shaped("b3", lambda d: f"SELECT p_partkey, {c.keyword_boost(d, 'p_name', '''concat('https://www.x.test/', replace(p_name, ' ', '-'), '/', p_type, '.html?q=1')''')} AS boost, CAST({d.size(c.slug_words(d, '''concat('https://www.x.test/shop/', p_type, '_', p_brand)'''))} AS BIGINT) AS slug_words FROM @p@", p=fx.PART))
declare("b4_keyword_mapping", MAPPING)
declare("b4_keyword_classes", c.keyword_classes(keywords=NAMES, mapping=MAPPING))
declare("b5_hub_pages", c.hub_pages(mapping=MAPPING, least=3))
declare("b6_near_duplicate_pairs", c.near_duplicate_pairs(pairs=SELF, minhash=CLOSEST, semantic=CLOSEST))
declare("b7_b8_cluster_summary", c.cluster_summary(members=GROUPED, pairs=GROUPED_PAIRS))
declare("b9_exact_duplicates", c.exact_duplicates(docs=DOCS))
WORDED = fx.shaped(
    "fixture_worded_pages",
    lambda d: f"SELECT doc_id AS id, {d.join(d.slice('w', '1', '8'), ' ')} AS title, {d.join(d.slice('w', '3', '6'), ' ')} AS h1, {d.join(d.slice('w', '9', '12'), ' ')} AS meta, body FROM (SELECT doc_id, coalesce(text, '') AS body, {d.split('coalesce(text, chr(32))', ' ')} AS w FROM @d@) AS d",
    d=fx.DOCUMENTS,
)
NEIGHBOURS = fx.shaped("fixture_neighbours", "SELECT a.doc_id AS pair, a.doc_id AS left_id, b.doc_id AS right_id FROM @d@ a JOIN @d@ b ON b.doc_id = a.doc_id + 1 UNION ALL SELECT -1 - doc_id AS pair, doc_id AS left_id, doc_id AS right_id FROM @d@", d=fx.DOCUMENTS)
COSINES = replace(c.component_cosines(pairs=NEIGHBOURS, weights=c.tfidf_weights(pages=WORDED)), kernel=lambda given: c.cosines_of_parts(given["pages"], given["pairs"]), kernel_inputs={"pages": WORDED, "pairs": NEIGHBOURS})
TITLED_ITEMS = fx.shaped("fixture_titled_items", "SELECT p_partkey AS id, CASE WHEN p_partkey % 90 = 0 THEN '' ELSE lower(p_type) || ' ' || replace(p_brand, '#', ' ') || ' made to last ' || CASE WHEN p_size > 25 THEN 'and to please' ELSE p_name END END AS title, CAST(p_partkey * 7919 % 1009 AS BIGINT) AS length FROM @p@", p=fx.PART)

declare("b12_component_cosines", COSINES)
declare("b12_b13_tfidf_class", c.component_class(parts=COSINES))
declare("b29_title_overlap", replace(c.titles_in_turn(items=TITLED_ITEMS), kernel=lambda given: c.drop_similar_titles(given["items"])))
declare("b12_b13_component_class", c.component_class(parts=PARTS))
declare("b14_keyword_page_topk", with_best(c.best_pages(pairs=NAMED, keywords=NAMES, k=5), PAIRS, "left", 5))
declare("b15_cannibalization_severity", replace(c.cannibalization_severity(gsc=fx.QUERY_PAGE), kernel=lambda given: c.cannibalizing_pages(given["gsc"])))
declare("b18_serp_overlap", SHARED)
declare("b19_serp_jaccard", JACCARD)
declare("b23_hub_urls", c.hub_urls(members=MEMBERS, serp=fx.SERP))
declare("b24_cluster_coherence", COHERENCE)
declare("b26_passage_retrieval", with_best(c.passage_retrieval(pairs=PASSAGES, least=0.2), PAIRS, "right", 5))
declare("b27_topical_checks", c.topical_checks(clusters=TOPICS))
declare("b28_unique_words", c.unique_words(words=WORDS))
declare("b29_item_dedup", c.item_dedup(items=ITEMS))


@query("b1_cosine_blocks", oracle=c.cosine_pairs(a=QUESTIONS, b=VECTORS, threshold=0.2).duck())
def b1_cosine_blocks(spark, sf_dir):
    """B1 by blocks of matrix products, against the same oracle as the SQL form."""
    pairs = c.similar_pairs(QUESTIONS.spark(spark, sf_dir), VECTORS.spark(spark, sf_dir), 0.2)
    return pairs.selectExpr("left_id", "right_id", "round(similarity, 6) AS similarity")


# --- page health -------------------------------------------------------------------------

CRAWL = fx.shaped(
    "fixture_crawl",
    """SELECT 'https://x.test' || CASE p_partkey % 7 WHEN 0 THEN '/blog/' WHEN 1 THEN '/product/' WHEN 2 THEN '/category/' WHEN 3 THEN '/dienst/' WHEN 4 THEN '/winkel/' WHEN 5 THEN '/x/' ELSE '/' END || CASE WHEN p_partkey % 7 = 6 THEN '' ELSE CAST(p_partkey AS STRING) END AS address,
    CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'https://x.test/other' ELSE 'https://x.test/x/' || CAST(p_partkey AS STRING) || '/' END AS canonical, CAST(p_partkey * 13 % 1200 AS BIGINT) AS word_count, CAST(p_partkey % 6 AS BIGINT) AS inlinks, CAST(p_partkey % 8 AS BIGINT) AS crawl_depth,
    CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name || ' ' || p_type || ' for everyone at ' || p_brand || CASE WHEN p_partkey % 3 = 0 THEN ' and much more to read about it all' ELSE '' END END AS title,
    CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_name END AS h1, CASE WHEN p_partkey % 9 = 0 THEN ' ' ELSE p_type END AS h2, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'Read about ' || p_name || ' from ' || p_brand || ', a thing of type ' || p_type || ' that is sold by many' END AS meta_desc, p_partkey FROM @p@""",
    p=fx.PART,
)
CLICKS = fx.shaped("fixture_clicks", "SELECT regexp_replace(lower(address), '/+$', '') AS url, CAST(sum(p_partkey % 3) AS BIGINT) AS clicks FROM @c@ WHERE p_partkey % 2 = 0 GROUP BY 1", c=CRAWL)
HEALTH = h.page_health(pages=CRAWL, clicks=CLICKS)
TYPED = fx.shaped("fixture_typed", "SELECT address AS url, CASE p_partkey % 5 WHEN 0 THEN 'blog' WHEN 1 THEN 'product' WHEN 2 THEN 'service' WHEN 3 THEN 'faq' ELSE 'homepage' END AS page_type, word_count, inlinks AS internal_links FROM @c@", c=CRAWL)
LOCATIONS = fx.shaped("fixture_locations", "SELECT p_brand AS site, CAST(p_partkey * 7 % 100 AS BIGINT) AS unique_percentage FROM @p@", p=fx.PART)
IMAGES = fx.shaped("fixture_images", "SELECT p_partkey AS src, CASE p_size % 3 WHEN 0 THEN 'thumbnail' WHEN 1 THEN 'content' ELSE 'hero' END AS kind, CAST(p_partkey * 11 % 400 AS BIGINT) AS kilobytes, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN 'a' ELSE p_name || ' of type ' || p_type END AS alt FROM @p@", p=fx.PART)
POSTS = fx.shaped("fixture_posts", "SELECT p_partkey AS url, title, meta_desc, p_partkey % 3 AS h1_count, p_partkey % 10 AS h2_count, p_partkey % 7 AS question_h2, p_partkey % 90 AS longest_heading, p_partkey % 13 AS internal_links, p_partkey % 5 AS external_links, canonical FROM @c@", c=CRAWL)
LINKS = fx.shaped("fixture_links", "SELECT l_orderkey % 200 AS page, 'https://x.test/' || CAST(l_partkey % 50 AS STRING) || CASE WHEN l_linenumber = 1 THEN '/?u=1' ELSE '' END AS href, l_returnflag || l_linestatus AS anchor FROM @l@", l=fx.LINEITEM)
URLS = fx.shaped("fixture_urls", "SELECT 'https://x.test/' || CASE WHEN o_orderkey % 3 = 0 THEN '2024/05/' ELSE 'Some/' END || replace(o_orderpriority, ' ', '-') || '/' || CAST(o_orderkey AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN '.html' ELSE '' END AS url FROM @o@", o=fx.ORDERS)
ANALYSED = fx.shaped("fixture_analysed", "SELECT p_partkey AS url, title, meta_desc, p_partkey % 20 AS keyword_count, word_count FROM @c@", c=CRAWL)
VITALS = fx.shaped("fixture_vitals", "SELECT user_id % 20 AS page, CASE event_type WHEN 'click' THEN 'LCP' WHEN 'view' THEN 'INP' ELSE 'CLS' END AS metric, CASE event_type WHEN 'click' THEN value * 60 WHEN 'view' THEN value * 8 ELSE value / 200 END AS value FROM @e@", e=fx.EVENTS)
SITE_LINKS = fx.shaped("fixture_site_links", "SELECT l_suppkey AS source, l_partkey AS target, l_returnflag AS anchor FROM @l@ WHERE l_partkey % 3 > 0", l=fx.LINEITEM)
SITE_CRAWL = fx.shaped("fixture_site_crawl", "SELECT p_partkey AS url, CASE p_partkey % 10 WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN 500 ELSE 200 END AS status, p_partkey % 11 = 0 AS noindex, p_partkey % 13 = 0 AS robots_blocked FROM @p@", p=fx.PART)
CANONICALS = fx.shaped("fixture_canonicals", "SELECT CAST(p_partkey AS STRING) AS url, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN CAST(p_partkey * 7 % 2500 AS STRING) ELSE CAST(p_partkey AS STRING) END AS canonical, CASE WHEN p_partkey % 10 = 0 THEN 404 ELSE 200 END AS status, p_partkey % 11 = 0 AS noindex, p_partkey % 13 = 0 AS robots_blocked FROM @p@", p=fx.PART)

declare("c1_page_types", h.page_types(pages=fx.shaped("fixture_crawl_urls", "SELECT DISTINCT address AS url FROM @c@", c=CRAWL)))
declare("c9_page_health", HEALTH)
declare("c10_health_bands", h.health_bands(health=HEALTH))
declare("c10_health_signals", h.health_signals(health=HEALTH))
declare("c11_custom_weights", h.page_health(pages=CRAWL, clicks=CLICKS, weights=h.rescaled({"thin_content": 50})))
declare("c12_s38_page_filters", h.page_filters(pages=CRAWL))
declare("c13_least_words", h.least_words(pages=TYPED))
declare("c14_location_gates", h.location_gates(pages=LOCATIONS))
declare("c15_link_targets", h.link_targets(pages=TYPED))
declare("c16_image_checks", h.image_checks(images=IMAGES))
declare("c17_seo_checklist", h.seo_checklist(posts=POSTS))
declare("c18_dedupe_links", replace(h.dedupe_links(links=LINKS), kernel=lambda given: h.first_links(given["links"])))
declare("c19_url_rules", h.url_rules(pages=URLS))
declare("c20_page_analysis", h.page_analysis(pages=ANALYSED))
declare("c21_web_vitals", h.web_vitals(samples=VITALS))
declare("c22_broken_links", h.broken_links(links=fx.shaped("fixture_all_site_links", "SELECT l_suppkey AS source, l_partkey AS target, l_returnflag AS anchor FROM @l@", l=fx.LINEITEM), crawl=SITE_CRAWL))
declare("c23_indexability", h.indexability(crawl=CANONICALS))
declare("c24_orphan_pages", h.orphan_pages(crawl=SITE_CRAWL, links=SITE_LINKS))
declare("c25_security_report", h.security_report(pages=fx.PAGES))
declare("c26_canonical_report", h.canonical_report(crawl=CANONICALS))
declare("c27_risk_pages", h.risk_pages(health=HEALTH))
SPREAD = fx.shaped(
    "fixture_spread_canonicals",
    """SELECT CAST(p_partkey AS STRING) AS url, CASE WHEN p_partkey % 9 = 0 THEN '' WHEN p_partkey % 9 = 1 THEN CAST(p_partkey AS STRING) WHEN p_partkey % 30 < 20 THEN CAST(p_partkey + 1 AS STRING) WHEN p_partkey % 30 = 29 THEN CAST(p_partkey - 3 AS STRING) ELSE CAST(p_partkey * 7 % 2500 AS STRING) END AS canonical,
    CASE WHEN p_partkey % 10 = 0 THEN 404 ELSE 200 END AS status FROM @p@ UNION ALL SELECT CAST(p_partkey AS STRING) AS url, 'other' AS canonical, 200 AS status FROM @p@ WHERE p_partkey % 40 = 0""",
    p=fx.PART,
)
declare("c26_canonical_paths", replace(h.canonical_walks(crawl=SPREAD), kernel=lambda given: h.canonical_paths(given["crawl"])))
EXPORT = fx.shaped(
    "fixture_crawl_export",
    """SELECT address, title, h1, meta_desc, h2, word_count, CASE WHEN p_partkey % 4 = 0 THEN address ELSE canonical END AS canonical, p_partkey % 7 > 0 AS canonical_indexable, CASE p_partkey % 12 WHEN 0 THEN '301' WHEN 1 THEN '302' WHEN 2 THEN '404' WHEN 3 THEN '500' WHEN 4 THEN '' ELSE '200' END AS status_code,
    CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'noindex, follow' WHEN 2 THEN 'index, nofollow' WHEN 3 THEN 'noarchive, nosnippet' ELSE 'index, follow' END AS directives, p_partkey % 3 / 1e0 AS seconds, p_partkey % 4 AS jsonld_blocks, p_partkey % 6 > 0 AS hsts FROM @c@""",
    c=CRAWL,
)
declare("s38_filter_counts", h.filter_counts(crawl=EXPORT))
