"""Queries of the text, product, html and portfolio operators."""

from __future__ import annotations

from dataclasses import replace

from lodestar.operators import portfolio as p
from lodestar.operators import products as g
from lodestar.operators import questions as q
from lodestar.operators import text as t
from lodestar.operators.graph import settled
from lodestar.plans import fixtures as fx
from lodestar.plans.registry import declare, query

TEXTS = fx.shaped("fixture_texts", "SELECT doc_id AS id, text FROM @d@", d=fx.DOCUMENTS)
PASSAGES = fx.shaped("fixture_passage_rows", "SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 3 = 0 THEN 'What is this?' ELSE 'About it' END AS section, CASE WHEN turn % 3 = 0 THEN 'What is this?' ELSE 'About it' END AS heading, CASE WHEN turn % 4 = 0 THEN 'However, 45% of 2024 users. ' WHEN turn % 4 = 1 THEN 'According to Google a score is a number. ' ELSE '' END || text AS text FROM @c@", c=fx.CONVERSATIONS)
SCORED = t.score_passages(passages=PASSAGES)
BY_PAGE = fx.shaped("fixture_scored_pages", "SELECT id, total, rating, word_count, id % 20 AS url, CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS section, CAST(1 + id % 3 AS BIGINT) AS weight FROM @s@", s=SCORED)
CITED = t.citability(passages=PASSAGES)
CITED_PAGES = fx.shaped("fixture_cited_pages", "SELECT id % 20 AS url, word_count, total, grade, containment FROM @c@", c=CITED)
READ = t.readability(texts=TEXTS)
POSTS = fx.shaped("fixture_geo_posts", "SELECT p_partkey AS url, p_partkey % 7 AS passages, p_partkey % 5 AS question_headings, p_size > 40 AS faq, p_partkey % 9 AS entities, p_partkey % 2 AS sources, p_partkey % 6 AS headings, p_partkey % 3 AS lists, p_partkey % 10 > 0 AS robots_ok, p_size > 5 AS ssr FROM @p@", p=fx.PART)
SIGNALS = fx.shaped("fixture_signals", "SELECT l_orderkey % 500 AS page, l_linenumber % 4 AS pillar, l_partkey % 9 AS points FROM @l@", l=fx.LINEITEM)
TITLES = fx.shaped("fixture_title_keywords", "SELECT p_brand || ' ' || p_name || ' for your home and garden at ' || p_type AS title, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_name ELSE 'nothing' END AS keyword FROM @p@", p=fx.PART)

declare("f1_f2_text_measures", t.text_measures(texts=TEXTS))
declare("f6_f7_score_passages", SCORED)
declare("f8_passage_report", t.passage_report(scored=BY_PAGE))
declare("f8_section_report", t.section_report(scored=BY_PAGE))
declare("f8_passage_extremes", t.passage_extremes(scored=BY_PAGE))
declare("f10_citability", CITED)
declare("f11_f12_page_citability", t.page_citability(scored=CITED_PAGES))
declare("f13_readability", READ)
declare("f14_metric_stats", replace(t.metric_stats(scores=READ), kernel=lambda given: t.metric_statistics(settled(given["scores"]))))
declare("f15_f17_classify_readability", t.classify_readability(scores=READ))
declare("f17_grade_assessment", t.grade_assessment(scores=READ, audience="b2b"))
declare("f16_grade_distribution", replace(t.grade_distribution(scores=READ), kernel=lambda given: t.grade_bands(given["scores"])))
declare("f18_entity_frequency", t.entity_frequency(texts=TEXTS))
declare("f18_entity_prominence", t.entity_prominence(texts=TEXTS))
declare("f18_entity_pairs", t.entity_pairs(texts=TEXTS))
declare("f19_blog_geo", t.blog_geo(posts=POSTS))
declare("f20_signal_total", t.signal_total(signals=SIGNALS))
declare("f21_title_checks", t.title_checks(titles=TITLES))

# --- products ----------------------------------------------------------------------------

OWN = fx.shaped("fixture_own_products", "SELECT p_partkey AS id, 'MP-' || CAST(CAST(p_partkey / 2 AS BIGINT) AS STRING) AS mpn, CASE WHEN p_partkey % 3 = 0 THEN 'S/' || CAST(p_partkey % 300 AS STRING) ELSE '' END AS sku, CAST(p_partkey % 700 AS STRING) AS gtin, p_type AS category, p_brand AS brand, p_brand || ' ' || p_name || ' - ' || p_type AS title FROM @p@ WHERE p_partkey % 2 = 0", p=fx.PART)
OTHER = fx.shaped("fixture_other_products", "SELECT p_partkey AS id, 'mp' || CAST(CAST((p_partkey - 1) / 2 AS BIGINT) AS STRING) AS mpn, CASE WHEN p_partkey % 5 = 0 THEN 's' || CAST(p_partkey % 300 AS STRING) ELSE '' END AS sku, '0' || CAST((p_partkey + 1) % 700 AS STRING) AS gtin, p_name || ', ' || p_brand || ' 2024 pro-line' AS title FROM @p@ WHERE p_partkey % 2 = 1", p=fx.PART)


def matched(own, other):
    """G3 by identifiers: rounds of certain edges in Spark, a recursion over rows in the oracle."""
    return replace(g.match_in_row_order(edges=g.identifier_edges(own=own, other=other)), kernel=lambda given: g.match_products(given["own"], given["other"], None), kernel_inputs={"own": own, "other": other})


def _contested(shift: int) -> str:
    """Products that share identifiers within and across fields, and titles that differ in the order of words only."""
    return f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'MP-' || CAST((p_partkey * 7 + {shift}) % 613 AS STRING) END AS mpn, CASE WHEN p_partkey % 3 = 0 THEN 'mp' || CAST(p_partkey % 411 AS STRING) ELSE '' END AS sku,
    CASE WHEN p_partkey % 5 = {shift} THEN '00' || CAST(p_partkey % 307 AS STRING) ELSE ' ' END AS gtin, {"p_type || ' ' || p_brand" if shift else "p_brand || ' ' || p_type"} AS title FROM @p@ WHERE p_partkey % 2 = {shift}"""


MATCHES = matched(OWN, OTHER)
RIVALS = fx.shaped("fixture_own_rivals", _contested(0), p=fx.PART), fx.shaped("fixture_other_rivals", _contested(1), p=fx.PART)
TITLED = fx.shaped("fixture_matched_titles", "SELECT o.category, o.title AS own_title, c.title AS other_title FROM @m@ m JOIN @o@ o ON m.own_id = o.id JOIN @c@ c ON m.other_id = c.id", m=MATCHES, o=OWN, c=OTHER)
SERP_TITLES = fx.shaped("fixture_product_serp", "SELECT p_type AS grp, p_name || ' ' || p_brand || ' sale' AS title, CASE WHEN p_partkey % 9 > 0 THEN p_partkey % 14 END AS position, p_partkey AS row_id FROM @p@", p=fx.PART)
CRUMBS = fx.shaped("fixture_breadcrumbs", "SELECT p_partkey AS url, CASE p_partkey % 4 WHEN 0 THEN 'Home > ' || p_type || ' > ' || p_name WHEN 1 THEN 'Home/' || p_type || '/' || p_name WHEN 2 THEN 'Home » ' || p_name ELSE p_name END AS breadcrumb FROM @p@", p=fx.PART)

declare("g1_g2_product_keys", g.product_keys(products=OWN))
declare("g3_match_products", matched(*RIVALS))


@query("g3_match_with_titles")
def g3_match_with_titles(spark, sf_dir):
    """The pass by identifiers, and by titles at the ratio of 90 for whom it leaves."""
    return g.match_products(*(x.spark(spark, sf_dir) for x in RIVALS))


declare("g4_title_gaps", g.title_gaps(matches=TITLED))
declare("g5_title_patterns", g.title_patterns(titles=SERP_TITLES))
declare("g6_standardize_titles", g.standardize_titles(products=OWN))
declare("g6_title_samples", g.title_samples(products=OWN))
declare("g7_g8_discover_categories", g.discover_categories(products=OWN))
declare("g9_breadcrumb_parts", g.breadcrumb_parts(pages=CRUMBS))

# --- portfolio ---------------------------------------------------------------------------


def scores_for(kind: str):
    names = list(p.WEIGHTS[kind])
    cases = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return fx.shaped(f"fixture_scores_{kind}", f"SELECT c_custkey AS domain, CASE k {cases} END AS category, CAST((c_custkey * 7 + k * 13) % 101 AS BIGINT) AS score FROM @c@ CROSS JOIN (SELECT * FROM (VALUES {', '.join(f'({i})' for i in range(len(names)))}) AS v(k)) AS v WHERE (c_custkey + k) % 50 > 0", c=fx.CUSTOMER)


for kind, bands, name in (
    ("seo", "audit", "q1_seo_score"), ("geo", "audit", "q1_geo_score"), ("technical_seo", "technical", "q2_technical_seo"), ("technical_geo", "technical", "q2_technical_geo"), ("geo_report", "report", "q3_geo_report"),
    ("content_seo", "audit", "q4_content_seo"), ("content_geo", "audit", "q4_content_geo"), ("brand", "brand", "q5_brand_authority"), ("llmstxt", "tier", "q7_llmstxt_quality"), ("ai_search", "tier", "q18_ai_search"),
):
    declare(name, p.composite_score(scores=scores_for(kind), kind=kind, bands=bands))

TOPIC_PAGES = fx.shaped("fixture_topic_pages", "SELECT c_custkey AS domain, c_custkey % 30 AS pages FROM @c@", c=fx.CUSTOMER)
HISTORY = fx.shaped("fixture_history", "SELECT o_custkey % 100 AS domain, o_orderpriority AS category, CAST(o_orderdate AS DATE) AS audit_date, o_orderkey AS id, CAST(o_orderkey * 7 % 101 AS BIGINT) AS score FROM @o@", o=fx.ORDERS)
LOG = fx.shaped("fixture_visibility", "SELECT user_id % 10 AS cluster, event_type AS platform, CASE event_id % 5 WHEN 0 THEN 'first' WHEN 1 THEN 'mentioned' WHEN 2 THEN 'cited' ELSE 'none' END AS mention FROM @e@", e=fx.EVENTS)
SENTIMENT = fx.shaped("fixture_sentiment", "SELECT user_id % 12 AS topic, event_type || CAST(user_id % 3 AS STRING) AS source, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS positive, CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END AS negative, CASE WHEN event_id % 3 = 2 THEN 1 ELSE 0 END AS neutral FROM @e@", e=fx.EVENTS)
ANALYSES = fx.shaped("fixture_analyses", "SELECT p_partkey AS id, p_partkey % 60 AS positive, 30 AS negative, CASE WHEN p_partkey % 4 = 0 THEN 5 ELSE 70 - p_partkey % 60 END AS neutral, p_partkey % 20 AS topics, p_partkey % 7 AS themes, p_partkey % 2 AS quotes, p_partkey % 5 AS sources FROM @p@", p=fx.PART)
FOUND = fx.shaped("fixture_found_items", "SELECT event_type AS source FROM @e@ WHERE event_type <> 'error'", e=fx.EVENTS)
WANTED = fx.shaped("fixture_wanted_sources", "SELECT DISTINCT event_type AS source, event_type = 'view' AS is_limited FROM @e@", e=fx.EVENTS)
BUDGET = fx.shaped("fixture_budget_items", "SELECT doc_id AS id, 1 + doc_id % 3 AS relevance, CAST(n_chars / 6 AS BIGINT) AS words FROM (SELECT doc_id, n_chars - n_chars % 6 AS n_chars FROM @d@) AS d", d=fx.DOCUMENTS)
PROSPECTS = fx.shaped("fixture_prospects", "SELECT c_custkey AS id, c_name AS company, CASE c_mktsegment WHEN 'BUILDING' THEN 'active' WHEN 'AUTOMOBILE' THEN 'proposal' WHEN 'MACHINERY' THEN 'audit' WHEN 'HOUSEHOLD' THEN 'lead' ELSE 'lost' END AS status, CAST(c_custkey * 7 % 101 AS BIGINT) AS geo_score, c_acctbal AS monthly_value FROM @c@", c=fx.CUSTOMER)
PHASES = fx.shaped("fixture_phases", "SELECT l_orderkey % 300 AS domain, l_linenumber AS phase_order, 'phase ' || CAST(l_linenumber AS STRING) AS phase, max(l_quantity) > 40 AS done, min(l_quantity) < 10 AS has_artefact FROM @l@ GROUP BY l_orderkey % 300, l_linenumber", l=fx.LINEITEM)
CHECKS = fx.shaped("fixture_checks", "SELECT c_custkey AS domain, n AS check_name, (c_custkey + k) % 3 > 0 AS passed FROM @c@ CROSS JOIN (SELECT * FROM (VALUES (0, 'https'), (1, 'hsts'), (2, 'viewport'), (3, 'ssr')) AS v(k, n)) AS v", c=fx.CUSTOMER)
POINTS = fx.shaped("fixture_points", "SELECT * FROM (VALUES ('https', 'security', 'seo', 40), ('hsts', 'security', 'seo', 20), ('viewport', 'mobile', 'seo', 30), ('ssr', 'rendering', 'geo', 60), ('https', 'security', 'geo', 30)) AS v(check_name, category, mode, points)")
LENSES = fx.shaped("fixture_lenses", "SELECT p_partkey AS id, p_partkey % 11 AS l1, p_partkey * 3 % 11 AS l2, p_partkey * 5 % 11 AS l3, p_partkey * 7 % 11 AS l4, p_size % 11 AS l5 FROM @p@", p=fx.PART)
FLAGS = fx.shaped("fixture_flags", "SELECT c_custkey AS id, c_custkey % 2 = 0 AS has_api, c_custkey % 3 = 0 AS has_search, c_custkey % 5 = 0 AS has_browser FROM @c@", c=fx.CUSTOMER)
SEEDS = fx.shaped("fixture_seeds", "SELECT 'What is ' || CAST(p_partkey AS STRING) || '?' AS question FROM @p@ WHERE p_partkey < 5", p=fx.PART)
QUESTIONS = fx.shaped("fixture_question_edges", "SELECT 'What is ' || CAST(p_partkey AS STRING) || '?' AS parent, 'what is ' || CAST((p_partkey * 3 + k) % 500 AS STRING) AS question FROM @p@ CROSS JOIN (SELECT * FROM (VALUES (1), (2), (3)) AS v(k)) AS v", p=fx.PART)

ROOTS = fx.shaped("fixture_question_roots", "SELECT n_nationkey AS place, 'What is ' || CAST(n_nationkey * 31 % 500 AS STRING) || '?' AS question FROM @n@", n=fx.scan("nation"))
ASKED = fx.shaped("fixture_asked", "SELECT 'What is ' || CAST(p_partkey AS STRING) || '?' AS parent, k AS place, 'What is   ' || CAST((p_partkey * 3 + k * k) % 500 AS STRING) || CASE WHEN k = 2 THEN '!' ELSE '?' END AS question FROM @p@ CROSS JOIN (SELECT * FROM (VALUES (1), (2), (3)) AS v(k)) AS v", p=fx.PART)

declare("q4_authority_modifier", p.authority_modifier(composite=p.composite_score(scores=scores_for("content_geo"), kind="content_geo"), pages=TOPIC_PAGES))
declare("q6_platform_readiness", p.platform_readiness(scores=scores_for("geo_report")))
declare("q8_delta_report", p.delta_report(history=HISTORY))
declare("q9_visibility_score", p.visibility_score(log=LOG))
declare("q10_sentiment", p.sentiment(items=SENTIMENT))
declare("q11_analysis_checks", p.analysis_checks(analyses=ANALYSES))
declare("q12_source_coverage", p.source_coverage(items=FOUND, sources=WANTED))
declare("q13_corpus_budget", replace(p.corpus_budget(items=BUDGET), kernel=lambda given: p.fit_corpus(given["items"])))
declare("q14_capability", p.capability(flags=FLAGS))
declare("q15_next_phase", p.next_phase(phases=PHASES))
declare("q16_question_tree", p.question_tree(seeds=SEEDS, edges=QUESTIONS, depth=5))
declare("q16_question_forest", replace(q.questions_in_turn(seeds=ROOTS, edges=ASKED, depth=4), kernel=lambda given: q.question_forest(given["seeds"], given["edges"], 4)))
declare("q17_check_points", p.check_points(checks=CHECKS, points=POINTS))
declare("q19_lens_score", p.lens_score(texts=LENSES))
declare("q20_brand_sentiment", p.sentiment(items=SENTIMENT, high=20, medium=5))
declare("q21_sales_forecast", p.sales_forecast(prospects=PROSPECTS))
declare("p1_crm_stats", p.crm_stats(prospects=PROSPECTS))
declare("p2_p5_p6_prospect_tiers", p.prospect_tiers(prospects=PROSPECTS))
declare("p3_dashboard", replace(p.dashboard(prospects=PROSPECTS), kernel=lambda given: p.dashboard_places(given["prospects"])))
declare("p4_pipeline_by_status", p.pipeline_by_status(prospects=PROSPECTS))
