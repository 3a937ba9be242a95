"""Queries of the search-performance operators."""

from __future__ import annotations

from dataclasses import replace

from lodestar.operators import search as s
from lodestar.plans import fixtures as fx
from lodestar.plans.registry import declare

MONTHLY = s.aggregate_monthly(gsc=fx.PAGE_MONTH)
RECENT = s.period_filter(monthly=MONTHLY, period_months=12)
DECAY = s.detect_decay(monthly=RECENT)
ANOMALIES = s.detect_anomalies(monthly=RECENT)
# the update dates lie years after the ship dates of the data; months are moved so that they meet
_LATER = "SELECT page, CAST(CAST(substr(month, 1, 4) AS INT) + 24 AS STRING) || substr(month, 5) AS month, clicks, impressions, position, ctr FROM @m@"
LATER = fx.shaped("later_months", _LATER, m=MONTHLY)
LATER_RECENT = s.period_filter(monthly=LATER, period_months=18)
LATER_DECAY = s.detect_decay(monthly=LATER_RECENT)
LATER_ANOMALIES = s.detect_anomalies(monthly=LATER_RECENT)
UPDATES = s.correlate_updates(months=LATER_RECENT)
PATTERNS = s.classify_pattern(decay=LATER_DECAY, monthly=LATER_RECENT, anomalies=LATER_ANOMALIES)
REPORT = s.decay_report(decay=LATER_DECAY, patterns=PATTERNS, updates=UPDATES, anomalies=LATER_ANOMALIES)
STRIKING = s.striking_distance(gsc=fx.QUERY_PAGE, crawl=fx.PART_PAGES)
SOV = s.share_of_voice(rankings=fx.RANKINGS)
TRAFFIC = fx.shaped("fixture_traffic", "SELECT domain, CAST(sum(volume) AS BIGINT) AS traffic, CAST(count(*) AS BIGINT) AS keywords FROM @r@ GROUP BY domain", r=fx.RANKINGS)
PRIORITY = fx.shaped(
    "fixture_priority",
    """SELECT page, clicks, impressions, CAST(partkey % 50 AS BIGINT) AS inlinks, CAST(partkey * 7 % 1000 AS DOUBLE) AS revenue, CAST(partkey % 1500 AS BIGINT) AS word_count, CAST(partkey % 100 AS DOUBLE) AS decay_risk
    FROM (SELECT page, partkey, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions FROM @g@ GROUP BY page, partkey) AS p""",
    g=fx.QUERY_PAGE,
)
ISSUES = fx.shaped("fixture_issues", "SELECT p_name AS issue, CAST(p_partkey * 7 % 101 AS BIGINT) AS impact, CAST(p_partkey * 11 % 101 AS BIGINT) AS effort, CAST(p_partkey * 17 % 101 AS BIGINT) AS urgency FROM @p@", p=fx.PART)
EVEN = fx.shaped("fixture_suggestions", "SELECT keyword, volume, difficulty, row_id FROM @k@ WHERE row_id % 3 < 2", k=fx.KEYWORDS)
THIRD = fx.shaped("fixture_related", "SELECT upper(keyword) AS keyword, volume, difficulty, row_id FROM @k@ WHERE row_id % 3 > 0", k=fx.KEYWORDS)
HEADINGS = fx.shaped(
    "fixture_headings",
    "SELECT o_custkey AS page, CASE WHEN o_orderkey % 4 = 0 THEN 'H3: ' WHEN o_orderkey % 7 = 0 THEN 'H1: ' ELSE 'H2: ' END || CASE WHEN o_orderkey % 2 = 0 THEN 'The ' ELSE 'about ' END || o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN '?' ELSE '' END AS heading FROM @o@",
    o=fx.ORDERS,
)
SERP_TITLES = fx.shaped("fixture_serp_titles", "SELECT p_name || CASE WHEN p_partkey % 9 = 0 THEN ' guide' WHEN p_partkey % 9 = 1 THEN ' price' ELSE '' END AS keyword, p_partkey % 10 = 0 AS has_snippet, CASE WHEN p_partkey % 3 = 0 THEN 'top ten ' ELSE 'all what ' END || lower(p_type) AS titles FROM @p@", p=fx.PART)
CONTENTS = fx.shaped("fixture_contents", "SELECT keyword, url, rank AS position, CAST(rank * 137 % 2500 AS BIGINT) AS word_count, 'Title ' || url AS title, 'H2: ' || url AS headings FROM @s@", s=fx.SERP)
BY_URL = fx.shaped("fixture_contents_by_url", "SELECT url, max(word_count) AS word_count, max(headings) AS headings FROM @c@ WHERE word_count > 400 GROUP BY url", c=CONTENTS)
FEATURES = fx.shaped("fixture_features", "SELECT p_type AS feature, p_brand AS product, p_size > 25 AS present FROM @p@", p=fx.PART)

declare("a1_keyword_in_text", fx.shaped("a1", lambda d: f"SELECT p_partkey, {s.keyword_in_text(d, 'p_brand', '''p_brand || ' is here' ''')} AS at_start, {s.keyword_in_text(d, 'p_name', 'p_type || p_name')} AS within, {s.keyword_in_text(d, 'p_name', 'p_type || p_name', False)} AS substring, {s.keyword_in_text(d, '''p_brand || '++' ''', '''p_brand || '++ now' ''')} AS escaped FROM @p@", p=fx.PART))
declare("a2_keyword_in_url", fx.shaped("a2", lambda d: f"SELECT p_partkey, {s.keyword_in_url(d, 'p_type', '''concat('https://x.test/', replace(p_type, ' ', '-'), '/1?q=', p_name)''')} AS in_path, {s.keyword_in_url(d, 'p_name', '''concat('https://x.test/', replace(p_type, ' ', '_'), '/1?q=', p_name)''')} AS in_query FROM @p@", p=fx.PART))
declare("a3_striking_distance", STRIKING)
declare("a4_multi_keyword_pages", s.multi_keyword_pages(striking=STRIKING))
declare("a5_striking_summary", s.striking_summary(striking=STRIKING))
declare("a6_quick_win_score", s.quick_wins(gsc=fx.QUERY_PAGE, min_impressions=1000, max_ctr=0.05))
declare("a7_monthly_agg", MONTHLY)
declare("a8_period_filter", RECENT)
declare("a9_detect_decay", DECAY)
declare("a10_anomalies", s.detect_anomalies(monthly=MONTHLY))
declare("a11_update_correlation", UPDATES)
declare("a12_decay_patterns", PATTERNS)
declare("a13_content_decay", REPORT)
declare("a14_growing", s.growing_pages(monthly=RECENT, decay=DECAY))
declare("a15_update_impact", s.update_impact(report=REPORT))
declare("a16_monthly_trend", s.monthly_trend(monthly=MONTHLY))
declare("a17_decay_summary", s.decay_summary(report=REPORT, all_pages=LATER))
declare("a18_share_of_voice", SOV)
declare("a19_extended_ctr_curve", s.share_of_voice(rankings=fx.RANKINGS, model="awr", top_n=25))
declare("a20_sov_keywords", s.sov_keyword_breakdown(rankings=fx.RANKINGS))
declare("a21_sov_distribution", s.sov_distribution(sov=SOV))
declare("a22_sov_meta", replace(s.sov_meta(rankings=fx.RANKINGS), kernel=lambda given: fx.totals_of_rankings(given["lineitem"], given["supplier"]), kernel_inputs=fx.RANKING_INPUTS))
declare("a23_simple_sov", s.simple_sov(traffic=TRAFFIC))
declare("a24_a25_keyword_intents", s.keyword_intents(keywords=fx.KEYWORDS))
declare("a26_keyword_discovery", s.keyword_discovery(suggestions=EVEN, related=THIRD))
declare("a27_serp_intent", s.serp_intent(serp=SERP_TITLES))
declare("a28_serp_word_counts", s.serp_word_counts(contents=CONTENTS))
declare("a29_topic_frequency", s.topic_frequency(headings=HEADINGS))
declare("a30_heading_patterns", s.heading_patterns(headings=HEADINGS))
declare("a31_detect_region", s.detect_region(keywords=fx.KEYWORDS))
declare("a32_research_assemble", s.research_assemble(serp=CONTENTS, contents=BY_URL, related=CONTENTS, depth=5))
declare("a33_query_intent_groups", s.query_intent_groups(keywords=fx.KEYWORDS))
declare("a34_cannibalization_by_query", s.cannibalization_by_query(gsc=fx.QUERY_PAGE))
declare("a35_page_priority", s.page_priority(pages=PRIORITY))
declare("a36_issue_priority", s.issue_priority(issues=ISSUES))
declare("a37_keyword_gap", s.keyword_gap(rankings=fx.RANKINGS, own="Supplier#000000001", competitor="Supplier#000000002"))
declare("a38_comparison_keywords", s.comparison_keywords(keywords=fx.KEYWORDS))
declare("a39_page_intersection", s.page_intersection(rankings=fx.RANKINGS, a="Supplier#000000001", b="Supplier#000000002"))
declare("a40_keyword_profile", s.keyword_profile(rankings=fx.RANKINGS, domain="Supplier#000000001"))
declare("a41_feature_matrix", s.feature_matrix(features=FEATURES, products=("Brand#1", "Brand#2", "Brand#11", "Brand#12")))
