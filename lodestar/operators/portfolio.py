"""Composite scores, client portfolio, monitoring, sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.order import place_in, running_sum
from lodestar.plans.dialect import Duck, operator, values

# Category weights of the composite scores.
WEIGHTS = {
    "seo": {"technical": 0.22, "content": 0.23, "onpage": 0.20, "schema": 0.10, "cwv": 0.10, "aisearch": 0.10, "images": 0.05},
    "geo": {"citability": 0.25, "brand": 0.20, "eeat": 0.20, "technical": 0.15, "schema": 0.10, "platform": 0.10},
    "geo_report": {"platform": 0.25, "content": 0.25, "technical": 0.20, "schema": 0.15, "brand": 0.15},
    "technical_seo": {"crawlability": 0.12, "indexability": 0.12, "security": 0.08, "url": 0.06, "mobile": 0.15, "cwv": 0.18, "ssr": 0.05, "schema": 0.08, "javascript": 0.08, "indexnow": 0.08},
    "technical_geo": {"crawlability": 0.16, "indexability": 0.08, "security": 0.05, "url": 0.04, "mobile": 0.06, "cwv": 0.08, "ssr": 0.20, "schema": 0.09, "javascript": 0.16, "indexnow": 0.08},
    "content_seo": {"keywords": 0.25, "readability": 0.20, "eeat": 0.25, "structure": 0.15, "links": 0.15},
    "content_geo": {"extractability": 0.25, "eeat": 0.25, "entities": 0.20, "passages": 0.15, "freshness": 0.15},
    "brand": {"youtube": 0.25, "reddit": 0.25, "wikipedia": 0.20, "linkedin": 0.15, "other": 0.15},
    "llmstxt": {"completeness": 0.40, "accuracy": 0.35, "usefulness": 0.25},
    "ai_search": {"citability": 0.25, "structure": 0.20, "multimodal": 0.15, "authority": 0.20, "technical": 0.20},
}
# Least score of each band, highest first.
BANDS = {
    "audit": [(90, "Excellent"), (75, "Good"), (60, "Fair"), (40, "Poor"), (0, "Critical")],
    "technical": [(90, "Excellent"), (70, "Good"), (50, "Needs Work"), (30, "Poor"), (0, "Critical")],
    "brand": [(85, "Dominant"), (70, "Strong"), (50, "Moderate"), (30, "Weak"), (0, "Minimal")],
    "report": [(85, "Excellent"), (70, "Good"), (55, "Moderate"), (40, "Below Average"), (0, "Needs Attention")],
    "tier": [(80, "Excellent"), (60, "Good"), (40, "Fair"), (0, "Poor")],
    "platform": [(70, "Strong"), (40, "Moderate"), (0, "Weak")],
    "service": [(61, "Basic"), (41, "Standard"), (0, "Premium")],
}


def band(score: str, name: str) -> str:
    cases = " ".join(f"WHEN {score} >= {least} THEN '{label}'" for least, label in BANDS[name])
    return f"CASE {cases} END"


@operator
def composite_score(d: Duck, kind: str = "seo", bands: str = "audit") -> str:
    """Q1-Q5, Q7, Q18. Weighted score by domain of ``scores`` (domain, category, score); a missing category makes it incomplete."""
    weights = WEIGHTS[kind]
    return f"""
SELECT domain, round(score, 2) AS score, {band('round(score, 2)', bands)} AS rating, categories < {len(weights)} AS incomplete FROM (
  SELECT s.domain, round(sum(s.score * w.weight), 8) AS score, CAST(count(*) AS BIGINT) AS categories FROM @scores@ s JOIN {values(list(weights.items()), "category, weight")} AS w ON s.category = w.category GROUP BY s.domain) AS t"""


@operator
def authority_modifier(d: Duck) -> str:
    """Q4. ``composite`` (domain, score) with the bonus for the number of pages on the topic (``pages``: domain, pages), 100 at most."""
    return """
SELECT c.domain, least(100e0, c.score + CASE WHEN p.pages >= 20 THEN 10 WHEN p.pages >= 10 THEN 5 WHEN p.pages >= 5 THEN 0 ELSE -5 END) AS score FROM @composite@ c JOIN @pages@ p ON c.domain = p.domain"""


@operator
def platform_readiness(d: Duck) -> str:
    """Q6. Mean of the platform scores of ``scores`` (domain, score)."""
    return f"SELECT domain, round(mean, 1) AS score, {band('mean', 'platform')} AS rating FROM (SELECT domain, round(avg(score), 6) AS mean FROM @scores@ GROUP BY domain) AS t"


@operator
def delta_report(d: Duck) -> str:
    """Q8. Newest against oldest score of each (domain, category) of ``history`` (domain, category, audit_date, score), and the trend."""
    return """
SELECT domain, category, baseline, latest, latest - baseline AS delta, CASE WHEN latest - baseline >= 5 THEN 'improved' WHEN latest - baseline >= 1 THEN 'slightly_up' WHEN latest - baseline > -1 THEN 'stable' WHEN latest - baseline > -5 THEN 'slightly_down' ELSE 'declined' END AS trend
FROM (SELECT domain, category, max(CASE WHEN a = 1 THEN score END) AS baseline, max(CASE WHEN z = 1 THEN score END) AS latest FROM (
  SELECT *, row_number() OVER (PARTITION BY domain, category ORDER BY audit_date, id) AS a, row_number() OVER (PARTITION BY domain, category ORDER BY audit_date DESC, id DESC) AS z FROM @history@) AS r GROUP BY domain, category) AS t"""


@operator
def visibility_score(d: Duck) -> str:
    """Q9. Points (3 first, 2 mentioned, 1 cited) over three for each prompt of ``log`` (cluster, platform, mention)."""
    return """
SELECT cluster, platform, CAST(count(*) AS BIGINT) AS prompts, round(sum(CASE mention WHEN 'first' THEN 3 WHEN 'mentioned' THEN 2 WHEN 'cited' THEN 1 ELSE 0 END) * 100e0 / (3 * count(*)), 2) AS visibility
FROM @log@ GROUP BY cluster, platform"""


@operator
def sentiment(d: Duck, high: int = 5, medium: int = 3) -> str:
    """Q10, Q20. Overall sentiment by topic of ``items`` (topic, source, positive, negative, neutral; 0 or 1): sources weighted by number of items, sum 100."""
    share = lambda c: f"sum({c} * 100e0 / n * w) / sum(w)"
    fix = lambda c, wins: f"CASE WHEN {wins} THEN {c} + 100 - (p + m + z) ELSE {c} END"
    return f"""
SELECT topic, CAST({fix('p', 'p >= m AND p >= z')} AS BIGINT) AS positive, CAST({fix('m', 'm > p AND m >= z')} AS BIGINT) AS negative, CAST({fix('z', 'z > p AND z > m')} AS BIGINT) AS neutral FROM (
  SELECT topic, round(round({share('pos')}, 6)) AS p, round(round({share('neg')}, 6)) AS m, round(round({share('neu')}, 6)) AS z FROM (
    SELECT topic, source, sum(positive) AS pos, sum(negative) AS neg, sum(neutral) AS neu, count(*) AS n, CASE WHEN count(*) >= {high} THEN 10e-1 WHEN count(*) >= {medium} THEN 7e-1 ELSE 4e-1 END AS w
    FROM @items@ GROUP BY topic, source) AS s GROUP BY topic) AS t"""


@operator
def analysis_checks(d: Duck) -> str:
    """Q11. Decidable checks of ``analyses`` (id, positive, negative, neutral, topics, themes, quotes, sources)."""
    return """
SELECT id, positive + negative + neutral = 100 AS sums_to_100, topics BETWEEN 8 AND 15 AS topics_ok, themes BETWEEN 3 AND 5 AS themes_ok, quotes >= 1 AS has_quotes, sources >= 3 AS enough_sources FROM @analyses@"""


@operator
def source_coverage(d: Duck) -> str:
    """Q12. Items of ``items`` (source) against the wanted ``sources`` (source, is_limited)."""
    return """
SELECT s.source, CAST(count(i.source) AS BIGINT) AS items, CASE WHEN count(i.source) = 0 THEN 'missing' WHEN count(i.source) >= 5 AND NOT s.is_limited THEN 'covered' ELSE 'thin' END AS coverage
FROM @sources@ s LEFT JOIN @items@ i ON s.source = i.source GROUP BY s.source, s.is_limited"""


@operator
def corpus_budget(d: Duck, most: int = 80_000) -> str:
    """Q13. ``items`` (id, relevance 1-3, words) in order of relevance while the words of all before fit the budget; top relevance always stays."""
    return f"""
SELECT id, relevance, words, relevance = 1 OR upto <= {most} AS kept FROM (SELECT *, CAST(sum(words) OVER (ORDER BY relevance, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto FROM @items@) AS t"""


def fit_corpus(items: DataFrame, most: int = 80_000) -> DataFrame:
    """Q13 by range-sorted running sums: rows as of ``corpus_budget``."""
    summed = running_sum(items.select("id", "relevance", "words"), [F.col("relevance"), F.col("id")], F.col("words").cast("bigint"), "upto")
    return summed.select("id", "relevance", "words", ((F.col("relevance") == 1) | (F.col("upto") <= most)).alias("kept"))


@operator
def crm_stats(d: Duck) -> str:
    """P1. Totals over ``prospects`` (id, status, monthly_value, geo_score)."""
    return f"""
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count_if(status = 'active') AS BIGINT) AS active, round(coalesce(sum(CASE WHEN status = 'active' THEN monthly_value END), 0), 2) AS mrr,
  round(coalesce(sum(CASE WHEN status = 'proposal' THEN monthly_value END), 0), 2) AS pipeline, CAST({d.half_even('avg(geo_score)')} AS BIGINT) AS avg_score FROM @prospects@"""


@operator
def prospect_tiers(d: Duck) -> str:
    """P2, P5, P6. Tier, report label and service tier of each prospect by its score."""
    return f"SELECT id, geo_score, {band('geo_score', 'tier')} AS tier, {band('geo_score', 'report')} AS label, {band('geo_score', 'service')} AS service FROM @prospects@"


@operator
def dashboard(d: Duck, status: str = "active") -> str:
    """P3. Prospects of a status with their places by score, company and value."""
    return f"""
SELECT id, company, CAST(row_number() OVER (ORDER BY geo_score, id) AS BIGINT) AS by_score, CAST(row_number() OVER (ORDER BY lower(company), id) AS BIGINT) AS by_company, CAST(row_number() OVER (ORDER BY monthly_value DESC, id) AS BIGINT) AS by_value FROM @prospects@ WHERE status = '{status}'"""


def dashboard_places(prospects: DataFrame, status: str = "active") -> DataFrame:
    """P3 by range sorting: rows as of ``dashboard``."""
    rows = prospects.filter(F.col("status") == status).select("id", "company", "geo_score", "monthly_value")
    for to, order in (("by_score", [F.col("geo_score"), F.col("id")]), ("by_company", [F.lower("company"), F.col("id")]), ("by_value", [F.col("monthly_value").desc(), F.col("id")])):
        rows = place_in(rows, order, to)
    return rows.select("id", "company", "by_score", "by_company", "by_value")


@operator
def pipeline_by_status(d: Duck) -> str:
    """P4. Prospects and value by status, in the order of the pipeline."""
    order = values([(1, "lead"), (2, "audit"), (3, "proposal"), (4, "active"), (5, "churned"), (6, "lost")], "place, status")
    return f"""
SELECT o.place, o.status, CAST(count(p.id) AS BIGINT) AS prospects, round(coalesce(sum(p.monthly_value), 0), 2) AS value FROM {order} AS o LEFT JOIN @prospects@ p ON o.status = p.status GROUP BY o.place, o.status"""


@operator
def sales_forecast(d: Duck) -> str:
    """Q21. Committed and pipeline value of ``prospects``, and a year of both."""
    return """
SELECT round(won, 2) AS committed_mrr, round(likely, 2) AS pipeline_mrr, round((won + likely) * 12, 2) AS annual FROM (
  SELECT coalesce(sum(CASE WHEN status = 'active' THEN monthly_value END), 0) AS won, coalesce(sum(CASE WHEN status IN ('audit', 'proposal') THEN monthly_value END), 0) AS likely FROM @prospects@) AS t"""


@operator
def next_phase(d: Duck) -> str:
    """Q15. First pending phase of each project (``phases``: domain, phase_order, phase, done, has_artefact) and phases whose artefact belies their state."""
    return """
SELECT domain, max(CASE WHEN n = 1 THEN phase END) AS next_phase, CAST(sum(CASE WHEN has_artefact AND NOT done THEN 1 ELSE 0 END) AS BIGINT) AS drifted FROM (
  SELECT *, CASE WHEN done THEN NULL ELSE row_number() OVER (PARTITION BY domain, done ORDER BY phase_order) END AS n FROM @phases@) AS p GROUP BY domain"""


@operator
def check_points(d: Duck) -> str:
    """Q17. Points of passed checks (``checks``: domain, check_name, passed) by category and mode, from ``points`` (check_name, category, mode, points)."""
    return """
SELECT c.domain, p.category, p.mode, CAST(sum(CASE WHEN c.passed THEN p.points ELSE 0 END) AS BIGINT) AS score, CAST(sum(p.points) AS BIGINT) AS most FROM @checks@ c JOIN @points@ p ON c.check_name = p.check_name GROUP BY c.domain, p.category, p.mode"""


@operator
def lens_score(d: Duck) -> str:
    """Q19. Five judged lenses (``texts``: id, l1-l5, 0-10 each) as a percentage with its band."""
    return f"SELECT id, score, {band('score', 'tier')} AS rating FROM (SELECT id, (l1 + l2 + l3 + l4 + l5) * 2e0 AS score FROM @texts@) AS t"


@operator
def capability(d: Duck) -> str:
    """Q14. Tier and mode of each set of flags in ``flags`` (id, has_api, has_search, has_browser)."""
    return """
SELECT id, CASE WHEN has_api AND has_search THEN 3 WHEN has_api OR has_search THEN 2 ELSE 1 END AS tier, CASE WHEN has_api AND has_search THEN 'full' WHEN has_api THEN 'api_only' WHEN has_search THEN 'search_only' ELSE 'fallback' END AS mode FROM @flags@"""


@operator
def question_tree(d: Duck, depth: int = 5) -> str:
    """Q16. Questions reachable from ``seeds`` (question) over ``edges`` (parent, question), each at its least depth (equal questions once)."""
    key = lambda c: d.sub(f"lower(trim({c}))", "[^a-z0-9 ]", "")
    steps = [f"level0 AS (SELECT DISTINCT {key('question')} AS question_key FROM @seeds@)", f"asked AS (SELECT DISTINCT {key('parent')} AS parent_key, {key('question')} AS question_key FROM @edges@)"]
    steps += [f"level{k} AS (SELECT DISTINCT e.question_key FROM level{k - 1} AS t JOIN asked AS e ON e.parent_key = t.question_key)" for k in range(1, depth + 1)]
    levels = " UNION ALL ".join(f"SELECT question_key, {k} AS depth FROM level{k}" for k in range(depth + 1))
    return f"""
WITH {', '.join(steps)}
SELECT question_key, CAST(min(depth) AS BIGINT) AS depth FROM ({levels}) AS t GROUP BY question_key"""
