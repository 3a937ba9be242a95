"""Search-performance operators: decay, share of voice, striking distance, keywords, result pages.

Inputs are named after the data they hold; see each operator for its columns. Empty strings
stand for missing text; nulls in counts count as zero where a sum is taken.
"""

from __future__ import annotations

from lodestar.functions import dims
from lodestar.plans.dialect import Duck, any_of, e, operator, text, values

# --- content decay -----------------------------------------------------------------------


@operator
def aggregate_monthly(d: Duck) -> str:
    """A7. ``gsc`` (page, month, clicks, impressions, ctr, position) to one row per page and month.

    Positions and click rates are plain means over positive values, 0 without any.
    """
    return """
SELECT page, month, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions,
  round(coalesce(avg(CASE WHEN position > 0 THEN position END), 0e0), 1) AS position,
  round(coalesce(avg(CASE WHEN ctr > 0 THEN ctr END), 0e0), 4) AS ctr
FROM @gsc@ GROUP BY page, month"""


@operator
def period_filter(d: Duck, period_months: int = 12) -> str:
    """A8. Rows of ``monthly`` within the last n months that occur in the data; pages with one month go."""
    return f"""
SELECT page, month, clicks, impressions, position, ctr FROM (
  SELECT m.*, count(*) OVER (PARTITION BY page) AS months
  FROM @monthly@ m JOIN (
    SELECT min(month) AS since FROM (SELECT month FROM @monthly@ GROUP BY month ORDER BY month DESC LIMIT {period_months}) AS recent
  ) AS cut ON m.month >= cut.since) AS inside
WHERE months >= 2"""


@operator
def detect_decay(d: Duck, min_decline: float = 30.0, min_peak: int = 50) -> str:
    """A9. Pages of ``monthly`` whose last month lies at least ``min_decline`` percent below the peak (first on ties)."""
    return f"""
SELECT page, peak_month, peak_clicks, current_month, current_clicks, round(decline, 1) AS decline_percentage, peak_clicks - current_clicks AS traffic_lost,
  CASE WHEN decline >= 80 THEN 'Critical' WHEN decline >= 50 THEN 'High' WHEN decline >= 30 THEN 'Medium' ELSE 'Low' END AS severity
FROM (SELECT *, (peak_clicks - current_clicks) / CAST(peak_clicks AS DOUBLE) * 100 AS decline FROM (
  SELECT page, max(CASE WHEN top = 1 THEN month END) AS peak_month, max(clicks) AS peak_clicks,
    max(month) AS current_month, max(CASE WHEN late = 1 THEN clicks END) AS current_clicks
  FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY clicks DESC, month) AS top,
    row_number() OVER (PARTITION BY page ORDER BY month DESC) AS late FROM @monthly@) AS ranked
  GROUP BY page) AS ends WHERE peak_clicks >= {min_peak} AND peak_clicks > 0) AS rated
WHERE decline >= {e(min_decline)}"""


@operator
def detect_anomalies(d: Duck, window: int = 3, std: float = 2.0) -> str:
    """A10. Months of ``monthly`` that fall below the trailing average by far more than usual for the page."""
    return f"""
SELECT page, month, clicks, round(delta, 1) AS delta, round(rolling_before, 1) AS rolling_avg_before,
  round(CASE WHEN previous > 0 THEN (previous - clicks) / CAST(previous AS DOUBLE) * 100 ELSE 0e0 END, 1) AS drop_percentage
FROM (
  SELECT *, avg(delta) OVER (PARTITION BY page) AS mean, stddev_pop(delta) OVER (PARTITION BY page) AS deviation FROM (
    SELECT *, clicks - rolling_before AS delta FROM (
      SELECT *, lag(rolling) OVER (PARTITION BY page ORDER BY month) AS rolling_before, lag(clicks) OVER (PARTITION BY page ORDER BY month) AS previous FROM (
        SELECT page, month, clicks, count(*) OVER (PARTITION BY page) AS months, CASE WHEN row_number() OVER (PARTITION BY page ORDER BY month) >= {window}
          THEN avg(clicks) OVER (PARTITION BY page ORDER BY month ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) END AS rolling
        FROM @monthly@) AS a WHERE months >= {window + 1}) AS b) AS c) AS f
WHERE delta < mean - {e(std)} * CASE WHEN deviation > 0 THEN deviation ELSE 1e0 END"""


@operator
def correlate_updates(d: Duck) -> str:
    """A11. For each month of ``months`` the first listed update from 28 days before its first day to 31 days after."""
    updates = values([(i, *u) for i, u in enumerate(dims.UPDATES)], "ordinal, update_name, update_date, update_type")
    gap = d.days(d.date("month || '-01'"), d.date("update_date"))
    return f"""
SELECT month, update_name, update_date, update_type FROM (
  SELECT month, update_name, update_date, update_type, row_number() OVER (PARTITION BY month ORDER BY ordinal) AS n
  FROM (SELECT DISTINCT month FROM @months@) AS m JOIN {updates} AS u ON {gap} BETWEEN -31 AND 28) AS hits WHERE n = 1"""


@operator
def classify_pattern(d: Duck) -> str:
    """A12. Pattern of each page in ``decay``, from its series in ``monthly`` and its ``anomalies``."""
    return """
SELECT q.page, CASE WHEN months < 3 THEN 'gradual'
  WHEN c1 > c2 AND c2 > c3 AND c1 < q.peak_clicks THEN 'recovering'
  WHEN coalesce(worst, 0) > 40 THEN 'sudden_drop'
  WHEN months >= 15 AND year_ago > 0 AND recent / year_ago BETWEEN 7e-1 AND 13e-1 THEN 'seasonal' ELSE 'gradual' END AS pattern
FROM @decay@ q
JOIN (SELECT page, count(*) AS months, max(CASE WHEN late = 1 THEN clicks END) AS c1, max(CASE WHEN late = 2 THEN clicks END) AS c2, max(CASE WHEN late = 3 THEN clicks END) AS c3,
    sum(CASE WHEN late <= 3 THEN clicks END) / 3e0 AS recent, sum(CASE WHEN late BETWEEN 13 AND 15 THEN clicks END) / 3e0 AS year_ago
  FROM (SELECT page, clicks, row_number() OVER (PARTITION BY page ORDER BY month DESC) AS late FROM @monthly@) AS r GROUP BY page) AS s ON q.page = s.page
LEFT JOIN (SELECT page, max(drop_percentage) AS worst FROM @anomalies@ GROUP BY page) AS a ON q.page = a.page"""


@operator
def decay_report(d: Duck) -> str:
    """A13. ``decay`` with ``patterns`` and the first ``updates`` hit over peak month, then anomaly months."""
    return """
SELECT q.page, q.peak_month, q.peak_clicks, q.current_month, q.current_clicks, q.decline_percentage, q.traffic_lost, q.severity, p.pattern, u.update_name
FROM @decay@ q JOIN @patterns@ p ON q.page = p.page
LEFT JOIN (SELECT page, update_name FROM (
  SELECT t.page, h.update_name, row_number() OVER (PARTITION BY t.page ORDER BY t.place, t.month) AS n
  FROM (SELECT page, peak_month AS month, 0 AS place FROM @decay@ UNION ALL SELECT page, month, 1 AS place FROM @anomalies@) AS t
  JOIN @updates@ h ON t.month = h.month) AS hits WHERE n = 1) AS u ON q.page = u.page"""


@operator
def growing_pages(d: Duck, least: float = 10.0, top: int = 20) -> str:
    """A14. Pages of ``monthly`` outside ``decay`` with at least three months that grew over the last two."""
    return f"""
SELECT page, clicks_before, clicks_now, round(growth, 1) AS growth_percentage FROM (
  SELECT page, clicks_before, clicks_now, (clicks_now - clicks_before) / CAST(clicks_before AS DOUBLE) * 100 AS growth FROM (
    SELECT page, max(CASE WHEN late = 1 THEN clicks END) AS clicks_now, max(CASE WHEN late = 3 THEN clicks END) AS clicks_before
    FROM (SELECT page, clicks, row_number() OVER (PARTITION BY page ORDER BY month DESC) AS late FROM @monthly@) AS r WHERE late <= 3 GROUP BY page) AS s
  WHERE clicks_before > 0 AND page NOT IN (SELECT page FROM @decay@)) AS g
WHERE growth > {e(least)} ORDER BY growth DESC, page LIMIT {top}"""


@operator
def update_impact(d: Duck) -> str:
    """A15. Pages, mean decline and worst page of each update in ``report``."""
    return """
SELECT update_name, CAST(count(*) AS BIGINT) AS pages_affected, round(avg(decline_percentage), 1) AS avg_decline, max(CASE WHEN n = 1 THEN page END) AS worst_page
FROM (SELECT *, row_number() OVER (PARTITION BY update_name ORDER BY decline_percentage DESC, traffic_lost DESC, page) AS n FROM @report@ WHERE update_name IS NOT NULL) AS r
GROUP BY update_name"""


@operator
def monthly_trend(d: Duck) -> str:
    """A16. Clicks of all pages by month, change on the month before and against the peak."""
    return """
SELECT month, clicks, impressions, CASE WHEN previous > 0 THEN round((clicks - previous) / CAST(previous AS DOUBLE) * 100, 1) END AS mom_percentage,
  CASE WHEN peak > 0 THEN round((clicks - peak) / CAST(peak AS DOUBLE) * 100, 1) END AS vs_peak_percentage
FROM (SELECT *, lag(clicks) OVER (ORDER BY month) AS previous, max(clicks) OVER () AS peak FROM (
  SELECT month, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions FROM @monthly@ GROUP BY month) AS m) AS t"""


@operator
def decay_summary(d: Duck) -> str:
    """A17. Counts by severity and pattern over ``report``, and all pages of ``all_pages``."""
    return """
SELECT (SELECT CAST(count(DISTINCT page) AS BIGINT) FROM @all_pages@) AS total_pages, CAST(count(*) AS BIGINT) AS decaying,
  CAST(count_if(severity = 'Critical') AS BIGINT) AS critical, CAST(count_if(severity = 'High') AS BIGINT) AS high, CAST(count_if(severity = 'Medium') AS BIGINT) AS medium,
  CAST(count_if(pattern = 'gradual') AS BIGINT) AS gradual, CAST(count_if(pattern = 'sudden_drop') AS BIGINT) AS sudden_drop,
  CAST(count_if(pattern = 'seasonal') AS BIGINT) AS seasonal, CAST(count_if(pattern = 'recovering') AS BIGINT) AS recovering,
  CAST(coalesce(sum(traffic_lost), 0) AS BIGINT) AS traffic_lost, CAST(count_if(update_name IS NOT NULL) AS BIGINT) AS with_update
FROM @report@"""


# --- striking distance -------------------------------------------------------------------


def keyword_in_text(d: Duck, kw: str, s: str, word_boundary: bool = True) -> str:
    """A1. Keyword in text, lower-cased and trimmed; at word boundaries or as a substring; false if either is empty."""
    k, t = f"lower(trim({kw}))", f"lower(trim({s}))"
    if not word_boundary:
        return f"({k} <> '' AND {t} <> '' AND {d.instr(t, k)} > 0)"
    escaped = d.sub(k, r"([^A-Za-z0-9_ ])", r"\\\1" if d.name == "duckdb" else r"\\$1")
    return f"({k} <> '' AND {t} <> '' AND " + d.like_col(t, f"({d.lit(r'(^|\b)')} || {escaped} || {d.lit(r'(\b|$)')})") + ")"


def keyword_in_url(d: Duck, kw: str, url: str) -> str:
    """A2. Keyword in the path of a url, with - _ / read as spaces."""
    path = d.extract(f"lower({url})", r"^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)")
    return f"({d.instr(f'''translate({path}, '-_/', '   ')''', f'lower(trim({kw}))')} > 0)"


def url_key(url: str) -> str:
    """Lower case without a trailing slash."""
    return f"regexp_replace(lower({url}), '/+$', '')"


@operator
def striking_distance(d: Duck, min_impressions: int = 100, min_position: float = 4, max_position: float = 20, min_opportunity: float = 50) -> str:
    """A3. Queries of ``gsc`` (query, page, impressions, ctr, position) near page one whose keyword is missing on the page.

    ``crawl``: address, title, h1, meta_desc; a page that it lacks has none of them.
    """
    ctr_goal = e(0.085)
    return f"""
SELECT query, page, impressions, ctr, position, round(score, 1) AS opportunity_score, class,
  CASE WHEN ctr >= {ctr_goal} THEN CAST(0 AS BIGINT) ELSE CAST(round(impressions * ({ctr_goal} - ctr)) AS BIGINT) END AS estimated_uplift, in_url
FROM (
  SELECT g.query, g.page, g.impressions, g.ctr, g.position, g.impressions * (1 - g.ctr) / CASE WHEN g.position <= 0 THEN 1e0 ELSE g.position END AS score,
    {keyword_in_url(d, 'g.query', 'g.page')} AS in_url,
    CASE WHEN NOT {keyword_in_text(d, 'g.query', "coalesce(c.title, '')")} AND NOT {keyword_in_text(d, 'g.query', "coalesce(c.h1, '')")} THEN 'BOTH_MISSING'
      WHEN NOT {keyword_in_text(d, 'g.query', "coalesce(c.title, '')")} THEN 'TITLE_MISSING'
      WHEN NOT {keyword_in_text(d, 'g.query', "coalesce(c.h1, '')")} THEN 'H1_MISSING'
      WHEN NOT {keyword_in_text(d, 'g.query', "coalesce(c.meta_desc, '')", False)} THEN 'META_MISSING' ELSE 'PRESENT_ALL' END AS class
  FROM @gsc@ g LEFT JOIN @crawl@ c ON {url_key('g.page')} = {url_key('c.address')}
  WHERE g.position BETWEEN {e(min_position)} AND {e(max_position)} AND g.impressions >= {min_impressions}) AS s
WHERE score >= {e(min_opportunity)} AND class <> 'PRESENT_ALL'"""


@operator
def multi_keyword_pages(d: Duck) -> str:
    """A4. Pages with at least two rows in ``striking``."""
    return """
SELECT page, CAST(count(*) AS BIGINT) AS keyword_count, CAST(sum(impressions) AS BIGINT) AS total_impressions, round(avg(position), 1) AS avg_position
FROM @striking@ GROUP BY page HAVING count(*) >= 2"""


@operator
def striking_summary(d: Duck) -> str:
    """A5. Counts over ``striking``."""
    return """
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count_if(class LIKE '%TITLE%' OR class = 'BOTH_MISSING') AS BIGINT) AS title_missing,
  CAST(count_if(class LIKE '%H1%' OR class = 'BOTH_MISSING') AS BIGINT) AS h1_missing, CAST(count_if(class = 'META_MISSING') AS BIGINT) AS meta_missing,
  CAST(coalesce(sum(estimated_uplift), 0) AS BIGINT) AS estimated_uplift, round(avg(opportunity_score), 1) AS avg_score
FROM @striking@"""


@operator
def quick_wins(d: Duck, min_impressions: int = 1000, max_ctr: float = 0.03) -> str:
    """A6. Rows of ``gsc`` with many impressions, few clicks and a position from 4 to 20, and their score."""
    return f"""
SELECT query, page, impressions, ctr, position, round(impressions * (1 - ctr) / position, 1) AS quick_win_score
FROM @gsc@ WHERE impressions > {min_impressions} AND ctr < {e(max_ctr)} AND position BETWEEN 4 AND 20"""


@operator
def cannibalization_by_query(d: Duck, keyword: str = "", min_impressions: int = 5) -> str:
    """A34. Queries of ``gsc`` that two or more pages rank for; pages in order of position."""
    return f"""
SELECT query, CAST(count(*) AS BIGINT) AS pages, CAST(sum(impressions) AS BIGINT) AS total_impressions, CAST(sum(clicks) AS BIGINT) AS total_clicks,
  max(CASE WHEN n = 1 THEN page END) AS best_page, max(CASE WHEN n = 2 THEN page END) AS second_page
FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY position, page) AS n FROM @gsc@
  WHERE impressions >= {min_impressions} AND {d.instr("lower(query)", text(keyword.lower()))} > 0) AS g
GROUP BY query HAVING count(*) >= 2"""


@operator
def page_priority(d: Duck, top: int = 25) -> str:
    """A35. ``pages`` (page, clicks, impressions, inlinks, revenue, word_count, decay_risk) by weighted score.

    Every measure is scaled to 0-100 by its largest value; without any revenue its weight is shared out.
    """

    def scaled(c: str) -> str:
        return f"CASE WHEN top_{c} > 0 THEN {c} * 100e0 / top_{c} ELSE 0e0 END"

    tops = ", ".join(f"max({c}) AS top_{c}" for c in ("clicks", "impressions", "inlinks", "revenue", "decay_risk"))

    return f"""
SELECT page, round(score, 2) AS priority_score FROM (
  SELECT page, CASE WHEN revenue_max > 0 THEN 30e-2 * c + 20e-2 * i + 15e-2 * l + 20e-2 * r + 5e-2 * w + 10e-2 * k
    ELSE (30e-2 * c + 20e-2 * i + 15e-2 * l + 5e-2 * w + 10e-2 * k) / 80e-2 END AS score
  FROM (SELECT page, {scaled('clicks')} AS c, {scaled('impressions')} AS i, {scaled('inlinks')} AS l, {scaled('revenue')} AS r,
    CASE WHEN word_count > 500 THEN 100e0 ELSE 0e0 END AS w, {scaled('decay_risk')} AS k, top_revenue AS revenue_max FROM @pages@ CROSS JOIN (SELECT {tops} FROM @pages@) AS m) AS s) AS t
ORDER BY score DESC, page LIMIT {top}"""


@operator
def issue_priority(d: Duck) -> str:
    """A36. ``issues`` (issue, impact, effort, urgency; 0-100 each) scored and put into waves and a P1-P4 matrix."""
    return """
SELECT issue, round(score, 2) AS score, CASE WHEN score >= 70 THEN 1 WHEN score >= 50 THEN 2 WHEN score >= 30 THEN 3 ELSE 4 END AS wave,
  CASE WHEN impact >= 50 AND effort < 50 THEN 'P1' WHEN impact >= 50 THEN 'P2' WHEN effort < 50 THEN 'P3' ELSE 'P4' END AS matrix
FROM (SELECT *, 4e-1 * impact + 3e-1 * (100 - effort) + 3e-1 * urgency AS score FROM @issues@) AS s"""


# --- share of voice ----------------------------------------------------------------------


def ctr_curve(model: str | dict[int, float] = "sistrix", top_n: int = 10) -> list[tuple[int, float]]:
    """S35, A19. (position, percent): a named or own curve, carried on by a factor of 0.8 down to 0.1 up to ``top_n``."""
    curve = dict(enumerate(dims.CTR_CURVES[model], 1)) if isinstance(model, str) else dict(model)
    last = max(curve)
    tail = [(p, round(max(curve[last] * 0.8 ** (p - last), 0.1), 2)) for p in range(last + 1, top_n + 1)]
    return [*sorted((p, float(c)) for p, c in curve.items()), *tail]


@operator
def share_of_voice(d: Duck, model: str | dict[int, float] = "sistrix", top_n: int = 10) -> str:
    """A18. Estimated clicks and share by domain of ``rankings`` (keyword, volume, domain, position)."""
    return f"""
SELECT domain, round(round(est * 100e0 / nullif(sum(est) OVER (), 0), 7), 2) AS sov_percent, round(round(est, 6), 1) AS estimated_clicks, keywords_ranked, avg_position
FROM (SELECT domain, sum(volume * coalesce(ctr, 0e0) / 100) AS est, CAST(count(*) AS BIGINT) AS keywords_ranked, round(avg(r.position), 1) AS avg_position
  FROM @rankings@ r LEFT JOIN {values(ctr_curve(model, top_n), "position, ctr")} AS c ON r.position = c.position
  WHERE r.position BETWEEN 1 AND {top_n} GROUP BY domain) AS t"""


@operator
def sov_keyword_breakdown(d: Duck, model: str | dict[int, float] = "sistrix", top_n: int = 10) -> str:
    """A20. Estimated clicks of each keyword of a domain, and their share of the domain."""
    return f"""
SELECT domain, keyword, position, volume, round(est, 1) AS estimated_clicks, CASE WHEN whole > 0 THEN round(round(est, 1) / whole * 100, 1) ELSE 0e0 END AS pct_of_domain
FROM (SELECT *, sum(est) OVER (PARTITION BY domain) AS whole FROM (
  SELECT domain, keyword, r.position, volume, volume * coalesce(ctr, 0e0) / 100 AS est
  FROM @rankings@ r LEFT JOIN {values(ctr_curve(model, top_n), "position, ctr")} AS c ON r.position = c.position
  WHERE r.position BETWEEN 1 AND {top_n}) AS t) AS u"""


@operator
def sov_distribution(d: Duck) -> str:
    """A21. Domains and combined share of ``sov`` in five buckets, all present."""
    buckets = values([(1, "> 10%"), (2, "5-10%"), (3, "2-5%"), (4, "1-2%"), (5, "< 1%")], "place, bucket")
    return f"""
SELECT b.bucket, CAST(count(s.domain) AS BIGINT) AS domains, round(coalesce(sum(s.sov_percent), 0e0), 1) AS combined_sov
FROM {buckets} AS b LEFT JOIN (
  SELECT domain, sov_percent, CASE WHEN sov_percent > 10 THEN 1 WHEN sov_percent >= 5 THEN 2 WHEN sov_percent >= 2 THEN 3 WHEN sov_percent >= 1 THEN 4 ELSE 5 END AS place
  FROM @sov@) AS s ON b.place = s.place GROUP BY b.bucket"""


@operator
def sov_meta(d: Duck) -> str:
    """A22. Keywords, domains and total volume of ``rankings``; a keyword's first row (by row_id) gives its volume."""
    return """
SELECT CAST(count(*) AS BIGINT) AS total_keywords, CAST(sum(volume) AS BIGINT) AS total_volume, (SELECT CAST(count(DISTINCT domain) AS BIGINT) FROM @rankings@) AS total_domains
FROM (SELECT keyword, volume, row_number() OVER (PARTITION BY keyword ORDER BY row_id) AS n FROM @rankings@) AS k WHERE n = 1"""


@operator
def simple_sov(d: Duck) -> str:
    """A23. Share of ``traffic`` (domain, traffic, keywords) row by row; a domain's rows stay apart."""
    return """
SELECT domain, traffic, keywords, round(CASE WHEN total > 0 THEN traffic * 100e0 / total ELSE 0e0 END, 2) AS sov_percent FROM @traffic@ CROSS JOIN (SELECT sum(traffic) AS total FROM @traffic@) AS t"""


# --- keywords ----------------------------------------------------------------------------


def intent_of(d: Duck, kw: str) -> str:
    """A24. Intent by signal words within the keyword."""
    cases = " ".join(f"WHEN {any_of(d, f'lower({kw})', words)} THEN '{intent}'" for intent, words in dims.INTENT_WORDS.items())
    return f"CASE {cases} ELSE 'informational' END"


def opportunity_of(volume: str, difficulty: str, intent: str) -> str:
    """A25. Volume times the intent's value, over the difficulty (1 at least)."""
    value = " ".join(f"WHEN '{i}' THEN {v}" for i, v in dims.INTENT_VALUES.items())
    return f"round({volume} * (CASE {intent} {value} ELSE 1 END) / CAST(greatest({difficulty}, 1) AS DOUBLE), 1)"


@operator
def keyword_intents(d: Duck) -> str:
    """A24, A25. ``keywords`` (keyword, volume, difficulty) with intent and opportunity."""
    return f"""
SELECT keyword, volume, difficulty, intent, {opportunity_of('volume', 'difficulty', 'intent')} AS opportunity
FROM (SELECT keyword, coalesce(volume, 0) AS volume, coalesce(difficulty, 0) AS difficulty, {intent_of(d, 'keyword')} AS intent FROM @keywords@) AS k"""


@operator
def keyword_discovery(d: Duck) -> str:
    """A26. Union of ``suggestions`` and ``related`` (keyword, volume, difficulty, row_id), first of equal keywords, scored.

    quick_win and geo_opportunity mark the first 20 of each list in order of opportunity.
    """
    questions = " OR ".join(f"lower(keyword) LIKE '{q}%'" for q in dims.QUESTION_WORDS)
    return f"""
SELECT keyword, volume, difficulty, intent, opportunity, (easy AND easy_n <= 20) AS quick_win, (asked AND asked_n <= 20) AS geo_opportunity FROM (
  SELECT *, row_number() OVER (PARTITION BY easy ORDER BY opportunity DESC, place, row_id) AS easy_n, row_number() OVER (PARTITION BY asked ORDER BY opportunity DESC, place, row_id) AS asked_n FROM (
    SELECT *, {opportunity_of('volume', 'difficulty', 'intent')} AS opportunity, volume >= 100 AND difficulty <= 40 AS easy, intent = 'informational' AND ({questions}) AS asked FROM (
      SELECT keyword, volume, difficulty, place, row_id, {intent_of(d, 'keyword')} AS intent FROM (
        SELECT keyword, coalesce(volume, 0) AS volume, coalesce(difficulty, 0) AS difficulty, place, row_id, row_number() OVER (PARTITION BY lower(trim(keyword)) ORDER BY place, row_id) AS n
        FROM (SELECT keyword, volume, difficulty, row_id, 0 AS place FROM @suggestions@ UNION ALL SELECT keyword, volume, difficulty, row_id, 1 AS place FROM @related@) AS u) AS v
      WHERE n = 1 AND trim(keyword) <> '') AS w) AS x) AS y"""


@operator
def serp_intent(d: Duck) -> str:
    """A27. Intent of each keyword in ``serp`` (keyword, has_snippet, titles: the first five, lower case, joined by a space)."""
    cases = " ".join(f"WHEN {any_of(d, 'lower(keyword)', words)} THEN '{i}'" for i, words in dims.SERP_INTENT.items())
    titles = " ".join(f"WHEN {any_of(d, 'titles', words)} THEN '{i}'" for i, words in dims.SERP_TITLE_INTENT.items())
    return f"SELECT keyword, CASE {cases} WHEN has_snippet THEN 'informational' {titles} ELSE 'commercial' END AS intent FROM @serp@"


@operator
def serp_word_counts(d: Duck) -> str:
    """A28. Word counts of the parsed pages of each keyword in ``contents`` (keyword, word_count) and the recommended range."""
    return f"""
SELECT keyword, competitors, lo AS min_words, hi AS max_words, {d.int('mid')} AS median_words, {d.int('mean')} AS mean_words,
  {d.int('mid * 8e-1')} AS recommended_min, {d.int('mid * 13e-1')} AS recommended_max
FROM (SELECT keyword, CAST(count(*) AS BIGINT) AS competitors, CAST(min(word_count) AS BIGINT) AS lo, CAST(max(word_count) AS BIGINT) AS hi,
  CAST(median(word_count) AS DOUBLE) AS mid, avg(word_count) AS mean FROM @contents@ WHERE word_count > 0 GROUP BY keyword) AS s"""


def topic_of(d: Duck, heading: str) -> str:
    """Heading text without its tag, leading fillers (in list order) and trailing punctuation."""
    t = f"lower(trim({d.sub(heading, '^H[0-9]:', '')}))"
    for filler in dims.TOPIC_FILLERS:
        t = d.sub(t, "^" + filler, "")
    return f"trim({d.sub(t, '[.:!?]+$', '')})"


@operator
def topic_frequency(d: Duck, top: int = 30) -> str:
    """A29. Topics of the H2 and H3 ``headings`` (page, heading: tagged "H2: text") by number of pages."""
    return f"""
SELECT topic, CAST(count(DISTINCT page) AS BIGINT) AS competitor_count
FROM (SELECT page, {topic_of(d, 'heading')} AS topic FROM @headings@ WHERE heading LIKE 'H2:%' OR heading LIKE 'H3:%') AS t
WHERE topic <> '' GROUP BY topic ORDER BY competitor_count DESC, topic LIMIT {top}"""


@operator
def heading_patterns(d: Duck) -> str:
    """A30. Mean and truncated median number of H2 and H3 per page of ``headings``."""
    return f"""
SELECT round(avg(h2), 1) AS avg_h2_count, round(avg(h3), 1) AS avg_h3_count, {d.int('median(h2)')} AS median_h2_count, {d.int('median(h3)')} AS median_h3_count
FROM (SELECT page, count_if(heading LIKE 'H2:%') AS h2, count_if(heading LIKE 'H3:%') AS h3 FROM @headings@ GROUP BY page) AS p"""


@operator
def detect_region(d: Duck) -> str:
    """A31. Region of each keyword in ``keywords`` by its function words, with location and language."""

    def hit(region: str) -> str:
        words = dims.REGION_WORDS[region]
        inside = any_of(d, "(' ' || lower(keyword) || ' ')", words)
        ends = "" if region == "fr" else "".join(f" OR lower(keyword) LIKE {text('%' + w.strip())}" for w in words)
        return f"({inside}{ends})"

    cases = " ".join(f"WHEN {hit(r)} THEN '{r}'" for r in dims.REGION_WORDS)
    return f"""
SELECT k.keyword, k.region, r.location_code, r.language_code FROM (SELECT keyword, CASE {cases} END AS region FROM @keywords@) AS k
LEFT JOIN {values(dims.REGIONS, "region, location_code, language_code")} AS r ON k.region = r.region"""


@operator
def research_assemble(d: Duck, depth: int = 10) -> str:
    """A32. One row for each result of ``serp`` (keyword, position, url, title) up to ``depth`` with its parsed ``contents``
    (url, word_count, headings) and the number of ``related`` keywords (keyword, related)."""
    return f"""
SELECT s.keyword, s.position, s.url, s.title, c.word_count, c.headings, coalesce(r.n, 0) AS related_keywords
FROM @serp@ s LEFT JOIN @contents@ c ON s.url = c.url
LEFT JOIN (SELECT keyword, CAST(count(*) AS BIGINT) AS n FROM @related@ GROUP BY keyword) AS r ON s.keyword = r.keyword
WHERE s.position <= {depth}"""


@operator
def query_intent_groups(d: Duck) -> str:
    """A33. Prompt groups: comparison, how-to, problem, recommendation, other."""
    k = "lower(keyword)"
    return f"""
SELECT keyword, CASE WHEN {d.like(k, r'( vs | versus |compare|difference|alternative)')} THEN 'comparison' WHEN {d.like(k, r'(^how to|how do|tutorial|guide|steps)')} THEN 'how-to'
  WHEN {d.like(k, r'(problem|fix|error|not working|why )')} THEN 'problem' WHEN {d.like(k, r'(best|top |recommend|which )')} THEN 'recommendation' ELSE 'other' END AS query_group FROM @keywords@"""


@operator
def keyword_gap(d: Duck, own: str = "", competitor: str = "", min_volume: int = 50, top: int = 50) -> str:
    """A37. Keywords of ``rankings`` that the competitor ranks for and the own domain does not, by volume."""
    return f"""
SELECT c.keyword, c.volume, c.position FROM @rankings@ c LEFT JOIN (SELECT DISTINCT keyword FROM @rankings@ WHERE domain = {text(own)}) AS o ON c.keyword = o.keyword
WHERE c.domain = {text(competitor)} AND o.keyword IS NULL AND c.volume > {min_volume} ORDER BY c.volume DESC, c.keyword LIMIT {top}"""


@operator
def comparison_keywords(d: Duck, min_volume: int = 100) -> str:
    """A38. Keywords with comparison intent and enough volume."""
    pattern = r"(\bvs\b|versus|compared to|alternatives?|better than|switch from|migrate from)"
    return f"SELECT keyword, volume FROM @keywords@ WHERE {d.like('lower(keyword)', pattern)} AND volume > {min_volume}"


@operator
def page_intersection(d: Duck, a: str = "", b: str = "") -> str:
    """A39. Keywords that both domains (or urls) of ``rankings`` rank for."""
    return f"""
SELECT a.keyword, a.volume, a.position AS position_a, b.position AS position_b FROM @rankings@ a JOIN @rankings@ b ON a.keyword = b.keyword
WHERE a.domain = {text(a)} AND b.domain = {text(b)}"""


@operator
def keyword_profile(d: Duck, domain: str = "", top: int = 25) -> str:
    """A40. The keywords of a domain (or url) with most volume."""
    return f"SELECT keyword, volume, position FROM @rankings@ WHERE domain = {text(domain)} ORDER BY volume DESC, keyword LIMIT {top}"


@operator
def feature_matrix(d: Duck, products: tuple[str, ...] = ()) -> str:
    """A41. ``features`` (feature, product, present) with a column for each product: has_1, has_2 and so on."""
    columns = ", ".join(f"max(CASE WHEN product = {text(p)} AND present THEN 1 ELSE 0 END) AS has_{i}" for i, p in enumerate(products, 1))
    return f"SELECT feature, {columns} FROM @features@ GROUP BY feature"
