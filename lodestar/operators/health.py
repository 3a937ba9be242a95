"""Page health and on-page rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.dims import HEALTH_WEIGHTS, PAGE_PATTERNS, PAGE_THRESHOLDS
from lodestar.operators.chains import follow
from lodestar.operators.graph import settled
from lodestar.plans.dialect import Duck, operator, values


def rescaled(weights: dict[str, float]) -> dict[str, int]:
    """C11. The default weights with some replaced, rescaled to a sum of 100 and rounded."""
    merged = HEALTH_WEIGHTS | weights
    total = sum(merged.values())
    return {k: round(v * 100 / total) for k, v in merged.items()}


def page_type(d: Duck, url: str) -> str:
    """C1. Type of a page by its url."""
    path = d.sub(url, "^https?://[^/]+", "")
    cases = " ".join(f"WHEN {d.like(url, p)} THEN '{t}'" for t, p in PAGE_PATTERNS)
    return f"CASE WHEN {path} IN ('', '/', '/index.html', '/index.php') THEN 'homepage' {cases} ELSE 'default' END"


@operator
def page_types(d: Duck) -> str:
    """C1. ``pages`` (url) with page_type."""
    return f"SELECT url, {page_type(d, 'url')} AS page_type FROM @pages@"


@operator
def page_health(d: Duck, weights: dict[str, int] | None = None) -> str:
    """C2-C9. Risk by signal and health of ``pages`` (address, canonical, word_count, inlinks, crawl_depth, title, h1, h2,
    meta_desc); ``clicks`` (url, clicks) flags listed pages with none."""
    w = {k: int(v) for k, v in (weights or HEALTH_WEIGHTS).items()}
    whole = lambda x: f"CAST({d.half_even(x)} AS BIGINT)"
    key = lambda c: f"regexp_replace(lower({c}), '/+$', '')"
    return f"""
SELECT url, page_type, thin_content, missing_canonical, orphan_page, poor_structure, missing_meta, deep_crawl_depth, traffic_decay,
  least(100, greatest(0, risk)) AS total_risk, 100 - least(100, greatest(0, risk)) AS health_score
FROM (SELECT *, thin_content + missing_canonical + orphan_page + poor_structure + missing_meta + deep_crawl_depth + traffic_decay AS risk FROM (
  SELECT p.address AS url, p.page_type,
    CASE WHEN p.word_count < t.thin THEN {whole(f"(1 - p.word_count / CAST(t.thin AS DOUBLE)) * {w['thin_content']}")} ELSE 0 END AS thin_content,
    CASE WHEN p.canonical = '' THEN {w['missing_canonical']} WHEN {key('p.canonical')} <> {key('p.address')} THEN {round(w['missing_canonical'] * 0.67)} ELSE 0 END AS missing_canonical,
    CASE WHEN t.orphan = 0 THEN 0 WHEN p.inlinks = 0 THEN {w['orphan_page']} WHEN p.inlinks < t.orphan THEN {whole(f"(1 - p.inlinks / CAST(t.orphan AS DOUBLE)) * {w['orphan_page']}")} ELSE 0 END AS orphan_page,
    CASE WHEN trim(p.h1) = '' AND trim(p.h2) = '' THEN {w['poor_structure']} WHEN trim(p.h1) = '' THEN {round(w['poor_structure'] * 0.67)} WHEN trim(p.h2) = '' THEN {round(w['poor_structure'] * 0.33)} ELSE 0 END AS poor_structure,
    least({w['missing_meta']}, CASE WHEN p.title = '' THEN 5 WHEN length(p.title) < 30 OR length(p.title) > 60 THEN 2 ELSE 0 END
      + CASE WHEN p.meta_desc = '' THEN 5 WHEN length(p.meta_desc) < 70 OR length(p.meta_desc) > 160 THEN 2 ELSE 0 END) AS missing_meta,
    CASE WHEN p.crawl_depth <= 3 THEN 0 WHEN p.crawl_depth = 4 THEN {round(w['deep_crawl_depth'] * 0.3)} WHEN p.crawl_depth = 5 THEN {round(w['deep_crawl_depth'] * 0.6)} ELSE {w['deep_crawl_depth']} END AS deep_crawl_depth,
    CASE WHEN c.clicks = 0 THEN {w['traffic_decay']} ELSE 0 END AS traffic_decay
  FROM (SELECT *, {page_type(d, 'address')} AS page_type FROM @pages@) AS p
  JOIN {values(PAGE_THRESHOLDS, "page_type, thin, orphan")} AS t ON p.page_type = t.page_type
  LEFT JOIN @clicks@ c ON {key('p.address')} = c.url) AS s) AS r"""


@operator
def health_bands(d: Duck) -> str:
    """C10. Pages of ``health`` in the five bands."""
    bands = values([(1, "excellent"), (2, "good"), (3, "fair"), (4, "poor"), (5, "critical")], "place, band")
    return f"""
SELECT b.band, CAST(count(h.url) AS BIGINT) AS pages FROM {bands} AS b LEFT JOIN (
  SELECT url, CASE WHEN health_score >= 90 THEN 1 WHEN health_score >= 70 THEN 2 WHEN health_score >= 50 THEN 3 WHEN health_score >= 30 THEN 4 ELSE 5 END AS place FROM @health@) AS h
ON b.place = h.place GROUP BY b.band"""


@operator
def health_signals(d: Duck) -> str:
    """C10. Average risk, affected pages and their share by signal of ``health``."""
    each = " UNION ALL ".join(f"SELECT '{s}' AS signal, {s} AS risk FROM @health@" for s in HEALTH_WEIGHTS)
    return f"""
SELECT signal, round(avg(risk), 1) AS avg_risk, CAST(count_if(risk > 0) AS BIGINT) AS affected, round(count_if(risk > 0) * 100e0 / count(*), 1) AS affected_percentage FROM ({each}) AS u GROUP BY signal"""


@operator
def risk_pages(d: Duck, top: int = 25) -> str:
    """C27. The pages of ``health`` with most risk."""
    return f"SELECT url, health_score, total_risk FROM @health@ ORDER BY total_risk DESC, url LIMIT {top}"


# Crawler filters, a predicate for each over (address, title, h1, meta_desc).
PAGE_FILTERS = {
    "titles:missing": "title = ''", "titles:over_60": "length(title) > 60", "titles:below_30": "title <> '' AND length(title) < 30", "titles:same_as_h1": "title <> '' AND title = h1",
    "meta:missing": "meta_desc = ''", "meta:over_155": "length(meta_desc) > 155", "meta:below_70": "meta_desc <> '' AND length(meta_desc) < 70",
    "h1:missing": "h1 = ''", "h1:over_70": "length(h1) > 70",
}
# Filters for texts that more than one page has, and the column of each.
COPIED = {"titles:duplicate": "title", "meta:duplicate": "meta_desc", "h1:duplicate": "h1"}


# Further crawler filters, over (address, status_code, canonical, canonical_indexable, directives, h2, word_count, seconds, jsonld_blocks, hsts).
CRAWL_FILTERS = {
    "response_codes:success_2xx": "status_code LIKE '2%'", "response_codes:redirection_3xx": "status_code LIKE '3%'", "response_codes:redirection_301": "status_code = '301'", "response_codes:redirection_302": "status_code = '302'",
    "response_codes:client_error_4xx": "status_code LIKE '4%'", "response_codes:server_error_5xx": "status_code LIKE '5%'", "response_codes:no_response": "status_code IN ('', '0')",
    "h2:missing": "trim(h2) = ''", "canonicals:self_referencing": "canonical = address", "canonicals:canonicalised": "canonical <> '' AND canonical <> address", "canonicals:missing": "canonical = ''", "canonicals:non_indexable_canonical": "canonical <> '' AND NOT canonical_indexable",
    "directives:index": "directives <> '' AND directives NOT LIKE '%noindex%'", "directives:noindex": "directives LIKE '%noindex%'", "directives:follow": "directives <> '' AND directives NOT LIKE '%nofollow%'", "directives:nofollow": "directives LIKE '%nofollow%'", "directives:none": "directives = ''",
    "directives:noarchive": "directives LIKE '%noarchive%'", "directives:nosnippet": "directives LIKE '%nosnippet%'",
    "structured_data:contains": "jsonld_blocks > 0", "structured_data:missing": "jsonld_blocks = 0", "content:low_content_pages": "word_count < 200", "page_speed:slow_over_1s": "seconds > 1",
    "security:http_urls": "address LIKE 'http://%'", "security:missing_hsts": "NOT hsts",
}


@operator
def filter_counts(d: Duck) -> str:
    """S38. Pages that each filter of the catalogue fits, and their share, over ``crawl`` (the columns of PAGE_FILTERS and CRAWL_FILTERS).

    All predicates are one aggregate over one scan, whose single row is then turned into one for each filter.
    """
    tests = PAGE_FILTERS | CRAWL_FILTERS
    sums = ", ".join(f"count_if({t}) AS f{i}" for i, t in enumerate(tests.values()))
    which = " ".join(f"WHEN '{n}' THEN f{i}" for i, n in enumerate(tests))
    return f"""
SELECT tab_filter, CAST(n AS BIGINT) AS pages, round(n * 100e0 / nullif(total, 0), 2) AS share FROM (
  SELECT tab_filter, total, CASE tab_filter {which} END AS n FROM (
    SELECT *, {d.explode(d.array(*[f"'{n}'" for n in tests]))} AS tab_filter FROM (SELECT count(*) AS total, {sums} FROM @crawl@) AS a) AS b) AS c"""


@operator
def page_filters(d: Duck) -> str:
    """C12, S38. Crawler filters over ``pages`` (address, title, h1, meta_desc): one row for each filter that a page meets.

    Row filters are one projection; a text that several pages have is found by its count and joined back, empty ones left out first.
    """
    named = d.array(*[f"CASE WHEN {t} THEN '{n}' END" for n, t in PAGE_FILTERS.items()])
    copied = " UNION ALL ".join(
        f"SELECT p.address, '{n}' AS tab_filter FROM @pages@ p JOIN (SELECT {c} FROM @pages@ WHERE {c} <> '' GROUP BY {c} HAVING count(*) > 1) AS m ON p.{c} = m.{c}" for n, c in COPIED.items()
    )
    return f"SELECT address, tab_filter FROM (SELECT address, {d.explode(named)} AS tab_filter FROM @pages@) AS x WHERE tab_filter IS NOT NULL UNION ALL {copied}"


# Least words, and least and most internal links, by page type.
LEAST_WORDS = [("homepage", 500), ("service", 800), ("location", 600), ("about", 500), ("blog", 1500), ("product", 400), ("category", 400), ("faq", 400), ("landing", 600), ("comparison", 800)]
LINK_TARGETS = [("blog", 5, 10), ("service", 3, 5), ("product", 2, 4)]


@operator
def least_words(d: Duck) -> str:
    """C13. ``pages`` (url, page_type, word_count) below the least words of their type."""
    return f"""
SELECT p.url, p.page_type, p.word_count, m.least_words, p.word_count >= m.least_words AS passes FROM @pages@ p JOIN {values(LEAST_WORDS, "page_type, least_words")} AS m ON p.page_type = m.page_type"""


@operator
def location_gates(d: Duck) -> str:
    """C14. Location pages by group (``pages``: site, unique_percentage): warn at 30, stop at 50, and pages under 60 and 40 percent unique."""
    return """
SELECT site, CAST(count(*) AS BIGINT) AS pages, CASE WHEN count(*) >= 50 THEN 'stop' WHEN count(*) >= 30 THEN 'warn' ELSE 'pass' END AS gate,
  CAST(count_if(unique_percentage < 60) AS BIGINT) AS below_60, CAST(count_if(unique_percentage < 40) AS BIGINT) AS below_40 FROM @pages@ GROUP BY site"""


@operator
def link_targets(d: Duck) -> str:
    """C15. Internal links of ``pages`` (url, page_type, internal_links) against the range of their type."""
    return f"""
SELECT p.url, p.internal_links, CASE WHEN p.internal_links < t.least THEN 'too_few' WHEN p.internal_links > t.most THEN 'too_many' ELSE 'ok' END AS verdict
FROM @pages@ p JOIN {values(LINK_TARGETS, "page_type, least, most")} AS t ON p.page_type = t.page_type"""


@operator
def image_checks(d: Duck) -> str:
    """C16. Size tier and alt text of ``images`` (src, kind, kilobytes, alt)."""
    return """
SELECT src, CASE WHEN kilobytes <= CASE kind WHEN 'thumbnail' THEN 50 WHEN 'content' THEN 100 ELSE 200 END THEN 'target' WHEN kilobytes <= CASE kind WHEN 'thumbnail' THEN 100 WHEN 'content' THEN 200 ELSE 300 END THEN 'warning'
  ELSE 'critical' END AS size_tier, CASE WHEN alt = '' THEN 'missing' WHEN length(alt) < 10 THEN 'short' WHEN length(alt) > 125 THEN 'long' ELSE 'ok' END AS alt_check FROM @images@"""


@operator
def seo_checklist(d: Duck) -> str:
    """C17. Checks of ``posts`` (url, title, meta_desc, h1_count, h2_count, question_h2, longest_heading, internal_links, external_links, canonical)."""
    tests = ["length(title) BETWEEN 40 AND 60", "length(meta_desc) BETWEEN 150 AND 160", "h1_count = 1", "h2_count BETWEEN 6 AND 8", "question_h2 * 10 BETWEEN h2_count * 6 AND h2_count * 7", "longest_heading < 70", "internal_links BETWEEN 3 AND 10", "external_links >= 3", "canonical LIKE 'http%://%'"]
    passed = " + ".join(f"CASE WHEN {t} THEN 1 ELSE 0 END" for t in tests)
    return f"SELECT url, {passed} AS passed, {len(tests)} AS checks FROM @posts@"


@operator
def dedupe_links(d: Duck) -> str:
    """C18. One link for each (page, normalised url) of ``links`` (page, href, anchor): the longest anchor; and the duplicates cut."""
    return """
SELECT page, url_key, anchor, copies - 1 AS duplicates FROM (
  SELECT page, url_key, anchor, count(*) OVER (PARTITION BY page, url_key) AS copies, row_number() OVER (PARTITION BY page, url_key ORDER BY length(anchor) DESC, anchor) AS n
  FROM (SELECT page, anchor, regexp_replace(regexp_replace(lower(href), '[?#].*$', ''), '/+$', '') AS url_key FROM @links@) AS l) AS r WHERE n = 1"""


def first_links(links: DataFrame) -> DataFrame:
    """C18 by partial sums: rows as of ``dedupe_links``; no task holds the links of a page and url."""
    key = F.regexp_replace(F.regexp_replace(F.lower("href"), "[?#].*$", ""), "/+$", "")
    each = links.select("page", key.alias("url_key"), "anchor").groupBy("page", "url_key", "anchor").agg(F.count(F.lit(1)).alias("n"))
    length = F.coalesce(-F.length("anchor"), F.lit(1)).alias("length")  # a null anchor goes last
    kept = each.groupBy("page", "url_key").agg(F.min(F.struct(length, "anchor")).alias("link"), F.sum("n").alias("copies"))
    return kept.select("page", "url_key", F.col("link.anchor").alias("anchor"), (F.col("copies") - 1).alias("duplicates"))


@operator
def url_rules(d: Duck) -> str:
    """C19. Structure rules of each url: length of the path, case, date segment, extension."""
    path = d.extract("url", r"^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)")
    return f"""
SELECT url, length(path) < 75 AS short_path, path = lower(path) AS lower_case, NOT {d.like('path', '/[0-9]{4}/[0-9]{2}(/|$)')} AS no_date, NOT {d.like('path', '[.](html?|php|aspx?)$')} AS no_extension
FROM (SELECT url, {path} AS path FROM @pages@) AS p"""


@operator
def page_analysis(d: Duck) -> str:
    """C20. Thresholds over ``pages`` (url, title, meta_desc, keyword_count, word_count)."""
    return """
SELECT url, length(title) BETWEEN 50 AND 60 AS title_ok, length(meta_desc) BETWEEN 150 AND 160 AS meta_ok,
  round(CASE WHEN word_count > 0 THEN keyword_count * 100e0 / word_count ELSE 0e0 END, 2) AS keyword_density,
  CASE WHEN word_count > 0 THEN keyword_count * 100e0 / word_count ELSE 0e0 END BETWEEN 1 AND 3 AS density_ok FROM @pages@"""


# Good and poor bounds of the web vitals.
VITALS = [("LCP", 2500.0, 4000.0), ("INP", 200.0, 500.0), ("CLS", 0.1, 0.25)]


@operator
def web_vitals(d: Duck) -> str:
    """C21. Rating of ``samples`` (page, metric, value) by the 75th percentile."""
    p75 = "percentile_cont(75e-2) WITHIN GROUP (ORDER BY value)"
    return f"""
SELECT s.page, s.metric, round(s.p75, 8) AS p75, CASE WHEN s.p75 <= v.good THEN 'good' WHEN s.p75 <= v.poor THEN 'needs_improvement' ELSE 'poor' END AS rating
FROM (SELECT page, metric, {p75} AS p75 FROM @samples@ GROUP BY page, metric) AS s JOIN {values(VITALS, "metric, good, poor")} AS v ON s.metric = v.metric"""


@operator
def broken_links(d: Duck) -> str:
    """C22. Targets of ``links`` (source, target, anchor) with a status of 400 or more in ``crawl`` (url, status), with inlinks and a sample."""
    return """
SELECT c.url, c.status, CAST(count(*) AS BIGINT) AS inlinks, min(l.source) AS sample_source, min(l.anchor) AS sample_anchor FROM @links@ l JOIN @crawl@ c ON l.target = c.url WHERE c.status >= 400 GROUP BY c.url, c.status"""


@operator
def indexability(d: Duck) -> str:
    """C23. Non-indexable pages of ``crawl`` (url, status, noindex, canonical, robots_blocked) by reason."""
    return """
SELECT reason, CAST(count(*) AS BIGINT) AS pages FROM (
  SELECT CASE WHEN robots_blocked THEN 'blocked_by_robots' WHEN status >= 400 THEN 'error' WHEN status >= 300 THEN 'redirected' WHEN noindex THEN 'noindex' WHEN canonical <> '' AND canonical <> url THEN 'canonicalised' END AS reason
  FROM @crawl@) AS r WHERE reason IS NOT NULL GROUP BY reason"""


@operator
def orphan_pages(d: Duck) -> str:
    """C24. Urls of ``crawl`` that no link of ``links`` (source, target) leads to from another page."""
    return "SELECT c.url FROM @crawl@ c WHERE NOT EXISTS (SELECT 1 FROM @links@ l WHERE l.target = c.url AND l.source <> l.target)"


@operator
def security_report(d: Duck) -> str:
    """C25. Pages of ``pages`` (url, html) over http, and secure pages with insecure resources."""
    mixed = d.like("html", "(?i)(src|href)=\"http://")
    return f"SELECT url, url LIKE 'http://%' AS insecure, url LIKE 'https://%' AND {mixed} AS mixed_content FROM @pages@"


@operator
def canonical_report(d: Duck) -> str:
    """C26. Canonicals of ``crawl`` (url, canonical, status) that lead on, to an error, or nowhere."""
    return """
SELECT a.url, a.canonical, CASE WHEN b.url IS NULL THEN 'not_crawled' WHEN b.status >= 400 THEN 'to_error' WHEN b.canonical <> '' AND b.canonical <> b.url THEN 'chain' ELSE 'ok' END AS verdict
FROM @crawl@ a LEFT JOIN @crawl@ b ON a.canonical = b.url WHERE a.canonical <> '' AND a.canonical <> a.url"""


def canonical_paths(crawl: DataFrame) -> DataFrame:
    """C26. (url, canonical, canonicals, final, hops, is_loop, verdict) of each url of ``crawl`` (url, canonical, status), chains of any length.

    A url with several canonicals is a conflict, and the smallest of them is followed; one without is
    ``missing``, one that names itself ``self``. Others lead to where their chain ends: ``loop`` if
    it never does, else ``not_crawled``, ``to_error`` (status of 400 or more), ``chain`` (more than one hop) or ``ok``.
    """
    named = F.when(F.col("canonical") != "", F.col("canonical"))
    urls = settled(crawl.filter("url IS NOT NULL").groupBy("url").agg(F.min(named).alias("canonical"), F.count_distinct(named).alias("canonicals"), F.max("status").alias("status")))
    paths = follow(urls.filter("canonical <> url").select(F.col("url").alias("node"), F.col("canonical").alias("next")))
    ends = urls.select(F.col("url").alias("end"), F.col("status").alias("end_status"))
    joined = urls.join(paths, F.col("url") == F.col("node"), "left").join(ends, F.col("final") == F.col("end"), "left")
    verdict = (
        F.when(F.col("canonicals") > 1, "conflict").when(F.col("canonical").isNull(), "missing").when(F.col("canonical") == F.col("url"), "self").when(F.col("is_loop"), "loop")
        .when(F.col("end").isNull(), "not_crawled").when(F.col("end_status") >= 400, "to_error").when(F.col("hops") > 1, "chain").otherwise("ok")
    )
    return joined.select("url", F.coalesce("canonical", F.lit("")).alias("canonical"), "canonicals", "final", "hops", F.coalesce("is_loop", F.lit(False)).alias("is_loop"), verdict.alias("verdict"))


@operator
def canonical_walks(d: Duck) -> str:
    """C26, oracle of canonical_paths: each chain walked in a recursion that keeps what it has seen."""
    return """
WITH RECURSIVE urls AS (SELECT url, min(nullif(canonical, '')) AS canonical, count(DISTINCT nullif(canonical, '')) AS canonicals, max(status) AS status FROM @crawl@ WHERE url IS NOT NULL GROUP BY url),
steps AS (SELECT url AS node, canonical AS next FROM urls WHERE canonical <> url),
walk AS (
  SELECT node, next AS place, 1::BIGINT AS hops, [node] AS seen FROM steps
  UNION ALL SELECT w.node, s.next, w.hops + 1, list_append(w.seen, w.place) FROM walk w JOIN steps s ON s.node = w.place WHERE NOT list_contains(w.seen, w.place)),
ends AS (SELECT node, max_by(place, hops) AS place, max(hops) AS hops, bool_or(list_contains(seen, place)) AS is_loop FROM walk GROUP BY node)
SELECT u.url, coalesce(u.canonical, '') AS canonical, u.canonicals, CASE WHEN NOT is_loop THEN place END AS final, CASE WHEN NOT is_loop THEN hops END AS hops, coalesce(is_loop, false) AS is_loop,
  CASE WHEN u.canonicals > 1 THEN 'conflict' WHEN u.canonical IS NULL THEN 'missing' WHEN u.canonical = u.url THEN 'self' WHEN is_loop THEN 'loop' WHEN f.url IS NULL THEN 'not_crawled'
    WHEN f.status >= 400 THEN 'to_error' WHEN hops > 1 THEN 'chain' ELSE 'ok' END AS verdict
FROM urls u LEFT JOIN ends e ON e.node = u.url LEFT JOIN urls f ON f.url = e.place AND NOT e.is_loop"""
