"""Redirects, crawl comparison, archive history, sitemaps, hreflang."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.chains import first_steps
from lodestar.operators.graph import settled
from lodestar.plans.dialect import Duck, operator

# Query parameters that only track.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_source_platform", "utm_creative_format",
    "utm_marketing_tactic", "fbclid", "gclid", "gclsrc", "dclid", "msclkid", "ref", "referrer", "source", "mc_cid", "mc_eid", "yclid",
    "twclid", "li_fat_id", "igshid", "s_kwcid",
]
HOPS = 10


def with_keys(d: Duck, source: str, columns: str, **urls: str) -> str:
    """E1 in SQL: ``columns`` of ``source``, and for each of ``urls`` (name to column) its key under that name.

    A key is percent-decoded (a plus sign in the query is a space) and has https, the host in lower case without a default port or user,
    a path ("/" at least) without slashes at its end, and the parameters that don't track, sorted;
    no fragment. An empty or null url has an empty key.
    """
    each = lambda make: ", ".join(make(n) for n in urls)
    spaced = lambda u: f"CASE WHEN {d.instr(u, chr(39) + '?' + chr(39))} > 0 THEN substr({u}, 1, {d.instr(u, chr(39) + '?' + chr(39))} - 1) || replace(substr({u}, {d.instr(u, chr(39) + '?' + chr(39))}), '+', '%20') ELSE {u} END"
    full = lambda n: f"CASE WHEN {d.like(f'u_{n}', '^[a-zA-Z][a-zA-Z0-9+.-]*://')} THEN {d.sub(f'u_{n}', '^[a-zA-Z][a-zA-Z0-9+.-]*://', 'https://')} WHEN u_{n} LIKE '//%' THEN 'https:' || u_{n} WHEN u_{n} = '' THEN '' ELSE 'https://' || u_{n} END"
    host = lambda n: f"lower({d.sub(d.extract(f'u_{n}', '^https://([^/?]*)'), '^.*@|:(80|443)$', '')})"
    path = lambda n: d.sub(d.extract(f"u_{n}", "^https://[^/?]*([^?]*)"), "/+$", "")
    query = lambda n: d.join(d.sort(d.filter(d.split(d.extract(f"u_{n}", "[?](.*)$"), "&"), lambda x: f"{x} <> '' AND NOT {d.like(f'lower({x})', '^(' + '|'.join(TRACKING) + ')(=|$)')}")), "&")
    return f"""(SELECT {columns}, {each(lambda n: f"CASE WHEN u_{n} = '' THEN '' ELSE 'https://' || h_{n} || CASE WHEN p_{n} = '' THEN '/' ELSE p_{n} END || CASE WHEN q_{n} <> '' THEN '?' || q_{n} ELSE '' END END AS {n}")} FROM (
  SELECT {columns}, {each(lambda n: f"u_{n}, {host(n)} AS h_{n}, {path(n)} AS p_{n}, {query(n)} AS q_{n}")} FROM (
    SELECT {columns}, {each(lambda n: f"{d.sub(full(n), '#.*$', '')} AS u_{n}")} FROM (
      SELECT {columns}, {each(lambda n: f"{d.decode(spaced(f'r_{n}'))} AS u_{n}")} FROM (
        SELECT {columns}, {each(lambda n: f"trim(coalesce({urls[n]}, '')) AS r_{n}")} FROM {source}) AS k00) AS k0) AS k1) AS k2)"""


@operator
def normalize_urls(d: Duck) -> str:
    """E1. ``urls`` (url) with their key."""
    return f"SELECT url, url_key FROM {with_keys(d, '@urls@', 'url', url_key='url')} AS k"


@operator
def redirect_map(d: Duck) -> str:
    """E2. The first row (by row_id) of each url key of ``crawl`` (url, status_code, redirect_url, row_id); rows without a url are left out."""
    keyed = with_keys(d, "@crawl@", "url, status_code, redirect_url, row_id", url_key="url", redirect_key="redirect_url")
    return f"""
SELECT url_key, url, status_code, redirect_key FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY row_id) AS n FROM {keyed} AS k WHERE url_key <> '') AS r WHERE n = 1"""


@operator
def redirect_chains(d: Duck) -> str:
    """E3. Where each redirecting url of ``map`` (url_key, status_code, redirect_key) ends: hops (9 at most, so 10 urls) and whether it comes back.

    One equi-join for each hop, so no recursion and no limit on rows; a chain that has ended
    meets nothing, under a key of its own.
    """
    moves = "(SELECT url_key, redirect_key FROM @map@ WHERE status_code LIKE '3%' AND redirect_key <> '')"
    path = f"(SELECT url_key AS n0, redirect_key AS n1, 1 AS hops, url_key = redirect_key AS is_loop FROM {moves} AS m1)"
    for k in range(2, HOPS):
        seen = ", ".join(f"n{i}" for i in range(k))
        path = f"""(SELECT {seen}, m.redirect_key AS n{k}, hops + CASE WHEN m.redirect_key IS NULL THEN 0 ELSE 1 END AS hops, is_loop OR coalesce(m.redirect_key IN ({seen}), false) AS is_loop
  FROM {path} AS p{k} LEFT JOIN {moves} AS m ON m.url_key = CASE WHEN is_loop OR n{k - 1} IS NULL THEN '#' || n0 ELSE n{k - 1} END)"""
    last = ", ".join(f"n{k}" for k in range(HOPS - 1, 0, -1))
    return f"SELECT n0 AS start, coalesce({last}) AS final_url, CAST(hops AS BIGINT) AS hops, is_loop FROM {path} AS p"


def follow_redirects(map: DataFrame) -> DataFrame:  # noqa: A002
    """E3 by paths that double each round (four joins for ten urls); rows as of ``redirect_chains``."""
    moves = map.filter("status_code LIKE '3%' AND redirect_key <> ''").select(F.col("url_key").alias("node"), F.col("redirect_key").alias("next"))
    paths = first_steps(moves, HOPS - 1).select("node", F.concat(F.array("node"), "path").alias("path"))
    back = F.filter(F.sequence(F.lit(1), F.size("path") - 1), lambda k: F.array_contains(F.slice("path", F.lit(1), k), F.get("path", k)))
    hops = F.coalesce(F.get(back, F.lit(0)), F.size("path") - 1)
    return paths.select(F.col("node").alias("start"), F.get("path", hops).alias("final_url"), hops.cast("bigint").alias("hops"), (F.size(back) > 0).alias("is_loop"))


def redirect_report(map: DataFrame) -> DataFrame:  # noqa: A002
    """E13. (start, final_url, hops, is_loop, types, advice) of each redirecting url of ``map`` (see redirect_map).

    types: the status of each hop, joined by ``>``. advice: ``break loop``, ``link A to C`` for a chain, ``make permanent``
    for a single hop that isn't 301 or 308, else empty.
    """
    moves = map.filter("status_code LIKE '3%' AND redirect_key <> ''").select(F.col("url_key").alias("node"), F.col("redirect_key").alias("next"), "status_code")
    chains = settled(follow_redirects(map))
    paths = first_steps(moves.select("node", "next"), HOPS - 1).select("node", F.concat(F.array("node"), "path").alias("path"))
    hops = paths.join(chains, F.col("node") == F.col("start")).select("start", "hops", F.posexplode("path").alias("at", "url")).filter("at < hops")
    typed = hops.join(moves.select(F.col("node").alias("of"), "status_code"), F.col("url") == F.col("of")).groupBy("start").agg(F.array_sort(F.collect_list(F.struct("at", "status_code"))).alias("t"))
    out = chains.join(typed, "start").withColumn("types", F.array_join(F.transform("t", lambda x: x["status_code"]), ">"))
    advice = F.when(F.col("is_loop"), "break loop").when(F.col("hops") > 1, F.concat(F.lit("link "), "start", F.lit(" to "), "final_url")).when(~F.col("types").isin("301", "308"), "make permanent").otherwise("")
    return out.select("start", "final_url", "hops", "is_loop", "types", advice.alias("advice"))


@operator
def redirect_walks(d: Duck) -> str:
    """E13, oracle of redirect_report: each chain walked in a recursion of nine hops."""
    return f"""
WITH RECURSIVE moves AS (SELECT url_key AS node, redirect_key AS next, status_code AS type FROM @map@ WHERE status_code LIKE '3%' AND redirect_key <> ''),
walk AS (
  SELECT node, next AS place, 1::BIGINT AS hops, [node] AS seen, type AS types FROM moves
  UNION ALL SELECT w.node, m.next, w.hops + 1, list_append(w.seen, w.place), w.types || '>' || m.type FROM walk w JOIN moves m ON m.node = w.place WHERE NOT list_contains(w.seen, w.place) AND w.hops < {HOPS - 1}),
ends AS (SELECT node, max_by(place, hops) AS final_url, max(hops) AS hops, bool_or(list_contains(seen, place)) AS is_loop, max_by(types, hops) AS types FROM walk GROUP BY node)
SELECT node AS start, final_url, hops, is_loop, types, CASE WHEN is_loop THEN 'break loop' WHEN hops > 1 THEN 'link ' || node || ' to ' || final_url WHEN types NOT IN ('301', '308') THEN 'make permanent' ELSE '' END AS advice FROM ends"""


@operator
def validate_redirects(d: Duck) -> str:
    """E4. One row for each finding on ``spec`` (old_url, new_url, type) against ``map`` and ``chains``, by key; a rule can be chain and match, and one without type takes any."""
    spec = with_keys(d, "@spec@", "old_url, new_url, type", old_key="old_url", new_key="new_url")
    return f"""
SELECT old_url, finding FROM (SELECT old_url, {d.explode('findings')} AS finding FROM (
  SELECT s.old_url, CASE WHEN m.url_key IS NULL OR m.status_code NOT LIKE '3%' THEN {d.array("'missing'", 'NULL')} WHEN c.is_loop THEN {d.array("'loop'", 'NULL')}
    ELSE {d.array("CASE WHEN c.hops > 1 THEN 'chain' END", "CASE WHEN m.redirect_key = s.new_key AND (coalesce(s.type, '') = '' OR m.status_code = s.type) THEN 'match' WHEN m.redirect_key = s.new_key THEN 'wrong_type' ELSE 'wrong_destination' END")} END AS findings
  FROM {spec} AS s LEFT JOIN @map@ m ON s.old_key = m.url_key LEFT JOIN @chains@ c ON s.old_key = c.start) AS f) AS x WHERE finding IS NOT NULL"""


@operator
def extra_redirects(d: Duck) -> str:
    """E5. Redirects of ``map`` that ``spec`` lacks, by key."""
    spec = with_keys(d, "@spec@", "old_url", old_key="old_url")
    return f"""
SELECT m.url, m.redirect_key FROM @map@ m {'ANTI' if d.name == 'duckdb' else 'LEFT ANTI'} JOIN {spec} AS s ON m.url_key = s.old_key WHERE m.status_code LIKE '3%' AND m.redirect_key <> ''"""


@operator
def redirect_summary(d: Duck) -> str:
    """E6. Findings by kind and the share of rules that match."""
    return """
SELECT CAST(count(DISTINCT old_url) AS BIGINT) AS rules, CAST(count_if(finding = 'match') AS BIGINT) AS matches, CAST(count_if(finding = 'missing') AS BIGINT) AS missing, CAST(count_if(finding = 'chain') AS BIGINT) AS chains,
  CAST(count_if(finding = 'loop') AS BIGINT) AS loops, CAST(count_if(finding = 'wrong_type') AS BIGINT) AS wrong_type, CAST(count_if(finding = 'wrong_destination') AS BIGINT) AS wrong_destination,
  round(count_if(finding = 'match') * 100e0 / nullif(count(DISTINCT old_url), 0), 1) AS score FROM @findings@"""


CRAWL_FIELDS = ["title", "h1", "status_code", "indexability", "canonical"]


@operator
def crawl_by_key(d: Duck) -> str:
    """E7. The last row (by row_id) of each url key of ``crawl`` (url, the fields of CRAWL_FIELDS, word_count, row_id)."""
    columns = ", ".join(["url", *CRAWL_FIELDS, "word_count", "row_id"])
    return f"""
SELECT url_key, {', '.join(CRAWL_FIELDS)}, word_count FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY row_id DESC) AS n FROM {with_keys(d, '@crawl@', columns, url_key='url')} AS k WHERE url_key <> '') AS r WHERE n = 1"""


@operator
def compare_crawls(d: Duck) -> str:
    """E7, E9. Url keys of ``old`` and ``new`` (see crawl_by_key): matched, removed (high risk above 500 words) or new (no redirects)."""
    return """
SELECT coalesce(o.url_key, n.url_key) AS url_key, CASE WHEN o.url_key IS NULL THEN 'new' WHEN n.url_key IS NULL THEN 'removed' ELSE 'matched' END AS presence, n.url_key IS NULL AND o.word_count > 500 AS high_risk
FROM @old@ o FULL OUTER JOIN @new@ n ON o.url_key = n.url_key WHERE o.url_key IS NOT NULL OR n.status_code NOT LIKE '3%'"""


@operator
def field_changes(d: Duck) -> str:
    """E8, E14. Changed fields of the url keys in both ``old`` and ``new`` (see crawl_by_key): the crawls meet once, then each key has a row for each field."""
    pick = lambda side, f: f"CASE field {' '.join(f'WHEN {chr(39)}{c}{chr(39)} THEN {side}_{c}' for c in f)} END"
    both = ", ".join(f"o.{f} AS o_{f}, n.{f} AS n_{f}" for f in [*CRAWL_FIELDS, "word_count"])
    return f"""
SELECT url_key, field, old_value, new_value, CASE field WHEN 'status_code' THEN old_value = '200' AND (new_value LIKE '4%' OR new_value LIKE '5%') WHEN 'indexability' THEN lower(old_value) LIKE '%indexable%' AND lower(new_value) LIKE '%non%'
  WHEN 'word_count' THEN (n_word_count - o_word_count) * 100e0 / o_word_count <= -30 ELSE false END AS critical FROM (
  SELECT url_key, field, o_word_count, n_word_count, CASE field WHEN 'word_count' THEN CAST(o_word_count AS STRING) ELSE {pick('o', CRAWL_FIELDS)} END AS old_value, CASE field WHEN 'word_count' THEN CAST(n_word_count AS STRING) ELSE {pick('n', CRAWL_FIELDS)} END AS new_value
  FROM (SELECT o.url_key, {both}, {d.explode(d.array(*[f"'{f}'" for f in [*CRAWL_FIELDS, 'word_count']]))} AS field FROM @old@ o JOIN @new@ n ON o.url_key = n.url_key) AS m) AS f
WHERE CASE field WHEN 'word_count' THEN o_word_count > 0 AND n_word_count > 0 AND abs(n_word_count - o_word_count) * 100e0 / o_word_count >= 20 ELSE old_value <> '' AND new_value <> '' AND old_value <> new_value END"""


@operator
def archive_timeline(d: Duck) -> str:
    """E10. Distinct originals by month of ``snapshots`` (timestamp, original), with the change on the row before."""
    return """
SELECT month, urls, urls - coalesce(previous, urls) AS change, CASE WHEN coalesce(previous, 0) = 0 THEN 0e0 ELSE round((urls - previous) * 100e0 / previous, 1) END AS change_percentage
FROM (SELECT month, urls, lag(urls) OVER (ORDER BY month) AS previous FROM (
  SELECT substr(timestamp, 1, 4) || '-' || substr(timestamp, 5, 2) AS month, CAST(count(DISTINCT original) AS BIGINT) AS urls FROM @snapshots@ GROUP BY 1) AS m) AS t"""


@operator
def structural_changes(d: Duck) -> str:
    """E11. Path patterns (two segments) that are new in or gone from a year of ``snapshots``, all of them."""
    pattern = d.extract("original", "^(?:https?://[^/]*)?((?:/[^/?#]*){0,2})")
    return f"""
WITH p AS (SELECT DISTINCT substr(timestamp, 1, 4) AS yr, {pattern} AS pattern FROM @snapshots@),
y AS (SELECT yr, lag(yr) OVER (ORDER BY yr) AS before, lead(yr) OVER (ORDER BY yr) AS after FROM (SELECT DISTINCT yr FROM p) AS d)
SELECT p.yr AS year, p.pattern, 'new' AS change FROM p JOIN y ON p.yr = y.yr LEFT JOIN p AS q ON q.yr = y.before AND q.pattern = p.pattern WHERE y.before IS NOT NULL AND q.yr IS NULL
UNION ALL SELECT y.after AS year, p.pattern, 'removed' AS change FROM p JOIN y ON p.yr = y.yr LEFT JOIN p AS q ON q.yr = y.after AND q.pattern = p.pattern WHERE y.after IS NOT NULL AND q.yr IS NULL"""


@operator
def robots_versions(d: Duck) -> str:
    """E12. Distinct digests of ``snapshots`` (timestamp, digest) and when each came first."""
    return "SELECT digest, min(timestamp) AS first_seen, CAST(count(*) AS BIGINT) AS captures FROM @snapshots@ GROUP BY digest"


@operator
def sitemap_cross_reference(d: Duck) -> str:
    """E15. Urls of ``sitemap`` (loc) and ``crawl`` (url, status_code, indexable) by category."""
    return """
SELECT category, CAST(count(*) AS BIGINT) AS urls FROM (
  SELECT CASE WHEN c.url IS NULL THEN 'in_sitemap_not_crawled' WHEN s.loc IS NULL AND c.indexable AND c.status_code = '200' THEN 'crawled_not_in_sitemap' WHEN s.loc IS NULL THEN 'rightly_left_out'
    WHEN c.status_code <> '200' THEN 'in_sitemap_not_200' WHEN NOT c.indexable THEN 'in_sitemap_not_indexable' ELSE 'ok' END AS category
  FROM (SELECT DISTINCT loc FROM @sitemap@) AS s FULL OUTER JOIN @crawl@ c ON s.loc = c.url) AS x GROUP BY category"""


@operator
def sitemap_checks(d: Duck, most: int = 50_000) -> str:
    """E16. Checks of each sitemap of ``urls`` (sitemap, loc, lastmod), and the files that a split would take."""
    return f"""
SELECT sitemap, CAST(count(*) AS BIGINT) AS urls, CAST(count_if(loc NOT LIKE 'https://%') AS BIGINT) AS not_https, CAST(count_if({d.like('loc', '[?#]')}) AS BIGINT) AS with_parameters,
  count(DISTINCT lastmod) = 1 AND count(*) > 1 AS all_lastmod_equal, {d.int(f'(count(*) + {most - 1}) / {most}')} AS files FROM @urls@ GROUP BY sitemap"""


@operator
def hreflang_checks(d: Duck) -> str:
    """E17. Findings on ``hreflang`` (page_url, lang, href, canonical): no return tag, no self reference, no x-default, bad code, canonical elsewhere, mixed protocol."""
    code = d.like("h.lang", "^([a-z]{2,3}(-[A-Za-z]{2})?|x-default)$")
    return f"""
SELECT h.page_url, h.lang, 'no_return_tag' AS finding, 'high' AS severity FROM @hreflang@ h WHERE h.href <> h.page_url AND NOT EXISTS (SELECT 1 FROM @hreflang@ b WHERE b.page_url = h.href AND b.href = h.page_url)
UNION ALL SELECT page_url, '' AS lang, 'no_self_reference' AS finding, 'high' AS severity FROM @hreflang@ GROUP BY page_url HAVING count_if(href = page_url) = 0
UNION ALL SELECT page_url, '' AS lang, 'no_x_default' AS finding, 'medium' AS severity FROM @hreflang@ GROUP BY page_url HAVING count_if(lang = 'x-default') = 0
UNION ALL SELECT h.page_url, h.lang, 'bad_code' AS finding, 'high' AS severity FROM @hreflang@ h WHERE NOT {code}
UNION ALL SELECT DISTINCT h.page_url, '' AS lang, 'canonical_elsewhere' AS finding, 'critical' AS severity FROM @hreflang@ h WHERE h.canonical <> '' AND h.canonical <> h.page_url
UNION ALL SELECT h.page_url, h.lang, 'mixed_protocol' AS finding, 'medium' AS severity FROM @hreflang@ h WHERE (h.href LIKE 'https://%') <> (h.page_url LIKE 'https://%')"""
