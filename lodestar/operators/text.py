"""Readability, passages, citability: text measures as SQL over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.graph import settled
from lodestar.plans.dialect import SPARK, Duck, operator, values

# Patterns of passage scores.
WEAK_OPENERS = r"(?i)^(This|It|That|These|Those|They|He|She|However|Moreover|Furthermore|Additionally|Also|But|And|Or|Yet|So|Thus|Hence|Therefore|In addition|As a result|On the other hand|In contrast)\b"
DATA = r"(?i)\b\d+[.,]?\d*\s*%|\$\d+|€\d+|£\d+|\b\d{4}\b|\b\d+[.,]\d+\b|\b\d+x\b|\b\d+\+\b|\b(?:million|billion|thousand|hundred)\b"
QUESTION = r"(?i)\b(what|how|why|when|where|who|which|can|does|is|are|should|will)\b.*\?"
# Patterns of citability scores.
DEFINITIONS = r"(?i)\b\w+\s+is\s+(?:a|an|the)\s|\b\w+\s+refers?\s+to\s|\b\w+\s+means?\s|\b\w+\s+(?:can be |are )?defined\s+as\s|\bin\s+(?:simple|other)\s+(?:terms|words)\s*,"
EARLY = r"(?i)\b(?:is|are|was|were|means?|refers?)\b|\d+%|\$[\d,]+|\d+\s+(?:million|billion|thousand)"
CLAIMS = r"(?i)(?:according to|research shows|studies? (?:show|indicate|suggest|found)|data (?:shows|indicates|suggests))"
PRONOUNS = r"(?i)\b(?:it|they|them|their|this|that|these|those|he|she|his|her)\b"
PROPER = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
LISTS = r"(?i)(?:first|second|third|finally|additionally|moreover|furthermore)"
NUMBERED = r"(?i)(?:\d+[\.\)]\s|\b(?:step|tip|point)\s+\d+)"
DOLLARS = r"\$[\d,]+(?:\.\d+)?(?:\s*(?:million|billion|M|B|K))?"
COUNTED = r"(?i)\b\d+(?:,\d{3})*(?:\.\d+)?\s+(?:users|customers|pages|sites|companies|businesses|people|percent|times|x\b)"
YEARS = r"\b20(?:2[3-6]|1\d)\b"
SOURCES = [r"(?:according to|per|from|by)\s+[A-Z]", r"(?:Gartner|Forrester|McKinsey|Harvard|Stanford|MIT|Google|Microsoft|OpenAI|Anthropic)", r"\([A-Z][a-z]+(?:\s+\d{4})?\)"]
OWN_DATA = r"(?i)(?:our (?:research|study|data|analysis|survey|findings)|we (?:found|discovered|analyzed|surveyed|measured))"
CASES = r"(?i)(?:case study|for example|for instance|in practice|real-world|hands-on)"
TOOLS = r"(?:using|with|via|through)\s+[A-Z][a-z]+"

WORD = r"[^\s]+"
#: Letters beyond ASCII; engines differ on whether a word boundary stands beside them, so they count as digits there.
LETTERS = "[À-ÖØ-öø-ɏͰ-῿]"


def words(d: Duck, s: str) -> str:
    return d.count(s, WORD)


def clean(d: Duck, s: str) -> str:
    """F1. White space collapsed and trimmed."""
    return f"trim({d.sub(s, r'\s+', ' ')})"


def sentences(d: Duck, s: str) -> str:
    """F2. Stretches between sentence ends that are longer than ten characters."""
    parts = d.split(d.sub(f"trim({s})", r"[.!?]+(\s|$)", "~|~"), "~|~") if d.name == "duckdb" else f"split(trim({s}), r'[.!?]+(\\s|$)', -1)"
    return d.size(d.filter(parts, lambda x: f"length(trim({x})) > 10"))


@operator
def text_measures(d: Duck) -> str:
    """F1, F2. Words, sentences and length of the cleaned ``texts`` (id, text)."""
    return f"""
SELECT id, CAST(length(t) AS BIGINT) AS characters, CAST({words(d, 't')} AS BIGINT) AS words, CAST({sentences(d, 't')} AS BIGINT) AS sentences FROM (SELECT id, {clean(d, 'text')} AS t FROM @texts@) AS c"""


@operator
def score_passages(d: Duck, lo: int = 134, hi: int = 167) -> str:
    """F6, F7. The six dimensions of each passage of ``passages`` (id, section, text), total and rating."""
    first = d.extract("t", r"^([^.!?]*)")
    unique = d.size(d.distinct(d.extract_all("lower(t)", WORD)))
    return f"""
SELECT id, word_count, length_score, self_containment, data_density, structure, lexical_diversity, qa_format, total,
  CASE WHEN total >= 80 THEN 'excellent' WHEN total >= 60 THEN 'good' WHEN total >= 40 THEN 'needs_work' WHEN total >= 20 THEN 'poor' ELSE 'critical' END AS rating
FROM (SELECT *, greatest(0, least(100, length_score + self_containment + data_density + structure + lexical_diversity + qa_format)) AS total FROM (
  SELECT id, CAST(n AS BIGINT) AS word_count, CAST(CASE WHEN n BETWEEN {lo} AND {hi} THEN 25 ELSE greatest(0, 25 - least(abs(n - {lo}), abs(n - {hi}))) END AS BIGINT) AS length_score,
    CAST(20 - CASE WHEN weak THEN 10 ELSE 0 END - CASE WHEN first_words < 5 THEN 5 ELSE 0 END - CASE WHEN ended THEN 0 ELSE 5 END AS BIGINT) AS self_containment,
    CAST(least(20, found * 5) AS BIGINT) AS data_density,
    CAST(least(15, CASE WHEN s BETWEEN 2 AND 5 THEN 15 WHEN s = 1 THEN 8 WHEN s = 6 THEN 12 ELSE greatest(0, 15 - abs(s - 4) * 2) END + CASE WHEN weak OR t LIKE '?%' THEN 0 ELSE 2 END) AS BIGINT) AS structure,
    CAST(least(10, {d.half_even('u / CAST(greatest(n, 1) AS DOUBLE) * 10')} + CASE WHEN u / CAST(greatest(n, 1) AS DOUBLE) BETWEEN 6e-1 AND 8e-1 THEN 2 ELSE 0 END) AS BIGINT) AS lexical_diversity,
    CAST(CASE WHEN asks AND NOT weak THEN 10 WHEN asks THEN 5 ELSE 0 END AS BIGINT) AS qa_format
  FROM (SELECT id, t, {words(d, 't')} AS n, {d.like('t', WEAK_OPENERS)} AS weak, {words(d, first)} AS first_words, {d.like('t', '[.!?]')} AS ended, {d.count('t', DATA)} AS found,
    {sentences(d, 't')} AS s, {unique} AS u, {d.like('section', QUESTION)} AS asks FROM (SELECT id, section, {clean(d, 'text')} AS t FROM @passages@) AS c) AS m) AS p) AS q"""


@operator
def passage_report(d: Duck) -> str:
    """F8. Passages of ``scored`` (id, total, rating, word_count, url, weight) by url: means, best, worst, weighted mean, share of the optimal length, distribution."""
    bands = ", ".join(f"CAST(count_if(rating = '{r}') AS BIGINT) AS {r}" for r in ("excellent", "good", "needs_work", "poor", "critical"))
    return f"""
SELECT url, round(avg(word_count), 1) AS avg_words, CAST(count_if(word_count BETWEEN 134 AND 167) AS BIGINT) AS optimal, round(count_if(word_count BETWEEN 134 AND 167) * 100e0 / count(*), 1) AS optimal_percentage, {bands}, CAST(count(*) AS BIGINT) AS passages, round(avg(total), 1) AS avg_score, max(total) AS best, min(total) AS worst, round(sum(total * weight) / sum(weight), 6) AS weighted,
  round(count_if(total >= 60) * 100e0 / count(*), 1) AS good_percentage FROM @scored@ GROUP BY url"""


@operator
def section_report(d: Duck) -> str:
    """F8. Passages of ``scored`` (id, total, url, section) by url and section."""
    return "SELECT url, section, CAST(count(*) AS BIGINT) AS passages, round(avg(total), 1) AS avg_score, max(total) AS best, min(total) AS worst FROM @scored@ GROUP BY url, section"


@operator
def passage_extremes(d: Duck, k: int = 5) -> str:
    """F8. The best and the worst k passages of each url of ``scored`` (id, total, url, weight), and their weighted priority; no worst ones among k or fewer."""
    return f"""
SELECT url, id, total, round(total * weight, 1) AS weighted_priority, CAST(n AS BIGINT) AS place, n <= {k} AS is_top, n > of_url - {k} AND of_url > {k} AS is_bottom
FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY total DESC, id) AS n, count(*) OVER (PARTITION BY url) AS of_url FROM @scored@) AS r WHERE n <= {k} OR n > of_url - {k}"""


@operator
def citability(d: Duck) -> str:
    """F10. The five dimensions of each of ``passages`` (id, heading, text), total and grade."""
    early = d.join(d.slice(d.extract_all("text", WORD), "1", "60"), " ")
    parts = d.split(d.sub("text", "[.!?]+", "~|~"), "~|~") if d.name == "duckdb" else "split(text, r'[.!?]+', -1)"
    clear = d.size(d.filter(parts, lambda x: f"{words(d, x)} BETWEEN 5 AND 25"))
    named = " + ".join(f"CASE WHEN {d.like('text', p)} THEN 2 ELSE 0 END" for p in SOURCES)
    return f"""
SELECT id, word_count, answer, containment, structure, statistics, uniqueness, total, CASE WHEN total >= 80 THEN 'A' WHEN total >= 65 THEN 'B' WHEN total >= 50 THEN 'C' WHEN total >= 35 THEN 'D' ELSE 'F' END AS grade
FROM (SELECT *, answer + containment + structure + statistics + uniqueness AS total FROM (
  SELECT id, CAST(n AS BIGINT) AS word_count,
    least(30, CASE WHEN defines THEN 15 ELSE 0 END + CASE WHEN early THEN 15 ELSE 0 END + CASE WHEN heading LIKE '%?' THEN 10 ELSE 0 END + {d.int('clear / CAST(parts AS DOUBLE) * 10')} + CASE WHEN claims THEN 10 ELSE 0 END) AS answer,
    CAST(least(25, CASE WHEN n BETWEEN 134 AND 167 THEN 10 WHEN n BETWEEN 100 AND 200 THEN 7 WHEN n BETWEEN 80 AND 250 THEN 4 WHEN n < 30 OR n > 400 THEN 0 ELSE 2 END
      + CASE WHEN n = 0 THEN 0 WHEN pronouns < n * 2e-2 THEN 8 WHEN pronouns < n * 4e-2 THEN 5 WHEN pronouns < n * 6e-2 THEN 3 ELSE 0 END + CASE WHEN proper >= 3 THEN 7 WHEN proper >= 1 THEN 4 ELSE 0 END) AS BIGINT) AS containment,
    CAST(least(20, CASE WHEN n BETWEEN 10 * parts AND 20 * parts THEN 8 WHEN n BETWEEN 8 * parts AND 25 * parts THEN 5 ELSE 2 END + CASE WHEN lists THEN 4 ELSE 0 END + CASE WHEN numbered THEN 4 ELSE 0 END + CASE WHEN breaks THEN 4 ELSE 0 END) AS BIGINT) AS structure,
    CAST(least(15, least(pct * 3, 6) + least(dollars * 3, 5) + least(counted * 2, 4) + CASE WHEN years > 0 THEN 2 ELSE 0 END + sources) AS BIGINT) AS statistics,
    CAST(least(10, CASE WHEN own THEN 5 ELSE 0 END + CASE WHEN cases THEN 3 ELSE 0 END + CASE WHEN tools THEN 2 ELSE 0 END) AS BIGINT) AS uniqueness
  FROM (SELECT id, heading, {words(d, 'text')} AS n, {d.like('text', DEFINITIONS)} AS defines, {d.like(early, EARLY)} AS early, {clear} AS clear, {d.size(parts)} AS parts, {d.like('text', CLAIMS)} AS claims,
    {d.count(d.sub('text', LETTERS, '0'), PRONOUNS)} AS pronouns, {d.count(d.sub('text', LETTERS, '0'), PROPER)} AS proper, {d.like('text', LISTS)} AS lists, {d.like('text', NUMBERED)} AS numbered, {d.like('text', r'\n')} AS breaks,
    {d.count('text', r'\d+(?:\.\d+)?%')} AS pct, {d.count('text', DOLLARS)} AS dollars, {d.count('text', COUNTED)} AS counted, {d.count('text', YEARS)} AS years, {named} AS sources,
    {d.like('text', OWN_DATA)} AS own, {d.like('text', CASES)} AS cases, {d.like('text', TOOLS)} AS tools FROM @passages@) AS m) AS p) AS q"""


@operator
def page_citability(d: Duck) -> str:
    """F11, F12. Blocks of ``scored`` (url, word_count, total, grade, containment) of 20 words or more, by url; category by self-contained share."""
    return """
SELECT url, CAST(count(*) AS BIGINT) AS blocks, round(avg(total), 1) AS avg_score, CAST(count_if(grade IN ('A', 'B')) AS BIGINT) AS good, CAST(count_if(grade = 'F') AS BIGINT) AS failing,
  CAST(count_if(word_count BETWEEN 134 AND 167) AS BIGINT) AS optimal,
  CASE WHEN count_if(containment >= 15) * 100 >= 80 * count(*) THEN 'excellent' WHEN count_if(containment >= 15) * 100 >= 60 * count(*) THEN 'good' WHEN count_if(containment >= 15) * 100 >= 40 * count(*) THEN 'moderate' ELSE 'poor' END AS category
FROM @scored@ WHERE word_count >= 20 GROUP BY url"""


@operator
def readability(d: Duck) -> str:
    """F13. Flesch, Flesch-Kincaid, Fog, SMOG and minutes of ``texts`` (id, text).

    Syllables are groups of vowels without a silent final e, at least one for each word; a
    complex word has three or more.
    """
    syllables_of = lambda w: f"CAST(greatest(1, {d.count(w, '[aeiouy]+')} - CASE WHEN {d.like(w, '[^aeiouyl]e$')} THEN 1 ELSE 0 END) AS BIGINT)"
    return f"""
SELECT id, words, sentences, syllables, complex_words, {d.round('206835e-3 - 1015e-3 * words / sentences - 846e-1 * syllables / words', 1)} AS flesch,
  {d.round('39e-2 * words / sentences + 118e-1 * syllables / words - 1559e-2', 1)} AS fk_grade, {d.round('4e-1 * (words / CAST(sentences AS DOUBLE) + 100e0 * complex_words / words)', 1)} AS fog,
  {d.round('1043e-3 * sqrt(complex_words * 30e0 / sentences) + 31291e-4', 1)} AS smog, {d.round('words / 238e0', 1)} AS minutes
FROM (SELECT id, CAST({d.size('each')} AS BIGINT) AS words, sentences, CAST({d.sum('each')} AS BIGINT) AS syllables, CAST({d.size(d.filter('each', lambda x: f'{x} >= 3'))} AS BIGINT) AS complex_words
  FROM (SELECT id, greatest(1, CAST({sentences(d, 'text')} AS BIGINT)) AS sentences, {d.transform(d.extract_all('lower(text)', '[a-z]+'), syllables_of)} AS each FROM @texts@) AS c) AS t WHERE words > 0"""


@operator
def metric_stats(d: Duck) -> str:
    """F14. Statistics of each metric of ``scores``: positional 10th and 90th percentiles, sample deviation."""
    metrics = ["flesch", "fk_grade", "fog", "smog", "minutes"]
    each = " UNION ALL ".join(f"SELECT '{m}' AS metric, id, {m} AS value FROM @scores@" for m in metrics)
    return f"""
SELECT metric, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(stddev_samp(value), 4) AS stdev, min(value) AS lowest, max(value) AS highest,
  max(CASE WHEN rn = {d.int('n * 10e-2')} + 1 THEN value END) AS p10, max(CASE WHEN rn = least(n - 1, {d.int('n * 90e-2')}) + 1 THEN value END) AS p90
FROM (SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY value, id) AS rn, count(*) OVER (PARTITION BY metric) AS n FROM ({each}) AS u) AS r GROUP BY metric"""


def metric_statistics(scores: DataFrame) -> DataFrame:
    """F14 by order statistics: rows as of ``metric_stats``."""
    from lodestar.operators.order import value_at

    names, rows = ["flesch", "fk_grade", "fog", "smog", "minutes"], []
    for m in names:
        n, mean, deviation, least, most = scores.agg(F.count(m), F.round(F.avg(m), 4), F.round(F.stddev_samp(m), 4), F.min(m), F.max(m)).first()
        if n:
            at = lambda place, m=m: float(value_at(scores, m, place))
            middle = (at((n + 1) // 2) + at(n // 2 + 1)) / 2
            rows.append((m, mean, middle, deviation, least, most, at(n // 10 + 1), at(min(n - 1, int(n * 0.9)) + 1)))
    made = scores.sparkSession.createDataFrame(rows, "metric string, mean double, median double, stdev double, lowest double, highest double, p10 double, p90 double")
    return made.withColumn("median", F.round("median", 4))


# Grade above which a text is hard and below which it is easy.
AUDIENCES = {"b2c": (10, 4), "b2b": (14, 6), "academic": (18, 10)}


@operator
def classify_readability(d: Duck, audience: str = "b2c") -> str:
    """F15, F17. Class of each row of ``scores`` for an audience, and whether it takes over eight minutes."""
    hard, easy = AUDIENCES[audience]
    return f"SELECT id, CASE WHEN fk_grade > {hard} THEN 'too_hard' WHEN fk_grade < {easy} THEN 'too_easy' ELSE 'fitting' END AS class, minutes > 8 AS is_long FROM @scores@"


# The grades meant for an audience.
TARGETS = {"b2c": (6, 8), "b2b": (8, 12), "academic": (12, 16)}


@operator
def grade_assessment(d: Duck, audience: str = "b2c") -> str:
    """F17. Mean grade of ``scores`` against the grades meant for an audience, and the share of texts of over eight minutes; none for an empty table."""
    lo, hi = TARGETS[audience]
    return f"""
SELECT pages, round(mean, 1) AS mean_grade, CASE WHEN mean > {hi} THEN 'above' WHEN mean < {lo} THEN 'below' ELSE 'within' END AS assessment, long_pages, CAST({d.half_even('long_pages * 100e0 / pages')} AS BIGINT) AS long_percentage
FROM (SELECT CAST(count(*) AS BIGINT) AS pages, avg(fk_grade) AS mean, CAST(count_if(minutes > 8) AS BIGINT) AS long_pages FROM @scores@ HAVING count(*) > 0) AS t"""


#: Bands of grades.
BANDS = [("0-4", 0.0, 4.99), ("5-6", 5.0, 6.99), ("7-8", 7.0, 8.99), ("9-10", 9.0, 10.99), ("11-12", 11.0, 12.99), ("13+", 13.0, 99.0)]


def grade_bands(scores: DataFrame) -> DataFrame:
    """F16 in one pass: rows as of ``grade_distribution``; texts are scored once, and the bands are counted where the scores are."""
    within = [F.count_if(F.col("id").isNotNull() & F.col("fk_grade").between(lo, hi)) for _, lo, hi in BANDS]
    counts = settled(scores.select("id", "fk_grade")).agg(F.count(F.lit(1)).alias("n"), *[c.alias(f"b{k}") for k, c in enumerate(within)])
    bands = F.explode(F.array(*[F.struct(F.lit(band).alias("band"), F.col(f"b{k}").alias("pages")) for k, (band, _, _) in enumerate(BANDS)]))
    percentage = f"CAST({SPARK.half_even('b.pages * 100e0 / n')} AS BIGINT) AS percentage"
    return counts.select("n", bands.alias("b")).selectExpr("b.band AS band", "b.pages AS pages", percentage)


@operator
def grade_distribution(d: Duck) -> str:
    """F16. Rows of ``scores`` by band of grade; negative grades fall in none."""
    bands = values(BANDS, "band, lo, hi")
    return f"""
SELECT b.band, CAST(count(s.id) AS BIGINT) AS pages, CAST({d.half_even('count(s.id) * 100e0 / max(t.n)')} AS BIGINT) AS percentage
FROM {bands} AS b CROSS JOIN (SELECT count(*) AS n FROM @scores@) AS t LEFT JOIN @scores@ s ON s.fk_grade BETWEEN b.lo AND b.hi GROUP BY b.band"""


@operator
def entity_frequency(d: Duck, top: int = 50) -> str:
    """F18. Capitalised phrases of ``texts`` (id, text): mentions and pages."""
    return f"""
SELECT entity, CAST(count(*) AS BIGINT) AS mentions, CAST(count(DISTINCT id) AS BIGINT) AS pages FROM (SELECT id, {d.explode(d.extract_all('text', '[A-Z][a-z]+(?: [A-Z][a-z]+)+'))} AS entity FROM @texts@) AS x
GROUP BY entity ORDER BY mentions DESC, entity LIMIT {top}"""


def _mentions(d: Duck) -> str:
    """(id, entity, place) of each mention; place: share of the text's phrases before it."""
    return f"""(SELECT id, entity, (n - 1) / CAST(total AS DOUBLE) AS place FROM (
  SELECT id, total, n, {d.at('found', 'n')} AS entity FROM (SELECT id, found, {d.size('found')} AS total, {d.explode(d.sequence('1', d.size('found')))} AS n FROM (
    SELECT id, {d.extract_all('text', '[A-Z][a-z]+(?: [A-Z][a-z]+)+')} AS found FROM @texts@) AS t) AS u) AS v)"""


@operator
def entity_prominence(d: Duck, top: int = 50) -> str:
    """F18. The entities of ``texts`` (id, text) that stand earliest: mentions, pages, mean place of all mentions and of each page's first (0: the beginning).

    A place is the share of the text's capitalised phrases that stand before it; entities of fewer than two pages are left out.
    """
    return f"""
SELECT entity, CAST(sum(mentions) AS BIGINT) AS mentions, CAST(count(*) AS BIGINT) AS pages, round(sum(places) / sum(mentions), 6) AS mean_place, round(avg(first_place), 6) AS mean_first_place FROM (
  SELECT id, entity, count(*) AS mentions, sum(place) AS places, min(place) AS first_place FROM {_mentions(d)} AS m GROUP BY id, entity) AS p
GROUP BY entity HAVING count(*) >= 2 ORDER BY mean_first_place, entity LIMIT {top}"""


@operator
def entity_pairs(d: Duck, frequent: int = 200, top: int = 100) -> str:
    """F18. Pairs of entities of ``texts`` (id, text) that most pages have both of, among the ``frequent`` entities of most pages.

    The entities are cut to the frequent ones, by exact counts, before they meet, so a page has at most frequent ** 2 / 2 pairs.
    """
    return f"""
WITH held AS (SELECT DISTINCT id, entity FROM {_mentions(d)} AS m),
frequent AS (SELECT entity FROM (SELECT entity, count(*) AS pages FROM held GROUP BY entity) AS c ORDER BY pages DESC, entity LIMIT {frequent}),
kept AS (SELECT h.id, h.entity FROM held h JOIN frequent f ON h.entity = f.entity)
SELECT a.entity AS entity_a, b.entity AS entity_b, CAST(count(*) AS BIGINT) AS pages FROM kept a JOIN kept b ON a.id = b.id AND a.entity < b.entity GROUP BY a.entity, b.entity ORDER BY pages DESC, entity_a, entity_b LIMIT {top}"""


@operator
def blog_geo(d: Duck) -> str:
    """F19. 15 points of ``posts`` (url, passages, question_headings, faq, entities, sources, headings, lists, robots_ok, ssr)."""
    return """
SELECT url, points, CASE WHEN points >= 12 THEN 'strong' WHEN points >= 8 THEN 'fair' ELSE 'weak' END AS band FROM (
  SELECT url, least(4, passages) + CASE WHEN question_headings >= 3 THEN 2 WHEN question_headings > 0 THEN 1 ELSE 0 END + CASE WHEN faq THEN 1 ELSE 0 END
    + CASE WHEN entities >= 5 THEN 2 WHEN entities > 0 THEN 1 ELSE 0 END + CASE WHEN sources > 0 THEN 1 ELSE 0 END + CASE WHEN headings >= 4 THEN 2 WHEN headings > 0 THEN 1 ELSE 0 END + CASE WHEN lists > 0 THEN 1 ELSE 0 END
    + CASE WHEN robots_ok THEN 1 ELSE 0 END + CASE WHEN ssr THEN 1 ELSE 0 END AS points FROM @posts@) AS p"""


@operator
def signal_total(d: Duck) -> str:
    """F20. Sum of judged signals (``signals``: page, pillar, points), at most 25 for each of the four pillars."""
    return """
SELECT page, CAST(sum(points) AS BIGINT) AS total FROM (SELECT page, pillar, least(25, sum(points)) AS points FROM @signals@ GROUP BY page, pillar) AS p GROUP BY page"""


@operator
def title_checks(d: Duck) -> str:
    """F21. The decidable dimensions of ``titles`` (title, keyword): length and place of the keyword, 0-10 each."""
    at = d.instr("lower(title)", "lower(keyword)")
    return f"""
SELECT title, keyword, CASE WHEN length(title) BETWEEN 50 AND 60 THEN 10 WHEN length(title) BETWEEN 40 AND 65 THEN 7 WHEN length(title) BETWEEN 30 AND 70 THEN 4 ELSE 1 END AS length_points,
  CASE WHEN {at} = 0 THEN 0 WHEN {at} = 1 THEN 10 WHEN {at} <= length(title) / 2 THEN 7 ELSE 4 END AS keyword_points FROM @titles@"""
