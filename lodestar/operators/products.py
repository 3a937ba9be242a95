"""Product feeds: titles, gaps, categories, breadcrumbs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.assignment import assign_in_order, assign_with_groups
from lodestar.operators.graph import settled
from lodestar.operators.matching import BLOCK_TITLES, all_ratios
from lodestar.plans.dialect import Duck, operator, text

# Stop words, Dutch then English.
STOP_WORDS = [
    "de", "het", "een", "van", "en", "in", "is", "op", "te", "dat", "die", "voor", "zijn", "met", "aan", "er", "maar", "om", "ook", "als", "dan",
    "naar", "bij", "nog", "wel", "geen", "wat", "wordt", "uit", "tot", "was", "heeft", "deze", "niet", "meer", "over", "zou", "worden",
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "it", "that", "this", "was", "are",
    "be", "has", "had", "have", "will", "can", "do", "does", "did", "not", "so", "if", "no", "up", "out", "all", "its", "as", "into", "more",
]
# Breadcrumb separators in order of priority.
SEPARATORS = [" > ", " / ", " | ", " » ", ">", "/", "|", "»"]


def identifier(d: Duck, x: str) -> str:
    """G1. Lower case without separators and leading zeros."""
    return d.sub(d.sub(f"lower({x})", r"[\s\-_/.]", ""), "^0+", "")


def title_tokens(d: Duck, x: str) -> str:
    """G2. Distinct lower-case tokens, hyphens kept within."""
    return d.distinct(d.extract_all(f"lower({x})", "[a-z0-9]+(?:-[a-z0-9]+)*"))


@operator
def product_keys(d: Duck) -> str:
    """G1, G2. Normalised identifier and number of title tokens of ``products`` (id, mpn, title)."""
    return f"SELECT id, {identifier(d, 'mpn')} AS key, CAST({d.size(title_tokens(d, 'title'))} AS BIGINT) AS tokens FROM @products@"


def _identifiers(d: Duck, side: str) -> str:
    return " UNION ALL ".join(f"SELECT id, {i} AS place, {identifier(d, f)} AS key FROM @{side}@ WHERE trim({f}) <> ''" for i, f in enumerate(("mpn", "sku", "gtin")))


@operator
def identifier_edges(d: Duck) -> str:
    """G3. (row, target, choice): for each product of ``own`` the first product of ``other`` under each of its identifiers (id, mpn, sku, gtin), in the order mpn, sku, gtin.

    An identifier of any field meets one of any field; of the products that share it, only the one with the smallest id counts.
    """
    return f"""
SELECT o.id AS row, c.id AS target, min(o.place) AS choice FROM ({_identifiers(d, 'own')}) AS o JOIN (SELECT key, min(id) AS id FROM ({_identifiers(d, 'other')}) AS k WHERE key <> '' GROUP BY key) AS c ON o.key = c.key GROUP BY o.id, c.id"""


@operator
def match_in_row_order(d: Duck) -> str:
    """G3, oracle of the pass by identifiers: the products of ``edges`` (row, target, choice) choose one after another, in a recursion over rows."""
    return """
WITH RECURSIVE lists AS (SELECT row, row_number() OVER (ORDER BY row) AS n, list({'choice': choice, 'target': target} ORDER BY choice, target) AS wanted FROM @edges@ GROUP BY row),
turns AS (
  SELECT 0::BIGINT AS n, NULL::BIGINT AS own_id, []::STRUCT(choice INTEGER, target BIGINT)[] AS taken
  UNION ALL
  SELECT l.n, l.row, list_concat(list_filter(l.wanted, lambda w: NOT list_contains(list_transform(t.taken, lambda x: x.target), w.target))[1:1], t.taken)
  FROM turns t JOIN lists l ON l.n = t.n + 1)
SELECT own_id, taken[1].target AS other_id, CAST(taken[1].choice AS INTEGER) AS matched_on FROM (SELECT *, len(taken) - lag(len(taken)) OVER (ORDER BY n) AS got FROM turns) AS t WHERE got = 1"""


#: How a match by title is told from one by mpn, sku or gtin (0, 1, 2).
BY_TITLE = 3


def match_products(own: DataFrame, other: DataFrame, title_ratio: float | None = 90.0) -> DataFrame:
    """G3. (own_id, other_id, matched_on): one-to-one matches of ``own`` and ``other`` (id, mpn, sku, gtin, title), in the order of own ids.

    Each own product takes the first free one among those that its mpn, sku and gtin lead to
    (matched_on 0, 1, 2); failing that, the free one whose title is most alike, with a ratio of
    ``title_ratio`` at least, the smaller id on a tie (matched_on 3). The result is that of the
    sequential loop over rows. Titles are compared only for products that may need it: those whose first
    choice is wanted by an earlier row, by identifier or title, or that have none; products of one
    title are not paired off: rows choose among the groups of products of alike titles.
    Null and blank identifiers and null titles match nothing; ids are distinct.
    """
    edges = settled(identifier_edges(own=own, other=other))
    if title_ratio is None:
        found = assign_in_order(edges)
    else:
        titles = own.select(F.col("id").alias("row"), F.col("title").alias("a"))
        targets = settled(other.select(F.col("id").alias("target"), F.col("title").alias("b")).filter("b IS NOT NULL"))
        few = titles.agg(F.count_distinct("a")).first()[0] * targets.agg(F.count_distinct("b")).first()[0] <= BLOCK_TITLES**2
        first = edges.groupBy("row").agg(F.min_by("target", F.struct("choice", "target")).alias("target"))
        wanted = edges.groupBy("target").agg(F.min("row").alias("by"))
        # a single block of titles is compared at once, for all rows
        safe = settled(first.join(wanted, "target").filter("by = row").select("row", "target")) if not few else None
        ask = titles.join(safe.select("row"), "row", "left_anti") if not few else titles
        asked, alike = None, None
        while True:
            ask = settled(ask.filter("a IS NOT NULL"))
            if ask.isEmpty():
                break
            new = ask.select("a").distinct() if alike is None else ask.select("a").distinct().join(asked.select("a").distinct(), "a", "left_anti")
            near = all_ratios(new, targets.select("b").distinct(), title_ratio).select("a", "b", (BY_TITLE + (100.0 - F.col("ratio"))).alias("choice"))
            asked = ask if asked is None else settled(asked.unionByName(ask))
            alike = settled(near if alike is None else alike.unionByName(near))
            if few:
                break
            # the first row that wants a title wants all products that have it
            by_title = alike.join(asked.groupBy("a").agg(F.min("row").alias("by")), "a").groupBy("b").agg(F.min("by").alias("by"))
            unsafe = settled(safe.join(targets.join(by_title, "b").select("target", "by"), "target").filter("by < row").select("row"))
            ask, safe = titles.join(unsafe, "row"), settled(safe.join(unsafe, "row", "left_anti"))
        found = assign_in_order(edges) if alike is None else assign_with_groups(edges, asked.toDF("row", "wish"), alike.toDF("wish", "of", "choice"), targets.toDF("target", "of"))
    return found.select(F.col("row").alias("own_id"), F.col("target").alias("other_id"), F.least("choice", F.lit(BY_TITLE)).cast("int").alias("matched_on"))


@operator
def title_gaps(d: Duck, top: int = 50) -> str:
    """G4. Tokens of the other title that the own one lacks, over ``matches`` (category, own_title, other_title): overall (category NULL) and by category."""
    missing = d.filter(d.minus(title_tokens(d, "other_title"), title_tokens(d, "own_title")), lambda x: f"length({x}) > 1 AND NOT {d.like(x, '^[0-9]+$')}")
    return f"""
SELECT category, token, n FROM (SELECT category, token, n, row_number() OVER (PARTITION BY category ORDER BY n DESC, token) AS rn FROM (
  SELECT category, token, CAST(count(*) AS BIGINT) AS n FROM (SELECT category, {d.explode(missing)} AS token FROM @matches@) AS x GROUP BY GROUPING SETS ((token), (category, token))) AS g) AS r
WHERE rn <= CASE WHEN category IS NULL THEN {top} ELSE 20 END"""


@operator
def title_patterns(d: Duck, positions: int = 12, k: int = 5) -> str:
    """G5. The commonest words at each place of the titles of ``titles`` (grp, title, position, row_id), with their share of the group's titles.

    Where a group's first row has a position, titles on positions 1 to 10 count, else all of them; dominant: a first word of more than 30 percent.
    """
    tokens = d.extract_all("lower(title)", "[a-z0-9]+(?:-[a-z0-9]+)*")
    return f"""
SELECT grp, place, word, n, round(n * 100e0 / titles, 1) AS percentage, place = 1 AND rn = 1 AND n * 100e0 / titles > 30 AS dominant FROM (
  SELECT w.grp, w.place, w.word, CAST(count(*) AS BIGINT) AS n, max(w.titles) AS titles, row_number() OVER (PARTITION BY w.grp, w.place ORDER BY count(*) DESC, w.word) AS rn FROM (
    SELECT grp, titles, place, {d.at('t', 'place')} AS word FROM (
      SELECT grp, t, titles, {d.explode(d.sequence('1', f'least({positions}, {d.size("t")})'))} AS place FROM (
        SELECT u.grp, u.t, c.titles FROM (
          SELECT x.grp, {tokens} AS t FROM @titles@ x JOIN (SELECT y.grp, max(y.position) AS first_position FROM @titles@ y JOIN (SELECT grp, min(row_id) AS row_id FROM @titles@ GROUP BY grp) AS f ON y.grp = f.grp AND y.row_id = f.row_id GROUP BY y.grp) AS h ON x.grp = h.grp
          WHERE h.first_position IS NULL OR (x.position > 0 AND x.position <= 10)) AS u
        JOIN (SELECT x.grp, count(*) AS titles FROM @titles@ x JOIN (SELECT y.grp, max(y.position) AS first_position FROM @titles@ y JOIN (SELECT grp, min(row_id) AS row_id FROM @titles@ GROUP BY grp) AS f ON y.grp = f.grp AND y.row_id = f.row_id GROUP BY y.grp) AS h ON x.grp = h.grp
          WHERE h.first_position IS NULL OR (x.position > 0 AND x.position <= 10) GROUP BY x.grp) AS c ON u.grp = c.grp) AS a) AS b) AS w GROUP BY w.grp, w.place, w.word) AS r WHERE rn <= {k}"""


@operator
def standardize_titles(d: Duck) -> str:
    """G6. Averages, brand-first share and separators of ``products`` (category, brand, title) by category; blank titles are left out, a missing category is All."""
    seps = ", ".join(f"CAST(count_if({d.instr('title', text(s))} > 0) AS BIGINT) AS {n}" for n, s in (("hyphens", " - "), ("pipes", " | "), ("slashes", " / "), ("en_dashes", " – "), ("em_dashes", " — ")))
    return f"""
SELECT category, CAST(count(*) AS BIGINT) AS products, round(avg(length(title)), 1) AS avg_chars, round(avg({d.count('title', '[^ ]+')}), 1) AS avg_words, CAST(min(length(title)) AS BIGINT) AS min_chars, CAST(max(length(title)) AS BIGINT) AS max_chars,
  round(count_if(brand <> '' AND lower(title) LIKE lower(brand) || '%') * 100e0 / count(*), 1) AS brand_first, CAST(count(DISTINCT CASE WHEN brand <> '' THEN lower(brand) END) AS BIGINT) AS brands, {seps}
FROM (SELECT coalesce(trim(category), 'All') AS category, trim(coalesce(brand, '')) AS brand, trim(title) AS title FROM @products@ WHERE trim(title) <> '') AS t GROUP BY category"""


@operator
def title_samples(d: Duck, k: int = 5) -> str:
    """G6. By category of ``products`` (id, category, title): the ``k`` commonest first words and the first ``k`` titles (by id)."""
    rows = f"(SELECT id, coalesce(trim(category), 'All') AS category, trim(title) AS title, {d.extract('lower(trim(title))', '^([^ ]+)')} AS word FROM @products@ WHERE trim(title) <> '')"
    return f"""
SELECT category, 'first_word' AS kind, CAST(place AS BIGINT) AS place, word AS value, n FROM (
  SELECT category, word, CAST(count(*) AS BIGINT) AS n, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, word) AS place FROM {rows} AS r GROUP BY category, word) AS w WHERE place <= {k}
UNION ALL SELECT category, 'sample' AS kind, CAST(place AS BIGINT) AS place, title AS value, CAST(1 AS BIGINT) AS n FROM (
  SELECT category, title, row_number() OVER (PARTITION BY category ORDER BY id) AS place FROM {rows} AS r) AS s WHERE place <= {k}"""


@operator
def discover_categories(d: Duck, min_freq: int = 5) -> str:
    """G7, G8. Two- and three-word phrases of the titles of ``products`` (category, title) by category, and whether a category covers them."""
    stop = d.array(*[text(w) for w in dict.fromkeys(STOP_WORDS)])
    words = d.filter(d.split(f"trim({d.sub(d.sub('lower(title)', r'[^a-z0-9\s-]', ' '), r'\s+', ' ')})", " "), lambda x: f"length({x}) > 1 AND NOT {d.contains(stop, x)}")
    gram = lambda n: f"SELECT category, {d.explode(d.transform(d.sequence('1', d.size('w') + f' - {n - 1}'), lambda x: d.join(d.slice('w', x, str(n)), ' ')))} AS phrase, {n} AS n FROM words"
    return f"""
WITH words AS (SELECT category, {words} AS w FROM @products@),
grams AS ({gram(2)} UNION ALL {gram(3)}),
counted AS (SELECT category, phrase, n, CAST(count(*) AS BIGINT) AS frequency FROM grams GROUP BY category, phrase, n HAVING count(*) >= {min_freq}),
known AS (SELECT DISTINCT lower(category) AS name FROM @products@)
SELECT c.category, c.phrase, c.n, c.frequency, EXISTS (SELECT 1 FROM known k WHERE {d.instr('k.name', 'c.phrase')} > 0 OR {d.instr('c.phrase', 'k.name')} > 0) AS already_exists FROM counted c"""


def crumbs(d: Duck, x: str) -> str:
    """G9. Parts of a breadcrumb by the first separator that gives more than one."""
    cases = " ".join(f"WHEN {d.instr(x, text(s))} > 0 THEN {d.split(x, s)}" for s in SEPARATORS)
    return f"CASE {cases} ELSE {d.array(x)} END"


@operator
def breadcrumb_parts(d: Duck) -> str:
    """G9. Depth and last part of each breadcrumb of ``pages`` (url, breadcrumb)."""
    return f"SELECT url, CAST({d.size('c')} AS BIGINT) AS depth, trim({d.at('c', d.size('c'))}) AS last_part FROM (SELECT url, {crumbs(d, 'breadcrumb')} AS c FROM @pages@) AS p"
