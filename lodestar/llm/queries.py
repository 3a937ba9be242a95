"""The queries opN_<name> over the synthetic tables, and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, classifier, conversation_trie, fim, license_scan, mixing, multi_index, quality_rules, sharding, simhash, substring_dedup, unigram, url_filter
from lodestar.llm.common import table

#: Rules of the url filter's contract.
URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]

ORACLE_SQL: dict[str, str] = {}


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; cutoffs are certified for each language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    judged = quality_rules.apply_quality_rules(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule")


def _op1_oracle() -> str:
    rules = quality_rules.RULES
    risk, level, steps = quality_rules.RISK, quality_rules.LEVEL, quality_rules.STEPS
    over = lambda rule, step: f"1000 * {rules[rule][0]} > {quality_rules.cutoff_at(rule, step)} * {rules[rule][1]}"
    each = " UNION ALL ".join(f"SELECT lang, {i} AS step, count(*) AS n, count(*) FILTER (WHERE {' OR '.join(over(r, i) for r in rules)}) AS k FROM good GROUP BY lang" for i in range(steps))
    cutoffs = ", ".join("([" + ", ".join(str(quality_rules.cutoff_at(r, i)) for i in range(steps)) + f"])[step + 1] AS cut_{r}" for r in rules)
    first = "CASE " + " ".join(f"WHEN 1000 * {a} > cut_{r} * {b} THEN '{r}'" for r, (a, b, _) in rules.items()) + " END"
    return rf"""
WITH cut AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS words FROM documents),
numbered AS (SELECT row_number() OVER () AS r, * FROM cut),
windows AS (
  SELECT r, unnest(range(1, len(words) - 1)) AS i, unnest(list_transform(range(1, len(words) - 1), lambda i: [words[i], words[i + 1], words[i + 2]])) AS w
  FROM numbered WHERE len(words) > 2),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + d) AS n FROM repeated, (VALUES (0), (1), (2)) AS t(d) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM numbered),
dups AS (
  SELECT r, sum(c - 1) AS n FROM (SELECT r, line, count(*) AS c FROM lines WHERE regexp_matches(line, '[^ 	-
]') GROUP BY r, line) GROUP BY r),
counts AS (
  SELECT doc_id, lang, len(words)::BIGINT AS n_words, length(list_aggregate(words || [''], 'string_agg', ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals
  FROM numbered LEFT JOIN dups USING (r) LEFT JOIN covered USING (r)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
good AS (SELECT b.* FROM based b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
tested AS ({each}),
strata AS (SELECT count(DISTINCT coalesce(lang, chr(0))) AS m FROM good),
tails AS (
  SELECT lang, step,
    CASE WHEN k >= n * {risk} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda j:
      exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk}) + (n - j) * ln(1 - {risk})))) END <= {level} / m AS passes
  FROM tested, strata),
certified AS (
  SELECT lang, max(step) AS step
  FROM (SELECT *, bool_and(passes) OVER (PARTITION BY lang ORDER BY step) AS all_pass FROM tails) WHERE all_pass GROUP BY lang),
judged AS (SELECT b.*, {first} AS failed_rule FROM based b LEFT JOIN (SELECT *, {cutoffs} FROM certified) c ON b.lang IS NOT DISTINCT FROM c.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rule IS NULL AS kept, failed_rule
FROM judged
"""


ORACLE_SQL["op1_quality_rules"] = _op1_oracle()


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, and the target of its source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL["op2_mixing"] = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('{mixing.SEED}' || coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_rank FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((source_rank - 1) % 3 + 1)::INT] AS weight, sum(source_size) OVER () AS total FROM per),
levels AS (
  SELECT *, 2 * source_size / weight AS at_full,
    (total * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY 2 * source_size / weight, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
aims AS (
  SELECT *, CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE coalesce(least((2 * source_size)::DOUBLE,
    weight * (SELECT min_by(level, at_full) FROM levels WHERE level < at_full)), (2 * source_size)::DOUBLE) END AS target
  FROM levels),
placed AS (
  SELECT row_number() OVER () AS r, s.*, a.source_rank, a.weight, a.source_size, a.total, a.target,
    sum(s.size) OVER (PARTITION BY a.source_rank ORDER BY h, doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source),
queue AS (SELECT r, size, total, source_rank, h, doc_id, copy, (upto + source_size * copy) / weight AS time FROM placed, (VALUES (0), (1)) AS c(copy)),
queued AS (SELECT r, total, sum(size) OVER (ORDER BY time, source_rank, h, doc_id, size, copy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS words FROM queue),
copies AS (SELECT r, count(*) AS n FROM queued WHERE words * 2 <= total * 3 GROUP BY r)
SELECT doc_id, size, source_size, target, (size * coalesce(n, 0))::BIGINT AS taken FROM placed LEFT JOIN copies USING (r)
"""


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every whole document, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"), digests=True)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that it repeats, and where they stood."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup_substrings(docs).select("doc_id", "removed_words", "spans", "text")


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector, among all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return multi_index.search(vectors, F.col("vec_id") % 20 == 0)


def op6_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classifier.score_quality(docs, table(spark, sf_dir, "labels"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict and rule for the url of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL["op7_url_filter"] = r"""
WITH rules AS (
  SELECT * FROM (VALUES ('block','com','/en/','com/en/'), ('allow','example.com','/en/7','example.com/en/7'),
    ('allow','net','/de/','net/de/'), ('block','example.net','/de/8','example.net/de/8'), ('block','org','/es/','org/es/'))
    AS t(verdict, r_host, r_path, rule)),
cut AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
found AS (
  SELECT page_id, host, path, max_by(rule, length(r_host) * 100000 + length(r_path)) AS rule,
    max_by(verdict, length(r_host) * 100000 + length(r_path)) AS verdict
  FROM cut JOIN rules ON (host = r_host OR host LIKE '%.' || r_host) AND starts_with(path, r_path)
  GROUP BY page_id, host, path)
SELECT cut.page_id, cut.host, cut.path, found.rule, coalesce(found.verdict, 'allow') AS verdict
FROM cut LEFT JOIN found USING (page_id)
"""

def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of near-duplicates of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens, tokens and log probability of every whole document under a unigram model."""
    scores = unigram.rank_scores(unigram.read_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    return unigram.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), scores)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; sizes of the 16 shards are near equal."""
    packed = sharding.pack_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), 16)
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _op11_oracle() -> str:
    k, covered, slack = license_scan.K, license_scan.COVERED, license_scan.SLACK
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    listed = [f"({i}, {quote(label)}, true, {quote(p)}, {quote(p)})" for i, (p, label) in enumerate(license_scan.PHRASES)]
    listed += [f"({len(listed) + i}, {quote(label)}, false, {quote(must)}, {quote(text)})" for i, (label, must, text) in enumerate(license_scan.TEMPLATES)]
    words = lambda x: f"regexp_extract_all(translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    places = lambda x: f"range(0, greatest(len({x}) - {k - 1}, 0))"
    return rf"""
WITH listed AS (SELECT no, label, base, {words("telling")} AS told, {words("txt")} AS words FROM (VALUES {", ".join(listed)}) AS t(no, label, base, telling, txt)),
marked AS (
  SELECT *, list_filter(range(0, len(words)), lambda i: words[i + 1 : i + len(told)] = told)[1] AS told_at FROM listed),
known AS (
  SELECT no, label, base, len(words) AS m, list_transform({places("told")}, lambda i: i + told_at) AS must, unnest({places("words")}) AS q,
    unnest(list_transform({places("words")}, lambda i: words[i + 1 : i + {k}])) AS gram FROM marked),
docs AS (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS words FROM documents),
cut AS (SELECT r, unnest({places("words")}) AS p, unnest(list_transform({places("words")}, lambda i: words[i + 1 : i + {k}])) AS gram FROM docs),
votes AS (SELECT r, no, label, base, m, must, p - q AS diagonal, list(q) AS met FROM cut JOIN known USING (gram) GROUP BY ALL),
merged AS (
  SELECT *, list_distinct(flatten(list(met) OVER (PARTITION BY r, no ORDER BY diagonal RANGE BETWEEN CURRENT ROW AND {slack} FOLLOWING))) AS near FROM votes),
judged AS (
  SELECT r, label, base AND len(met) = m - {k - 1} AS place, diagonal,
    CASE WHEN base THEN (len(met) = m - {k - 1})::INT::DOUBLE ELSE len(list_distinct(flatten(list_transform(near, lambda q: range(q, q + {k}))))) / m::DOUBLE END AS share,
    NOT base AND len(list_distinct(flatten(list_transform(near, lambda q: range(q, q + {k}))))) / m::DOUBLE >= {covered} AND list_has_all(near, must) AS verified
  FROM merged),
found AS (
  SELECT r, count(*) FILTER (WHERE place) AS n_base, min(diagonal) FILTER (WHERE place) AS first_word, max(diagonal) FILTER (WHERE place) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE place) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE place OR verified) AS labels,
    max(share) AS score FROM judged GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM docs LEFT JOIN found USING (r)
"""


ORACLE_SQL["op11_license_scan"] = _op11_oracle()


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle form of every whole document, and the text restored from it, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = fim.fill_in_middle(docs).withColumnsRenamed({"prefix_units": "prefix_chars", "middle_units": "middle_chars"})
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(fim.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE_SQL["op12_fill_in_middle"] = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
cut AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS u, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS v,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (SELECT *, substr(text, 1, least(u, v)) AS before, substr(text, least(u, v) + 1, greatest(u, v) - least(u, v)) AS middle, substr(text, greatest(u, v) + 1) AS behind FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(u, v) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(u, v) - least(u, v) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || before || '<S>' || behind || '<M>' || middle ELSE '<S>' || behind || '<P>' || before || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations, with the totals of its subtree."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trie = conversation_trie.prefix_trie(turns, base=lambda c: c - c % 20, borrowed=lambda c: F.crc32(c.cast("string").cast("binary")) % 4, most_borrowed=3)
    return trie.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


ORACLE_SQL["op13_conversation_trie"] = r"""
WITH said AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS words
  FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT c, list({k: k, w: words} ORDER BY i) AS own FROM said GROUP BY c),
heads AS (
  SELECT *, xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::UBIGINT),
    lambda a, b: list_reduce([xor(a, b)] || list_transform(range(8), lambda j: j::UBIGINT), lambda x, j: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT)::BIGINT % 4 AS h
  FROM lists),
rebuilt AS (
  SELECT a.c, coalesce(b.own[1 : a.h], []) || a.own[a.h + 1 :] AS turns FROM heads a LEFT JOIN lists b ON b.c = a.c - a.c % 20),
prefixes AS (
  SELECT c, turns, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt),
keyed AS (
  SELECT c, n, d, sha256(array_to_string(list_transform(turns[1 : d], lambda t: t.k), ' ')) AS node,
    CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(turns[1 : d - 1], lambda t: t.k), ' ')) END AS parent, CASE WHEN d > 0 THEN turns[d].w ELSE 0 END AS w
  FROM prefixes),
nodes AS (
  SELECT node, d, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS saved,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM keyed GROUP BY node, d),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes GROUP BY parent),
path AS (SELECT DISTINCT a.node, b.node AS above FROM keyed a JOIN keyed b ON a.c = b.c AND b.d <= a.d),
totals AS (
  SELECT above AS node, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum(saved) AS saved_tokens
  FROM path JOIN nodes USING (node) LEFT JOIN children USING (node) GROUP BY above)
SELECT a.conv_id, a.d::BIGINT AS depth, p.conv_id AS parent_conv_id, a.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, a.ends_sha256
FROM nodes a JOIN totals t ON t.node = a.node LEFT JOIN children c ON c.node = a.node LEFT JOIN nodes p ON p.node = a.parent
"""


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_mixing, op3_bpe, op4_substring_dedup, op5_multi_index, op6_classifier, op7_url_filter, op8_simhash, op9_token_counts, op10_sharding, op11_license_scan, op12_fill_in_middle, op13_conversation_trie)}
