"""Similarity, keyword mapping, result-page clusters and duplicates.

Vector pairs are scored in blocks: each side is dealt into blocks by hash, and a task scores
one block against one block with a matrix product (see ``similar_pairs``).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.assignment import keep_in_order
from lodestar.operators.graph import settled
from lodestar.operators.setjoin import similar_sets
from lodestar.plans.dialect import SPARK, Duck, e, operator
from lodestar.sources.shipping import ship

# Words of a url that say nothing.
SLUG_STOP = ["www", "com", "net", "org", "html", "htm", "php", "asp", "index", "page", "en", "nl", "de"]
#: Rows of a block of vectors, and of a strip that is multiplied at once.
BLOCK, STRIP = 4096, 256


def slug_words(d: Duck, url: str) -> str:
    """B2. Distinct words of a url's path, longer than two characters and not in the stop list."""
    path = d.extract(d.sub(f"lower({url})", r"^https?://[^/]+", ""), r"^([^?#]*)")
    stop = d.array(*[f"'{w}'" for w in SLUG_STOP])
    return d.distinct(d.filter(d.split(f"translate({path}, '-_.+', '////')", "/"), lambda x: f"length({x}) > 2 AND NOT {d.contains(stop, x)}"))


def keyword_boost(d: Duck, kw: str, url: str, boost: float = 0.05) -> str:
    """B3. Share of the keyword's words that the url's path has, times ``boost``."""
    words = d.distinct(d.filter(d.split(f"lower(trim({kw}))", " "), lambda x: f"{x} <> ''"))
    return f"({d.size(d.intersect(words, slug_words(d, url)))} * {e(boost)} / greatest({d.size(words)}, 1))"


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, key: str = "id", vector: str = "vector", block: int = BLOCK, best: tuple[str, int, float] | None = None) -> DataFrame:
    """B1. (left_id, right_id, similarity) of all pairs with a cosine of at least ``threshold``.

    Blocks of ``block`` rows on either side meet in one task each, whatever the number of rows, a strip at a time;
    a vector of length zero has cosine zero with all. Null vectors take no part.

    ``best`` (side, k, slack): leaves out the pairs of a row of that side ("left" or "right") that lie more than ``slack``
    below its k-th best of the block, for whoever wants no more than k of each row: k better ones of the same row stay.
    """
    spark = left.sparkSession
    ship(spark)
    sides = []
    for df, name in ((left, "left"), (right, "right")):
        size = 4 * block if best and best[0] != name else block  # long rows to choose the best of
        kept = df.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter("v IS NOT NULL")
        n = max(1, math.ceil(kept.count() / size))
        sides.append((kept.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), n))
    (a, na), (b, nb) = sides
    a = a.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))).withColumnsRenamed({"b": "x", "c": "y"})
    b = b.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(na - 1)))).withColumnsRenamed({"b": "y", "c": "x"})
    kinds = [dict(df.select(key).dtypes)[key] for df in (left, right)]
    turned = bool(best) and best[0] == "right"

    def score(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"left_id": l["id"][:0], "right_id": r["id"][:0], "similarity": np.zeros(0)})
        if l.empty or r.empty:
            return empty
        p, q = (np.stack(side["v"].to_numpy()).astype(np.float64) for side in (l, r))
        p /= np.linalg.norm(p, axis=1, keepdims=True) + 1e-10
        q /= np.linalg.norm(q, axis=1, keepdims=True) + 1e-10
        if turned:
            p, q = q, p
        rows, columns, values = [], [], []
        for at in range(0, len(p), STRIP):
            s = p[at : at + STRIP] @ q.T
            hit = s >= threshold
            if best and best[1] < s.shape[1]:
                hit &= s >= np.partition(s, -best[1], axis=1)[:, -best[1], None] - best[2]
            i, j = np.nonzero(hit)
            rows.append((i + at).astype(np.int32))
            columns.append(j.astype(np.int32))
            values.append(s[i, j])
        i, j = np.concatenate(rows), np.concatenate(columns)
        if turned:
            i, j = j, i
        return pd.DataFrame({"left_id": l["id"].to_numpy()[i], "right_id": r["id"].to_numpy()[j], "similarity": np.concatenate(values)})

    return a.groupBy("x", "y").cogroup(b.groupBy("x", "y")).applyInPandas(score, f"left_id {kinds[0]}, right_id {kinds[1]}, similarity double")


@operator
def cosine_pairs(d: Duck, threshold: float = -1.0) -> str:
    """B1 in SQL, for small sides: ``a`` and ``b`` (id, vector) by inner product of the normalised vectors."""
    va, vb = d.doubles("a.vector"), d.doubles("b.vector")
    return f"""
SELECT left_id, right_id, round(similarity, 6) AS similarity FROM (
  SELECT a.id AS left_id, b.id AS right_id, {d.dot(va, vb)} / ((sqrt({d.dot(va, va)}) + 1e-10) * (sqrt({d.dot(vb, vb)}) + 1e-10)) AS similarity
  FROM @a@ a CROSS JOIN @b@ b) AS s WHERE similarity >= {e(threshold)}"""


@operator
def keyword_mapping(d: Duck, threshold: float = 0.70, top_n: int = 5, boost: float = 0.05) -> str:
    """B4. Best pages of each keyword in ``pairs`` (keyword, url, similarity): cosine plus url boost."""
    return f"""
SELECT keyword, url, CAST(n AS BIGINT) AS match_rank, {d.round('combined', 4)} AS similarity, {d.round('combined', 4)} >= {e(threshold)} AS strong FROM (
  SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY combined DESC, url) AS n FROM (
    SELECT keyword, url, similarity + {keyword_boost(d, 'keyword', 'url', boost)} AS combined FROM @pairs@) AS c) AS r
WHERE n <= {top_n} AND combined >= {e(threshold * 0.5)}"""


@operator
def keyword_classes(d: Duck) -> str:
    """B4. Class of each keyword of ``keywords`` by its strong matches in ``mapping``."""
    return """
SELECT k.keyword, CAST(count_if(m.strong) AS BIGINT) AS strong_matches,
  CASE WHEN count_if(m.strong) = 0 THEN 'gap' WHEN count_if(m.strong) = 1 THEN 'mapped' ELSE 'cannibalization' END AS class
FROM @keywords@ k LEFT JOIN @mapping@ m ON k.keyword = m.keyword GROUP BY k.keyword"""


@operator
def hub_pages(d: Duck, least: int = 5) -> str:
    """B5. Strong matches of ``mapping`` by url, and whether the url is a hub."""
    return f"""
SELECT url, CAST(count(*) AS BIGINT) AS keywords, round(avg(similarity), 6) AS avg_similarity, count(*) >= {least} AS is_hub FROM @mapping@ WHERE strong GROUP BY url"""


@operator
def near_duplicate_pairs(d: Duck) -> str:
    """B6. ``pairs`` (left_id < right_id, similarity) with the ``minhash`` (url, closest_match, similarity_pct) and ``semantic``
    (url, closest_semantic_match, semantic_score) values where the left page names the right one."""
    return f"""
SELECT p.left_id, p.right_id, {d.round('p.similarity', 4)} AS similarity, m.similarity_pct AS minhash_pct, s.semantic_score
FROM @pairs@ p LEFT JOIN @minhash@ m ON p.left_id = m.url AND p.right_id = m.closest_match
LEFT JOIN @semantic@ s ON p.left_id = s.url AND p.right_id = s.closest_semantic_match WHERE p.left_id < p.right_id"""


@operator
def cluster_summary(d: Duck) -> str:
    """B7, B8. Size, similarity, class and advice of each cluster: ``members`` (node, root) and ``pairs`` (left_id, right_id, similarity, minhash_pct)."""
    return """
SELECT *, CASE class WHEN 'EXACT_DUPLICATE' THEN 'CANONICAL' WHEN 'NEAR_DUPLICATE' THEN 'MERGE' WHEN 'SEMANTICALLY_SIMILAR' THEN 'REVIEW' ELSE 'OK' END AS advice FROM (
SELECT c.root, c.size, p.max_similarity, p.avg_similarity,
  CASE WHEN p.minhash >= 95 THEN 'EXACT_DUPLICATE' WHEN p.minhash >= 90 THEN 'NEAR_DUPLICATE' WHEN p.max_similarity >= 95e-2 THEN 'NEAR_DUPLICATE'
    WHEN p.max_similarity >= 85e-2 THEN 'SEMANTICALLY_SIMILAR' WHEN p.max_similarity >= 70e-2 THEN 'THEMATICALLY_RELATED' ELSE 'RELATED' END AS class
FROM (SELECT root, CAST(count(*) AS BIGINT) AS size FROM @members@ GROUP BY root) AS c
JOIN (SELECT m.root, max(round(q.similarity, 4)) AS max_similarity, round(avg(round(q.similarity, 4)), 4) AS avg_similarity, max(q.minhash_pct) AS minhash
  FROM @pairs@ q JOIN @members@ m ON q.left_id = m.node GROUP BY m.root) AS p ON c.root = p.root) AS s"""


@operator
def exact_duplicates(d: Duck) -> str:
    """B9. Groups of ``docs`` (id, text) with equal MD5."""
    return f"""
SELECT hash, CAST(count(*) AS BIGINT) AS copies, min(id) AS first_id, max(id) AS last_id FROM (SELECT id, {d.md5('text')} AS hash FROM @docs@) AS h GROUP BY hash HAVING count(*) > 1"""


@operator
def component_class(d: Duck) -> str:
    """B12, B13. Weighted similarity of page components and the advice: ``parts`` (pair, title, h1, meta, body), cosines."""
    return """
SELECT pair, round(20e-2 * title + 15e-2 * h1 + 10e-2 * meta + 55e-2 * body, 4) AS weighted,
  CASE WHEN title >= 90e-2 AND body < 60e-2 THEN 'DIFFERENTIATE' WHEN body >= 85e-2 AND title < 60e-2 THEN 'CANONICAL' WHEN title >= 90e-2 AND body >= 85e-2 THEN 'MERGE'
    WHEN body >= 70e-2 THEN 'REWRITE' ELSE 'MONITOR' END AS advice FROM @parts@"""


PARTS = ("title", "h1", "meta", "body")


@operator
def tfidf_weights(d: Duck) -> str:
    """B12. (id, part, term, w, norm): TF-IDF of the words of ``pages`` (id, title, h1, meta, body), for each part on its own.

    w = count in the part x (ln((1 + pages) / (1 + pages with the term)) + 1); norm is the length of the page's vector of that part.
    """
    each = " UNION ALL ".join(f"SELECT id, '{p}' AS part, {d.explode(d.extract_all(f'lower({p})', '[a-z0-9]+'))} AS term FROM @pages@" for p in PARTS)
    return f"""
WITH terms AS (SELECT id, part, term, count(*) AS tf FROM ({each}) AS x GROUP BY id, part, term),
uses AS (SELECT part, term, count(*) AS df FROM terms GROUP BY part, term),
weighed AS (SELECT t.id, t.part, t.term, t.tf * (ln((1e0 + n.n) / (1e0 + u.df)) + 1e0) AS w FROM terms t JOIN uses u ON t.part = u.part AND t.term = u.term CROSS JOIN (SELECT count(*) AS n FROM @pages@) AS n)
SELECT id, part, term, w, sqrt(sum(w * w) OVER (PARTITION BY id, part)) AS norm FROM weighed"""


@operator
def component_cosines(d: Duck) -> str:
    """B12. Cosines of title, h1, meta and body of ``pairs`` (pair, left_id, right_id) over ``weights`` (see tfidf_weights); 0 where a side has no words.

    The two pages of a pair meet term by term, so the work is that of the shared vocabulary.
    """
    cosines = ", ".join(f"coalesce(round(sum(CASE WHEN part = '{p}' THEN cosine END), 6), 0e0) AS {p}" for p in PARTS)
    return f"""
SELECT p.pair, {cosines} FROM @pairs@ p LEFT JOIN (
  SELECT q.pair, a.part, sum(a.w / a.norm * b.w / b.norm) AS cosine FROM @pairs@ q JOIN @weights@ a ON a.id = q.left_id JOIN @weights@ b ON b.id = q.right_id AND b.part = a.part AND b.term = a.term GROUP BY q.pair, a.part) AS c
ON p.pair = c.pair GROUP BY p.pair"""


#: Terms of two pages or more that are sent to the tasks at most, 16 bytes each; beyond, the weights are joined as rows.
MOST_TERMS = 8_000_000


def _term_hash(term, seed: int):
    """64 bits of a term; the terms of a corpus are numbered by a seed that gives no two of them the same."""
    return F.xxhash64(term, F.lit(seed))


def cosines_of_parts(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """B12. Rows as of ``component_cosines`` over the weights of ``pages``, with one row for each page instead of one for each term.

    A page's terms are counted where its text is and move as one list; hashes of terms, which no two terms share, go to the
    tasks with their weights. A term of one page adds to its length only. A page is not joined with itself: its cosine is 1 where it has words.
    """
    spark = pages.sparkSession
    ship(spark)
    kind = dict(pages.dtypes)["id"]

    few = lambda batches: (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256))

    def count(batches):
        for batch in few(batches):
            terms, times = [], []
            for texts in zip(*(batch[p].to_pylist() for p in PARTS), strict=True):
                counts = Counter(f"{k}{word}" for k, text in enumerate(texts) if text for word in re.findall("[a-z0-9]+", text))
                terms.append(list(counts))
                times.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(terms, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))], ["id", "terms", "times"])

    bags = pages.select("id", *[F.lower(p).alias(p) for p in PARTS]).mapInArrow(count, f"id {kind}, terms array<string>, times array<int>")
    if not pages.groupBy("id").count().filter("count > 1").isEmpty():
        bags = bags.groupBy("id").agg(F.flatten(F.collect_list("terms")).alias("terms"), F.flatten(F.collect_list("times")).alias("times"))
    bags = settled(bags)
    uses = settled(bags.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("uses")))
    if uses.filter("uses > 1").count() > MOST_TERMS:
        return component_cosines(pairs=pairs, weights=settled(tfidf_weights(pages=pages)))
    seed = 0
    while not uses.groupBy(_term_hash("term", seed)).count().filter("count > 1").isEmpty():
        seed += 1
    rare = math.log((1.0 + (n := pages.count())) / 2.0) + 1.0
    rows = uses.filter("uses > 1").select(_term_hash("term", seed).alias("hash"), "uses").toArrow()
    hashes = rows["hash"].to_numpy()
    order = np.argsort(hashes)
    known = spark.sparkContext.broadcast(hashes[order])
    idf = spark.sparkContext.broadcast(np.log((1.0 + n) / (1.0 + rows["uses"].to_numpy()[order])) + 1.0)
    parts = len(PARTS)

    def number(batches):
        sorted_hashes, weight = known.value, idf.value
        for batch in few(batches):
            bounds = np.concatenate(([0], np.cumsum(batch["hashes"].value_lengths().to_numpy())))
            flat, times, part = (batch[c].flatten().to_numpy() for c in ("hashes", "times", "parts"))
            codes, counts, norms = [], [], np.zeros((batch.num_rows, parts))
            for i in range(batch.num_rows):
                at = slice(bounds[i], bounds[i + 1])
                bag, first, again = np.unique(flat[at], return_index=True, return_inverse=True)
                k, of = np.bincount(again, times[at], len(bag)), part[at][first]
                code = np.searchsorted(sorted_hashes, bag)
                shared = code < len(sorted_hashes)
                shared[shared] = sorted_hashes[code[shared]] == bag[shared]
                w = np.full(len(bag), rare)
                w[shared] = weight[code[shared]]
                norms[i] = np.sqrt(np.bincount(of, (k * w) ** 2, parts))
                codes.append((code[shared] * parts + of[shared]).astype(np.int32))
                counts.append(k[shared].astype(np.int32))
            cuts = pa.array(np.concatenate(([0], np.cumsum([len(c) for c in codes]))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(x) if x else np.zeros(0, np.int32), pa.int32())) for x in (codes, counts)]
            lengths = pa.ListArray.from_arrays(pa.array(np.arange(0, norms.size + 1, parts, dtype=np.int32)), pa.array(norms.ravel()))
            yield pa.RecordBatch.from_arrays([batch["id"], *lists, lengths], ["id", "codes", "times", "norms"])

    hashed = F.transform("terms", lambda x: _term_hash(x, seed)), F.transform("terms", lambda x: F.substring(x, 1, 1).cast("int"))
    bags = bags.select("id", hashed[0].alias("hashes"), "times", hashed[1].alias("parts"))
    vectors = settled(bags.filter("id IS NOT NULL").mapInArrow(number, f"id {kind}, codes array<int>, times array<int>, norms array<double>"))
    each = [F.when(F.col("norms")[k] > 0, 1.0).otherwise(0.0).alias(p) for k, p in enumerate(PARTS)]
    same = pairs.filter("left_id = right_id").join(vectors.select(F.col("id").alias("left_id"), "norms"), "left_id").select("pair", *each)
    sides = [vectors.select(F.col("id").alias(to), F.struct("codes", "times", "norms").alias(side)) for to, side in (("left_id", "a"), ("right_id", "b"))]
    both = pairs.filter("left_id <> right_id").join(sides[0], "left_id").join(sides[1], "right_id").select("pair", "a", "b")

    def multiply(batches):
        weight = idf.value
        for batch in few(batches):
            out = np.zeros((len(PARTS), batch.num_rows))
            lists = {}
            for side in ("a", "b"):
                fields = [batch[side].field(k) for k in range(3)]
                bounds = np.concatenate(([0], np.cumsum(fields[0].value_lengths().to_numpy())))
                lists[side] = bounds, fields[0].flatten().to_numpy(), fields[1].flatten().to_numpy(), fields[2].flatten().to_numpy().reshape(-1, len(PARTS))
            (ba, ca, ta, na), (bb, cb, tb, nb) = lists["a"], lists["b"]
            for i in range(batch.num_rows):
                common, x, y = np.intersect1d(ca[ba[i] : ba[i + 1]], cb[bb[i] : bb[i + 1]], assume_unique=True, return_indices=True)
                products = ta[ba[i] + x] * tb[bb[i] + y] * weight[common // len(PARTS)] ** 2
                sums = np.bincount(common % len(PARTS), products, len(PARTS))
                lengths = na[i] * nb[i]
                out[:, i] = np.divide(sums, lengths, out=np.zeros(len(PARTS)), where=lengths > 0)
            yield pa.RecordBatch.from_arrays([batch["pair"], *map(pa.array, out)], ["pair", *PARTS])

    met = both.mapInArrow(multiply, f"pair {dict(pairs.dtypes)['pair']}, " + ", ".join(f"{p} double" for p in PARTS)).unionByName(same)
    # a pair given several times counts as often for each of its rows, as in the SQL; a null one meets none
    given = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("given"))
    sums = met.groupBy("pair").agg(*[F.sum(p).alias(p) for p in PARTS])
    return given.join(sums, "pair", "left").select("pair", *[F.coalesce(F.round(F.col("given") * F.col(p), 6), F.lit(0.0)).alias(p) for p in PARTS])


@operator
def best_pages(d: Duck, k: int = 5) -> str:
    """B14. The k best pages of each keyword, mismatch with the ranking page, and misallocation (mismatch within rank 20)."""
    return f"""
SELECT t.keyword, t.url, CAST(t.n AS BIGINT) AS match_rank, {d.round('t.similarity', 4)} AS similarity, k.actual_url <> '' AND k.actual_url <> t.best AS mismatch, k.actual_url <> '' AND k.actual_url <> t.best AND k.actual_rank <= 20 AS misallocated
FROM (SELECT *, max(CASE WHEN n = 1 THEN url END) OVER (PARTITION BY keyword) AS best FROM (
  SELECT keyword, url, similarity, row_number() OVER (PARTITION BY keyword ORDER BY similarity DESC, url) AS n FROM @pairs@) AS r) AS t
JOIN @keywords@ k ON t.keyword = k.keyword WHERE t.n <= {k}"""


@operator
def cannibalization_severity(d: Duck) -> str:
    """B15. Pairs of pages that rank for the same queries of ``gsc``: overlap, severity and advice."""
    return """
SELECT page_a, page_b, overlap, round(severity, 2) AS severity, CASE WHEN severity > 100 THEN 'MERGE' WHEN severity >= 30 THEN 'DIFFERENTIATE' ELSE 'CANONICAL' END AS advice FROM (
  SELECT page_a, page_b, overlap, overlap * volume / greatest(gap, 1e0) AS severity FROM (
    SELECT a.page AS page_a, b.page AS page_b, CAST(count(*) AS BIGINT) AS overlap, avg((a.impressions + b.impressions) / 2e0) AS volume, avg(abs(a.position - b.position)) AS gap
    FROM @gsc@ a JOIN @gsc@ b ON a.query = b.query AND a.page < b.page GROUP BY a.page, b.page) AS p) AS s"""


#: Pages of a query in a block, which moves once for each block; pages that meet at a time there; and rows of small queries that one task takes together.
BLOCK_PAGES, TILE_PAGES, FEW_ROWS = 8_192, 512, 4_000


def cannibalizing_pages(gsc: DataFrame) -> DataFrame:
    """B15 over the pages of each query: rows as of ``cannibalization_severity``.

    A page's rows for a query are one row with counts by position, so pairs of rows are never formed: the gaps of
    two pages follow from their running counts. Pages of a large query meet in blocks. A pair is complete where one of
    its pages has one query only; the others are added up over their queries.
    """
    ship(gsc.sparkSession)
    rows = gsc.filter("query IS NOT NULL AND page IS NOT NULL")
    placed = rows.groupBy("query", "page", F.col("position").cast("double").alias("position")).agg(F.count(F.lit(1)).alias("n"), F.count("impressions").alias("ni"), F.sum(F.col("impressions").cast("double")).alias("si"))
    at = F.collect_list(F.when(F.col("position").isNotNull(), F.struct("position", "n")))
    pages = settled(placed.groupBy("query", "page").agg(F.sum("n").alias("n"), F.sum("ni").alias("ni"), F.coalesce(F.sum("si"), F.lit(0.0)).alias("si"), at.alias("at")))
    pages = pages.join(pages.groupBy("page").agg((F.count(F.lit(1)) > 1).alias("many")), "page")
    whole = _paired(settled(pages), False).drop("many")
    parts = _paired(pages.filter("many"), True).groupBy("page_a", "page_b").agg(*[F.sum(c).alias(c) for c in ("overlap", "ni", "si", "np", "gap")])
    severity = "overlap * (si / 2e0 / ni) / greatest(gap / np, 1e0)"
    rated = whole.unionByName(parts).selectExpr("page_a", "page_b", "overlap", f"{severity} AS severity")
    return rated.selectExpr("page_a", "page_b", "overlap", f"{SPARK.round('severity', 2)} AS severity", "CASE WHEN severity > 100 THEN 'MERGE' WHEN severity >= 30 THEN 'DIFFERENTIATE' ELSE 'CANONICAL' END AS advice")


def _paired(pages: DataFrame, many: bool) -> DataFrame:
    """Sums over the pairs of rows of two pages of a query; of pairs of pages with further queries both, or of all others."""
    sizes = pages.groupBy("query").agg(F.ceil(F.count(F.lit(1)) / BLOCK_PAGES).cast("int").alias("blocks"))
    tasks = pages.count() // FEW_ROWS + 1
    dealt = pages.join(sizes, "query").withColumn("b", F.pmod(F.xxhash64("page"), F.col("blocks")).cast("int"))
    # a block meets those after it and itself; queries of one block share tasks
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    of = F.when(F.col("blocks") > 1, F.col("query"))
    dealt = dealt.select("query", "page", "n", "ni", "si", "at", "many", "b", of.alias("of"), F.when(of.isNull(), F.pmod(F.xxhash64("query"), F.lit(tasks))).alias("task"), F.least("b", "other").alias("x"), F.greatest("b", "other").alias("y"))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        names, queries = t["page"].to_pylist(), t["query"].to_pylist()
        b, x, y, open_ = (t[c].to_numpy() for c in ("b", "x", "y", "many"))
        n, ni, si = (t[c].to_numpy().astype(float) for c in ("n", "ni", "si"))
        lists = t["at"].combine_chunks()
        flat, cuts = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        where, times = flat.field("position").to_numpy(), flat.field("n").to_numpy().astype(float)
        order = np.array(sorted(range(len(names)), key=lambda k: (queries[k], names[k])), np.int64)
        parted = np.flatnonzero([k == 0 or queries[order[k]] != queries[order[k - 1]] for k in range(len(order))])
        spelt = t["page"].combine_chunks()

        def placed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """For each position of these rows: the place of the row, the position, how often."""
            sizes = cuts[rows + 1] - cuts[rows]
            at = np.arange(sizes.sum()) + np.repeat(cuts[rows] - np.cumsum(sizes) + sizes, sizes)
            return np.repeat(np.arange(len(rows)), sizes), where[at], times[at]

        def met(first: np.ndarray, second: np.ndarray) -> pa.RecordBatch | None:
            # by name, so the first page is the smaller
            i, j = np.triu_indices(len(first), 1) if first is second else (k.ravel() for k in np.indices((len(first), len(second))))
            keep = (b[first[i]] != b[second[j]]) | (x[first[i]] == y[first[i]])
            if not many:
                keep &= ~(open_[first[i]] & open_[second[j]])
            i, j = i[keep], j[keep]
            if not len(i):
                return None
            sides = [placed(first), placed(second)]
            points = np.unique(np.concatenate([s[1] for s in sides]))
            totals = [np.bincount(s[0], s[2], len(rows)) for s, rows in zip(sides, (first, second), strict=True)]
            seen = [np.zeros(len(first)), np.zeros(len(second))]
            gaps = np.zeros((len(first), len(second)))
            for start in range(0, max(len(points) - 1, 0), 1_024):
                some = points[start : start + 1_025]
                running = []
                for k, (row, position, often) in enumerate(sides):
                    column = np.searchsorted(points, position) - start
                    inside = (column >= 0) & (column < len(some) - 1)
                    counts = np.bincount(row[inside] * (len(some) - 1) + column[inside], often[inside], len(seen[k]) * (len(some) - 1)).reshape(len(seen[k]), -1)
                    running.append(counts.cumsum(axis=1) + seen[k][:, None])
                    seen[k] = running[k][:, -1]
                # between two positions, each row of one page below meets each row of the other above
                wide = np.diff(some)
                gaps += (running[0] * wide) @ (totals[1][:, None] - running[1]).T + ((totals[0][:, None] - running[0]) * wide) @ running[1].T
            a, c = first[i], second[j]
            known, pairs = ni[a] * ni[c], totals[0][i] * totals[1][j]
            null = lambda values, of: pc.if_else(pa.array(of > 0), pa.array(values), pa.scalar(None, pa.float64()))
            columns = [spelt.take(pa.array(a)), spelt.take(pa.array(c)), pa.array((n[a] * n[c]).astype(np.int64)), null(known, known), null(ni[c] * si[a] + ni[a] * si[c], known), null(pairs, pairs), null(gaps[i, j], pairs)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(a), many))], ["page_a", "page_b", "overlap", "ni", "si", "np", "gap", "many"])

        for of_query in np.split(order, parted[1:]):
            tiles = [of_query[k : k + TILE_PAGES] for k in range(0, len(of_query), TILE_PAGES)]
            for u, first in enumerate(tiles):
                yield from (got for second in tiles[u:] if (got := met(first, second)) is not None)

    return dealt.groupBy("of", "task", "x", "y").applyInArrow(pair, f"page_a {dict(pages.dtypes)['page']}, page_b {dict(pages.dtypes)['page']}, overlap bigint, ni double, si double, np double, gap double, many boolean")


@operator
def serp_overlap(d: Duck) -> str:
    """B18. Urls that two keywords of ``serp`` (keyword, url) share."""
    return """
SELECT a.keyword AS keyword_a, b.keyword AS keyword_b, CAST(count(*) AS BIGINT) AS shared FROM @serp@ a JOIN @serp@ b ON a.url = b.url AND a.keyword < b.keyword
GROUP BY a.keyword, b.keyword"""


@operator
def serp_jaccard(d: Duck) -> str:
    """B19. Jaccard similarity of the pairs in ``overlap``, from the url counts in ``serp``."""
    return """
SELECT o.keyword_a, o.keyword_b, o.shared, round(o.shared / CAST(a.n + b.n - o.shared AS DOUBLE), 4) AS jaccard
FROM @overlap@ o JOIN (SELECT keyword, count(DISTINCT url) AS n FROM @serp@ GROUP BY keyword) AS a ON o.keyword_a = a.keyword
JOIN (SELECT keyword, count(DISTINCT url) AS n FROM @serp@ GROUP BY keyword) AS b ON o.keyword_b = b.keyword"""


@operator
def hub_urls(d: Duck, top: int = 10) -> str:
    """B23. Urls that most keywords of a cluster share: ``members`` (keyword, cluster) and ``serp``."""
    return f"""
SELECT cluster, url, keywords FROM (
  SELECT m.cluster, s.url, CAST(count(*) AS BIGINT) AS keywords, row_number() OVER (PARTITION BY m.cluster ORDER BY count(*) DESC, s.url) AS n
  FROM @members@ m JOIN @serp@ s ON m.keyword = s.keyword GROUP BY m.cluster, s.url) AS h WHERE n <= {top} AND keywords >= 2"""


@operator
def cluster_coherence(d: Duck) -> str:
    """B24. Mean Jaccard over all pairs within a cluster of ``members`` (keyword, cluster), pairs without overlap as 0."""
    return """
SELECT cluster, size, round(mean, 4) AS coherence, CASE WHEN mean >= 5e-1 THEN 'tight' WHEN mean >= 3e-1 THEN 'moderate' WHEN mean >= 15e-2 THEN 'loose' ELSE 'weak' END AS label FROM (
  SELECT s.cluster, s.size, coalesce(j.total, 0e0) / (s.size * (s.size - 1) / 2e0) AS mean
  FROM (SELECT cluster, CAST(count(*) AS BIGINT) AS size FROM @members@ GROUP BY cluster HAVING count(*) > 1) AS s
  LEFT JOIN (SELECT a.cluster, sum(p.jaccard) AS total FROM @jaccard@ p JOIN @members@ a ON p.keyword_a = a.keyword JOIN @members@ b ON p.keyword_b = b.keyword AND a.cluster = b.cluster
    GROUP BY a.cluster) AS j ON s.cluster = j.cluster) AS m"""


def jaccard_within(members: DataFrame, serp: DataFrame) -> DataFrame:
    """B24. Rows as of ``serp_jaccard`` (without shared) for pairs of keywords with a common cluster of ``members``, the only ones that coherence needs.

    Keywords meet by cluster and url, so pairs between clusters are never formed.
    """
    sizes = serp.groupBy("keyword").agg(F.count_distinct("url").alias("n"))
    placed = serp.join(members.filter("cluster IS NOT NULL").select("keyword", "cluster").distinct(), "keyword").join(sizes, "keyword")
    a, b = (placed.select("cluster", "url", F.col("keyword").alias(f"keyword_{k}"), F.col("n").alias(f"n_{k}")) for k in "ab")
    met = a.join(b, ["cluster", "url"]).filter("keyword_a < keyword_b")
    shared = met.groupBy("cluster", "keyword_a", "keyword_b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("shared"))
    return shared.select("keyword_a", "keyword_b", F.round(F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")).cast("double"), 4).alias("jaccard")).distinct()


@operator
def passage_retrieval(d: Duck, k: int = 5, least: float = 0.3) -> str:
    """B26. The best queries of each passage in ``pairs`` (passage, query, similarity), its mean over the top three and rating."""
    return f"""
SELECT passage, round(max(similarity) * 100, 1) AS best_score, round(avg(CASE WHEN n <= 3 THEN similarity END) * 100, 1) AS top3_mean, CAST(count(*) AS BIGINT) AS matched,
  max(CASE WHEN n = 1 THEN query END) AS best_query,
  CASE WHEN max(similarity) >= 80e-2 THEN 'excellent' WHEN max(similarity) >= 65e-2 THEN 'good' WHEN max(similarity) >= 50e-2 THEN 'moderate' WHEN max(similarity) >= 35e-2 THEN 'weak' ELSE 'poor' END AS rating
FROM (SELECT *, row_number() OVER (PARTITION BY passage ORDER BY similarity DESC, query) AS n FROM @pairs@ WHERE similarity > {e(least)}) AS r WHERE n <= {k} GROUP BY passage"""


@operator
def topical_checks(d: Duck) -> str:
    """B27. Checks of ``clusters`` (cluster, keyword, volume): size, thin (under 3), oversized (over 20), pillar volume."""
    return """
SELECT cluster, CAST(count(*) AS BIGINT) AS keywords, CAST(sum(volume) AS BIGINT) AS pillar_volume, count(*) < 3 AS thin, count(*) > 20 AS oversized FROM @clusters@ GROUP BY cluster"""


@operator
def unique_words(d: Duck) -> str:
    """B28. Share of a page's words (``words``: page, word) that no other page has, and the gates at 40 and 30 percent."""
    return """
SELECT page, words, round(pct, 2) AS unique_percentage, CASE WHEN pct < 30 THEN 'stop' WHEN pct < 40 THEN 'flag' ELSE 'pass' END AS gate, words < 300 AS short FROM (
  SELECT w.page, CAST(count(*) AS BIGINT) AS words, count_if(f.pages = 1) * 100e0 / count(*) AS pct
  FROM @words@ w JOIN (SELECT word, count(DISTINCT page) AS pages FROM @words@ GROUP BY word) AS f ON w.word = f.word GROUP BY w.page) AS p"""


@operator
def item_dedup(d: Duck) -> str:
    """B29. One of the ``items`` (id, url, priority, length) with the same normalised url: best priority, then longest."""
    return """
SELECT id, url_key, copies FROM (
  SELECT id, url_key, count(*) OVER (PARTITION BY url_key) AS copies, row_number() OVER (PARTITION BY url_key ORDER BY priority, length DESC, id) AS n
  FROM (SELECT id, priority, length, regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '/+$', '') AS url_key FROM @items@) AS u) AS r WHERE n = 1"""


def drop_similar_titles(items: DataFrame, share: float = 0.8) -> DataFrame:
    """B29, second step. (id, kept_by) of ``items`` (id, title, length): kept_by is the item that stands for it, null if it stays itself.

    Titles are alike if more than ``share`` of the longer one's distinct words are in both. Items are
    taken from the longest content on (ties: smaller id), and one goes with the first that stays and has
    a like title. Equal sets of words are one node, and others meet by their rare words
    (``setjoin``), so no group of titles is paired with itself. Null and wordless titles stay.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    place = F.struct((-F.coalesce("length", F.lit(0))).alias("shorter"), F.col("id").alias("by_id"))
    rows = settled(items.select("id", place.alias("place"), F.array_sort(words).alias("tokens")))
    worded = rows.filter(F.size("tokens") > 0)
    firsts = settled(worded.groupBy("tokens").agg(F.min("place").alias("place")).select(F.col("place.by_id").alias("id"), "place", "tokens"))
    fate = keep_in_order(firsts, settled(similar_sets(firsts, share).select("a", "b")))
    by_set = firsts.join(fate, "id").select("tokens", F.col("id").alias("first"), F.coalesce("kept_by", "id").alias("for_all"), "kept_by")
    same = worded.join(by_set, "tokens").select("id", F.when(F.col("id") == F.col("first"), F.col("kept_by")).otherwise(F.col("for_all")).alias("kept_by"))
    return same.unionByName(rows.filter(F.size("tokens") == 0).select("id", F.lit(None).cast(dict(rows.dtypes)["id"]).alias("kept_by")))


@operator
def titles_in_turn(d: Duck, share: float = 0.8) -> str:
    """B29, oracle of the second step: items one after another, from the longest content on."""
    return f"""
WITH rows AS (SELECT id, row_number() OVER (ORDER BY length DESC, id) AS n, list_sort(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')))::VARCHAR AS s, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS t FROM @items@),
sets AS (SELECT s, any_value(t) AS t FROM rows WHERE len(t) > 0 GROUP BY s),
alike AS (SELECT a.s AS s, b.s AS u FROM sets a JOIN sets b ON len(list_intersect(a.t, b.t)) > {share} * greatest(len(a.t), len(b.t)) + 1e-9),
near AS (SELECT x.n, y.n AS m, y.id AS m_id FROM rows x JOIN alike ON alike.s = x.s JOIN rows y ON y.s = alike.u WHERE y.n < x.n),
lists AS (SELECT r.n, coalesce(list(near.m) FILTER (WHERE near.m IS NOT NULL), []::BIGINT[]) AS near FROM rows r LEFT JOIN near ON near.n = r.n GROUP BY r.n),
held AS (
  SELECT unnest(list_reduce(list({{'kept': []::BIGINT[], 'n': n, 'near': near}} ORDER BY n),
    lambda a, x: {{'kept': CASE WHEN list_has_any(a.kept, x.near) THEN a.kept ELSE list_append(a.kept, x.n) END, 'n': x.n, 'near': x.near}}, {{'kept': []::BIGINT[], 'n': 0::BIGINT, 'near': []::BIGINT[]}}).kept) AS n FROM lists)
SELECT rows.id, f.m_id AS kept_by FROM rows LEFT JOIN held USING (n) LEFT JOIN (SELECT n, min_by(m_id, m) AS m_id FROM near WHERE m IN (SELECT n FROM held) GROUP BY n) AS f ON f.n = rows.n AND held.n IS NULL"""
