"""Fuzzy titles, breadcrumbs, greedy clusters and shingle duplicates: what needs more than SQL."""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import accumulate, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.graph import connected_components, settled
from lodestar.plans.dialect import Duck, operator
from lodestar.sources.shipping import ship


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of ``a``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = open_ = (1 << len(a)) - 1
    for c in b:
        hit = open_ & places.get(c, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


def sorted_tokens(s: str) -> str:
    return " ".join(sorted(s.lower().split()))


def token_sort_ratio(a: str, b: str) -> float:
    """G11. 0-100: twice the common subsequence of the sorted tokens over both lengths; two empty strings are equal."""
    a, b = sorted_tokens(a), sorted_tokens(b)
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def with_ratio(pairs: DataFrame, a: str, b: str, to: str = "ratio") -> DataFrame:
    """G11 over two columns; nulls count as empty."""
    ship(pairs.sparkSession)

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([token_sort_ratio(p, q) for p, q in zip(x, y, strict=True)], dtype=float)

    return pairs.withColumn(to, ratio(F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))))


#: Distinct titles of either side in a block.
BLOCK_TITLES = 2_048


def ratios_to(a: str, codes: np.ndarray, lengths: np.ndarray, alphabet: dict[str, int], others: list[str]) -> np.ndarray:
    """token_sort_ratio of ``a`` with each of ``others``, all given as sorted tokens.

    ``codes``: a row for each place, the number that ``alphabet`` gives the character there, or 0 past the end.
    """
    if len(a) > 64:
        common = np.array([common_length(a, b) for b in others])
    else:
        places = np.zeros(len(alphabet) + 1, np.uint64)
        for i, c in enumerate(a):
            if c in alphabet:
                places[alphabet[c]] |= np.uint64(1 << i)
        full = np.uint64((1 << len(a)) - 1)
        open_ = np.full(len(others), full)
        for at in codes:
            hit = open_ & places[at]
            open_ = ((open_ + hit) | (open_ - hit)) & full
        common = len(a) - np.bitwise_count(open_).astype(np.int64)
    both = lengths + len(a)
    return np.where(both > 0, 200.0 * common / np.maximum(both, 1), 100.0)


def all_ratios(left: DataFrame, right: DataFrame, threshold: float | None = None) -> DataFrame:
    """(a, b, ratio): the distinct titles of ``left`` against those of ``right`` (one column each), without nulls.

    Pairs with at least the threshold; without one, for each block of ``right`` the best b of
    each a, the largest on a tie.
    """
    ship(left.sparkSession)
    m, n = (max(1, -(-side.count() // BLOCK_TITLES)) for side in (left, right))
    block = lambda side, k: F.pmod(F.xxhash64(side.columns[0]), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    x = left.select(F.col(left.columns[0]).alias("a"), block(left, m).alias("i"), each(n).alias("j"))
    y = right.select(F.col(right.columns[0]).alias("b"), block(right, n).alias("j"), each(m).alias("i"))

    def rate(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"a": [], "b": [], "ratio": []}
        names = sorted(q["b"])
        others = [sorted_tokens(b) for b in names]
        alphabet = {c: k + 1 for k, c in enumerate(sorted(set("".join(others))))}
        lengths = np.array([len(b) for b in others], np.int64)
        codes = np.zeros((max(lengths, default=0), len(others)), np.int32)
        for k, b in enumerate(others):
            codes[: len(b), k] = [alphabet[c] for c in b]
        for a in p["a"] if names else ():
            ratios = ratios_to(sorted_tokens(a), codes, lengths, alphabet, others)
            hits = np.flatnonzero(ratios >= threshold) if threshold is not None else np.flatnonzero(ratios == ratios.max())[-1:]
            out["a"] += [a] * len(hits)
            out["b"] += [names[k] for k in hits]
            out["ratio"] += ratios[hits].tolist()
        return pd.DataFrame({c: pd.Series(v, dtype="float64" if c == "ratio" else object) for c, v in out.items()})

    return x.groupBy("i", "j").cogroup(y.groupBy("i", "j")).applyInPandas(rate, "a string, b string, ratio double")


def check_breadcrumbs(pages: DataFrame, threshold: float = 60.0) -> DataFrame:
    """G10. Ratio of title and last breadcrumb part of ``pages`` (url, title, last_part); below the threshold the best other part, if better.

    Only distinct mismatched titles meet the distinct parts, all of them.
    """
    rated = with_ratio(pages, "title", "last_part")
    poor = rated.filter(F.col("ratio") < threshold)
    parts = pages.select(F.col("last_part").alias("candidate")).filter("candidate IS NOT NULL").distinct()
    tried = all_ratios(poor.select("title").filter("title IS NOT NULL").distinct(), parts)
    best = tried.groupBy("a").agg(F.max_by(F.struct(F.col("b").alias("candidate"), F.col("ratio").alias("better")), F.struct("ratio", "b")).alias("b")).withColumnRenamed("a", "title")
    joined = rated.join(best, "title", "left")
    use = (F.col("ratio") < threshold) & (F.col("b.better") > F.col("ratio"))
    return joined.select("url", "title", "last_part", F.round("ratio", 4).alias("ratio"), (F.col("ratio") < threshold).alias("mismatch"), F.when(use, F.col("b.candidate")).alias("suggestion"))


def fuzzy_matches(own: DataFrame, other: DataFrame, threshold: float = 90.0) -> DataFrame:
    """G3, second pass. Best title of ``other`` for each title of ``own`` (id, title) with a ratio of at least the threshold.

    Every distinct title meets every other one, in blocks: the ratio does not imply a common token.
    """
    a = own.select(F.col("id").alias("own_id"), F.col("title").alias("own_title")).filter("own_title IS NOT NULL")
    b = other.select(F.col("id").alias("other_id"), F.col("title").alias("other_title")).filter("other_title IS NOT NULL")
    alike = all_ratios(a.select("own_title").distinct(), b.select("other_title").distinct(), threshold).toDF("own_title", "other_title", "ratio")
    rated = alike.join(a.select("own_id", "own_title").distinct(), "own_title").join(b.select("other_id", "other_title").distinct(), "other_title")
    first = Window.partitionBy("own_id").orderBy(F.desc("ratio"), "other_id")
    return rated.withColumn("n", F.row_number().over(first)).filter("n = 1").select("own_id", "other_id", F.round("ratio", 4).alias("ratio"))


#: Longs of a bitmap of a set of shingles, and the constants of XXH64.
BITMAP = 16
_XX = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * _XX[1]
    h = (h ^ h >> np.uint64(29)) * _XX[2]
    return h ^ h >> np.uint64(32)


#: Shingles whose minimum hashes are made at once.
AT_ONCE = 4_096


def least_hashes(sets: list[np.ndarray], n: int) -> list[np.ndarray]:
    """For each of ``sets`` (of longs, not empty) the smallest xxhash64(x, t) of its x for each int t below ``n``, as by the SQL function."""
    out, k = [], 0
    while k < len(sets):
        first, size = k, 0
        while k < len(sets) and size < AT_ONCE:
            size += len(sets[k])
            k += 1
        x = np.concatenate(sets[first:k]).view(np.uint64)
        starts = np.cumsum([0, *map(len, sets[first : k - 1])])
        x = _rotated(x * _XX[1], 31) * _XX[0] ^ np.full(1, 42 + 8, np.uint64) + _XX[4]
        x = _mixed(_rotated(x, 27) * _XX[0] + _XX[3]) + (_XX[4] + np.full(1, 4, np.uint64))
        least = [np.minimum.reduceat(_mixed(_rotated(x ^ np.full(1, t, np.uint64) * _XX[0], 23) * _XX[1] + _XX[2]).view(np.int64), starts) for t in range(n)]
        out += list(np.array(least).T)
    return out


def shingle_set(lower: str, k: int) -> np.ndarray:
    """Distinct hashes (as longs) of the k-word shingles of a text in lower case; words are runs of ASCII letters, digits and _."""
    words = re.findall("[A-Za-z0-9_]+", lower)
    joined, ends = " ".join(words).encode(), list(accumulate(len(w) + 1 for w in words))
    places = map(slice, [0, *ends], [x - 1 for x in ends[k - 1 :]])
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, map(joined.__getitem__, places), repeat(42))), ">i8").astype(np.int64))


def _sketches(texts: DataFrame, k: int, hashes: int) -> DataFrame:
    """(id, n, s, least, bits) of ``texts`` (id, text: in lower case) with k words at least: the set of shingles, its size, minimum hashes and bitmap.

    A bit of the bitmap is the parity of the shingles that fall on it, so two sets differ by as many shingles as bits at least.
    """
    ship(texts.sparkSession)

    def sketch(batches):
        for batch in batches:
            sets = [shingle_set(t, k) for t in batch["text"].to_pylist()]
            some = [len(s) > 0 for s in sets]
            sets = [s for s in sets if len(s)]
            bits = [np.packbits(np.bincount(s & (64 * BITMAP - 1), minlength=64 * BITMAP) & 1).view(np.int64) for s in sets]
            lists = lambda xs: pa.ListArray.from_arrays(np.cumsum([0, *map(len, xs)], dtype=np.int32), pa.array(np.concatenate([np.zeros(0, np.int64), *xs])))
            columns = [batch["id"].filter(pa.array(some, pa.bool_())), pa.array([len(s) for s in sets], pa.int32()), lists(sets), lists(least_hashes(sets, hashes)), lists(bits)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "s", "least", "bits"])

    return texts.mapInArrow(sketch, f"id {dict(texts.dtypes)['id']}, n int, s array<bigint>, least array<bigint>, bits array<bigint>")


def minhash_duplicates(docs: DataFrame, threshold: float = 0.9, k: int = 5, tables: int = 8) -> DataFrame:
    """B10. Pairs of ``docs`` (id, text) whose sets of k-word shingles have a Jaccard similarity of at least the threshold.

    Equal texts are one document, the one with the smallest id, so copies don't square: every
    other copy, of a text of any length, has one row with it (id_a; copy is true). Null texts
    have no copies. Candidates share one of ``tables`` bands of two minimum hashes, and their sizes and bitmaps
    don't rule the threshold out; the similarity is exact. Shingles are made once, and move for candidates alone.
    """
    one = docs.filter("text IS NOT NULL").groupBy("text").agg(F.min("id").alias("id")).select("id", F.lower("text").alias("text"))
    sets = settled(_sketches(one, k, 2 * tables))
    bands = F.array(*[F.xxhash64(F.lit(t), F.col("least")[2 * t], F.col("least")[2 * t + 1]) for t in range(tables)])
    keyed = sets.select("id", "n", *[F.col("bits")[i].alias(f"bits{i}") for i in range(BITMAP)], F.explode(bands).alias("band"))
    unlike = sum((F.bit_count(F.col(f"a.bits{i}").bitwiseXOR(F.col(f"b.bits{i}"))) for i in range(BITMAP)), F.lit(0))
    # sets that are alike enough have sizes that are, and differ by no more shingles than this
    near_sizes = F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n") - 1e-9
    near_bits = unlike <= (F.col("a.n") + F.col("b.n")) * ((1 - threshold) / (1 + threshold)) + 1e-9
    met = keyed.alias("a").join(keyed.alias("b"), (F.col("a.band") == F.col("b.band")) & (F.col("a.id") < F.col("b.id")) & near_sizes & near_bits)
    pairs = settled(met.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct())
    a = sets.select(F.col("id").alias("id_a"), F.col("s").alias("s_a"))
    b = sets.select(F.col("id").alias("id_b"), F.col("s").alias("s_b"))
    a, b = a.join(pairs.select("id_a"), "id_a", "left_semi"), b.join(pairs.select("id_b"), "id_b", "left_semi")
    both = F.size(F.array_intersect("s_a", "s_b"))
    found = pairs.join(a, "id_a").join(b, "id_b").withColumn("jaccard", both / (F.size("s_a") + F.size("s_b") - both))
    near = found.filter(F.col("jaccard") >= threshold).select("id_a", "id_b", F.round("jaccard", 6).alias("jaccard"), F.lit(False).alias("copy"))
    named = docs.filter("text IS NOT NULL").select("id", F.unhex(F.sha2("text", 256)).alias("of"))
    kept = named.groupBy("of").agg(F.min("id").alias("id_a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("of", "id_a")
    copies = named.join(kept, "of").filter("id <> id_a").select("id_a", F.col("id").alias("id_b"), F.lit(1.0).alias("jaccard"), F.lit(True).alias("copy"))
    return near.unionByName(copies.distinct())


#: Keywords of the components that are clustered in one group, on average.
GROUP_KEYWORDS = 5_000


def greedy_clusters(overlap: DataFrame, serp: DataFrame, method: str = "clique", min_overlap: int = 2) -> DataFrame:
    """B21, B22. (keyword, cluster) over the pairs of ``overlap`` (keyword_a, keyword_b, shared) that share enough urls.

    Greedy within connected components, as no cluster crosses one; those of a group go through one order, which is each one's own too. clique: keywords by
    degree, each joins the seed if it links to all members. core: pairs by overlap, joined by
    keywords that share enough of the pair's common urls. Ties go to the smaller keyword.
    """
    spark = overlap.sparkSession
    ship(spark)
    edges = settled(overlap.filter(F.col("shared") >= min_overlap))  # read by every round, and again for the links
    parts = connected_components(edges.select("keyword_a", "keyword_b"))
    # many components to a group, as most are small; explicit counts, as little data needs long work
    groups = max(spark.sparkContext.defaultParallelism, -(-parts.count() // GROUP_KEYWORDS))
    placed = parts.select("node", F.pmod(F.xxhash64("root"), F.lit(groups)).cast("int").alias("part"))
    nodes = serp.join(placed, F.col("node") == F.col("keyword")).groupBy("part", "keyword").agg(F.collect_set("url").alias("urls")).repartition(groups, "part")
    links = edges.join(placed, F.col("keyword_a") == F.col("node")).select(F.col("part").alias("of"), "keyword_a", "keyword_b", "shared").repartition(groups, "of")

    def cluster(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        have = {k: set(u) for k, u in zip(n["keyword"], n["urls"], strict=True)}
        near: dict[str, set[str]] = {k: set() for k in have}
        for a, b in zip(e["keyword_a"], e["keyword_b"], strict=True):
            near[a].add(b)
            near[b].add(a)
        of: dict[str, str] = {}
        if method == "clique":
            for seed in sorted(near, key=lambda k: (-len(near[k]), k)):
                if seed in of:
                    continue
                members = [seed]
                for k in sorted(near[seed] - of.keys(), key=lambda k: (-len(near[k]), k)):
                    if all(k in near[m] for m in members):
                        members.append(k)
                of |= dict.fromkeys(members, min(members))
        else:
            for a, b, _ in sorted(zip(e["keyword_a"], e["keyword_b"], e["shared"], strict=True), key=lambda x: (-x[2], x[0], x[1])):
                members = [k for k in (a, b) if k not in of]
                if not members:
                    continue
                core = have[a] & have[b]
                members += [k for k in sorted(near[a] & near[b]) if k not in of and len(have[k] & core) >= min_overlap]
                of |= dict.fromkeys(members, min(members))
        return pd.DataFrame({"keyword": list(of), "cluster": list(of.values())}, dtype=str)

    found = nodes.groupBy("part").cogroup(links.groupBy("of")).applyInPandas(cluster, "keyword string, cluster string")
    # keywords that share too few urls with any other are clusters of their own
    alone = serp.select("keyword").distinct().join(parts, F.col("keyword") == F.col("node"), "left_anti").select("keyword", F.col("keyword").alias("cluster"))
    return found.unionByName(alone)


@operator
def centroid_outliers(d: Duck, top: int = 20) -> str:
    """B11. The vectors of ``vectors`` (id, vector) farthest from their mean, by cosine."""
    each = d.explode(d.sequence("1", d.size("vector")))
    return f"""
WITH parts AS (SELECT id, i, {d.at('vector', 'i')} AS x FROM (SELECT id, vector, {each} AS i FROM @vectors@) AS u),
mean AS (SELECT i, avg(x) AS m FROM parts GROUP BY i)
SELECT id, round(1 - cosine, 6) AS distance FROM (SELECT id, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m)) + 1e-10) AS cosine FROM parts p JOIN mean ON p.i = mean.i GROUP BY id) AS c
ORDER BY cosine, id LIMIT {top}"""


@operator
def primary_keyword(d: Duck) -> str:
    """B16. The commonest two- or three-word phrase of each of ``pages`` (id, text), ties to the longer, then alphabetical."""
    words = d.extract_all("lower(text)", "[a-z]+")
    gram = lambda n: f"SELECT id, {d.explode(d.transform(d.sequence('1', d.size('w') + f' - {n - 1}'), lambda x: d.join(d.slice('w', x, str(n)), ' ')))} AS phrase, {n} AS n FROM (SELECT id, {words} AS w FROM @pages@) AS p"
    return f"""
SELECT id, phrase, frequency FROM (SELECT id, phrase, CAST(count(*) AS BIGINT) AS frequency, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, max(n) DESC, phrase) AS rn
  FROM ({gram(2)} UNION ALL {gram(3)}) AS g GROUP BY id, phrase) AS r WHERE rn = 1"""


def commonest_phrase(texts: list[str]) -> tuple[str, int] | None:
    """B16 for one page, whose ``texts`` are in lower case; None without two words in a row."""
    counts: Counter[str] = Counter()
    for text in texts:
        words = re.findall("[a-z]+", text)
        for n in (2, 3):
            counts.update(map(" ".join, zip(*(words[k:] for k in range(n)), strict=False)))
    return min(counts.items(), key=lambda x: (-x[1], -x[0].count(" "), x[0]), default=None)


def primary_keywords(pages: DataFrame) -> DataFrame:
    """B16. Rows as of ``primary_keyword``: texts move once, to those of the same id, and phrases are counted where the page is."""
    ship(pages.sparkSession)
    whole = pages.groupBy("id").agg(F.collect_list(F.lower("text")).alias("texts"))

    def count(batches):
        for batch in batches:
            found = [commonest_phrase(texts) for texts in batch["texts"].to_pylist()]
            some = pa.array([f is not None for f in found], pa.bool_())
            phrases = pa.array([f[0] for f in found if f], pa.string()), pa.array([f[1] for f in found if f], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["id"].filter(some), *phrases], ["id", "phrase", "frequency"])

    return whole.mapInArrow(count, f"id {dict(pages.dtypes)['id']}, phrase string, frequency bigint")


@operator
def local_cannibalization(d: Duck) -> str:
    """B17. Pairs of ``pages`` (page, keyword, kind) with equal keywords (Critical), equal stems (High) or contained ones (Low)."""
    stem = lambda c: d.sub(f"lower({c})", "(ing|ed|es|s)$", "")
    return f"""
SELECT a.page AS page_a, b.page AS page_b, CASE WHEN lower(a.keyword) = lower(b.keyword) THEN 'Critical' ELSE 'High' END AS severity, a.kind <> b.kind AS cross_type
FROM @pages@ a JOIN @pages@ b ON {stem('a.keyword')} = {stem('b.keyword')} AND a.page < b.page
UNION ALL SELECT least(s.page, l.page) AS page_a, greatest(s.page, l.page) AS page_b, 'Low' AS severity, s.kind <> l.kind AS cross_type
FROM @pages@ s JOIN (SELECT page, kind, keyword, {d.explode(d.split('lower(keyword)', ' '))} AS word FROM @pages@) AS l ON lower(s.keyword) = l.word AND lower(s.keyword) <> lower(l.keyword)"""


#: Rows of a key in a block where its rows meet, and pairs that a task forms.
BLOCK_ROWS, TASK_PAIRS = 4_096, 20_000_000


def _met(left: DataFrame, right: DataFrame, key: str, once: bool = False) -> DataFrame:
    """Pairs of ``left`` and ``right`` (struct a, struct b) with an equal key, in tasks of about TASK_PAIRS at most.

    The rows of a key are dealt to blocks on either side, and blocks meet one by one. ``once``: both sides are the same
    rows, dealt by their page; pairs of unequal blocks come in one order only.
    """
    n, m = left.groupBy(key).agg(F.count(F.lit(1)).alias("n")), right.groupBy(key).agg(F.count(F.lit(1)).alias("m"))
    sizes = settled(n.join(m, key))
    pairs = sizes.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_ROWS).cast("int")
    sizes = sizes.select(F.col(key).alias("of"), blocks("n").alias("xs"), blocks("m").alias("ys"))
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / (2 if once else 1) / TASK_PAIRS))
    own = lambda c: F.pmod(F.xxhash64("page"), F.col(c)).cast("int")
    a = left.join(sizes, F.col(key) == F.col("of")).select("of", F.struct(*left.columns).alias("a"), own("xs").alias("x"), "ys")
    b = right.join(sizes, F.col(key) == F.col("of")).select("of", F.struct(*right.columns).alias("b"), own("ys").alias("y"), "xs")
    a = a.select("of", "a", "x", F.explode(F.sequence(F.col("x") if once else F.lit(0), F.col("ys") - 1)).alias("y"))
    b = b.select("of", "b", "y", F.explode(F.sequence(F.lit(0), F.col("y") if once else F.col("xs") - 1)).alias("x"))
    return a.repartition(tasks, "of", "x", "y").join(b.repartition(tasks, "of", "x", "y"), ["of", "x", "y"])


def cannibalizing_keywords(pages: DataFrame) -> DataFrame:
    """B17 in blocks: rows as of ``local_cannibalization``, however many pages a stem or a word has."""
    lower = pages.select("page", "kind", F.lower("keyword").alias("k"))
    stems = lower.filter("page IS NOT NULL").select("page", "kind", "k", F.regexp_replace("k", "(ing|ed|es|s)$", "").alias("stem"))
    cross = F.col("a.kind") != F.col("b.kind")
    page_a, page_b = F.least("a.page", "b.page").alias("page_a"), F.greatest("a.page", "b.page").alias("page_b")
    severity = F.when(F.col("a.k") == F.col("b.k"), "Critical").otherwise("High")
    same = _met(stems, stems, "stem", once=True).filter("x < y OR a.page < b.page").select(page_a, page_b, severity.alias("severity"), cross.alias("cross_type"))
    # the only word of a keyword is the keyword, so long ones have a space and short ones none
    spaced = F.instr("k", " ") > 0
    words = lower.filter(spaced).select("page", "kind", F.explode(F.split("k", " ")).alias("k"))
    return same.unionByName(_met(lower.filter(~spaced), words, "k").select(page_a, page_b, F.lit("Low").alias("severity"), cross.alias("cross_type")))


#: Pages of a block whose headings are counted against those of another one: at most, and at least if that gives FEW_BLOCKS; pairs that leave a task at once.
MOST_PAGES, BLOCK_PAGES, FEW_BLOCKS, SENT_PAIRS = 65_536, 4_096, 16, 100_000


def shared_headings(headings: DataFrame, least: int = 3) -> DataFrame:
    """B17, rule of shared headings. (page_a, page_b, severity, shared): pairs of pages of ``headings`` (page, h2) with ``least`` common second headings: High.

    Headings count once for each page, without case and outer spaces; blank ones don't. Each two blocks of pages meet in one
    task, where the pages that share a heading with a page are counted; only pairs of the result leave it.
    """
    spark = headings.sparkSession
    named = settled(headings.select("page", F.trim(F.lower("h2")).alias("h2")).filter("page IS NOT NULL AND h2 <> ''").distinct())
    uses = named.groupBy("h2").agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1")
    numbers = settled(uses.select("h2", F.monotonically_increasing_id().alias("number")))
    sets = named.join(numbers, "h2").groupBy("page").agg(F.collect_list("number").alias("numbers")).filter(F.size("numbers") >= least)
    sets = settled(sets)
    pages = sets.count()
    n = max(1, -(-pages // MOST_PAGES), min(-(-pages // BLOCK_PAGES), FEW_BLOCKS))
    blocks = settled(sets.groupBy(F.pmod(F.xxhash64("page"), F.lit(n)).cast("int").alias("x")).agg(F.collect_list("page").alias("pages"), F.collect_list("numbers").alias("numbers")))
    ship(spark)
    # every task reads two stored parts, so no block is written once for each that it meets
    left = blocks.repartitionByRange(n, "x")
    right = blocks.select(F.col("x").alias("y"), F.col("pages").alias("others"), F.col("numbers").alias("theirs")).repartitionByRange(n, "y").hint("shuffle_replicate_nl")

    def count(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                at = lambda c: batch[c].slice(k, 1).flatten()  # noqa: B023, E731
                same = batch["x"][k].as_py() == batch["y"][k].as_py()
                yield from _sharing(at("pages"), at("numbers"), at("others"), at("theirs"), same, least)

    kind = dict(headings.dtypes)["page"]
    found = left.join(right, F.col("x") <= F.col("y")).mapInArrow(count, f"p {kind}, q {kind}, shared bigint")
    return found.select(F.least("p", "q").alias("page_a"), F.greatest("p", "q").alias("page_b"), F.lit("High").alias("severity"), "shared")


def _sharing(pages: pa.Array, numbers: pa.Array, others: pa.Array, theirs: pa.Array, same: bool, least: int):
    """Batches (p, q, shared) of the pairs of two blocks with ``least`` common numbers; of one block with itself, each pair once."""
    mine, bounds = numbers.flatten().to_numpy(), np.concatenate(([0], np.cumsum(numbers.value_lengths().to_numpy())))
    flat, owner = theirs.flatten().to_numpy(), np.repeat(np.arange(len(others), dtype=np.int32), theirs.value_lengths().to_numpy())
    order = np.argsort(flat, kind="stable")
    known, starts = np.unique(flat[order], return_index=True)
    rows_of = dict(zip(known.tolist(), np.split(owner[order], starts[1:]), strict=True))
    none = np.zeros(0, np.int32)
    p, q, shared, held = [], [], [], 0
    for i in range(len(pages)):
        met = [rows_of.get(x, none) for x in mine[bounds[i] : bounds[i + 1]].tolist()]
        n = np.bincount(np.concatenate(met), minlength=len(others))
        if same:
            n[: i + 1] = 0
        hits = np.flatnonzero(n >= least)
        if len(hits):
            p.append(np.full(len(hits), i))
            q.append(hits)
            shared.append(n[hits])
            held += len(hits)
        if held >= SENT_PAIRS or (held and i + 1 == len(pages)):
            columns = [pages.take(pa.array(np.concatenate(p))), others.take(pa.array(np.concatenate(q))), pa.array(np.concatenate(shared), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["p", "q", "shared"])
            p, q, shared, held = [], [], [], 0
