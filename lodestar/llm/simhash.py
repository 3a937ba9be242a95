"""Operator 8. SimHash near-duplicates, found by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a fingerprint between them that is at
most r bits from either. So every fingerprint emits all variants within r bits, and two that
link share a variant; and as a variant's fingerprints lie within r bits of it, any two of
them link. A variant with many fingerprints thus needs no pairs: all are tied to the smallest.

The shuffle goes by the leading bits of the variants, and the variants are spelt out where
they meet: a fingerprint is sent to each prefix within r bits of its own (37 instead of the
2,081 variants for r = 2 and 8 leading bits), and the receiving task forms exactly its
variants with that prefix. Each task returns a spanning forest of what it found, so that
links stay linear in the number of fingerprints.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import col, fresh, map_rows, materialize, others, same_rows, words_of
from lodestar.llm.graph import components
from lodestar.operators.setjoin import similar_sets
from lodestar.sources.shipping import ship

SHINGLE_WORDS, DISTANCE, SEED = 4, 4, 42
#: Fingerprints that a prefix is meant to receive, the range of prefix lengths, the rows above which a prefix is lengthened, and by how many bits.
PREFIX_ROWS, SHORTEST, LONGEST, SPLIT_ROWS, MORE_BITS = 40_000, 6, 60, 1_000_000, 8
#: Variants that a task spells out at a time.
VARIANTS = 4_000_000

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if it is set in over half the XXH64 of the text's shingles, repeats included; no words: 0."""
    return majority(shingle_hashes(text, shingle_words))


def shingle_hashes(text: str, shingle_words: int) -> np.ndarray:
    """XXH64 of the text's shingles in order; a text of fewer words is one shingle."""
    words = words_of(text.translate(_LOWER) if not text.islower() else text)
    if not words:
        return np.array([], dtype="<u8")
    joined = " ".join(words).encode()
    if len(words) <= shingle_words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        # words are found again as stretches between spaces, which no word holds
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = np.concatenate(([0], gaps + 1))[: len(words) - shingle_words + 1].tolist()
        ends = np.concatenate((gaps, [len(joined)]))[shingle_words - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)]
    return np.array(hashes, dtype="<u8")


def majority(h: np.ndarray) -> int:
    bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        bits += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    ones = np.packbits(2 * bits > len(h), bitorder="little")
    return int(ones.view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """The columns of ``docs`` but the text, and fp: the fingerprint as a signed bigint."""

    def make():
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return lambda cols: {"fp": [signed(fingerprint(t or "", shingle_words)) for (texts,) in [cols.values()] for t in texts]}

    keep = others(docs, text, "fp")
    return map_rows(docs.select(*map(col, keep), col(text)), make, "fp bigint", keep)


def ball(bits: int, radius: int) -> np.ndarray:
    """Masks over the lowest ``bits`` bits with at most ``radius`` set."""
    return np.array([sum(1 << b for b in on) for r in range(radius + 1) for on in combinations(range(bits), r)], dtype=np.uint64)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links a - b."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low < high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return root


def meet(fps: np.ndarray, prefix: int, prefix_bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger, smaller) that tie together the fingerprints whose variants with this prefix meet.

    ``fps``: distinct, sorted. Variants are spelt out VARIANTS at a time, by their hash.
    """
    low = 64 - prefix_bits
    top = fps >> np.uint64(low)
    away = np.bitwise_count(top ^ np.uint64(prefix))
    base = (fps & np.uint64((1 << low) - 1)) | np.uint64(prefix << low)
    groups = [(np.flatnonzero(away == d), ball(low, radius - d)) for d in range(radius + 1)]
    loops = -(-max(sum(len(i) * len(m) for i, m in groups), 1) // VARIANTS)
    left, right = [], []
    for loop in range(loops):
        values, owners = [], []
        for index, masks in groups:
            step = max(1, VARIANTS // len(masks))
            for at in range(0, len(index), step):
                some = index[at : at + step]
                v = (base[some, None] ^ masks[None, :]).ravel()
                o = np.repeat(some, len(masks))
                if loops > 1:
                    mine = (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(loops) == np.uint64(loop)
                    v, o = v[mine], o[mine]
                values.append(v)
                owners.append(o)
        v, o = np.concatenate(values), np.concatenate(owners)
        ranked = np.sort(v)
        twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        if not len(twice):
            continue
        at = np.minimum(np.searchsorted(twice, v), len(twice) - 1)
        hit = twice[at] == v
        at, o = at[hit], o[hit]
        first = np.full(len(twice), len(fps))
        np.minimum.at(first, at, o)
        tied = first[at] != o
        a, b = o[tied], first[at[tied]]
        true = np.bitwise_count(fps[a] ^ fps[b]) <= 2 * radius  # colliding pairs are verified
        left.append(a[true])
        right.append(b[true])
    if not left:
        return np.array([], np.uint64), np.array([], np.uint64)
    root = forest(len(fps), np.concatenate(left), np.concatenate(right))
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[moved], fps[root[moved]]


def _lengthened(sent: DataFrame, bits: int, more: int, radius: int) -> DataFrame:
    """Rows (fp, prefix of ``bits``, left) sent on to prefixes that are ``more`` bits longer; left: how far a variant may still differ."""
    own = F.shiftrightunsigned("fp", 64 - bits - more).bitwiseAND(F.lit((1 << more) - 1))
    masks = ball(more, radius)
    by_left = [F.array(*[F.struct(F.lit(int(m)).cast("bigint").alias("mask"), F.lit(int(m).bit_count()).alias("used")) for m in masks if int(m).bit_count() <= k]) for k in range(radius + 1)]
    which = by_left[-1]
    for k in range(radius - 1, -1, -1):
        which = F.when(F.col("left") == k, by_left[k]).otherwise(which)
    routed = sent.select("fp", "prefix", "left", own.alias("own"), F.explode(which).alias("m"))
    return routed.select("fp", F.shiftleft("prefix", more).bitwiseOR(F.col("own").bitwiseXOR(F.col("m.mask"))).alias("prefix"), (F.col("left") - F.col("m.used")).alias("left"))


def _links_of(bits: int, radius: int):
    def links(key, pdf):
        import pandas as pd

        a, b = meet(np.sort(pdf["fp"].to_numpy().view(np.uint64)), int(key[0]), bits, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return links


def near_links(distinct: DataFrame, distance: int = DISTANCE, prefix_rows: int = PREFIX_ROWS) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints which links of at most ``distance`` bits connect.

    ``distinct``: one column of distinct fingerprints (bigint). ``distance`` is even. Prefixes
    lengthen with the number of fingerprints; one that receives more than SPLIT_ROWS of them
    is lengthened on its own, up to LONGEST bits, under which a ball has few members.
    """
    if distance % 2:
        raise ValueError("meeting in the middle takes an even distance")
    radius, spark = distance // 2, distinct.sparkSession
    n = distinct.count()
    routes = lambda bits: len(ball(bits, radius))
    bits = next((b for b in range(SHORTEST, LONGEST) if n * routes(b) <= prefix_rows << b), LONGEST)
    ship(spark)
    start = distinct.select(F.col(distinct.columns[0]).alias("fp"), F.lit(0).cast("bigint").alias("prefix"), F.lit(radius).alias("left"))
    sent, found = _lengthened(start, 0, bits, radius), []
    while True:
        full = None
        if bits + MORE_BITS <= LONGEST:
            full = sent.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SPLIT_ROWS).select("prefix")
            full = materialize(full, "full-prefixes")
            full = None if full.isEmpty() else full
        here = sent if full is None else sent.join(full, "prefix", "left_anti")
        found.append(here.select("fp", "prefix").groupBy("prefix").applyInPandas(_links_of(bits, radius), "a bigint, b bigint"))
        if full is None:
            break
        sent, bits = _lengthened(materialize(sent.join(full, "prefix", "left_semi"), "rows-of-full-prefixes"), bits, MORE_BITS, radius), bits + MORE_BITS
    return reduce(DataFrame.unionByName, found).distinct()


#: Keys (of 40 bytes) that are broadcast at most.
MOST_SENT = 1_000_000
#: Bands of minimum hashes: texts of similarity 0.8 share none of them once in 38,000 times.
BANDS, BAND_HASHES = 20, 4
_MIX = np.array([[xxhash.xxh64_intdigest(bytes([i, j]), 11) | (j == 1) for j in range(2)] for i in range(BANDS * BAND_HASHES)], dtype=np.uint64)


def minimum_bands(h: np.ndarray) -> list[int]:
    """A signed number for each band of minimum hashes of the shingle hashes ``h``; none for a text without words."""
    if not len(h):
        return []
    least = np.full(len(_MIX), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 2_048):
        np.minimum(least, ((h[None, at : at + 2_048] ^ _MIX[:, :1]) * _MIX[:, 1:]).min(axis=1), out=least)
    digest = xxhash.xxh64_intdigest
    rows = least.reshape(BANDS, BAND_HASHES)
    return np.array([digest(x.tobytes(), t) for t, x in enumerate(rows)], dtype=np.uint64).view(np.int64).tolist()


def sketches(docs: DataFrame, shingle_words: int) -> DataFrame:
    """The columns of ``docs`` but text, and what near-duplicates need of it, from one pass over its shingles.

    t: MD5 of the text (one for all wordless ones), fp: fingerprint, n: distinct shingles, bands: its minimum bands.
    """

    def make():
        signed = lambda x: x - (1 << 64) if x >> 63 else x

        def step(cols):
            hashes = [shingle_hashes(x or "", shingle_words) for x in cols["text"]]
            return {"fp": [signed(majority(h)) for h in hashes], "n": [len(np.unique(h)) for h in hashes], "bands": [minimum_bands(h) for h in hashes]}

        return step

    keyed = docs.withColumn("t", F.unhex(F.md5("text")))
    found = map_rows(keyed, make, "fp bigint, n bigint, bands array<bigint>", others(keyed, "text"))
    return found.withColumn("t", F.when(F.col("n") == 0, F.unhex(F.md5(F.lit("")))).otherwise(F.col("t")))


def candidate_pairs(texts: DataFrame, similarity: float, distance: int) -> DataFrame:
    """(t, c): pairs of ``texts`` (t, fp, n, bands) that may be as similar, from SimHash and from minimum hashes.

    Texts that share a fingerprint or a band meet one of the texts there, another one in each; fingerprints that link
    within ``distance`` bits bring one text of each together. No pairs within a group are formed, and
    sets of too unlike sizes are left out, as they cannot be so similar.
    """
    one = F.struct("t", "fp", "n").alias("one")
    order = lambda by: F.struct(F.xxhash64("one.t", by).alias("order"), "one")
    worded = texts.filter("n > 0").select(one, "fp", F.explode(F.concat("bands", F.array(F.xxhash64(F.lit("fingerprint"), "fp")))).alias("bucket"))
    worded = materialize(worded, "buckets")
    centers = worded.groupBy("bucket").agg(F.min(order("bucket")).alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket", F.col("m.one").alias("center"))
    met = worded.join(centers, "bucket").select("one", "center")
    by_fp = texts.filter("n > 0").select(one, "fp").groupBy("fp").agg(F.min(order("fp")).alias("m")).select("fp", F.col("m.one").alias("one"))
    by_fp = materialize(by_fp, "fingerprint-centers")
    links = near_links(by_fp.select("fp"), distance)
    near = links.join(by_fp.select(F.col("fp").alias("a"), "one"), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("one").alias("center")), "b").select("one", "center")
    sizes = F.least("one.n", "center.n") >= F.lit(float(similarity)) * F.greatest("one.n", "center.n")
    pairs = met.unionByName(near).filter(F.col("one.t") != F.col("center.t")).filter(sizes)
    return pairs.select(F.least("one.t", "center.t").alias("t"), F.greatest("one.t", "center.t").alias("c")).distinct()


#: Of the texts, one in SAMPLE tells which shingles are common: in COMMON of those at least, the MOST_COMMON commonest. Their order depends on it, no link does.
SAMPLE, COMMON, MOST_COMMON = 16, 8, 1_000_000


def common_shingles(docs: DataFrame, shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of common shingles, and their number of uses in a sample of the texts."""
    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    make = lambda: lambda cols: {"h": [x for t in cols["text"] for x in np.unique(shingle_hashes(t or "", shingle_words)).view(np.int64).tolist()]}
    uses = map_rows(some, make, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("uses")).filter(F.col("uses") >= COMMON)
    found = uses.orderBy(F.desc("uses"), "h").limit(MOST_COMMON).toPandas()
    h, n = found["h"].to_numpy(np.int64).view(np.uint64), found["uses"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def first_shingles(h: np.ndarray, common: np.ndarray, uses: np.ndarray, similarity: float) -> np.ndarray:
    """The first of the distinct shingles ``h``, by uses if common and then by hash, so many that two sets as similar share one of them."""
    if not len(h):
        return h
    rank = np.zeros(len(h), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        rank = np.where(common[at] == h, uses[at], 0)
    return h[np.lexsort((h, rank))][: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]


def pairs_across(docs: DataFrame, texts: DataFrame, linked: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """(t, c): every pair of ``texts`` (t, doc_key, n) in unlike components of ``linked`` (a, b) that may be as similar.

    Sets as similar have a common shingle among the first of either, in whatever order, and so many of them that the
    shingles behind could make up the rest. Common shingles come last. Pairs within a component change nothing and are not formed.
    """
    of = materialize(components(linked), "linked-components")
    numbered = texts.filter("n > 0").select("t", "doc_key", "n").join(of.withColumnRenamed("node", "t"), "t", "left").withColumn("root", F.coalesce("root", "t"))
    numbered = materialize(numbered.withColumn("num", F.monotonically_increasing_id()), "numbered-texts")
    numbered = numbered.join(numbered.groupBy("root").agg(F.min("num").alias("of")), "root").select("t", "doc_key", "n", "num", "of")
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle_words))  # MOST_COMMON at most

    def make():
        known, uses = common.value
        firsts = lambda x: first_shingles(np.unique(shingle_hashes(x or "", shingle_words)), known, uses, similarity).view(np.int64).tolist()
        return lambda cols: {"h": [firsts(x) for x in cols["text"]]}

    heads = map_rows(docs.select("doc_key", "text"), make, "h array<bigint>", ["doc_key"]).dropDuplicates(["doc_key"])
    heads = materialize(heads.join(numbered, "doc_key").select("t", "n", "num", "of", "h"), "first-shingles")
    places = heads.select("n", "num", "of", F.posexplode("h").alias("place", "h"))
    mixed = places.groupBy("h").agg(F.min("of").alias("least"), F.max("of").alias("most")).filter("least < most").select("h")
    mixed = materialize(mixed, "shingles-across")
    mixed = F.broadcast(mixed) if mixed.count() <= MOST_SENT else mixed
    hits = materialize(places.join(mixed, "h"), "places-across")
    groups = hits.select("h", "of").distinct()
    met = groups.toDF("h", "of_a").join(groups.toDF("h", "of_b"), "h").filter("of_a < of_b")
    side = lambda k: hits.select("h", *[F.col(c).alias(f"{c}_{k}") for c in ("n", "num", "of", "place")])
    both = met.join(side("a"), ["h", "of_a"]).join(side("b"), ["h", "of_b"])
    sizes = F.least("n_a", "n_b") >= F.lit(float(similarity)) * F.greatest("n_a", "n_b") - 1e-9
    counted = both.filter(sizes).groupBy("num_a", "num_b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("common"), F.max("place_a").alias("last_a"), F.max("place_b").alias("last_b"))
    # the rest of those first shingles that end earlier meets none of the other set
    rest = lambda x, y: F.least(F.ceil(F.lit(float(similarity)) * F.col(f"n_{x}") - 1e-9) - 1, F.col(f"n_{y}") - F.col(f"last_{y}") - 1)
    enough = F.col("common") + F.greatest(rest("a", "b"), rest("b", "a")) >= (F.col("n_a") + F.col("n_b")) * (similarity / (1 + similarity)) - 1e-9
    pairs = counted.filter(enough)
    name = lambda k, c: heads.select(F.col("num").alias(f"num_{k}"), F.col("t").alias(c))
    return pairs.join(name("a", "t"), "num_a").join(name("b", "c"), "num_b").select("t", "c")


def similar_links(docs: DataFrame, sketched: DataFrame, shingle_words: int, similarity: float, distance: int = DISTANCE, exact: bool = False) -> DataFrame:
    """(a, b): texts (by MD5) with a Jaccard similarity of at least ``similarity``, each pair compared by its whole sets of shingles.

    ``docs``: doc_key, text; ``sketched``: a stored table of its ``sketches``. Compared are the ``candidate_pairs``, and
    then all ``pairs_across`` the components of the links found among them, so the links have the components of
    all similar pairs. ``exact`` finds every pair, those within components too, by prefix filters over all shingles, and moves all of them once.
    """
    texts = materialize(sketched.select("t", "doc_key", "fp", "n", "bands").dropDuplicates(["t"]), "texts")
    if exact:
        whole = docs.join(texts.select("doc_key", "t"), "doc_key").select("t", "text").dropDuplicates(["t"])
        make = lambda: lambda cols: {"tokens": [np.unique(shingle_hashes(x or "", shingle_words)).view(np.int64).tolist() for x in cols["text"]]}
        return similar_sets(map_rows(whole, make, "tokens array<bigint>", ["t"]).withColumnRenamed("t", "id"), similarity, "jaccard").select("a", "b")
    proposed = compared(docs, texts, candidate_pairs(texts, similarity, distance), shingle_words, similarity)
    proposed = materialize(proposed, "proposed-links")
    return proposed.unionByName(compared(docs, texts, pairs_across(docs, texts, proposed, shingle_words, similarity), shingle_words, similarity))


def compared(docs: DataFrame, texts: DataFrame, pairs: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """(a, b): those of ``pairs`` (t, c) of ``texts`` that are as similar."""
    tasks = 4 * docs.sparkSession.sparkContext.defaultParallelism  # pairs are small, and long to compare
    pairs = materialize(pairs.repartition(tasks), "candidate-pairs")
    met = pairs.select("t").union(pairs.select("c")).distinct()
    met = materialize(texts.select("t", "doc_key").join(met, "t", "left_semi"), "met-keys")
    # texts stay where they are while the keys of those that are read again are few enough to be sent to them
    met = F.broadcast(met) if met.count() <= MOST_SENT else met
    read = docs.select("doc_key", "text").join(met, "doc_key").select("t", "text").dropDuplicates(["t"])
    read = materialize(read, "met-texts")
    both = pairs.join(read, "t").withColumnRenamed("text", "x").join(read.select(F.col("t").alias("c"), F.col("text").alias("y")), "c").select(F.col("t").alias("a"), F.col("c").alias("b"), "x", "y")

    def compare():
        def step(cols):
            out: dict[str, list] = {"a": [], "b": []}
            for a, b, x, y in zip(cols["a"], cols["b"], cols["x"], cols["y"], strict=True):
                s, u = set(shingle_hashes(x, shingle_words).tolist()), set(shingle_hashes(y, shingle_words).tolist())
                if len(s & u) >= similarity * len(s | u):
                    out["a"].append(a)
                    out["b"].append(b)
            return out

        return step

    return map_rows(both, compare, "a binary, b binary")


def components_of(docs: DataFrame, doc_id: str, text: str, shingle_words: int = SHINGLE_WORDS, distance: int = DISTANCE, similarity: float | None = None, exact: bool = False) -> DataFrame:
    """The rows of near_duplicates, and root: the smallest node of the component, which stands for it.

    Nodes are fingerprints. With ``similarity`` they are texts, and links are those pairs alone whose sets of
    shingles have such a Jaccard similarity; SimHash then proposes pairs, and never links unlike ones.
    """
    keyed = docs.select(col(doc_id).alias("doc_id"), same_rows(docs, doc_id, text).alias("doc_key"), col(text).alias("text"))
    if similarity is None:
        rows, by = materialize(fingerprints(keyed, "text", shingle_words), "fingerprints"), "fp"
    else:
        rows, by = materialize(sketches(keyed, shingle_words), "sketches"), "t"
    distinct = materialize(rows.groupBy(F.col(by).alias("own")).agg(F.min("doc_id").alias("least")), "distinct-nodes")
    links = near_links(distinct.select("own"), distance) if similarity is None else similar_links(keyed, rows, shingle_words, similarity, distance, exact)
    links = materialize(links, "near-links")
    found = components(links)
    tied = found.join(distinct, F.col("node") == F.col("own")).select("own", "root", "least")
    roots = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    tied = tied.join(roots, "root").select("own", "root", "component_id")
    alone = distinct.join(tied, "own", "left").select(F.col("own").alias("of_own"), F.coalesce("root", "own").alias("root"), F.when(F.col("component_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    alone = materialize(alone, "node-components")
    return rows.join(alone, F.col(by) == F.col("of_own")).select("doc_id", "doc_key", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS, distance: int = DISTANCE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, doc_key (128 bits of id and text), fp and component_id.

    component_id is the smallest doc_id among the documents that links of at most ``distance``
    bits reach, the document itself included. Null, empty and wordless texts have fingerprint
    zero and link like any other. A null doc_id counts only if all in its component are null.
    Repeated rows share a component; an empty table gives no rows. Only id and text are read, so
    no name can clash.
    """
    return components_of(docs, doc_id, text, shingle_words, distance).select("doc_id", "doc_key", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id (null first), then key.

    Rows that repeat it (same id and text) are one document: one of them stays, the one with the
    smallest hash of its whole row. Wordless texts are one component. An empty table gives no rows.
    """
    (key,) = fresh(docs, "near_key")
    found = components_of(docs, doc_id, text, **options)
    rows = found.groupBy("root", "doc_key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    stays = rows.groupBy("root").agg(F.min(F.struct("doc_id", "doc_key", "n")).alias("d")).select(F.col("d.doc_key").alias(key), F.col("d.n").alias("n"))
    stays = materialize(stays, "near-keys")  # texts move only as far as this table is too large to be sent to them
    keyed = docs.withColumn(key, same_rows(docs, doc_id, text))
    single = keyed.join(stays.filter("n = 1").select(key), key, "left_semi").select(*map(col, docs.columns))
    repeated = keyed.join(stays.filter("n > 1").select(key), key, "left_semi")
    everything = F.struct(same_rows(docs).alias("order"), F.struct(*map(col, docs.columns)).alias("row"))
    one = repeated.select(F.col(key), everything.alias("r")).groupBy(key).agg(F.min_by("r.row", "r.order").alias("r"))
    return single.unionByName(one.select(*[F.col("r").getField(c).alias(c) for c in docs.columns]))
