"""Operator 4. Repeated passages, by content-defined chunking with a gear rolling hash.

Candidates for chunk borders are word starts, each with the gear hash of the 16 bytes before
it. A candidate is a border if its hash is the smallest among those of the REACH candidates
before and after it; so a chunk has at least REACH + 1 words and five on average, and only
bytes nearby decide: an insertion moves borders near itself alone. In stretches of 64 bytes
without white space any character start with a small hash (one in 24) is a border too, and a
chunk ends after 4,096 bytes at the latest.

A unit is four neighbouring chunks (of a text with fewer, all of them), or one chunk of at least
MIN_WORDS words, and has a 64-bit digest: chunks of a few frequent words stand elsewhere by
chance, so a chunk counts only with its neighbours. As a chunk has three words at least, each
eight consecutive words lie within a unit. Of the documents with a unit one owns it: the one with
the smallest hash of id and text. Units in other documents, and later ones in the owner, are
duplicates; the owned one stays whole, whatever its neighbours are. Duplicates that follow one
another form a run, and pieces of a run of at least MIN_WORDS words are cut out. So whatever eight
words are cut out of a text stand in another one or at another place. Of a passage of over 50 words
the whole chunks go, the few words between its ends and the outermost borders stay.

No occurrence list of a unit is ever gathered: the owner is a minimum with partial sums, and
only units whose digest occurs more than once are joined, in tasks that Spark can split.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import col, fresh, map_rows, materialize, others, unique_keys

WINDOW_BITS = 16  # the gear hash has as many bits as its window has bytes
REACH, CHAR_BORDER = 2, 65_536 // 24
NO_SPACE, LONGEST = 64, 4096
MIN_WORDS = 24
#: Chunks of a unit; with REACH + 1 words in each, any eight words lie in so many.
UNIT_CHUNKS = 4

#: The gear: 256 numbers of 16 bits by a rule.
GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) & 0xFFFF for b in range(256)], dtype=np.uint16)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def borders(data: bytes) -> np.ndarray:
    """Starts of the chunks of ``data`` (UTF-8), then its length."""
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    h = GEAR[b]
    step = 1
    while step < WINDOW_BITS:  # the hash of 2k bytes from two hashes of k bytes
        h[step:] += h[:-step] << np.uint16(step)
        step *= 2
    space = SPACE[b]
    before = np.empty(n, np.uint16)  # hash of the bytes before each position
    before[0], before[1:] = 0xFFFF, h[:-1]
    starts = ~space
    starts[1:] &= space[:-1]
    at = np.flatnonzero(starts)
    hashes, least = before[at], np.ones(len(at), bool)
    for k in range(1, REACH + 1):  # of equal hashes the first is the smaller
        least[k:] &= hashes[k:] < hashes[:-k]
        least[:-k] &= hashes[:-k] <= hashes[k:]
    cut = np.zeros(n, bool)
    cut[at[least]] = True
    index = np.arange(n)
    since = index - np.maximum.accumulate(np.where(space, index, -1))
    if since.max(initial=0) >= NO_SPACE:
        cut |= (since >= NO_SPACE) & ((b & 0xC0) != 0x80) & (before < CHAR_BORDER)
    cut[0] = True
    at = np.flatnonzero(cut)
    edges = np.append(at, n)
    if (np.diff(edges) > LONGEST).any():
        more = np.concatenate([np.arange(s, e, LONGEST) for s, e in zip(edges[:-1], edges[1:], strict=True)])
        char = (b & 0xC0) != 0x80
        for k, p in enumerate(more):
            while p < n and not char[p]:
                p += 1
            more[k] = p
        edges = np.unique(np.append(more, n))
    return edges


def chunks(data: bytes) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Digest, start, length and words of the chunks of ``data``; a word counts where it starts."""
    edges = borders(data)
    space = SPACE[np.frombuffer(data, np.uint8)]
    word = ~space
    word[1:] &= space[:-1]
    total = np.concatenate(([0], np.cumsum(word)))
    digest = xxhash.xxh3_64_intdigest
    at = edges.tolist()
    return [digest(data[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)], edges[:-1], np.diff(edges), np.diff(total[edges])


def units(data: bytes, min_words: int = MIN_WORDS) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Digests of the units of ``data``, their first chunks, and whether each is a long chunk alone."""
    single, starts, lengths, words = chunks(data)
    n = len(single)
    span = min(UNIT_CHUNKS, n)
    ends = starts + lengths
    digest = xxhash.xxh3_64_intdigest
    first = np.arange(n - span + 1)
    several = [digest(data[s:e], 1) for s, e in zip(starts[first].tolist(), ends[first + span - 1].tolist(), strict=True)]
    long = np.flatnonzero(words >= min_words)
    chunk = np.concatenate((first, long))
    return several + [single[i] for i in long], chunk, np.arange(len(chunk)) >= len(first)


def placed(data: bytes, codes: list[int]) -> list[dict]:
    """The units of ``data`` that ``codes`` name (see repeated_units), with their bytes and words."""
    edges = borders(data)
    space = SPACE[np.frombuffer(data, np.uint8)]
    word = ~space
    word[1:] &= space[:-1]
    total = np.concatenate(([0], np.cumsum(word)))[edges].tolist()
    edges, out = edges.tolist(), []
    for code in codes:
        chunk, kind, stays = code >> 4, code >> 1 & 7, bool(code & 1)
        last = min(chunk + (1 if kind & SINGLE else UNIT_CHUNKS), len(edges) - 1)
        out.append({"chunk": chunk, "kind": kind, "stays": stays, "place": edges[chunk], "length": edges[last] - edges[chunk], "word": total[chunk], "words": total[last] - total[chunk]})
    return out


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


#: Bits of a unit's kind: the document has the digest at an earlier place; it has it at a later one; a long chunk alone.
AGAIN, REPEATS, SINGLE = 1, 2, 4


def unit_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, digest, chunk, kind) of each unit of ``docs`` (doc, text); where a chunk stands is found anew in the text.

    Units with the same digest, as of a line repeated a thousand times, stay single rows.
    """

    def make():
        def step(cols):
            out: dict[str, list] = {c: [] for c in ("doc", "digest", "chunk", "kind")}
            for doc, text in zip(cols["doc"], cols["text"], strict=True):
                if not text:
                    continue
                digests, chunk, single = units(text.encode(), min_words)
                d = _signed(digests)
                _, first, uses = np.unique(d, return_index=True, return_counts=True)
                kind = np.full(len(d), AGAIN, np.int8)
                kind[first] = np.where(uses > 1, REPEATS, 0)
                kind += single * np.int8(SINGLE)
                for c, v in (("doc", np.full(len(d), doc)), ("digest", d), ("chunk", chunk), ("kind", kind)):
                    out[c].append(v)
            return {c: np.concatenate(v) if v else [] for c, v in out.items()}

        return step

    return map_rows(docs, make, "doc bigint, digest bigint, chunk int, kind tinyint", chunk=200)


def cut_ranges(found: list[dict], min_words: int) -> list[tuple[int, int, int]]:
    """(start, end, words) of what goes of a text, in bytes, from its duplicate units and those that must stay whole.

    Duplicate units whose first chunks follow one another are a run: each stretch of UNIT_CHUNKS chunks in it stands in a
    unit's owner. Where two runs overlap without that, the stretches across stand nowhere else, so the last unit of the one and
    the first of the other stay. A piece of a run goes if it has ``min_words`` words.
    """
    ends = lambda u: ((u["place"], u["word"]), (u["place"] + u["length"], u["word"] + u["words"]))
    runs: list[list] = []  # start, end, first chunk of the last unit, chunk behind, its last unit's range
    stay = sorted(ends(u) for u in found if u["stays"])
    for u in sorted((u for u in found if not u["stays"]), key=lambda u: (u["chunk"], u["kind"] & SINGLE)):
        start, end = ends(u)
        alone = bool(u["kind"] & SINGLE)
        behind = u["chunk"] + (1 if alone else UNIT_CHUNKS)
        if runs and alone and behind <= runs[-1][3]:
            continue
        if runs and not alone and u["chunk"] == runs[-1][2] + 1:
            runs[-1][1:] = [end, u["chunk"], behind, (start, end)]
            continue
        if runs and start < runs[-1][1] and not (alone or runs[-1][2] < 0):
            stay += [runs[-1][4], (start, end)]
        runs.append([start, end, -2 if alone else u["chunk"], behind, (start, end)])
    stay.sort()
    merged: list[list] = []
    for start, end, *_ in runs:
        if merged and start <= merged[-1][1] and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    out, i = [], 0
    for start, end in merged:
        at = start
        while i < len(stay) and stay[i][1] <= start:
            i += 1
        j = i
        while j < len(stay) and stay[j][0] < end:
            if stay[j][0] > at:
                out.append((at, stay[j][0]))
            at = max(at, stay[j][1])
            j += 1
        if at < end:
            out.append((at, end))
    return [(a[0], b[0], b[1] - a[1]) for a, b in out if b[1] - a[1] >= min_words]


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, codes) of the documents (doc, text) with duplicate units: 16 * chunk + 2 * kind of these, and, plus 1, of the units that must stay whole."""
    table = materialize(unit_table(docs, min_words), "units")
    again, repeats = F.col("kind").bitwiseAND(AGAIN) > 0, F.col("kind").bitwiseAND(REPEATS) > 0
    owners = table.filter(~again).groupBy("digest").agg(F.min("doc").alias("owner"), F.count(F.lit(1)).alias("n"))
    owners = owners.filter("n > 1").select("digest", "owner")
    code = F.col("chunk").cast("bigint") * 16 + F.col("kind") * 2
    shared = table.filter(~again).join(owners, "digest").select("doc", (code + (F.col("doc") == F.col("owner")).cast("int")).alias("code"))
    # in a text alone: later places go, and the first stays unless another text owns it
    later = table.filter(again).select("doc", code.alias("code"))
    alone = table.filter(repeats).join(owners, "digest", "left_anti").select("doc", (code + 1).alias("code"))
    by_doc = shared.unionByName(later).unionByName(alone).groupBy("doc").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    return by_doc.filter(F.exists("codes", lambda c: c % 2 == 0))


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with their repeated passages cut out of the text, and removed_words and spans added.

    Every passage stays in one document. Null texts stay null and empty ones empty; a text
    that is wholly repeated becomes empty, its row stays. Rows with the same id and text count
    as one document and are cut alike; null ids are ids. An empty table gives no rows. Columns named
    removed_words or spans are replaced, others may have any names. White space around a cut
    passage is left as it is.
    """
    kept = others(docs, "removed_words", "spans")
    doc, of_doc, codes, raw = fresh(docs, "doc", "of_doc", "codes", "raw")
    keyed = docs.select(*map(col, kept), unique_keys(docs, doc_id, text).alias(doc))
    found = repeated_units(keyed.select(col(doc).alias("doc"), col(text).alias("text")), min_words)
    found = materialize(found.toDF(of_doc, codes), "repeated-units")
    joined = keyed.join(found, F.col(doc) == F.col(of_doc), "left")
    rest = [c for c in kept if c.lower() != text.lower()]

    def make():
        def step(cols):
            out: dict[str, list] = {"rest": [], "removed_words": [], "spans": []}
            for whole, named in zip(cols[raw], cols[codes], strict=True):
                cut = cut_ranges(placed(whole.encode(), named), min_words) if named else []
                if cut:
                    data, at, left = whole.encode(), 0, []
                    for a, b, _ in cut:
                        left.append(data[at:a])
                        at = b
                    whole = b"".join([*left, data[at:]]).decode()
                out["rest"].append(whole)
                out["removed_words"].append(sum(w for _, _, w in cut))
                out["spans"].append([{"start": a, "length": b - a} for a, b, _ in cut])
            return out

        return step

    read = joined.select(*map(col, rest), col(text).alias(raw), codes)
    cut = map_rows(read, make, "rest string, removed_words bigint, spans array<struct<start:int,length:int>>", rest, chunk=200)
    (name,) = [c for c in kept if c.lower() == text.lower()]
    cut = cut.toDF(*[f"c{i}" for i in range(len(rest))], "rest", "removed_words", "spans")
    of = {c: f"c{i}" for i, c in enumerate(rest)} | {name: "rest"}
    return cut.select(*[F.col(of[c]).alias(c) for c in kept], "removed_words", "spans")
