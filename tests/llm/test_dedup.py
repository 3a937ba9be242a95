from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from lodestar.llm import graph, simhash, substring_dedup as sd
from tests.llm.conftest import SF

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def slow_fingerprint(text, k=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(fps, dtype=np.uint64)
    for i, j in zip(*np.nonzero(np.triu(np.bitwise_count(a[:, None] ^ a[None]) <= 4, 1)), strict=True):
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", "A b", "one", "A\tB\nC  d e", "Ünï ÀB " * 30])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_components_of_documents(spark, documents):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    ids = sorted(documents.index)
    fps = [slow_fingerprint(documents.text[i]) for i in ids]
    for i, f, c in zip(ids, fps, classes(fps), strict=True):
        assert got[i]["fp"] % (1 << 64) == f and got[i]["component_id"] == ids[c]


@pytest.mark.parametrize("split", [False, True])
def test_links_of_chains_and_clouds(spark, monkeypatch, split):
    """Fingerprints in chains of 4-bit steps and in clouds, with and without lengthened prefixes and small expansions."""
    if split:
        monkeypatch.setattr(simhash, "SPLIT_ROWS", 60)
        monkeypatch.setattr(simhash, "LONGEST", 22)
        monkeypatch.setattr(simhash, "VARIANTS", 20_000)
    r = random.Random(9)
    fps = {r.getrandbits(64) for _ in range(150)}
    x = r.getrandbits(64)
    for _ in range(40):
        x ^= sum(1 << b for b in r.sample(range(64), 4))
        fps.add(x)
    centre = r.getrandbits(64)
    fps |= {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(60)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp bigint"))
    found = {r["node"]: r["root"] for r in graph.components(links).collect()}
    want = classes([f % (1 << 64) for f in signed])
    groups: dict = {}
    for i, c in enumerate(want):
        groups.setdefault(c, set()).add(signed[i])
    for members in groups.values():
        assert {found.get(m, m) for m in members} == {min(members)}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1050), 1000), 2000: 2000, 2001: 2000}


def test_near_duplicates_odd_rows(spark, odd_documents, no_documents):
    rows = simhash.near_duplicates(odd_documents).collect()
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(rows) == odd_documents.count() and by[1] == by[2] == by[3] == 1 and by[5] == by[8] == 5
    assert simhash.near_duplicates(no_documents).count() == 0
    left = simhash.drop_near_duplicates(odd_documents).collect()
    assert sorted(r["doc_id"] or 0 for r in left) == [0, 1, 4, 5, 7]


# --- substring dedup -----------------------------------------------------------------------


def prose(r, n):
    return " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(n))


def test_gear_hash_and_borders_by_hand():
    data = prose(random.Random(1), 300).encode()
    h, hashes, starts = 0, [], []
    for i, b in enumerate(data):
        if i == 0 or data[i - 1 : i] == b" ":
            starts.append(i)
            hashes.append(h if i else 0xFFFF)
        h = (h << 1) + int(sd.GEAR[b]) & 0xFFFF
    # ties go to the first
    want = [s for k, s in enumerate(starts) if min((hashes[j], j) for j in range(max(0, k - 2), min(len(starts), k + 3))) == (hashes[k], k)]
    assert sd.borders(data).tolist() == sorted({0, *want, len(data)})
    words = np.searchsorted(starts, sd.borders(data)[1:-1])
    assert (np.diff(words) >= sd.REACH + 1).all()


def test_cut_runs_against_exact_search(spark):
    """What is cut stands elsewhere word by word, and long repeats are left in one place."""
    r = random.Random(11)
    pool = [prose(r, n) for n in (55, 70, 110)]
    rows = [(i, " ".join([prose(r, r.randint(30, 90)), *(r.sample(pool, r.randint(0, 2))), prose(r, r.randint(30, 90))])) for i in range(80)]
    got = {x["doc_id"]: x for x in sd.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    texts = dict(rows)
    for i, x in got.items():
        for s in x["spans"]:
            cut = texts[i].encode()[s["start"] : s["start"] + s["length"]].decode().strip()
            assert any(cut in texts[j] for j in texts if j != i)
    # exact search: every run of 24 words that stands in two texts
    places: dict[str, set[int]] = {}
    for i, t in texts.items():
        w = t.split()
        for k in range(len(w) - 23):
            places.setdefault(" ".join(w[k : k + 24]), set()).add(i)
    repeated = {run for run, where in places.items() if len(where) > 1}
    before = sum(len(places[run]) - 1 for run in repeated)
    left = sum(max(0, sum(run in got[i]["text"] for i in places[run]) - 1) for run in repeated)
    assert left <= 0.05 * before
    # nothing is lost: every chunk stays in some text
    for t in texts.values():
        edges = sd.borders(t.encode()).tolist()
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            chunk = t.encode()[s:e].decode()
            assert any(chunk in x["text"] for x in got.values())


def test_chunks_cover_the_text_and_resist_shifts():
    r = random.Random(2)
    text = prose(r, 3000)
    a, b = sd.borders(text.encode()), sd.borders(("inserted words here " + text).encode())
    moved = set((b - len("inserted words here ")).tolist())
    assert len(set(a.tolist()) - moved) <= 3
    for t in (text, "x" * 20_000, "é" * 9_000, "ab " * 4000, " ", "a", "中文" * 3000):
        data = t.encode()
        digests, starts, lengths, words = sd.chunks(data)
        assert starts[0] == 0 and lengths.sum() == len(data) and len(digests) == len(starts) and lengths.max() <= sd.LONGEST + 4
        assert words.sum() == len(WORDS.findall(t))
        for s in starts:
            data[s:].decode()


def test_repeated_passages_go_and_clean_texts_stay(spark):
    r = random.Random(4)
    passages = [prose(r, n) for n in (60, 80, 120, 200)]
    rows, marked = [], {}
    for i in range(300):
        body = [prose(r, r.randint(40, 160)) for _ in range(3)]
        if i % 3 == 0:
            marked[i] = i // 3 % 4
            body.insert(r.randint(0, 3), passages[marked[i]])
        rows.append((i, " ".join(body)))
    got = {x["doc_id"]: x for x in sd.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    texts = dict(rows)
    cut = {i for i, x in got.items() if x["removed_words"]}
    assert cut <= set(marked) and len(cut) >= len(marked) - 4 - 2  # one owner for each passage
    for i, x in got.items():
        data, kept, at = texts[i].encode(), b"", 0
        for s in x["spans"]:
            kept, at = kept + data[at : s["start"]], s["start"] + s["length"]
        assert x["text"] == (kept + data[at:]).decode()
    for k, p in enumerate(passages):
        middle = " ".join(p.split()[15:-15])
        assert sum(middle in x["text"] for x in got.values()) == 1, k


def test_copies_and_lines_repeated_within(spark):
    r = random.Random(6)
    text, line = prose(r, 300), prose(r, 60)
    rows = [(1, text), (2, text), (3, "\n".join([line] * 20) + "\n" + prose(r, 50))]
    got = {x["doc_id"]: x["text"] for x in sd.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sorted(map(len, (got[1], got[2]))) == [0, len(text)]
    assert len(got[3]) < 5 * len(line)


def test_substring_odd_rows(spark, odd_documents, no_documents):
    got = sd.dedup_substrings(odd_documents)
    assert set(odd_documents.columns) < set(got.columns)
    rows = got.collect()
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert len(rows) == odd_documents.count() and texts[1] is None and texts[2] == "" and texts[5] == "one two three" == texts[8]
    assert sd.dedup_substrings(no_documents).count() == 0
