"""Runs are cut only where their joints repeat."""

from __future__ import annotations

import random

from lodestar.llm import substring_dedup


def test_runs_of_chunks_that_meet_nowhere_else_stay(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(15)]
    texts = [" ".join(r.choice(words) for _ in range(120)) for _ in range(300)]
    seen: dict[tuple, set[int]] = {}
    for i, t in enumerate(texts):
        w = t.split()
        for k in range(len(w) - 15):
            seen.setdefault(tuple(w[k : k + 16]), set()).add(i)
    assert max(map(len, seen.values())) == 1
    shared = " ".join("".join(r.choice("qrstuvw") for _ in range(6)) for _ in range(80))
    rows = [*enumerate(texts), (1000, shared + " one more"), (1001, "and " + shared)]
    got = {x["doc_id"]: x["removed_words"] for x in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(got[i] for i in range(300)) == 0
    assert 60 <= got[1000] + got[1001] <= 81


def eights(text):
    w = (text or "").split()
    return {tuple(w[i : i + 8]) for i in range(len(w) - 7)}


def test_no_eight_words_of_a_cut_run_are_lost(spark):
    """What is cut out of a text stands in another output; three random passages meet in every order, besides the test table."""
    r = random.Random(2)
    passage = [" ".join("".join(r.choice("abcdefghijklm") for _ in range(r.randint(1, 7))) for _ in range(60)) for _ in range(5)]
    parts = [p[: r.randrange(100, len(p))] for p in passage] + passage
    rows = [(i, " ".join(r.choice(parts) for _ in range(4))) for i in range(60)]
    rows += [(1000 + x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    out = {x.doc_id: x for x in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    stand = set().union(*(eights(x.text) for x in out.values()))
    cut, lost = 0, 0
    for i, text in rows:
        for s in out[i].spans:
            inside = eights(text.encode()[s["start"] : s["start"] + s["length"]].decode())
            cut += len(inside)
            lost += len(inside - stand)
    assert cut > 10_000 and lost == 0, (cut, lost)
