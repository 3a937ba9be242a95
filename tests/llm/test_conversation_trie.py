"""Conversation trie: against a dictionary of prefixes, with long spines, hot and odd conversations."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar.llm import conversation_trie as trie
from lodestar.llm import queries

SF = "/root/testdata/sf0.001"
BASE, BORROWED = lambda c: c - c % 20, lambda c: F.crc32(c.cast("string").cast("binary")) % 4


def expected(turns, rebuild=True):
    """turns: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        full[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
        ends[v].append(c)
    kids = defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] += not kids[k]
        saved[k] += (len(members[k]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0)
        if k:
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    sha = lambda v: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest()
    return sorted((min(m), len(k), str(min(members[k[:-1]]) if k else None), len(m), kids[k], leaves[k], saved[k], sha(ends[k])) for k, m in members.items())


def found(df):
    return sorted((r.conv_id, r.depth, str(r.parent_conv_id), r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_whole_query(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op13_conversation_trie(spark, SF)) == expected(turns)


def test_odd_rows(spark):
    rnd = random.Random(5)
    turns = [(c, rnd.choice([None, 0, 1, 2, 2, 5]), rnd.choice([None, "user", ""]), rnd.choice([None, "", "a b", "a b", "é ü ö", "x " * 5000])) for c in rnd.choices(range(-30, 90), k=500)]
    turns += [(None, 1, "user", "left out"), (7, 0, "user", "only"), (7, 0, "user", "only"), (201, 0, "u", "t")]  # 201 borrows from none
    df = spark.createDataFrame(turns, SCHEMA).withColumn("part", F.lit(1)).withColumn("k", F.lit("x"))
    assert found(trie.prefix_trie(df, BASE, BORROWED)) == expected(turns)
    assert trie.prefix_trie(df.limit(0), BASE, BORROWED).count() == 0


def test_copies_and_a_long_conversation(spark):
    """Copies of one conversation, one conversation with most turns, and equal turns without numbers."""
    turns = [(c, t, "user", f"turn {t}") for c in range(300, 420) for t in range(3)]
    turns += [(1, t, "user", f"long {t % 7} {t}") for t in range(600)]
    turns += [(2, None, "user", "same")] * 200
    df = spark.createDataFrame(turns, SCHEMA).repartition(5)
    assert found(trie.prefix_trie(df)) == expected(turns, rebuild=False)


@pytest.mark.parametrize("few", [0.25, 2.0])
def test_spines(spark, few, monkeypatch):
    """Conversations that share ever longer prefixes: rounds grow with the logarithm of the depth."""
    monkeypatch.setattr(trie, "FEW", few)
    monkeypatch.setattr(trie, "MOST_ROUNDS", 8)
    turns = [(c, t, "user", f"turn {t}" if t < c else f"branch {c}") for c in range(1, 40) for t in range(c + 1)]
    turns += [(100 + c, t, "user", f"b {t}" if t < 20 else f"end {c} {t}") for c in range(3) for t in range(22)]
    assert found(trie.prefix_trie(spark.createDataFrame(turns, SCHEMA))) == expected(turns, rebuild=False)
