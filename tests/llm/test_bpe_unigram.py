from __future__ import annotations

import hashlib
import random
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestar.llm import bpe, unigram

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def ours():
    with open(PATH, encoding="utf-8") as f:
        return bpe.TrieBPE(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(ours, library, texts):
    for text, got in zip(texts, ours.encode_many(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert array("I", got).tolist() == want, repr(text[:80])
        assert ours.decode(got) == library.decode(want, skip_special_tokens=False)


def test_documents_match_the_library(ours, library, documents):
    check(ours, library, [t or "" for t in documents.text])


def test_random_texts_match_the_library(ours, library):
    r = random.Random(3)
    parts = [*"abcdefghij XYZ.,'\n\t0123_-éßü²Ⅷ中😀", "  ", "<|endoftext|>", "'s", "'ll", "the", "ing", "\r\n", " \n", "\u00a0"]
    check(ours, library, ["".join(r.choices(parts, k=r.randint(0, 50))) for _ in range(4000)] + ["a" * 3000, " " * 500, ""])


def test_every_character_matches_the_library(ours, library):
    check(ours, library, ["".join(chr(c) for c in range(a, a + 64)) for a in range(0, 0xD800, 64)])


def test_odd_rows(spark, odd_documents, no_documents):
    rows = bpe.bpe_encode(odd_documents, PATH, digests=True).collect()
    assert len(rows) == odd_documents.count()
    empty = next(r for r in rows if r["doc_id"] == 1)
    assert empty["n_tokens"] == 0 and empty["ids_sha256"] == hashlib.sha256(b"").hexdigest() and empty["n_words"] == 9
    assert bpe.bpe_encode(no_documents, PATH).count() == 0


def test_round_trip(spark, odd_documents):
    coded = bpe.bpe_encode(odd_documents.select("doc_id", "text"), PATH)
    back = {r["doc_id"]: r["text"] for r in bpe.bpe_decode(coded.drop("text"), PATH).collect()}
    for r in odd_documents.select("doc_id", "text").collect():
        assert back[r["doc_id"]] == (r["text"] or "")


def test_own_text_column_and_ids_in_its_place(spark, odd_documents):
    coded = bpe.bpe_encode(odd_documents, PATH, ids="score")
    assert dict(coded.dtypes)["score"] == "array<bigint>" and set(coded.columns) == set(odd_documents.columns)


SCORES = unigram.rank_scores(unigram.read_pieces(public_tokenizers.path("piece_bpe_32k.model")))


def best(model, word):
    """Brute force: the best (score, fewest tokens) over all segmentations, by plain recursion on prefixes."""
    found = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = []
        for start in range(end):
            score = model.scores.get(word[start:end])
            if score is not None:
                options.append((found[start][0] + score, -found[start][1] - 1))
        c = word[end - 1]
        if c not in model.scores:
            options.append((found[end - 1][0] + sum(model.byte_score[b] for b in c.encode()), -found[end - 1][1] - len(c.encode())))
        top = max(options)
        found.append((top[0], -top[1]))
    return found[-1]


def test_unigram_counts_match_brute_force(documents):
    model = unigram.TrieUnigram(SCORES)
    texts = [t or "" for t in documents.text][:60]
    for text, (pre, tokens, score) in zip(texts, model.count_many(texts), strict=True):
        words = unigram.words_of(text)
        each = [best(model, unigram.MARK + w) for w in words]
        assert pre == len(words) and tokens == sum(n for _, n in each)
        assert score == pytest.approx(sum(s for s, _ in each))


def test_unigram_odd_rows(spark, odd_documents, no_documents):
    rows = {r["doc_id"]: r for r in unigram.count_tokens(odd_documents, SCORES).collect()}
    assert rows[1]["n_tokens"] == rows[2]["n_tokens"] == rows[3]["n_tokens"] == 0 and rows[1]["log_prob"] == 0
    assert unigram.count_tokens(no_documents, SCORES).count() == 0
