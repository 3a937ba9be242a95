"""Operator 9. Token counts under a unigram model, by dynamic programming over a trie.

The best segmentation of a pre-token is the one with the highest sum of piece scores. The
forward score of a prefix (its best segmentation) depends on the prefix alone, so distinct
pre-tokens go into a trie, held in sorted form: sorted words are the leaves of a depth-first
traversal, the path to the word before is kept, and forward scores are computed once for a
shared prefix. Each word's terminal count is stored for all its places.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterable

from pyspark.sql import DataFrame

from lodestar.llm.common import col, fresh, map_rows, others, words_of

#: Stands before the first character of every pre-token.
MARK = "▁"
KNOWN_WORDS = 500_000


def rank_scores(pieces: list[str]) -> dict[str, float]:
    """Log probabilities by Zipf's law from the order of the vocabulary: p(rank r) = 1 / (r * H)."""
    total = math.log(math.fsum(1 / r for r in range(1, len(pieces) + 1)))
    return {p: -math.log(r) - total for r, p in enumerate(pieces, 1)}


def read_pieces(path: str) -> list[str]:
    """The ordinary and byte pieces of a sentencepiece model, in the order of their ids."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]


class TrieUnigram:
    """Counts tokens of pre-tokens; characters outside the vocabulary cost one byte piece for each byte."""

    def __init__(self, scores: dict[str, float]):
        self.byte_score = [scores.get(f"<0x{b:02X}>") for b in range(256)]
        if None in self.byte_score:
            raise ValueError("the vocabulary lacks byte pieces")
        self.scores = {p: s for p, s in scores.items() if not (len(p) == 6 and p.startswith("<0x"))}
        self.longest: dict[str, int] = {}  # by last character
        for p in self.scores:
            self.longest[p[-1]] = max(self.longest.get(p[-1], 0), len(p))
        self.known: dict[str, tuple[int, float]] = {}

    def count_distinct(self, words: Iterable[str]) -> dict[str, tuple[int, float]]:
        """(tokens, score) of each distinct word; of equal scores the segmentation with fewer tokens counts."""
        scores, longest = self.scores, self.longest
        out: dict[str, tuple[int, float]] = {}
        best, count = [0.0], [0]  # of each prefix on the path
        before = ""
        for word in sorted(words):
            n, shared = len(word), 0
            most = min(n, len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :]
            del count[shared + 1 :]
            for end in range(shared + 1, n + 1):
                c = word[end - 1]
                top, least = -math.inf, 0
                for start in range(max(0, end - longest.get(c, 0)), end):
                    s = scores.get(word[start:end])
                    if s is not None:
                        s += best[start]
                        if s > top or (s == top and count[start] + 1 < least):
                            top, least = s, count[start] + 1
                if c not in scores:
                    spelt = c.encode()
                    s = best[end - 1] + sum(self.byte_score[b] for b in spelt)
                    if s > top:
                        top, least = s, count[end - 1] + len(spelt)
                best.append(top)
                count.append(least)
            out[word] = (count[n], best[n])
            before = word
        return out

    def count_many(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """(pre-tokens, tokens, score) of whole texts."""
        cut = [words_of(t) for t in texts]
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known = self.known
        fresh = {MARK + w: w for words in cut for w in words if w not in known}
        for marked, found in self.count_distinct(fresh).items():
            known[fresh[marked]] = found
        out = []
        for words in cut:
            each = [known[w] for w in words]
            out.append((len(words), sum(n for n, _ in each), math.fsum(s for _, s in each)))
        return out


_LOADED: dict[str, TrieUnigram] = {}


def counter(spec: str) -> TrieUnigram:
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = TrieUnigram(json.loads(spec))
    return _LOADED[key]


def count_tokens(docs: DataFrame, scores: dict[str, float], text: str = "text") -> DataFrame:
    """Add n_pretokens, n_tokens and log_prob to ``docs`` without its text column.

    ``scores``: log probability of each piece of a public vocabulary (of fixed size), with the
    256 byte pieces. Pre-tokens are words with a mark before them. A null, empty or wordless
    text has no tokens and log_prob 0. Rows stand alone: repeated rows, ties and empty tables
    need no special case; columns of ``docs`` with a result's name are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(json.dumps(scores))
    made = ["n_pretokens", "n_tokens", "log_prob"]
    keep = others(docs, text, *made)
    (read,) = fresh(docs, "text_read")

    def make():
        model = counter(sent.value)

        def step(cols):
            found = model.count_many([t or "" for t in cols[read]])
            return {c: [x[i] for x in found] for i, c in enumerate(made)}

        return step

    return map_rows(docs.select(*map(col, keep), col(text).alias(read)), make, "n_pretokens bigint, n_tokens bigint, log_prob double", keep)
