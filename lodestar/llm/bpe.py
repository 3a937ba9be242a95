"""Operator 3. BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of a prefix is fixed by its last token: the encoding of ``p`` is the encoding
of ``p`` without its last token, followed by that token. So every trie node needs one state,
the last token of its prefix, and the whole encoding is read off by walking back. A token
``t`` that is a suffix of ``p`` is the last one exactly if BPE would keep the boundary
between ``t`` and the last token before it.

Distinct pre-tokens are put into a trie held in sorted form: in sorted order the words are
the leaves of a depth-first traversal, the shared prefix with the word before is the path
that stays on the stack, and only the states below it are computed.

Vocabularies must give every merge the next free id (merge order = id order), which the
constructor checks. Memory: one batch of documents and a bounded table of known words.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import col, fresh, map_rows, others

#: Pre-token pattern of byte-level BPE (fixed values); the alternatives exclude each other but for the last two.
PRE_TOKEN = r" ?\p{L}+| ?\p{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose encodings a Python worker keeps; beyond it the table starts anew.
KNOWN_WORDS = 500_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBPE:
    """Encoder and decoder over one byte-level BPE vocabulary (the text of its tokenizer.json)."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        if j.get("normalizer") or (j.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or j["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level vocabularies without a normalizer or a prefix space are supported")
        symbols, vocab = byte_symbols(), j["model"]["vocab"]
        spelt = lambda s: bytes(symbols[c] for c in s)
        self.bytes_of = {i: spelt(s) for s, i in vocab.items() if all(c in symbols for c in s)}
        self.id_of: dict[bytes, int] = {b: i for i, b in self.bytes_of.items() if len(b) == 1}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        below = -1
        for merge in j["model"]["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            i = vocab[a + b]
            if i <= below:
                raise ValueError("merge order and id order differ")
            below = i
            self.parts[i] = (vocab[a], vocab[b])
            self.merged[vocab[a], vocab[b]] = i
            self.id_of[spelt(a + b)] = i
        self.special = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in j.get("added_tokens", [])):
            raise ValueError("added tokens that strip, need whole words or are normalized are not supported")
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self._link_suffixes()
        self.pre_tokens = regex.compile(PRE_TOKEN).findall
        self.kept: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}  # by pre-token
        self.heads: dict[str, bytes] = {}  # by the first chunk of a line
        self.tails: dict[str, bytes] = {}  # by a later chunk of a line, without the space before it

    def _link_suffixes(self) -> None:
        """The tokens that end at a position, longest first, by one automaton step for each byte."""
        step: dict[int, int] = {}  # state << 8 | byte
        token, fail, above = [-1], [0], [(0, 0)]
        where: dict[int, int] = {}
        for spelt, i in self.id_of.items():
            at = 0
            for b in spelt:
                nxt = step.get(at << 8 | b)
                if nxt is None:
                    nxt = step[at << 8 | b] = len(token)
                    token.append(-1)
                    fail.append(0)
                    above.append((at, b))
                at = nxt
            token[at] = where_id = i
            where[where_id] = at
        depth = [0] * len(token)
        for s in range(1, len(token)):
            depth[s] = depth[above[s][0]] + 1
        for s in sorted(range(1, len(token)), key=depth.__getitem__):
            up, b = above[s]
            if up:
                f = fail[up]
                while (nxt := step.get(f << 8 | b)) is None:
                    f = fail[f]
                fail[s] = nxt
        # the longest token that is a suffix of each state, and each token's longest proper suffix that is a token
        for s in sorted(range(1, len(token)), key=depth.__getitem__):
            if token[s] < 0:
                token[s] = token[fail[s]]
        self.step, self.fail, self.token = step, fail, token
        self.shorter = {i: token[fail[s]] for i, s in where.items()}
        self.length = {i: len(b) for i, b in self.bytes_of.items()}

    def keeps(self, left: int, right: int) -> bool:
        """Whether BPE on the joined bytes of two tokens gives just these two tokens.

        Undo the merges of both sides in reverse order, the younger first, and see whether a
        merge over the boundary would have come before the one that was undone.
        """
        key = left << 32 | right
        if (known := self.kept.get(key)) is not None:
            return known
        before, a, b = 1 << 62, left, right
        while True:
            over = self.merged.get((a, b))
            if over is not None and over < before:
                answer = False
                break
            cut_a, cut_b = self.parts.get(a), self.parts.get(b)
            if cut_a is None and cut_b is None:
                answer = True
                break
            # of the two sides' last merges the later one is undone; on a tie the right one, as BPE merges from the left
            if cut_b is None or (cut_a is not None and a > b):
                before, a = a, cut_a[1]
            else:
                before, b = b + 1, cut_b[0]
        if len(self.kept) > 2_000_000:
            self.kept.clear()
        self.kept[key] = answer
        return answer

    def encode_distinct(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Each distinct word's ids, as little-endian unsigned 32-bit integers."""
        step, fail, token, shorter, length, keeps, kept = self.step, self.fail, self.token, self.shorter, self.length, self.keeps, self.kept
        out: dict[bytes, bytes] = {}
        path: list[int] = []  # last token of each prefix of the word before
        states = [0]  # of the suffix automaton after each prefix
        before = b""
        for word in sorted(words):
            n, shared = len(word), 0
            most = min(n, len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del path[shared:]
            del states[shared + 1 :]
            state = states[shared]
            for end in range(shared, n):
                byte = word[end]
                while (at := step.get(state << 8 | byte)) is None:
                    state = fail[state]
                states.append(state := at)
                t = token[state]
                while True:
                    start = end - length[t]
                    if start < 0:  # the token is the whole prefix
                        break
                    left = path[start]
                    good = kept.get(left << 32 | t)
                    if keeps(left, t) if good is None else good:
                        break
                    t = shorter[t]
                path.append(t)
            ids, end = array("I"), n
            while end:
                ids.append(t := path[end - 1])
                end -= length[t]
            ids.reverse()
            out[word] = ids.tobytes()
            before = word
        return out

    def _code(self, pieces: dict[str, str]) -> dict[str, bytes]:
        """The ids of pieces of text, by key; new pre-tokens go through the trie once."""
        cut = {k: self.pre_tokens(p) for k, p in pieces.items()}
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        spelt = {w: w.encode() for pre in cut.values() for w in pre if w not in known}
        coded = self.encode_distinct(spelt.values())
        for w, b in spelt.items():
            known[w] = coded[b]
        get = known.__getitem__
        return {k: b"".join(map(get, pre)) for k, pre in cut.items()}

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, as little-endian unsigned 32-bit integers.

        A single space or newline between two characters that are not white space separates
        chunks whose pre-tokens don't depend on each other, so a chunk is coded once for all its
        places. Texts with other white space at the edge of a chunk are cut by the pattern as a whole.
        """
        heads, tails, special = self.heads, self.tails, self.special
        if max(len(heads), len(tails)) > KNOWN_WORDS:
            heads.clear()
            tails.clear()
        parts = [[p for p in self.split_special(t) if p] if special and any(s in t for s in special) else [t] if t else [] for t in texts]
        lines = {p: [line.split(" ") for line in p.split("\n")] for some in parts for p in some if p not in special}
        new_heads: set[str] = set()
        new_tails: set[str] = set()
        for some in lines.values():
            for chunks in some:
                new_heads.add(chunks[0])
                new_tails.update(chunks[1:])
        new_heads = {c for c in new_heads if c not in heads}
        new_tails = {c for c in new_tails if c not in tails}
        odd = {c for c in new_heads | new_tails if not c or c != c.strip()}
        heads |= self._code({c: c for c in new_heads - odd})
        tails |= self._code({c: " " + c for c in new_tails - odd})
        head, tail, newline = heads.__getitem__, tails.__getitem__, self._code({"": "\n"})[""]
        coded: dict[str, bytes] = {p: i.to_bytes(4, "little") for p, i in special.items()}
        whole: dict[str, str] = {}
        for p, some in lines.items():
            try:
                coded[p] = newline.join([head(chunks[0]) + b"".join(map(tail, chunks[1:])) for chunks in some])
            except KeyError:  # a chunk is empty or has white space at its edge
                whole[p] = p
        coded |= self._code(whole)
        return [b"".join([coded[p] for p in some]) for some in parts]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids))).decode("utf-8", "replace")


#: One encoder for each vocabulary in a Python worker, kept over tasks.
_LOADED: dict[str, TrieBPE] = {}


def encoder(spec: str) -> TrieBPE:
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = TrieBPE(spec)
    return _LOADED[key]


def bpe_encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str | None = None, digests: bool = False) -> DataFrame:
    """Add ``ids`` (array<int>) and, if named, ``decoded`` (string) to ``docs``; keep all its columns.

    ``vocabulary``: path of a tokenizer.json that the driver reads; its text (a file of fixed
    size) is sent to the tasks. Matches the public library with ``add_special_tokens=False``
    and without truncation or padding. With ``digests`` the two results are given instead as
    n_tokens, ids_sha256 and decoded_sha256, so that whole id lists need not leave the task.

    A null text counts as empty: no ids. Empty and very long texts, repeated rows and empty
    tables need no special case. A column of ``docs`` that has the name of a result is replaced,
    others may have any names. Each row depends on its own text only, so nothing is shuffled.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())
    made = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"} if digests else {ids: "array<bigint>", **({decoded: "string"} if decoded else {})}
    keep = others(docs, *made)
    (read,) = fresh(docs, "text_read")

    def make():
        bpe = encoder(sent.value)

        def step(cols):
            coded = bpe.encode_many([t or "" for t in cols[read]])
            if digests:
                return {"n_tokens": [len(c) // 4 for c in coded], "ids_sha256": [hashlib.sha256(c).hexdigest() for c in coded], "decoded_sha256": [hashlib.sha256(bpe.decode(c).encode()).hexdigest() for c in coded]}
            return {ids: [array("I", c).tolist() for c in coded]} | ({decoded: [bpe.decode(c) for c in coded]} if decoded else {})

        return step

    return map_rows(docs.select(*map(col, keep), col(text).alias(read)), make, ", ".join(f"`{n}` {t}" for n, t in made.items()), keep, 200)


def bpe_decode(tokens: DataFrame, vocabulary: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add ``text``, the decoding of the id lists in ``ids``; a null list decodes to the empty string.

    Bytes that are not UTF-8 become U+FFFD; an id outside the vocabulary is an error. Empty
    lists, repeated rows and empty tables need no special case; a column named ``text`` is replaced.
    """
    with open(vocabulary, encoding="utf-8") as f:
        sent = tokens.sparkSession.sparkContext.broadcast(f.read())
    keep = others(tokens, text)
    (read,) = fresh(tokens, "ids_read")

    def make():
        bpe = encoder(sent.value)
        return lambda cols: {text: [bpe.decode(array("I", x or []).tobytes()) for x in cols[read]]}

    return map_rows(tokens.select(*map(col, keep), col(ids).alias(read)), make, f"`{text}` string", keep)
