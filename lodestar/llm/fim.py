"""Operator 12. Fill-in-the-middle transformation by bit-parallel big integers.

A text is held as UTF-8 bytes. ``bytes.translate`` turns each byte into the digit of its class,
the digits become one big integer (bit i belongs to byte i), and boolean operations on it and
on its shifted self mark where units begin. ``int.bit_count`` gives the number of units, and the
byte offset of a unit of given rank is found by halving the integer: the set bits of the lower
half tell in which half the unit lies. Every step is linear in the text and touches 30 bits at once.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import col, fresh, map_rows, others

SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix, middle
#: Per cent of texts left as they are, and per cent of the others that begin with the suffix.
PLAIN, SPM = 10, 20

#: Digit of each byte: "1" for those that a unit is told by.
_CLASS = {
    "char": bytes(48 if 0x80 <= b < 0xC0 else 49 for b in range(256)),  # bytes that begin a code point
    "word": bytes(48 if b in b" \t\n\v\f\r" else 49 for b in range(256)),  # bytes of words
    "line": bytes(49 if b == 10 else 48 for b in range(256)),  # line ends
}


def class_mask(data: bytes, table: bytes) -> int:
    """Bit i says whether byte i is of the class whose digits ``table`` holds."""
    return int(data.translate(table)[::-1], 2) if data else 0


def starts(data: bytes, unit: str = "char") -> int:
    """Bit i is set if a unit (code point, word or line) begins at byte i."""
    mask = class_mask(data, _CLASS[unit])
    if unit == "word":
        return mask & ~(mask << 1)
    if unit == "line":
        return ((mask << 1) | 1) & ((1 << len(data)) - 1)
    return mask


def ranked_bit(mask: int, rank: int, width: int) -> int:
    """Place of the set bit that has ``rank`` set bits below it, of ``width`` bits."""
    if width == 1:
        return 0
    half = width >> 1
    low = mask & ((1 << half) - 1)
    below = low.bit_count()
    if rank < below:
        return ranked_bit(low, rank, half)
    return half + ranked_bit(mask >> half, rank - below, width - half)


def offset(mask: int, units: int, n: int, width: int) -> int:
    """Byte offset behind the first ``units`` of ``n`` units; what stands between two goes with the one before."""
    return 0 if units == 0 else width if units == n else ranked_bit(mask, units, width)


def transform(data: bytes, draws: Sequence[int], unit: str, plain: int, spm: int, marks: Sequence[bytes]) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, units of the prefix, units of the middle, output) of one text."""
    mask = starts(data, unit)
    n = mask.bit_count()
    if n == 0 or draws[2] % 100 >= 100 - plain or any(m in data for m in marks):
        return n, "plain", None, None, data
    first, second = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = offset(mask, first, n, len(data)), offset(mask, second, n, len(data))
    before, behind = marks[0] + data[:a], marks[1] + data[b:]
    form = "spm" if draws[3] % 100 < spm else "psm"
    return n, form, first, second - first, (behind + before if form == "spm" else before + behind) + marks[2] + data[a:b]


def check_sentinels(marks: Sequence[str]) -> None:
    """No end of a sentinel may be the beginning of one, else a cut could read wrongly."""
    if len(set(marks)) != 3 or not all(marks) or any(x in y for x in marks for y in marks if x != y):
        raise ValueError("three sentinels are needed, none within another")
    if any(y.startswith(x[i:]) for x in marks for y in marks for i in range(1, len(x))):
        raise ValueError("no end of a sentinel may be the beginning of a sentinel")


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "char", seed: int = 1, plain: int = PLAIN, spm: int = SPM, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """The documents with their text as a fill-in-the-middle example.

    ``output`` takes the place of ``text``, and n (units of the text: code points, words or
    lines), form (plain, psm or spm), prefix_units and middle_units (null if plain) are added;
    columns of these names are replaced, others of any name stay. ``restore`` undoes it.

    The draws come from the sha256 of seed and id, so they agree between runs and partitionings;
    a null id counts as an empty one. A null text counts as empty; empty texts, texts without a
    unit and texts that hold a sentinel are plain. Repeated rows are cut alike, an empty table
    gives none. Texts of any length go through whole, in memory of about four times their bytes.
    """
    check_sentinels(sentinels)
    if unit not in _CLASS:
        raise ValueError(f"a unit is one of {', '.join(_CLASS)}")
    made = ["output", "n", "form", "prefix_units", "middle_units"]
    keep = others(docs, text, *made)
    data, digest = fresh(docs, "data_read", "digest_read")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(col(doc_id).cast("string"), F.lit(""))), 256)
    read = docs.select(*map(col, keep), F.coalesce(col(text).cast("binary"), F.lit(b"")).alias(data), F.substring(hashed, 1, 32).alias(digest))
    marks = [m.encode() for m in sentinels]

    def make():
        def step(cols):
            draws = ([int(h[i : i + 8], 16) for i in (0, 8, 16, 24)] for h in cols[digest])
            found = [transform(d, x, unit, plain, spm, marks) for d, x in zip(cols[data], draws, strict=True)]
            return dict(zip(("n", "form", "prefix_units", "middle_units", "output"), map(list, zip(*found, strict=True)), strict=True))

        return step

    out = map_rows(read, make, "n bigint, form string, prefix_units bigint, middle_units bigint, output binary", keep, chunk=100)
    return out.withColumn("output", F.col("output").cast("string"))


def restore(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The exact text, from output and form alone."""
    parts = F.split(output, "|".join(map(re.escape, sentinels)))
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)
