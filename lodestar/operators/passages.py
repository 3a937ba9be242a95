"""Passages of whole texts: headings, sections, splits at sentence ends with overlap. State never leaves a document."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.sources.shipping import ship

LEAST, MOST, OVERLAP = 50, 250, 30


def is_heading(line: str) -> bool:
    """F4. Short, few words, no full stop or comma at the end, in title or upper case or marked by #."""
    short = len(line) < 80 and len(line.split()) < 12 and line[-1:] not in (".", ",")
    return short and (line.startswith("#") or line in (line.title(), line.upper()))


def sections(text: str) -> Iterator[tuple[str, str]]:
    """F4. (heading, text) of the stretches between headings; neighbours with one heading are joined."""
    heading, body = "Introduction", []
    for line in filter(None, map(str.strip, text.split("\n"))):
        if not is_heading(line):
            body.append(line)
            continue
        named = line.lstrip("#").strip()
        if body and named != heading:
            yield heading, " ".join(" ".join(body).split())
            body = []
        heading = named
    if body:
        yield heading, " ".join(" ".join(body).split())


def split_words(words: list[str], most: int = MOST) -> tuple[list[str], list[str]]:
    """F3. The first ``most`` words up to their last sentence end (if past 30 percent of them), and the rest."""
    head = " ".join(words[:most])
    end = max(head.rfind(mark) for mark in (". ", "? ", "! "))
    if end <= len(head) * 0.3:
        return words[:most], words[most:]
    return head[: end + 1].split(), head[end + 2 :].split() + words[most:]


def passages(text: str, least: int = LEAST, most: int = MOST, overlap: int = OVERLAP) -> list[tuple[str, str]]:
    """F5. (section, passage) in order: short sections are carried into the next, long ones are split with an overlap.

    A sentence end among the first ``overlap`` words splits none, as the next passage would begin where this one did.
    """
    if overlap >= most:
        raise ValueError("overlap is less than most")
    done: list[tuple[str, str]] = []
    carried: list[str] = []
    for heading, body in sections(text):
        words = carried + body.split()
        carried = []
        if len(words) < least:
            carried = words
            continue
        while len(words) > most:
            head, rest = split_words(words, most)
            if len(head) <= overlap:  # all of it would come again
                head, rest = words[:most], words[most:]
            done.append((heading, " ".join(head)))
            words = head[-overlap:] + rest
        done.append((heading, " ".join(words)))
    if carried:
        if done:
            done[-1] = (done[-1][0], done[-1][1] + " " + " ".join(carried))
        else:
            done.append(("Continuation", " ".join(carried)))
    return done


def create_passages(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """F3-F5. (key, passage_id, section, text, words) of every passage; a null or empty text has none."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<struct<passage_id:string,section:string,text:string,words:bigint>>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"passage_id": f"P{i:02d}", "section": s, "text": t, "words": len(t.split())} for i, (s, t) in enumerate(passages(x), 1)] for x in texts])

    return docs.select(key, cut(F.coalesce(F.col(text), F.lit(""))).alias("p")).select(key, F.inline("p"))


def word_shingles(text: str, k: int = 5) -> set[str]:
    words = re.findall(r"\w+", text.lower())
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()
