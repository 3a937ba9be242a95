"""Operator 11. License scans by diagonal voting, with DataFrame functions only.

Every word k-gram of a text is hashed (cyclic polynomial over word hashes) and joined to the
places of the templates' k-grams. A hit at word p of the text and word q of a template votes for
the diagonal p - q. A verbatim copy puts all its votes on one diagonal; a word put in or left out
moves the rest to a neighbouring one, so the votes of diagonals at most ``slack`` apart are merged.
A merged span is verified by words: the words of each hit are compared, the span must hold the
template's telling phrase whole, and its hits must cover most of the template's words. A base
phrase is a place where one diagonal has all the phrase's k-grams, which is the phrase word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import col, fresh, others, same_rows

#: A run of digits, a-z and characters beyond ASCII, in a text whose A-Z are in lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
#: Share of a template's words that a span must cover, and words that may come in or go missing on the way.
COVERED, SLACK = 0.8, 4
#: Templates beyond so many k-grams are not broadcast.
MOST_GRAMS = 200_000
#: Parts of a group of equal texts when results meet their documents.
SALTS = 8

#: (phrase, label), fixed values.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

#: (label, telling phrase, text of a notice), public license notices.
TEMPLATES = [
    (
        "mit",
        "permission is hereby granted free of charge",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    ("mit", "the mit license", "this software is released under the terms of the MIT License"),
    (
        "apache-2",
        "the apache license version 2",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    ("apache-2", "the apache license version 2", "this work is licensed under the Apache License, version 2"),
    ("gpl-3", "public license version 3", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl-3",
        "either version 3 of the license",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version",
    ),
    ("gpl-2", "public license version 2", "This work is licensed under the GNU General Public License, version 2"),
    (
        "gpl-2",
        "either version 2 of the license",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
        "either version 2 of the License, or (at your option) any later version",
    ),
    (
        "bsd",
        "redistributions of source code must retain",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ),
    ("isc", "permission to use copy modify and or distribute this software", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "the mozilla public license v 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "attribution noncommercial 4 0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("unlicense", "released into the public domain", "This is free and unencumbered software released into the public domain"),
]


_LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case; a null text has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    """Number of words; the case of letters makes no difference to it."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")).cast("bigint")


def _turned(x: Column, bits: int) -> Column:
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits)) if bits else x


def grams(hashes: Column, k: int) -> Column:
    """The rolling hash at each word: its k word hashes, turned by their place and joined by exclusive or."""
    n = F.size(hashes)
    at = lambda i: reduce(lambda a, b: a.bitwiseXOR(b), [_turned(F.get(hashes, i + j), k - 1 - j) for j in range(k)])
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), at)).otherwise(F.array().cast("array<bigint>"))


def _hashed(rows: DataFrame, text: Column, k: int) -> DataFrame:
    """Add words and grams, each computed once."""
    return rows.withColumn("words", words_of(text)).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("grams", grams(F.col("hashes"), k)).drop("hashes")


def template_grams(spark: SparkSession, phrases: Iterable[tuple[str, str]], templates: Iterable[tuple[str, str, str]], k: int = K) -> DataFrame:
    """One row for each k-gram of a phrase or template: no, label, base, m (words), must (places), q (place), said (its words), gram."""
    cut = lambda s: re.findall(WORD, s.translate(_LOWER))
    listed = [(label, True, cut(phrase), cut(phrase)) for phrase, label in phrases] + [(label, False, cut(must), cut(text)) for label, must, text in templates]
    rows = []
    for no, (label, base, told, words) in enumerate(listed):
        at = next((i for i in range(len(words)) if words[i : i + len(told)] == told), None)
        if len(told) < k or at is None:
            raise ValueError(f"a phrase needs {k} words, and a template must hold its telling phrase: {label}, {' '.join(told)}")
        must = list(range(at, at + len(told) - k + 1))
        rows += [(no, label, base, len(words), must, q, words[q : q + k]) for q in range(len(words) - k + 1)]
    known = spark.createDataFrame(rows, "no int, label string, base boolean, m int, must array<int>, q int, said array<string>")
    return known.withColumn("gram", reduce(lambda a, b: a.bitwiseXOR(b), [_turned(F.xxhash64(F.get("said", F.lit(j))), k - 1 - j) for j in range(k)]))


def scan_licenses(docs: DataFrame, text: str = "text", phrases: Iterable[tuple[str, str]] = PHRASES, templates: Iterable[tuple[str, str, str]] = TEMPLATES, k: int = K, covered: float = COVERED, slack: int = SLACK) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and spans to ``docs``.

    n_base: places where a phrase stands word by word; first_word and last_word: their smallest and
    largest start, null without one; base_labels and labels (those of verified spans too): distinct,
    sorted, joined by commas, empty without one; score: the largest share of a template's words that
    a span covers, 1 for a base place; spans: label, first and last word and share of each verified span.

    All rows stay; columns of these names are replaced. A null text counts as empty. A text is scanned
    whole, whatever its length, and its votes are summed before they are moved, so texts that many
    documents share cost one row for each task. Repeated rows get equal results; an empty table gives none.
    """
    spark = docs.sparkSession
    known = template_grams(spark, phrases, templates, k)
    sent = sum(len(t[-1]) for t in templates) + sum(len(p[0]) for p in phrases) < MOST_GRAMS  # a k-gram takes two characters at least
    plain = docs.select(same_rows(docs, text).alias("key"), col(text).alias("text"))
    # the outer form: else a filter on the grams would be pushed below them, and compute words and hashes anew for each
    exploded = _hashed(plain, F.col("text"), k).select("key", "words", F.posexplode_outer("grams").alias("p", "gram"))
    hits = exploded.join(F.broadcast(known) if sent else known, "gram").filter(F.slice("words", F.col("p") + 1, k) == F.col("said"))
    # votes: the places of a template that one diagonal meets
    about = ["key", "no", "label", "base", "m", "must"]
    votes = hits.select(*about, (F.col("p") - F.col("q")).alias("diagonal"), "q").distinct().groupBy(*about, "diagonal").agg(F.collect_list("q").alias("met"))
    near = Window.partitionBy("key", "no").orderBy("diagonal").rangeBetween(0, slack)
    whole = F.size("met") == F.col("m") - k + 1
    merged = votes.select(
        "key", "label", "no", "base", "m", "must", "diagonal", whole.alias("whole"),
        F.array_distinct(F.flatten(F.collect_list("met").over(near))).alias("met"),
        F.min(F.col("diagonal") + F.array_min("met")).over(near).alias("first"),
        (F.max(F.col("diagonal") + F.array_max("met")).over(near) + (k - 1)).alias("last"),
    )
    share = F.size(F.array_distinct(F.flatten(F.transform("met", lambda q: F.sequence(q, q + (k - 1)))))) / F.col("m")
    judged = merged.withColumn("share", F.when(F.col("base"), F.col("whole").cast("double")).otherwise(share))
    judged = judged.withColumn("place", F.col("base") & F.col("whole")).withColumn("verified", ~F.col("base") & (F.col("share") >= covered) & (F.size(F.array_except("must", "met")) == 0))
    # verified windows that begin on neighbouring diagonals are one span
    order = Window.partitionBy("key", "no", "verified").orderBy("diagonal")
    judged = judged.withColumn("new", (F.col("diagonal") - F.lag("diagonal", 1, -(1 << 30)).over(order) > slack).cast("int"))
    judged = judged.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = judged.groupBy("key", "label", "no", "verified", "span").agg(
        F.count_if("place").alias("n_base"), F.min(F.when(F.col("place"), F.col("diagonal"))).alias("first_word"), F.max(F.when(F.col("place"), F.col("diagonal"))).alias("last_word"),
        F.min("first").alias("first"), F.max("last").alias("last"), F.max("share").alias("share"),
    )
    names = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    span = F.struct("label", F.col("first").cast("bigint").alias("first_word"), F.col("last").cast("bigint").alias("last_word"), "share")
    found = spans.groupBy("key").agg(
        F.sum("n_base").alias("n_base"), F.min("first_word").cast("bigint").alias("first_word"), F.max("last_word").cast("bigint").alias("last_word"),
        names(F.col("n_base") > 0).alias("base_labels"), names((F.col("n_base") > 0) | F.col("verified")).alias("labels"), F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("verified"), span))).alias("spans"),
    )
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    keep = others(docs, *made)
    key, salt = fresh(docs, "text_key", "salt")
    salted = found.select(F.col("key").alias(key), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt), *made[1:])
    whose = F.pmod(same_rows(docs)["y"], F.lit(SALTS)).cast("int")
    rows = docs.select(*map(col, keep), n_words(col(text)).alias("n_words"), same_rows(docs, text).alias(key), whose.alias(salt))
    joined = rows.join(salted, [key, salt], "left")
    without = {"n_base": F.lit(0).cast("bigint"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0), "spans": F.array().cast(found.schema["spans"].dataType)}
    return joined.select(*map(col, keep), "n_words", *[F.coalesce(F.col(c), without[c]).alias(c) if c in without else F.col(c) for c in made[1:]])
