"""Components whose documents have no id, or the same one."""

from __future__ import annotations

import random

from lodestar.llm import simhash


def test_components_without_ids_keep_a_document_each(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefghij") * r.randint(2, 6) for _ in range(60)) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (None, texts[0]), (8, texts[5])]
    got = sorted(x["text"] for x in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == sorted(texts)
