"""From raw documents to token ids: quality rules, near-dedup, substring dedup, mixing, BPE.

``run(spark, sf_dir)`` applies STAGES to the table documents. Each stage is written as Parquet
to the shared folder and read again as the documents of the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.bpe import bpe_encode
from lodestar.llm.common import materialize, table
from lodestar.llm.mixing import mixed_documents
from lodestar.llm.quality_rules import keep_good
from lodestar.llm.simhash import drop_near_duplicates
from lodestar.llm.substring_dedup import dedup_substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base contract and the certified rules of their language keep.

    Null, empty and wordless texts are below the least number of words and go; a null language
    is a stratum, a null id has no label; repeated rows are judged alike and all stay or go. An
    empty table gives none; other columns, whatever their names, are left behind by every stage.
    """
    return keep_good(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: pairs with five-word shingles of a similarity of 0.8 or more, those that SimHash and minimum hashes propose first.

    Documents that no chain of such pairs unites all stay. The smallest id of a group stays, a null one first; rows that share id and text are one
    document. Null, empty and wordless texts are one group. Texts that tie go by a hash of the row.
    """
    return drop_near_duplicates(docs, shingle_words=5, similarity=0.8).select(COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand in another document too; every row stays.

    Null texts stay null and empty ones empty, and n_chars follows the text. Rows that share id and
    text are cut alike, null ids are ids.
    """
    return dedup_substrings(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: left out, once or twice.

    A null source is a source, the last. Null and empty texts have no words, so whether they are
    taken has no effect on the mix. Repeated rows are queued one after another.
    """
    return mixed_documents(docs).select(COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, and digests of ids and of decoded text, of each document of the mix.

    A null text counts as empty: no tokens. Every row, repeated or not, gives one row.
    """
    coded = bpe_encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"), digests=True)
    return coded.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("bpe", bpe),
]

#: SQL has no SimHash over XXH64, gear hash or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
