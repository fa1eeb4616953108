"""The corpus pipeline: language, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import jaccard, language, packing, suffixarray
from pagemill.llm.common import materialise, small_batches


#: Near copies: no contract of its own, so five words and a similarity of 0.8 or more.
WIDTH, THRESHOLD = 5, Fraction(4, 5)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language.

    A network is trained on the labelled rows outside the held-out fold and on invented texts of no language; what it
    takes for the latter goes, and so does a null or letterless text. Whole texts of any length are judged; rows
    that repeat or share an id are judged one by one; with no labels nothing has a language, and an empty table stays empty.
    """
    small_batches(spark)
    return language.keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group linked by five-word shingles at a similarity of 0.8.

    A null or empty text links with nothing and stays; one of fewer words than five is one shingle; ids may be null or
    repeat: rows are told apart by id and text, and of equal ids the least text hash is kept; an empty table stays empty.
    """
    small_batches(spark)
    return jaccard.one_of_each(docs, width=WIDTH, threshold=THRESHOLD)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the 200-byte strings that start elsewhere too; n_chars follows the text.

    A null text becomes empty; texts under 200 bytes stay whole, those of any length are searched whole; rows that
    repeat or share an id are texts of their own and lose what they share; an empty table stays empty.
    """
    small_batches(spark)
    return suffixarray.without_repeats(docs).selectExpr("doc_id", "text", "lang", "source", "CAST(length(text) AS BIGINT) AS n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens.

    A null or empty text is the end id alone; longer texts are cut into full pieces; rows that repeat or share an id are
    packed one by one; pieces of equal length take places in any order; an empty table gives no rows.
    """
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("packing", packed),
]

#: No stage is expressible in SQL: a trained network, exact set similarity with components, and a fitted packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
