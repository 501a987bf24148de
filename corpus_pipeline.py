"""Documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is
written as Parquet and read again as the next stage's ``docs``. All but the
last keep the columns of ``documents``.

For every stage: null and empty texts are texts without a word, null ids are
ids like any other, nulls in other columns and columns of any name are carried
along, a very long text is read whole, and an empty table gives an empty table.
Rows that repeat one another share their fate in the first two stages and the
fourth, and one of them stays in the third.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import jaccard, ordinal, packing, pii, toxicity
from maskwright.llm.common import shared_folder, table


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject. It learns from the labelled documents that came in; without labels all stay."""
    return toxicity.keep_civil(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def sound(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a sound grade is at least one half, by a model of the labelled ones among them."""
    return ordinal.keep_sound(docs, ordinal.fit(docs, ordinal.ratings(table(spark, sf_dir, "labels"))))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (SimHash groups and MinHash bands of five-word shingles, exact Jaccard 0.8): that with the smallest id, a null id last."""
    return jaccard.keep_distinct(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with each piece of personal data replaced by its kind; null texts stay null, and ``n_chars`` follows the text."""
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, each with its place in a sequence; a null text is the end id alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", civil),
    ("quality", sound),
    ("near_duplicates", distinct),
    ("personal_data", private),
    ("packing", packed),
]

#: SQL expresses neither the models nor the fingerprints: the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them goes to the shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
