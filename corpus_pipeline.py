"""A training-corpus pipeline: quality, near-duplicates, repeated passages, packing.

Every stage takes the documents its predecessor kept.  ``run`` writes each stage's rows to the shared
scratch folder and reads them back, so a lost executor never costs more than the stage at hand.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from icewake.llm import best_fit_packing, quality_crf, simhash_dedup, suffix_array_dedup
from icewake.llm.common import materialise, table

ORACLE_SQL = None  # the classifier and the fingerprints are beyond SQL; tests hold them against brute force


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier does not reject."""
    return quality_crf.without_bad(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return simhash_dedup.one_of_each(docs, words=5, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that also start earlier."""
    return suffix_array_dedup.without_repeats(docs, 100)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences of at most 2048."""
    return best_fit_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_one_of_each),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k}")
    return docs
