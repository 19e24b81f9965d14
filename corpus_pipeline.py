"""A training corpus from raw documents: every stage is one operator over all its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lintlake.llm import exact, language, minhash, mixing, packing
from lintlake.llm.common import documents, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one or several of the learned languages stay; those without a letter, or whose
    trigrams fit no mixture of them, go."""
    return language.keep_identified(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, that with the largest doc_id."""
    return exact.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five words, 0.8), that with the smallest doc_id."""
    return minhash.drop_near_duplicates(docs, width=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of the curriculum when written."""
    return mixing.mixed_documents(docs, share=1.5, max_repeats=2.0)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and place; a repeated document is packed as often as it was taken.

    The stage before is written in training order: sequences are numbered in it, run by run.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), spaced=False, end_id=1,
                                  capacity=4096, group=packing.read_order(docs))


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: No SQL expresses the learned languages; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
