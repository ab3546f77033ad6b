"""A corpus pipeline: five stages over `documents`, each one operator of the subpackage llm.

run() writes every stage's documents as Parquet below the shared folder and reads
them again, so no stage is computed twice and lost executors cost one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablestakes.llm import bpe, decontamination, language_id, line_dedup, ngram_join
from tablestakes.llm.common import cut, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and a language that reaches the posterior limit."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that occur in an earlier document or place; those left without a word go."""
    return line_dedup.clean(docs, drop_emptied=True)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies."""
    return ngram_join.keep_first(docs)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return bpe.round_trip(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("decontamination", remove_benchmark_leaks),
    ("byte_bpe", encode),
]

# A language model's posteriors and BPE merges are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
