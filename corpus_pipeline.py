"""The training-text pipeline: five operators, each on what the one before kept.

``documents`` whose language is not told go; one of each group of near copies
stays; repeated 200-byte strings are cut out; documents with benchmark windows
go; the rest is mixed to the sources' target weights. ``run`` writes each
stage as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm.common import saved, table, word_count
from cairnlake.llm.decontamination import clean_documents
from cairnlake.llm.language_id import known_language
from cairnlake.llm.mixing import mixed_blocks, plan_mix
from cairnlake.llm.ngram_join import keep_one
from cairnlake.llm.suffix_dedup import without_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return known_language(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row per slot of its shards, with the text and the doc_ids."""
    sized = docs.select("doc_id", "source", "text", word_count(F.col("text")).alias("size"))
    return mixed_blocks(plan_mix(saved(sized, "mix-sized")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
]

#: Learned models and similarity joins are beyond SQL; the tests hold the rows
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
