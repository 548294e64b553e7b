"""A corpus pipeline of five of the training-data operators, in the order in which they thin the documents.

Every stage takes all documents that the one before kept and, but for the last, gives back
documents with the same columns. The last gives the token digests of the documents left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rankflow.llm import bpe_codec, decontaminate, line_dedup, quality_rules, simhash
from rankflow.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy keeps."""
    return quality_rules.screen(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line runs that repeat earlier ones; ``n_chars`` follows the text."""
    return line_dedup.deduplicate(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return simhash.deduplicate(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every document left."""
    return bpe_codec.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("simhash", near_duplicate_stage),
          ("decontaminate", benchmark_stage), ("bpe_codec", token_stage)]
#: SQL can state neither XXH64 fingerprints nor the merges; ``tests/llm`` holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
