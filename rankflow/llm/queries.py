"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.llm import (bpe_codec, decontaminate, html_extract, line_dedup, quality_cnn, quality_rules, quote_threads,
                          secret_scan, simhash, token_counts, turn_repair, warc, whitening)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and the verdict of the production policy for every document."""
    return quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))


@query
def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the decoded text of every document."""
    return bpe_codec.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a window of a benchmark item, and the verdict."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest_match")


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of lines that repeat earlier ones."""
    return line_dedup.report(table(spark, sf_dir, "documents"))


@query
def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query
def op9_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a network trained on labels outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_cnn.classify(docs, quality_cnn.train(*quality_cnn.sample(docs, labels)))


@query
def op10_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without quotes, in reply order, with what it replies to."""
    return quote_threads.threads(table(spark, sf_dir, "conversations"))


@query
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the hash of the repaired text of every damaged conversation."""
    return turn_repair.damage_and_repair(table(spark, sf_dir, "conversations"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its capture in the archives tells it."""
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")
