"""Ordering and cutting of ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: decimals at which scores of different engines and summation orders agree
SCORE_DECIMALS = 6


def top_k(scored: DataFrame, k: int | None, by: Sequence[str] = ("query_id",),
          order: Sequence | None = None) -> DataFrame:
    """Rank rows within each key and keep the first ``k``.

    The default order is rounded score descending, then item id. The cut is
    pushed below the shuffle, so each task hands on at most ``k`` rows per key.
    """
    order = order or [F.desc("score"), F.asc("item_id")]
    ranked = scored.withColumn("rank", F.row_number().over(
        Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k) if k else ranked


def truncate(ranked: DataFrame, k: int) -> DataFrame:
    """First ``k`` rows of every list."""
    return ranked.filter(F.col("rank") <= k)


def rank_score(ranked: DataFrame) -> DataFrame:
    """Replace the score by the reciprocal of the rank."""
    return ranked.withColumn("score", 1 / F.col("rank"))


def dedupe(ranked: DataFrame, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Keep the first occurrence of each item and close the gaps in the ranks; rows are dealt by list once for both."""
    first = ranked.repartition(*by).groupBy(*by, "item_id").agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", F.row_number().over(
        Window.partitionBy(*by).orderBy("rank")))


#: cells of a score matrix that are worked on at a time: a product of fewer rows takes longer for each
SLICE_CELLS = 1 << 22


#: tasks that a few rows are spread over, on any cluster: blocks, and with them sums, follow from the data alone
SPREAD = 16


def slice_rows(columns: int) -> int:
    """Rows of a score matrix with so many columns to compute at a time."""
    return max(1, SLICE_CELLS // max(1, columns))


def reached(scores: np.ndarray, k: int) -> np.ndarray:
    """A score that at least ``k`` columns of each row reach, close to that of the ``k``-th best."""
    wide = 16 * k
    if scores.shape[1] >= 2 * wide:
        best = scores[:, :wide].copy()
        for at in range(wide, scores.shape[1] - wide + 1, wide):
            np.maximum(best, scores[:, at:at + wide], out=best)
        scores = best
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
