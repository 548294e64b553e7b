"""Repair of weak predictions: select, guard, patch, validate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.operators.judge import mean_score

#: stands in for a stored baseline score that is missing
DEFAULT_BASELINE = 3.5


def key_of(*tables: DataFrame) -> list[str]:
    """Session and, where all ``tables`` have it, turn."""
    return [c for c in ("session_id", "turn_number") if all(c in t.columns for t in tables)]


def _or_zero() -> Column:
    return F.coalesce(mean_score(), F.lit(0.0))


def targets_mean(scores: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Sessions, or turns if the scores are of turns, with a mean up to the threshold; unscored ones count as 0."""
    return scores.select(*key_of(scores), _or_zero().alias("avg")).filter(F.col("avg") <= threshold)


def targets_band(scores: DataFrame, low: float = 3.0, high: float = 3.99) -> DataFrame:
    """Sessions with a mean score in (low, high]."""
    return (scores.select(*key_of(scores), _or_zero().alias("avg"))
            .filter((F.col("avg") > low) & (F.col("avg") <= high)))


def targets_floor(scores: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Scored sessions with an explanation score up to the threshold."""
    return (scores.filter(mean_score().isNotNull() & (F.col("explanation") <= threshold))
            .select(*key_of(scores), mean_score().alias("avg"), "explanation"))


def worst_first(targets: DataFrame, by: str = "avg") -> DataFrame:
    return targets.orderBy(F.asc(by), F.asc("session_id"))


def work_rows(targets: DataFrame, predictions: DataFrame, conversations: DataFrame,
              candidates: DataFrame) -> DataFrame:
    """Targets with their prediction's response and the rendered texts, a row per turn that has a prediction.

    ``conversations`` is (session_id[, turn_number], conversation), ``candidates`` (session_id[, turn_number],
    candidates); tables meet by turn where both sides tell it, else by session. Targets without a prediction or a
    session are left out.
    """
    rows = targets.join(predictions.select(*key_of(predictions), "predicted_response"), key_of(targets, predictions))
    return rows.join(conversations, key_of(rows, conversations)).join(candidates, key_of(rows, candidates), "left")


def unmatched(targets: DataFrame, *tables: DataFrame) -> DataFrame:
    """Targets that are missing from at least one of the tables."""
    found = targets.select(*key_of(targets))
    for table in tables:
        found = found.join(table, key_of(found, table), "left_semi")
    return targets.join(found, key_of(targets), "left_anti")


def without_result(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Tasks for which no response came back."""
    return tasks.join(results, key_of(tasks, results), "left_anti")


def guard_live(rows: DataFrame, default_baseline: float = DEFAULT_BASELINE) -> DataFrame:
    """Add ``decision`` to rows with new_score, live_score and stored_score.

    A new response is patched in if it beats the live score of the old one. If
    that is missing it must beat the stored score; without a score of its own it
    is not used.
    """
    stored = F.coalesce("stored_score", F.lit(default_baseline))
    new, live = F.col("new_score"), F.col("live_score")
    decision = (
        F.when(new.isNull(), "keep_failed")
        .when(live.isNull(), F.when(new > stored, "patch_stored").otherwise("keep_failed"))
        .when(new > live, "patch").otherwise("keep"))
    return rows.withColumn("decision", decision)


def guard_strict(rows: DataFrame) -> DataFrame:
    """Add ``decision``: patch only if both scores are there and the new one is higher."""
    new, live = F.col("new_score"), F.col("live_score")
    return rows.withColumn("decision", F.when(new.isNull() | live.isNull(), "keep_failed")
                           .when(new > live, "patch").otherwise("keep"))


def cleared(guarded: DataFrame) -> DataFrame:
    """Rows whose new response goes in."""
    return guarded.filter(F.col("decision").startswith("patch"))


def patch(predictions: DataFrame, responses: DataFrame) -> DataFrame:
    """Predictions with new responses where there is one, by session and, if ``responses`` has it, turn."""
    key = key_of(predictions, responses)
    new = responses.select(*key, F.col("response").alias("_new"))
    return (predictions.join(new, key, "left")
            .withColumn("predicted_response", F.coalesce("_new", "predicted_response")).drop("_new"))


def merge_responses(predictions: DataFrame, source: DataFrame) -> DataFrame:
    """Ranked items of one run with the responses of another for the same turn; empty if it has none."""
    key = key_of(predictions, source)
    texts = source.select(*key, F.col("predicted_response").alias("_text"))
    return (predictions.drop("predicted_response").join(texts, key, "left")
            .withColumn("predicted_response", F.coalesce("_text", F.lit(""))).drop("_text"))


def validated(predictions: DataFrame, length: int = 20) -> DataFrame:
    """Predictions with flags ``has_duplicates`` and ``is_short``."""
    ids = F.col("predicted_track_ids")
    return (predictions
            .withColumn("has_duplicates", F.size(ids) != F.size(F.array_distinct(ids)))
            .withColumn("is_short", F.size(ids) < length))


def require_unique(predictions: DataFrame) -> DataFrame:
    """The predictions, failing the job on the first list that repeats an item."""
    ids = F.col("predicted_track_ids")
    return predictions.withColumn(
        "predicted_track_ids",
        F.when(F.size(ids) == F.size(F.array_distinct(ids)), ids).otherwise(
            F.raise_error(F.concat(F.lit("duplicate items in session "), F.col("session_id")))))


def counts(tasks: DataFrame, results: DataFrame, guarded: DataFrame) -> DataFrame:
    """(n_tasks, n_responses, n_patched) of a repair run."""
    n = F.count("*")
    return guarded.agg(
        tasks.select(n).scalar().alias("n_tasks"),
        results.select(n).scalar().alias("n_responses"),
        F.count_if(F.col("decision").startswith("patch")).alias("n_patched"))
