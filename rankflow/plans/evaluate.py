"""Offline evaluation and judging of prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.functions import replies as R
from rankflow.operators import complete as C
from rankflow.operators import metrics, render
from rankflow.operators.ranking import truncate
from rankflow.plans.recommend import turn_key
from rankflow.session import materialize
from rankflow.sources.tables import unpack_predictions


def evaluate(predictions: DataFrame, truth: DataFrame, all_turns: bool = False,
             k: int = 20, bucket_texts: int | None = None) -> DataFrame:
    """(mode, ndcg20, lexdiv, n) of predictions against (session_id, turn_number, truth).

    All pairs of responses are compared, or with ``bucket_texts`` those that share a bucket of about so many.
    """
    rows = predictions if all_turns else metrics.last_turn_only(predictions)
    # written once: both metrics and the number of texts read it
    scored = materialize(metrics.ndcg_single(rows, truth, k).select("session_id", "turn_number", "predicted_response", "ndcg"), "scored")
    judged = scored.filter(F.col("ndcg").isNotNull()).withColumn(
        "key", F.concat_ws("/", F.col("session_id").cast("string"), F.col("turn_number").cast("string")))
    diversity = metrics.lexical_diversity(judged, "key", "predicted_response", bucket_texts)
    return metrics.metric_record(metrics.ndcg_mean(scored), diversity, all_turns)


def judge_prompts(predictions: DataFrame, turns: DataFrame, catalog: DataFrame, template: str,
                  conversation_style: str = "judge", candidate_style: str = "bullet",
                  shown: int = 5) -> DataFrame:
    """(session_id, turn_number, prompt) for every prediction whose session is known, with its own tracks and what was
    said up to its turn.

    ``template`` has places ``{conversation}``, ``{response}`` and ``{tracks}``. The predictions are written first, as
    conversations, tracks and responses each start from them.
    """
    predictions = materialize(predictions.select("session_id", "turn_number", "predicted_track_ids", "predicted_response"), "predictions")
    conversations = render.render_upto(turns, predictions, conversation_style)
    ranked = truncate(unpack_predictions(predictions), shown).select(
        turn_key().alias("query_id"), F.col("track_id").alias("item_id"), "rank")
    tracks = render.render_candidates(ranked, catalog, candidate_style)
    rows = (predictions.select("session_id", "turn_number", turn_key().alias("query_id"), "predicted_response")
            .join(tracks, "query_id", "left").join(conversations, ["session_id", "turn_number"]))
    return rows.select("session_id", "turn_number", render.fill_prompt(
        template, conversation=F.col("conversation"), response=F.col("predicted_response"),
        tracks=F.col("candidates")).alias("prompt"))


def score_predictions(prompts: DataFrame, completer: C.Completer, **options) -> DataFrame:
    """The keys of ``prompts`` and (personalization, explanation, reasoning); nulls where judging failed."""
    keys = [c for c in ("session_id", "turn_number") if c in prompts.columns]
    answered = C.complete(prompts, completer, **options)
    parsed = answered.withColumn("s", R.parse_scores(F.col("reply")))
    return parsed.select(
        *keys, "s.personalization", "s.explanation",
        F.coalesce("s.reasoning", F.when(F.col("reply").isNull(), "no reply")
                   .otherwise("parse error")).alias("reasoning"))
