"""The repair run: regenerate weak responses, keep those that score higher."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rankflow.functions.gates import GateRules, gate_reason
from rankflow.functions.text import strip
from rankflow.operators import complete as C
from rankflow.operators import repair as K
from rankflow.operators.judge import mean_score
from rankflow.operators.render import fill_prompt
from rankflow.plans.evaluate import score_predictions
from rankflow.session import materialize


@dataclass(frozen=True)
class RepairResult:
    """Patched predictions, guarded and failed work rows, and what was counted on the way."""

    predictions: DataFrame
    guarded: DataFrame
    failed: DataFrame
    counts: dict[str, int]


def regenerate(work: DataFrame, completer: C.Completer, template: str, rules: GateRules,
               max_tries: int = 3, **options) -> DataFrame:
    """Work rows with a new ``response`` that passed the gates, or null."""
    prompts = work.withColumn("prompt", fill_prompt(
        template, conversation=F.col("conversation"), tracks=F.col("candidates")))
    made = C.complete(prompts, completer, into="response", max_tries=max_tries,
                      accept=gate_reason(strip(F.col("reply")), rules).isNull(), **options).drop("prompt")
    return made.withColumn("response", strip(F.col("response")))


def live_scores(work: DataFrame, judge: C.Completer, template: str, **options) -> DataFrame:
    """Work rows with new_score and live_score: both responses judged in one pass."""
    both = F.explode(F.array(
        F.struct(F.lit("new_score").alias("which"), F.col("response").alias("text")),
        F.struct(F.lit("live_score").alias("which"), F.col("predicted_response").alias("text"))))
    key = K.key_of(work)
    rows = work.select(*key, "conversation", "candidates", both.alias("r"))
    prompts = rows.select(*key, "r.which", fill_prompt(
        template, conversation=F.col("conversation"), response=F.col("r.text"),
        tracks=F.col("candidates")).alias("prompt"))
    keyed = prompts.select(F.struct(*key, "which").alias("session_id"), "prompt")
    scored = score_predictions(keyed, judge, **options).select("session_id.*", mean_score().alias("avg"))
    pivoted = scored.groupBy(*key).agg(*[
        F.max(F.when(F.col("which") == w, F.col("avg"))).alias(w) for w in ("new_score", "live_score")])
    return work.join(pivoted, key)


def repair(predictions: DataFrame, work: DataFrame, completer: C.Completer, template: str,
           rules: GateRules, judge: C.Completer | None = None, judge_template: str = "",
           strict: bool = False, max_tries: int = 3, **options) -> RepairResult:
    """Patch the predictions of the work rows.

    ``work`` comes from :func:`rankflow.operators.repair.work_rows`; its ``avg`` is the
    stored score. Each of its rows is judged and patched by session and turn. Tasks, responses, failures and decisions are
    counted as the stages are written, without a scan of their own. Without a judge every new response goes in.
    """
    written, decided = Observation("written"), Observation("decided")
    response, decision = F.col("response"), F.col("decision")
    made = materialize(regenerate(work, completer, template, rules, max_tries, **options).observe(
        written, F.count("*").alias("n_tasks"), F.count(response).alias("n_responses"), F.count_if(response.isNull()).alias("n_failed")),
        "regenerated")
    ready = made.filter(F.col("response").isNotNull())
    if judge is None:
        guarded = ready.withColumn("decision", F.lit("patch"))
    else:
        scored = live_scores(ready, judge, judge_template, **options).withColumn("stored_score", F.col("avg"))
        guarded = K.guard_strict(scored) if strict else K.guard_live(scored)
    guarded = materialize(guarded.observe(
        decided, F.count_if(decision.startswith("patch")).alias("n_patched"), F.count_if(decision == "patch_stored").alias("n_fallbacks"),
        F.count_if(decision == "keep").alias("n_kept"), F.count_if(decision == "keep_failed").alias("n_skipped")), "guarded")
    patched = K.patch(predictions, K.cleared(guarded).select(*K.key_of(guarded), "response"))
    failed = made.filter(F.col("response").isNull()).drop("response")
    return RepairResult(patched, guarded, failed, written.get | decided.get)
