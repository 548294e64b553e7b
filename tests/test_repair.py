import os
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rankflow.functions import gates
from rankflow.operators import complete, judge, repair
from rankflow.plans import repair as plan
from rankflow.session import scratch_path
from tests.conftest import rows


def scores(spark, *values):
    return spark.createDataFrame([(f"s{n}", p, e) for n, (p, e) in enumerate(values)],
                                 "session_id string, personalization double, explanation double")


def test_targets(spark):
    s = scores(spark, (None, None), (3.0, 3.0), (4.0, 3.0), (4.0, 3.98), (5.0, 2.0), (5.0, 5.0))
    assert [r[0] for r in rows(repair.targets_mean(s))] == ["s0", "s1"]
    assert [r[0] for r in rows(repair.targets_band(s))] == ["s2", "s3", "s4"]
    assert [r[0] for r in rows(repair.targets_floor(s))] == ["s4"]
    assert [r[0] for r in repair.worst_first(repair.targets_band(s)).collect()] == ["s2", "s4", "s3"]


@pytest.mark.parametrize("new, live, stored, want, strict", [
    (None, 3.0, 3.0, "keep_failed", "keep_failed"), (4.0, 3.0, None, "patch", "patch"),
    (3.0, 3.0, None, "keep", "keep"), (4.0, None, 3.0, "patch_stored", "keep_failed"),
    (3.6, None, None, "patch_stored", "keep_failed"), (3.5, None, None, "keep_failed", "keep_failed"),
    (4.0, None, 4.0, "keep_failed", "keep_failed"), (None, None, 1.0, "keep_failed", "keep_failed"),
])
def test_guards(spark, new, live, stored, want, strict):
    row = spark.createDataFrame([("s", new, live, stored)],
                                "session_id string, new_score double, live_score double, stored_score double")
    assert repair.guard_live(row).first()["decision"] == want
    assert repair.guard_strict(row).first()["decision"] == strict


def test_judge_tables(spark):
    s = scores(spark, (4.0, 2.0), (5.0, 5.0), (None, None))
    m = judge.judge_means(s).first()
    assert (m["mean_combined"], m["n_scored"], m["n_failed"]) == (4.0, 2, 1)
    got = {r["session_id"]: r for r in judge.bias_corrected(s, 4.4).collect()}
    assert got["s0"]["corrected_avg"] == pytest.approx(3.3)
    assert got["s1"]["corrected_avg"] == 5.0 and got["s2"]["corrected_avg"] is None
    none = judge.bias_corrected(scores(spark, (None, None)), 4.4).first()
    assert (none["bias_factor"], none["proxy_avg"]) == (1.0, None)
    ends = judge.extremes(judge.bias_corrected(s, 4.4), 1)
    assert rows(ends, "session_id", "side") == [("s0", "worst"), ("s1", "best")]
    other = scores(spark, (5.0, 4.0), (5.0, 5.0), (1.0, 1.0))
    assert rows(judge.largest_drops(s, other), "session_id", "drop") == [("s0", 1.5)]
    c = judge.comparison(s, other).first()
    assert c["n_worse"] == 1 and c["delta"] == pytest.approx(4.0 - 3.5)


def preds(spark):
    return spark.createDataFrame([("s0", ["a", "b"], "old"), ("s1", ["a", "a"], "old")],
                                 "session_id string, predicted_track_ids array<string>, predicted_response string")


def test_patch_keeps_keys_and_items(spark):
    new = spark.createDataFrame([("s0", "new"), ("zz", "lost")], "session_id string, response string")
    assert rows(repair.patch(preds(spark), new), "session_id", "predicted_response") == [("s0", "new"), ("s1", "old")]
    merged = repair.merge_responses(preds(spark), preds(spark).filter(F.col("session_id") == "s1"))
    assert rows(merged, "session_id", "predicted_response") == [("s0", ""), ("s1", "old")]


def test_validation(spark):
    flags = rows(repair.validated(preds(spark)), "session_id", "has_duplicates", "is_short")
    assert flags == [("s0", False, True), ("s1", True, True)]
    with pytest.raises(PySparkException):
        repair.require_unique(preds(spark)).collect()


def test_completion_asks_each_prompt_once(spark):
    path, log = scratch_path(spark, "t"), spark.sparkContext.accumulator(0)

    def completer(prompt):
        log.add(1)
        if prompt == "bad":
            raise RuntimeError("down")
        return prompt.upper()

    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "bad"), (4, None)], "id int, prompt string")
    got = complete.complete(df, completer, max_tries=3, store=path)
    assert rows(got, "id", "reply") == [(1, "X"), (2, "X"), (3, None), (4, None)]
    assert log.value == 1 + 3
    # a second run finds the answered prompt in the store
    complete.complete(df, completer, store=path).collect()
    assert log.value == 5


def test_completion_tries_until_accepted(spark):
    df = spark.createDataFrame([("ok",), ("no",)], "prompt string")
    got = complete.complete(df, lambda p: p * 3, accept=F.col("reply").startswith("ok"), max_tries=2)
    got = complete.with_fallback(got, "reply", F.lit("?"))
    assert rows(got, "prompt", "reply", "is_fallback") == [("no", "?", True), ("ok", "okokok", False)]


def test_calls_are_bounded_by_partitions_and_threads(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("prompt"), F.lit("h").alias("prompt_hash"))
    assert complete._call(complete.empty_completer, df, 1, 3).rdd.getNumPartitions() == 3
    assert complete._call(complete.empty_completer, df, 1, 12, 4).rdd.getNumPartitions() == 3


def test_calls_of_a_task_overlap(spark):
    """Eight calls of 0.25 s in a task of eight threads take well under their sum."""
    def slow(prompt):
        begun = time.time()
        time.sleep(0.25)
        return f"{begun} {time.time()}"

    df = spark.range(8).select(F.col("id").cast("string").alias("prompt"), F.col("id").cast("string").alias("prompt_hash"))
    spans = [tuple(map(float, r.reply.split())) for r in complete._call(slow, df, 1, 8, 8).collect()]
    assert max(e for _, e in spans) - min(b for b, _ in spans) < 0.6 * 8 * 0.25


def test_prompts_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def prompt(i):
        made.add(1)
        return f"prompt {i % 40}"

    got = complete.complete(spark.range(60).select("id", prompt("id").alias("prompt")), str.upper, wave=10)
    assert sorted(r.reply for r in got.collect()) == sorted(f"PROMPT {i % 40}" for i in range(60))
    assert made.value == 60


def test_encoding_takes_texts_a_few_at_a_time(spark):
    """Nulls stay null, vectors stay with their texts, and no more texts than the batch size become Python objects at once."""
    def encoder(texts):
        assert len(texts) <= 3 and all(type(t) is str for t in texts)
        return [[len(t), 1.0] for t in texts]

    rows = spark.createDataFrame([(i, None if i % 4 == 0 else "x" * i) for i in range(20)], "i int, t string").coalesce(1)
    got = {r.i: r.v for r in rows.select("i", complete.encode(F.col("t"), encoder, 3).alias("v")).collect()}
    assert all((got[i] is None) == (i % 4 == 0) for i in range(20))
    assert all(got[i] == pytest.approx([i / (i * i + 1) ** 0.5, 1 / (i * i + 1) ** 0.5]) for i in range(20) if i % 4)


def test_a_killed_task_repeats_at_most_its_wave(spark, tmp_path):
    """The worker dies in the middle of a wave: what earlier waves brought is kept and not asked again."""
    calls, fuse = tmp_path / "calls", tmp_path / "fuse"
    fuse.write_text("")

    def completer(prompt):
        with open(calls, "a") as log:
            log.write(f"{prompt}\n")
        if fuse.exists() and len(calls.read_text().split()) > 150:
            fuse.unlink(missing_ok=True)
            os._exit(1)
        return prompt.upper()

    df = spark.range(300).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    store = scratch_path(spark, "waves-test")
    options = {"store": store, "wave": 50, "parallelism": 4, "threads": 2}
    with pytest.raises(Exception):
        complete.replies(df, completer, **options)
    kept = spark.read.parquet(store).count()
    assert kept >= 80
    assert complete.replies(df, completer, **options).count() == 300
    asked = calls.read_text().split()
    # waves hold about 50 prompts each
    assert set(asked) == {f"p{i}" for i in range(300)} and len(asked) - 300 <= 75


def turns_table(spark):
    return spark.createDataFrame([("s", t, pos, role, f"{role}{t}") for t in (1, 2, 3) for pos, role in enumerate(("user", "music"))],
                                 "session_id string, turn_number int, pos int, role string, content string")


def test_each_turn_is_repaired_on_its_own(spark):
    """Two predictions of one session: two work rows, and each gets the text that was made for it."""
    from rankflow.operators import render

    predictions = spark.createDataFrame([("s", 1, ["a"], "old one"), ("s", 2, ["b"], "old two"), ("s", 3, ["c"], "fine")],
                                        "session_id string, turn_number int, predicted_track_ids array<string>, predicted_response string")
    scores = spark.createDataFrame([("s", 1, 3.5, 3.5), ("s", 2, 3.5, 3.5), ("s", 3, 5.0, 5.0)],
                                   "session_id string, turn_number int, personalization double, explanation double")
    talk = render.render_upto(turns_table(spark), predictions, "judge")
    assert {r.turn_number: r.conversation.count("\n") for r in talk.collect()} == {1: 1, 2: 3, 3: 5}
    shown = spark.createDataFrame([("s", "tracks")], "session_id string, candidates string")
    work = repair.work_rows(repair.targets_band(scores), predictions, talk, shown)
    assert rows(work, "turn_number", "predicted_response") == [(1, "old one"), (2, "old two")]
    # targets told by session alone still give one row per prediction
    assert repair.work_rows(scores.where("turn_number = 1").select("session_id", F.lit(1.0).alias("avg")), predictions, talk, shown).count() == 3
    result = plan.repair(predictions, work, lambda p: f"You asked for this and heard {p.count('user')} — close to what you played before, in colour.",
                         "{conversation}", gates.EXPLAINED)
    got = rows(result.predictions, "turn_number", "predicted_response")
    assert [t for t, _ in got] == [1, 2, 3] and "heard 1 " in got[0][1] and "heard 2 " in got[1][1] and got[2][1] == "fine"
    assert repair.unmatched(scores, predictions.where("turn_number < 3")).count() == 1
    assert repair.without_result(scores, predictions.where("turn_number < 2")).count() == 2


def test_repair_run(spark):
    work = spark.createDataFrame([("s0", 3.5, "old", "talk", "tracks"), ("s1", 3.2, "old", "talk", "other")],
                                 "session_id string, avg double, predicted_response string, conversation string, candidates string")

    def writer(prompt):
        return f"You asked for this — {prompt} is close to what you played before, in colour and in pace."

    def judge_reply(prompt):
        high = "You asked" in prompt and "tracks" in prompt.rsplit("\n", 1)[-1]
        return '{"personalization": %d, "explanation": 3}' % (5 if high else 2)

    result = plan.repair(preds(spark), work, writer, "{conversation}\n{tracks}", gates.EXPLAINED, judge_reply,
                         "{conversation}\n{response}\n{tracks}", strict=True)
    got = dict(rows(result.predictions, "session_id", "predicted_response"))
    assert got["s0"].startswith("You asked for this") and got["s1"] == "old"
    assert rows(result.guarded, "session_id", "decision") == [("s0", "patch"), ("s1", "keep")]
    assert result.failed.count() == 0
    assert result.counts == {"n_tasks": 2, "n_responses": 2, "n_failed": 0, "n_patched": 1, "n_fallbacks": 0, "n_kept": 1, "n_skipped": 0}
