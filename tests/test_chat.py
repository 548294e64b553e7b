"""The whole turn as one plan, and the same on a stream."""

import json
import re

import pytest
from pyspark.sql import functions as F

from rankflow.operators import lexical, sessions
from rankflow.plans import chat as C
from rankflow.plans.retrieval import Indexes
from rankflow.session import materialize, scratch_path, scratch_scope
from rankflow.streaming import turns as S
from tests.conftest import rows


@pytest.fixture(scope="module")
def index(spark, catalog):
    from rankflow.functions import text as X

    return Indexes(lexical.build_index(catalog.select(F.col("track_id").alias("item_id"), X.lexical_text().alias("text"))))


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([("s1", "u1"), ("s2", "u2")], "session_id string, user_id string")


@pytest.fixture(scope="module")
def vectors(spark):
    user = spark.createDataFrame([("u1", [1.0, 0.0])], "user_id string, vector array<double>")
    item = spark.createDataFrame([("a", [0.0, 1.0]), ("d", [1.0, 0.0])], "item_id string, vector array<double>")
    return user, item


def plan(spark, vectors, log, **changes):
    def noted(stage, reply):
        def completer(prompt):
            with open(log, "a") as file:
                file.write(f"{stage}\n")
            return reply(prompt)

        return completer

    def rewrite(prompt):
        if "hello" in prompt:
            raise RuntimeError("down")
        return json.dumps({"genres": ["jazz", "rock"], "user_query": prompt.splitlines()[-1]})

    def rank(prompt):
        return json.dumps(re.findall(r"^\d+\. \[(\w)\]", prompt, re.M)[::-1])

    system = spark.createDataFrame([("u1", "kind"), ("u2", "kind")], "user_id string, system string")
    stages = {"rewrite": C.Rewrite(noted("rewrite", rewrite), "{conversation}\n{query}"), "profile": C.Profile(*vectors),
              "rank": C.Rank(noted("rank", rank), "{conversation}\n{candidates}", "tagged", 2),
              "respond": C.Respond(noted("respond", lambda p: p.split("\n")[0] + "|" + p.split("\n")[-1][:11]), "{system}\n{conversation}\n{item}", system)}
    return C.Chat(**(stages | changes))


def told(df):
    return {(r.session_id, r.turn_number): (r.user_id, r.predicted_track_ids, r.predicted_response) for r in df.collect()}


def test_every_stage_takes_part(spark, turns, users, catalog, index, vectors, tmp_path):
    log = tmp_path / "calls"
    out = told(C.chat(turns, users, catalog, index, plan(spark, vectors, log)))
    # s1 asks for something calm: d is calm and jazz, a is rock; taste puts d first, the list turns the two round
    assert out["s1", 3] == ("u1", ["a", "d"], "kind|track_id: a")
    # the rewriter is down for s2, whose query finds nothing
    assert out["s2", 1] == ("u2", [], "kind|")
    plain = told(C.chat(turns, users, catalog, index, plan(spark, vectors, log, rank=None, respond=None)))
    assert plain["s1", 3][1] == ["d", "a"] and '"Alpha" by One' in plain["s1", 3][2]  # d has no artist to name
    only = told(C.chat(turns, users, catalog, index, C.Chat(), mode="all"))
    assert "d" in only["s1", 3][1] and only["s1", 1][1] == ["a"] and len(only) == 4
    assert sorted(set(log.read_text().split())) == ["rank", "respond", "rewrite"]


def test_facets_are_fused(spark, turns, users, catalog, index):
    facets = C.Rewrite(lambda p: json.dumps({"q1": "jazz", "q2": "pop", "q3": ""}) if "calm" in p else "nothing", "{query}", facets=3)
    out = told(C.chat(turns, users, catalog, index, C.Chat("multi_query", rewrite=facets, options={"dense_weight": 0.0})))
    assert set(out["s1", 3][1]) == {"b", "d"} and out["s2", 1][1] == []


def test_a_stream_gives_the_rows_of_the_batch_plan_and_asks_nothing_twice(spark, turns, users, catalog, index, vectors, tmp_path):
    log = tmp_path / "calls"
    whole = plan(spark, vectors, log)
    want = told(C.chat(turns, users, catalog, index, whole, mode="all"))
    feed, out = scratch_path(spark, "feed"), scratch_path(spark, "chat")
    events = S.turn_events(turns)
    events.repartition(2).write.parquet(feed)
    start = lambda check: S.start_chat(S.read_turn_events(spark, feed, 1), users, catalog, index, whole, f"{out}/rows", f"{out}/{check}",
                                       f"{out}/replies", available_now=True)
    start("first").awaitTermination()
    assert told(S.read_ranked(spark, f"{out}/rows")) == want and len(want) == 4
    # all batches again, as after a failure before their commit: rows stay, no prompt is asked again but those that failed
    asked = len(log.read_text().split())
    start("second").awaitTermination()
    assert told(S.read_ranked(spark, f"{out}/rows")) == want
    again = log.read_text().split()[asked:]
    assert set(again) <= {"rewrite"} and len(again) <= 1


def test_scratch_tables_of_a_scope_go_at_its_end(spark):
    with scratch_scope(spark):
        path = scratch_path(spark, "x")
        assert materialize(spark.range(3), "y").count() == 3
        with scratch_scope(spark):
            inner = materialize(spark.range(2), "z").inputFiles()
        assert inner and "scope" in path
    import os
    assert not os.path.exists(inner[0].removeprefix("file:")) and not os.path.exists(os.path.dirname(path))
    assert "scope" not in scratch_path(spark, "x")


def test_history_up_to_a_turn(spark, turns):
    targets = spark.createDataFrame([("s1", 2)], "session_id string, turn_number int")
    assert rows(sessions.upto(turns, targets), "turn_number") == [(1,)] * 3 + [(2,)] * 3
