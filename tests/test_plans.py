import json

import pytest
from pyspark.sql import functions as F

from rankflow.functions import text as X
from rankflow.operators import dense, lexical, ranking, render
from rankflow.plans import evaluate, recommend, retrieval
from rankflow.session import scratch_path
from tests.conftest import rows


@pytest.fixture(scope="module")
def index(catalog):
    return lexical.build_index(catalog.select(F.col("track_id").alias("item_id"), X.lexical_text().alias("text")))


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([("s1", "u1"), ("s2", "u2")], "session_id string, user_id string")


def test_targets_by_mode(turns):
    assert recommend.targets_of(turns, "last").count() == 2
    assert recommend.targets_of(turns, "all").count() == 4
    assert recommend.targets_of(turns, "grid", (2, 3)).count() == 2
    with pytest.raises(ValueError):
        recommend.targets_of(turns, "first")


@pytest.mark.parametrize("mode, n", [("last", 2), ("all", 4)])
def test_recommend(spark, turns, users, catalog, index, mode, n):
    got = recommend.recommend(turns, users, catalog, retrieval.Indexes(index), "bm25", mode)
    made = {(r["session_id"], r["turn_number"]): r for r in got.collect()}
    assert len(made) == n
    # "c" shares its artist with the played "a"
    assert set(made["s1", 3]["predicted_track_ids"]) == {"a", "b", "c", "d"}
    assert made["s1", 3]["predicted_response"].startswith("Here are my top picks")
    # nothing matches: an empty list and the fixed sentence
    assert made["s2", 1]["predicted_track_ids"] == [] and made["s2", 1]["predicted_response"] == render.NO_TRACKS


def test_side_of_weight_zero_is_not_planned(spark, turns, users, catalog, index):
    got = recommend.recommend(turns, users, catalog, retrieval.Indexes(index), "bm25_cf",
                              collaborative_weight=0.0)
    assert got.count() == 2


def test_taste_of_unknown_user_gives_no_rows(spark):
    items = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "item_id string, vector array<double>")
    path = scratch_path(spark, "taste-test")
    opened = [dense.open_vectors(items, path), dense.open_vectors(items.limit(0), path)]
    q = spark.createDataFrame([("u", [0.0, 2.0])], "query_id string, vector array<double>")
    for ix in opened:
        got = retrieval.retrieve("cf", retrieval.Indexes(collaborative=ix), retrieval.Queries(user_vectors=q), topk=2)
        assert rows(got, "query_id", "item_id", "rank") == [("u", "a", 2), ("u", "b", 1)]


def test_reformulated_and_facet_queries(spark, turns):
    targets = recommend.targets_of(turns)
    prompts = targets.select("session_id", "turn_number", F.col("query").alias("prompt"),
                             F.concat(F.lit("User: "), "query").alias("conversation"))

    def entities(prompt):
        return json.dumps({"moods": ["calm"], "user_query": prompt}) if "calm" in prompt else "no idea"

    got = dict(rows(recommend.reformulated_texts(targets, prompts, entities)))
    assert got == {"s1/3": "calm something calm", "s2/1": "hello there"}

    def facets(prompt):
        return json.dumps({"q1": "one", "q3": "three"}) if "calm" in prompt else None

    got = dict(rows(recommend.facet_rows(targets, prompts, facets)))
    assert got == {"s1/3": ["one", "three"], "s2/1": ["User: hello there"]}


def test_listwise_replies_and_chain(spark, catalog):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("q", "d", 4)],
                                   "query_id string, item_id string, rank int")
    talk = spark.createDataFrame([("q", "User: hi")], "query_id string, conversation string")

    def last_first(prompt):
        ids = [line.split("track_id: ")[1].split("]")[0] for line in prompt.splitlines() if "track_id: " in line]
        return "```json\n" + json.dumps(ids[::-1]) + "\n```"

    told = recommend.listwise_replies(ranked, talk, catalog, last_first, "{conversation}\n{candidates}", window=3)
    got = recommend.rerank_chain(ranked, answers=told, window=3, topk=3)
    assert [r["item_id"] for r in got.orderBy("rank").collect()] == ["c", "b", "a"]
    # an id outside the window does not count as an answer
    outside = spark.createDataFrame([("q", '["d", "c"]')], "query_id string, reply string")
    got = recommend.rerank_chain(ranked, answers=outside, window=3, topk=4)
    assert [r["item_id"] for r in got.orderBy("rank").collect()] == ["c", "a", "b", "d"]
    assert rows(ranking.rank_score(ranked), "item_id", "score")[1] == ("b", 0.5)


def test_responses_without_any_item(spark, catalog):
    ranked = spark.createDataFrame([("q", "a", 1)], "query_id string, item_id string, rank int")
    talk = spark.createDataFrame([("q", "hi"), ("r", "ho")], "query_id string, conversation string")
    system = talk.select("query_id", render.system_prompt("role", "rules", "who", F.lit("")).alias("system"))
    got = dict(rows(recommend.responses(ranked, catalog, talk, system, lambda p: p, "{system}|{conversation}|{item}")))
    assert got["q"].startswith("role\nrules|hi|track_id: a, track_name: alpha")
    assert got["r"] == "role\nrules|ho|"


def test_judging(spark, turns, catalog):
    preds = spark.createDataFrame([("s1", 3, ["a", "zz"], "try these"), ("s1", 2, ["b"], "or this"), ("gone", 1, ["a"], "x")],
                                  "session_id string, turn_number int, predicted_track_ids array<string>, predicted_response string")
    prompts = evaluate.judge_prompts(preds, turns, catalog, "{conversation}#{response}#{tracks}")
    text = {(s, t): p for s, t, p in rows(prompts)}
    assert sorted(text) == [("s1", 2), ("s1", 3)]
    assert text["s1", 3].endswith("#try these#- Alpha by One | rock, loud\n- zz by Unknown | ")
    assert "#or this#- Beta by" in text["s1", 2] and "Alpha by One | rock" not in text["s1", 2].split("#or this#")[1]
    got = evaluate.score_predictions(prompts, lambda p: "no numbers").first()
    assert (got["personalization"], got["reasoning"]) == (None, "parse error")


def test_predictions_are_made_once_for_their_prompts(spark, turns, catalog):
    """Conversations, tracks and responses all start from the predictions."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(session):
        made.add(1)
        return session

    preds = spark.createDataFrame([("s1", 3, ["a"], "this"), ("s2", 1, ["b"], "that")],
                                  "session_id string, turn_number int, predicted_track_ids array<string>, predicted_response string")
    prompts = evaluate.judge_prompts(preds.withColumn("session_id", counted("session_id")), turns, catalog, "{conversation}#{response}#{tracks}")
    assert prompts.count() == 2 and made.value == 2


def test_lists_are_reranked_once_for_offer_and_merge(spark, monkeypatch):
    """The lists that answers are read against and merged into are written once; lists that come as they are, not again."""
    written, write = [], recommend.materialize
    monkeypatch.setattr(recommend, "materialize", lambda df, name: written.append(name) or write(df, name))
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, item_id string, rank int")
    told = spark.createDataFrame([(1, '["b"]')], "query_id long, reply string")
    users = spark.createDataFrame([(1, 7)], "query_id long, user_id long")
    vectors = spark.createDataFrame([(7, [1.0])], "user_id long, vector array<double>")
    items = spark.createDataFrame([("a", [1.0]), ("b", [0.5])], "item_id string, vector array<double>")
    got = recommend.rerank_chain(ranked, users, vectors, items, told).orderBy("rank").collect()
    assert [r.item_id for r in got] == ["b", "a"] and written == ["offered"]
    recommend.rerank_chain(ranked, answers=told)
    assert written == ["offered"]
