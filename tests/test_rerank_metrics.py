import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankflow.operators import metrics, rerank
from rankflow.plans import evaluate
from tests.conftest import rows


def lists(spark, **queries):
    return spark.createDataFrame([(q, i, n) for q, items in queries.items() for n, i in enumerate(items, 1)],
                                 "query_id string, item_id string, rank int")


def order(df, query):
    return [r["item_id"] for r in df.filter(F.col("query_id") == query).orderBy("rank").collect()]


def test_profile_rerank(spark):
    ranked = lists(spark, q=["a", "b", "c"], r=["a", "b"])
    users = spark.createDataFrame([("q", "u"), ("r", "nobody")], "query_id string, user_id string")
    uv = spark.createDataFrame([("u", [1.0, 0.0])], "user_id string, vector array<double>")
    iv = spark.createDataFrame([("a", [-1.0, 0.0]), ("c", [1.0, 0.0])], "item_id string, vector array<double>")
    got = rerank.profile_rerank(ranked, users, uv, iv)
    # a: .7 - .3, b: .35 without a vector, c: .7/3 + .3
    assert order(got, "q") == ["c", "a", "b"]
    assert order(got, "r") == ["a", "b"]


def test_listwise_merge_is_a_permutation(spark):
    ranked = lists(spark, q=["a", "b", "c", "d"], r=["a", "b"])
    answers = spark.createDataFrame([("q", ["d", "zz", "b", "d"])], "query_id string, ids array<string>")
    got = rerank.listwise_merge(ranked, rerank.answer_rows(answers), 10)
    assert order(got, "q") == ["d", "b", "a", "c"]
    assert order(got, "r") == ["a", "b"]
    assert order(rerank.listwise_merge(ranked, rerank.answer_rows(answers), 2), "q") == ["d", "b"]


@pytest.mark.parametrize("n", [5, 20, 50])
def test_pass_through_length(spark, n):
    ranked = lists(spark, **{f"s{s}": [f"t{i}" for i in range(n)] for s in range(8)})
    none = spark.createDataFrame([], "query_id string, item_id string, new_rank int")
    got = rerank.listwise_merge(ranked, none, 20)
    assert got.count() == 8 * min(20, n)
    assert order(got, "s3") == [f"t{i}" for i in range(min(20, n))]


def test_ndcg_forms(spark):
    ranked = lists(spark, q=["a", "b", "c"], r=["x"])
    relevant = spark.createDataFrame([("q", "b"), ("q", "c"), ("q", "z")], "query_id string, item_id string")
    got = dict(rows(metrics.ndcg_set(ranked, relevant)))
    assert got["q"] == pytest.approx(1 / math.log2(3) + 1 / math.log2(4)) and got["r"] == 0
    ideal = dict(rows(metrics.ndcg_set(ranked, relevant, ideal_hits=True)))
    assert ideal["q"] == pytest.approx(got["q"] / (1 + 1 / math.log2(3) + 0.5))


def predictions(spark):
    return spark.createDataFrame([
        ("s", 1, ["a", "b"], "one two"), ("s", 2, ["c", "d"], "two three"), ("t", 1, ["x"], ""), ("u", 1, ["y"], "four"),
    ], "session_id string, turn_number int, predicted_track_ids array<string>, predicted_response string")


def test_evaluate(spark):
    truth = spark.createDataFrame([("s", 2, "d"), ("t", 1, "q"), ("s", 1, "a")],
                                  "session_id string, turn_number int, truth string")
    last = evaluate.evaluate(predictions(spark), truth).first()
    assert (last["mode"], last["n"]) == ("last-turn-only", 2)
    assert last["ndcg20"] == pytest.approx(1 / math.log2(3) / 2)
    assert last["lexdiv"] == 0.0
    every = evaluate.evaluate(predictions(spark), truth, all_turns=True).first()
    assert every["n"] == 3 and every["lexdiv"] == pytest.approx(1 - 1 / 3)
    nothing = evaluate.evaluate(predictions(spark), truth.limit(0)).first()
    assert (nothing["ndcg20"], nothing["n"]) == (0.0, 0)


def test_lexical_diversity_uses_every_pair_of_few_texts(spark):
    texts = spark.createDataFrame([(n, f"w{n} w{n + 1} same") for n in range(15)], "k int, t string")
    bags = [{f"w{n}", f"w{n + 1}", "same"} for n in range(15)]
    pairs = [1 - len(a & b) / len(a | b) for i, a in enumerate(bags) for b in bags[i + 1:]]
    assert metrics.lexical_diversity(texts, "k", "t").first()[0] == pytest.approx(sum(pairs) / len(pairs))
    assert metrics.lexical_diversity(texts.limit(1), "k", "t").first()[0] == 0.0


def test_lexical_diversity_uses_every_text(spark):
    rows = [(i, f"common w{i % 50} x{i % 7}") for i in range(1000)]

    def value(changed=None):
        texts = [(i, "quite another text" if i == changed else t) for i, t in rows]
        return metrics.lexical_diversity(spark.createDataFrame(texts, "k long, t string"), "k", "t").first()[0]

    whole = value()
    assert all(value(i) != whole for i in (0, 1, 499, 500, 998, 999))


def test_lexical_diversity_compares_all_pairs(spark, monkeypatch):
    """More texts than a bucket has, some of one key, some equal, some without a word: every pair of different keys counts."""
    rows = [(i // 2 if i < 20 else i, f"c w{i % 9} x{i % 7} y{i * i % 11}" if i % 10 else "  ") for i in range(300)]
    bags = [(str(k), set(t.split())) for k, t in rows]
    pairs = [1 - len(a & b) / len(a | b) for i, (j, a) in enumerate(bags) for k, b in bags[i + 1:] if j != k and a | b]
    texts = spark.createDataFrame(rows, "k long, t string")
    for sets, cells in ((2048, 1 << 18), (70, 500), (100, 500)):
        monkeypatch.setattr(metrics, "BLOCK_SETS", sets)
        monkeypatch.setattr(metrics, "CELLS", cells)
        assert metrics.lexical_diversity(texts, "k", "t").first()[0] == pytest.approx(sum(pairs) / len(pairs), abs=1e-9)
    assert metrics.lexical_diversity(texts, "k", "t", 64).first()[0] != pytest.approx(sum(pairs) / len(pairs), abs=1e-9)


def test_evaluate_compares_all_responses_of_last_turns(spark):
    said = [f"c w{i % 9} x{i % 7} y{i * i % 11}" for i in range(200)]
    bags = [set(t.split()) for t in said]
    pairs = [1 - len(a & b) / len(a | b) for i, a in enumerate(bags) for b in bags[i + 1:]]
    rows = [(i, turn, ["a"], t if turn == 2 else "never last") for i, t in enumerate(said) for turn in (1, 2)]
    made = spark.createDataFrame(rows, "session_id long, turn_number int, predicted_track_ids array<string>, predicted_response string")
    truth = spark.createDataFrame([(i, 2, "a") for i in range(200)], "session_id long, turn_number int, truth string")
    assert evaluate.evaluate(made, truth).first()["lexdiv"] == pytest.approx(sum(pairs) / len(pairs), abs=1e-9)


def test_lexical_diversity_makes_texts_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        made.add(1)
        return f"w{i % 5} common"

    assert metrics.lexical_diversity(spark.range(50).select("id", text("id").alias("t")), "id", "t").first()[0] > 0
    # by the filter and by the words, in one pass
    assert made.value <= 100


def test_distances_in_pieces_leave_out_equal_keys(monkeypatch):
    texts = [("a", ["x", "y"]), ("b", ["y", "z"]), ("b", ["x", "y"]), ("c", []), ("d", []), ("e", [f"w{i}" for i in range(40)] + ["x"])]
    want = [1 - len({*x} & {*y}) / len({*x} | {*y}) for n, (a, x) in enumerate(texts) for b, y in texts[n + 1:] if a != b and x + y]
    for cells in (7, 1 << 18):
        monkeypatch.setattr(metrics, "CELLS", cells)
        got = metrics._distances(pa.table({"id": [i for i, _ in texts], "words": pa.array([w for _, w in texts], pa.list_(pa.string()))})).to_pylist()[0]
        assert got["n"] == len(want) and got["total"] == pytest.approx(sum(want))


def test_ndcg_counts_queries_without_a_list(spark):
    ranked = spark.createDataFrame([("q1", "a", 1)], "query_id string, item_id string, rank int")
    relevant = spark.createDataFrame([("q1", "a"), ("q2", "b")], "query_id string, item_id string")
    got = metrics.ndcg_set(ranked, relevant, evaluated=relevant).collect()
    assert {r.query_id: r.ndcg for r in got} == {"q1": 1.0, "q2": 0.0}


def test_profile_rerank_copies_no_vector_to_candidates(spark, monkeypatch):
    """Lists in packs and items in passes give the scores of a product per candidate; no shuffle carries a vector per candidate."""
    rng = np.random.default_rng(3)
    unit = lambda n: [v / np.linalg.norm(v) for v in rng.normal(size=(n, 4))]
    taste, items = dict(enumerate(unit(5))), {f"i{n}": v for n, v in enumerate(unit(40))}
    del taste[2]
    lists = [(q, f"i{(q * 3 + r) % 45}", r) for q in range(6) for r in range(1, 21)]
    monkeypatch.setattr(rerank, "PACK", 7)
    monkeypatch.setattr(rerank, "PASS_ROWS", 5)
    monkeypatch.setattr(rerank, "ITEM_ROWS", 6)
    ranked = spark.createDataFrame(lists, "query_id long, item_id string, rank int")
    users = spark.createDataFrame([(q, q) for q in range(6)], "query_id long, user_id long")
    vectors = lambda rows, name: spark.createDataFrame([(k, v.tolist()) for k, v in rows.items()], f"{name}, vector array<double>")
    sides = rerank.similarities(ranked, users.join(vectors(taste, "user_id long"), "user_id").select("query_id", F.col("vector").alias("user_vector")),
                                vectors(items, "item_id string")).collect()
    assert len(sides) == len(lists)
    for r in sides:
        both = r.query_id in taste and r.item_id in items
        # added one after the other, as the built-in sum of floats does not
        want = reduce(lambda acc, x: acc + x, (taste[r.query_id] * items[r.item_id]).tolist(), 0.0) if both else 0.0
        assert r.similarity == want and r.known == (r.query_id in taste)
    got = rerank.profile_rerank(ranked, users, vectors(taste, "user_id long"), vectors(items, "item_id string")).where("query_id = 2").orderBy("rank")
    assert [r.item_id for r in got.collect()] == [i for q, i, _ in lists if q == 2]
