import pytest
from pyspark.sql import functions as F

from rankflow.functions import gates, replies, text
from rankflow.functions.vectors import dot, normalize


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(build(F.col("t"))).first()[0]


def test_scores_are_parsed_once(spark):
    replied = spark.range(1).select(F.col("id").cast("string").alias("t")).withColumn("s", replies.parse_scores(F.col("t")))
    plan = replied.select("s.personalization", "s.explanation", "s.reasoning")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_tokens_keep_scripts_and_drop_stop_words(spark):
    assert one(spark, "The Café Über a B-52_x é with THEM", text.tokens) == ["café", "über", "52_x", "them"]


def test_catalog_texts(spark, catalog):
    got = {r[0]: tuple(r[1:]) for r in catalog.select(
        "track_id", text.lexical_text(), text.passage_text(), text.display_text()).collect()}
    assert got["b"][0] == "Beta Two Three Second pop"
    assert got["b"][1] == "passage: track_name: Beta; artist_name: Two, Three; album_name: Second; tag_list: pop"
    assert got["b"][2] == ("track_id: b, track_name: beta, artist_name: two, three, album_name: second, "
                           "release_date: 2001, tag_list: pop")
    assert got["d"][2].endswith("tag_list: jazz, calm, late, night, sax")
    assert got["e"][0] == "Epsilon Five"


def test_jaccard_distance(spark):
    df = spark.createDataFrame([("a b", "B c"), ("", " ")], "x string, y string")
    got = df.select(text.jaccard_distance(text.blank_tokens(F.col("x")), text.blank_tokens(F.col("y")))).collect()
    assert got[0][0] == pytest.approx(2 / 3)
    assert got[1][0] is None


@pytest.mark.parametrize("reply, want", [
    ('["c","a"]', ["c", "a"]),
    ('```json\n["c","a"]\n```', ["c", "a"]),
    ('Sure: ["c", "zz", "c", "b"] ok', ["c", "b"]),
    ('["c",', None), ("[]", None), (None, None), ('["zz"]', None), ("no list", None),
])
def test_parse_id_array(spark, reply, want):
    valid = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    assert one(spark, reply, lambda c: replies.parse_id_array(c, valid)) == want


def test_parse_rank_object(spark):
    valid = F.array(F.lit("a"), F.lit("b"))
    parse = lambda c: replies.parse_rank_object(c, valid)
    got = one(spark, 'x {"ranked_tracks": ["b","b","q"], "response": " hi "} y', parse)
    assert (got["ranked"], got["response"]) == (["b"], "hi")
    assert one(spark, '{"ranked_tracks": ["b"], "response": " "}', parse) is None
    assert one(spark, '{"ranked_tracks": [], "response": "hi"}', parse) is None


@pytest.mark.parametrize("reply, want", [
    ('{"artists": ["A", "", "B"], "era": "80s", "genres": "folk", "user_query": "q"}', "A, B folk 80s q"),
    ('```json\n{"moods": ["sad"]}\n```', "sad"),
    ('{"artists": [], "era": null}', "raw"), ("broken {", "raw"), (None, "raw"),
])
def test_entity_query(spark, reply, want):
    assert one(spark, reply, lambda c: replies.entity_query(c, F.lit("raw"))) == want


def test_facets_and_scores(spark):
    facets = lambda c: replies.facet_queries(c, F.lit("talk"))
    assert one(spark, '{"q1": "x", "q3": "z"}', facets) == ["x", "z"]
    assert one(spark, "oops", facets) == ["talk"]
    got = one(spark, 'a {"personalization": "4", "explanation": 3.5} b', replies.parse_scores)
    assert (got["personalization"], got["explanation"], got["reasoning"]) == (4.0, 3.5, "")
    for bad in ('{"personalization": 6, "explanation": 3}', '{"personalization": 4}', "none", None):
        assert one(spark, bad, replies.parse_scores) is None


@pytest.mark.parametrize("value, rules, want", [
    (None, gates.PLAIN, "missing"), ("x" * 49, gates.PLAIN, "too_short"), ("x" * 50, gates.PLAIN, None),
    ("[" + "x" * 60, gates.PLAIN, "json"), ("You asked. " + "x" * 50, gates.USER_FIRST, None),
    ("The track. you " + "x" * 50, gates.USER_FIRST, "not_user_first"),
    ("Since you like it " + "x" * 50, gates.USER_FIRST, None),
    ("x" * 39 + " you " + "x" * 50, gates.USER_FIRST, "not_user_first"),
    ("x" * 39 + " you — " + "x" * 50, gates.EXPLAINED, None),
    ("You asked " + "x" * 60, gates.EXPLAINED, "no_connector"),
])
def test_gates(spark, value, rules, want):
    assert one(spark, value, lambda c: gates.gate_reason(c, rules)) == want


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "x array<float>, y array<float>")
    got = df.select(normalize(F.col("x")), dot(F.col("x"), F.col("y"))).collect()
    assert got[0][0] == pytest.approx([0.6, 0.8]) and got[0][1] == 11.0
    assert got[1][0] == [0.0, 0.0]
