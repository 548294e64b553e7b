from pyspark.sql import functions as F

from rankflow.operators import queries, render, sessions
from tests.conftest import rows


def test_targets(turns):
    assert rows(sessions.last_user_turn(turns)) == [("s1", 3, "something calm"), ("s2", 1, "hello there")]
    assert len(rows(sessions.all_user_turns(turns))) == 4
    assert ("s2", 1, "start") in rows(sessions.turn_grid(turns))


def test_history_forms_agree(turns):
    window = sessions.history_window(turns)
    targets = sessions.all_user_turns(turns)
    theta = sessions.history(turns, targets).groupBy("session_id", F.col("target_turn").alias("turn_number")).count()
    sizes = {(r[0], r[1]): r[2] for r in window.select("session_id", "turn_number", F.size("history")).collect()}
    for s, t, n in rows(theta):
        assert sizes.pop((s, t)) == n
    assert set(sizes.values()) == {0}


def test_ground_truth(turns):
    assert rows(sessions.ground_truth_first(turns)) == [("s1", 1, " a "), ("s1", 2, "x")]
    assert rows(sessions.ground_truth_last(turns)) == [("s1", 1, "a"), ("s1", 2, "b")]


def test_memory_names_played_tracks(turns, catalog):
    memory = sessions.memory_array(sessions.session_memory(turns, sessions.last_user_turn(turns), catalog))
    got = {r["session_id"]: [(m["role"], m["content"]) for m in r["memory"]] for r in memory.collect()}
    assert got["s1"] == [
        ("user", "play rock"), ("assistant", "[Played: Alpha by One]"), ("assistant", "here you go"),
        ("user", "more pop"), ("assistant", "[Played: x]"), ("assistant", "[Played: Beta by Two, Three]"),
        ("user", "something calm")]
    assert got["s2"] == [("user", "hello there")]


def test_role_remap(turns, catalog):
    got = {(r["session_id"], r["turn_number"], r["pos"]): (r["role"], r["content"])
           for r in sessions.remap_roles(turns, catalog, system_too=True).collect()}
    assert got["s1", 1, 1][0] == "assistant" and got["s1", 1, 1][1].startswith("track_id: a, track_name: alpha")
    assert got["s1", 2, 1] == ("assistant", "track_id: x")
    assert got["s2", 1, 0] == ("assistant", "start")


def test_weighted_query(turns, catalog):
    parts = queries.query_parts(turns, sessions.last_user_turn(turns), catalog)
    text = {r[0]: r[2] for r in queries.query_text(parts).collect()}
    assert text["s1"] == ("One rock loud Two Three pop play rock more pop more pop "
                          "something calm something calm something calm")
    assert text["s2"] == "hello there hello there hello there"
    terms = queries.query_terms(parts.select(F.col("session_id").alias("query_id"), "text", "weight"))
    got = {(r[0], r[1]): r[2] for r in terms.collect()}
    assert got["s1", "rock"] == 2 and got["s1", "pop"] == 3 and got["s1", "calm"] == 3


def test_plain_query(turns):
    got = {r[0]: r[2] for r in queries.plain_query(turns, sessions.last_user_turn(turns)).collect()}
    assert got["s1"].startswith("user: play rock\nmusic:  a \nassistant: here you go\n")
    assert got["s1"].endswith("\nUser: something calm")


def test_rendered_turns(turns, catalog):
    targets = sessions.last_user_turn(turns)
    past = sessions.history(turns, targets)
    played = {r[0]: r[1] for r in render.render_turns(past, "played", catalog, targets).collect()}
    assert played["s1"] == ("User: play rock\n[Track played: Alpha by One]\nUser: more pop\n"
                            "[Track played: x by Unknown Artist]\n[Track played: Beta by Two, Three]\n"
                            "User (latest): something calm")
    assert played["s2"] == "User (latest): hello there"
    judged = {r[0]: r[1] for r in render.render_turns(turns, "judge").collect()}
    assert "Assistant: here you go..." in judged["s1"]
    only_bot = turns.filter(F.col("role") == "system")
    assert [r[1] for r in render.render_turns(only_bot, "quoted").collect()] == ["(no prior conversation)"]


def test_template_response(spark, catalog):
    def respond(ids):
        ranked = spark.createDataFrame([("q", i, n) for n, i in enumerate(ids, 1)],
                                       "query_id string, item_id string, rank int")
        return render.template_response(ranked, catalog).first()["response"]

    assert respond(["x", "d"]) == render.NO_TRACKS
    assert respond(["a", "x"]).startswith('Here are my top picks for you: "Alpha" by One — plus 1 more')
    # the second track of an artist is passed over whatever its case
    assert '"Alpha" by One, and "Beta" by Two Three — plus 1 more' in respond(["a", "c", "b"])
    assert '"Alpha" by One, "Beta" by Two Three, and "Epsilon" by Five — plus 3' in respond(
        ["a", "b", "e", "x", "y", "z"])


def test_candidate_styles(spark, catalog):
    ranked = spark.createDataFrame([("q", "d", 1), ("q", "x", 2)], "query_id string, item_id string, rank int")
    got = {s: render.render_candidates(ranked, catalog, s).first()["candidates"].split("\n")
           for s in render.STYLE_TAGS}
    assert got["tagged"] == ["1. [d] Delta — Unknown Artist | tags: jazz, calm, late, night, sax, slow",
                             "2. [x] x — Unknown Artist | tags: "]
    assert got["dated"][0].startswith("1. [d] Delta (2010) — Unknown Artist")
    assert got["quoted"][1] == '2. "x" by Unknown Artist'
    assert got["bullet"][0] == "- Delta by Unknown | jazz, calm, late, night"
    assert got["fields"][0].startswith("1. [track_id: d] track_name: Delta | album_name: Fourth | release_year: 2010")
