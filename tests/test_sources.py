import json

import pytest
from pyspark.sql import functions as F

from rankflow.operators import joins
from rankflow.session import scratch_path
from rankflow.sources import sinks, splits, tables
from tests.conftest import rows


@pytest.fixture
def root(spark):
    path = scratch_path(spark, "splits-test")
    old = spark.createDataFrame([("a", ["A one", "alias"], "X", None), ("b", ["B"], "Y", ["t"])],
                                "track_id string, track_name array<string>, artist_name string, tag_list array<string>")
    new = spark.createDataFrame([("a", ["A two"], "Z", ["u", "v"])], old.schema)
    old.write.parquet(f"{path}/split=old")
    new.write.parquet(f"{path}/split=train")
    return path


def test_splits(spark, root):
    assert splits.available_splits(spark, root) == ["old", "train"]
    assert splits.read_splits(spark, root).count() == 3
    assert splits.read_splits(spark, root, ["old", "none"], skip_missing=True).count() == 2
    with pytest.raises(ValueError):
        splits.read_splits(spark, root, ["old", "none"])
    assert splits.read_preferred(spark, root).count() == 1
    assert splits.read_preferred(spark, root, prefer="none").count() == 2


def test_file_layout(spark, root):
    path = scratch_path(spark, "layout")
    splits.read_preferred(spark, root).drop("split_no").write.parquet(f"{path}/all_tracks-00000-of-00001.parquet")
    layout = "{root}/{split}-00000-of-00001.parquet"
    assert splits.available_splits(spark, path, layout) == ["all_tracks"]
    assert splits.read_splits(spark, path, ["all_tracks"], layout=layout).count() == 1


def test_catalog_last_split_wins(spark, root):
    got = tables.normalize_catalog(splits.read_splits(spark, root))
    assert rows(got, "track_id", "track_name", "artist_name", "tag_list") == [
        ("a", "A two", ["Z"], ["u", "v"]), ("b", "B", ["Y"], ["t"])]


def test_prediction_formats(spark):
    path = scratch_path(spark, "pred-test")
    ranked = spark.createDataFrame([("s", 1, "b", 2), ("s", 1, "a", 1), ("s", 1, "c", 3)],
                                   "session_id string, turn_number int, item_id string, rank int")
    targets = spark.createDataFrame([("s", "u", 1), ("t", "u", 4)], "session_id string, user_id string, turn_number int")
    made = sinks.prediction_rows(targets, ranked, k=2)
    sinks.write_predictions(made, path)
    back = tables.read_predictions(spark, path)
    assert rows(back, "session_id", "predicted_track_ids", "predicted_response") == [("s", ["a", "b"], ""), ("t", [], "")]
    assert rows(tables.unpack_predictions(back), "track_id", "rank") == [("a", 1), ("b", 2)]
    one_file = f"{path}-array"
    text = json.dumps([r.asDict() for r in back.collect()], indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n\n").text(one_file)
    assert tables.read_predictions(spark, one_file, multiline=True).count() == 2


def test_judge_score_file(spark):
    path = scratch_path(spark, "judge-test")
    text = json.dumps({"proxy_avg": 3.0, "sessions": {
        "s": {"personalization": 4.0, "explanation": 2.0, "reasoning": "r"},
        "t": {"personalization": None, "explanation": None, "reasoning": "parse error"}}}, indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    assert rows(tables.read_judge_scores(spark, path), "session_id", "personalization") == [("s", 4.0), ("t", None)]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_lookup_with_a_crowded_key(spark, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        facts = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
        keyed = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
        got = joins.lookup(facts, keyed, ["k"], "left", salt_by=["id"])
        assert got.count() == 3000
        assert got.filter("v is not null and v != k * 10").count() == 0
        assert got.filter("v is not null").count() == facts.filter("k % 2 = 0").count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])
