"""Declared schemas of the tables the operators exchange."""

from pyspark.sql import types as T

TURN = T.StructType([
    T.StructField("turn_number", T.IntegerType()),
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])

#: one row per session, turns nested
SESSION = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("conversations", T.ArrayType(TURN)),
])

CATALOG = T.StructType([
    T.StructField("track_id", T.StringType()),
    T.StructField("track_name", T.StringType()),
    T.StructField("artist_name", T.ArrayType(T.StringType())),
    T.StructField("album_name", T.StringType()),
    T.StructField("release_date", T.StringType()),
    T.StructField("tag_list", T.ArrayType(T.StringType())),
])

USER = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("age_group", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("country", T.StringType()),
])

PREDICTION = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("turn_number", T.IntegerType()),
    T.StructField("predicted_track_ids", T.ArrayType(T.StringType())),
    T.StructField("predicted_response", T.StringType()),
])

#: judge scores of one session as they stand in a score file
JUDGE_SCORE = T.StructType([
    T.StructField("personalization", T.DoubleType()),
    T.StructField("explanation", T.DoubleType()),
    T.StructField("reasoning", T.StringType()),
])

METRICS = T.StructType([
    T.StructField("ndcg20", T.DoubleType()),
    T.StructField("lexdiv", T.DoubleType()),
    T.StructField("n", T.LongType()),
])
