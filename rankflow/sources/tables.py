"""Readers that bring catalogue, session, prediction and score files into shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow import schemas
from rankflow.sources.splits import last_wins


def _as_array(df: DataFrame, field: str) -> Column:
    value = F.col(field)
    if isinstance(df.schema[field].dataType, T.ArrayType):
        return value.cast("array<string>")
    return F.when(value.isNotNull(), F.array(value.cast("string")))


def _as_scalar(df: DataFrame, field: str) -> Column:
    value = F.col(field)
    if isinstance(df.schema[field].dataType, T.ArrayType):
        value = F.get(value, F.lit(0))
    return value.cast("string")


def normalize_catalog(df: DataFrame) -> DataFrame:
    """Catalogue with list-or-scalar fields settled, one row per track, last split wins."""
    wanted = []
    for field in schemas.CATALOG.names:
        if field not in df.columns:
            wanted.append(F.lit(None).cast(schemas.CATALOG[field].dataType).alias(field))
        elif field in ("artist_name", "tag_list"):
            wanted.append(_as_array(df, field).alias(field))
        else:
            wanted.append(_as_scalar(df, field).alias(field))
    order = F.col("split_no") if "split_no" in df.columns else F.lit(0)
    rows = df.select(*wanted, order.alias("split_no"))
    return last_wins(rows, "track_id", "split_no", "track_name").drop("split_no")


def normalize_users(df: DataFrame) -> DataFrame:
    """User profiles, one row per user, last split wins."""
    order = F.col("split_no") if "split_no" in df.columns else F.lit(0)
    rows = df.select(*[F.col(c).cast("string") for c in schemas.USER.names],
                     order.alias("split_no"))
    return last_wins(rows, "user_id", "split_no", "age_group").drop("split_no")


def read_sessions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Sessions with nested turns, declared schema."""
    return spark.read.format(fmt).schema(schemas.SESSION).load(path)


def first_sessions(sessions: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` sessions by id; all of them if ``n`` is not given."""
    return sessions.orderBy("session_id").limit(n) if n else sessions


def read_predictions(spark: SparkSession, path: str, fmt: str = "json",
                     multiline: bool = False) -> DataFrame:
    """Prediction rows. ``multiline`` reads one JSON array per file."""
    reader = spark.read.format(fmt).schema(schemas.PREDICTION)
    if fmt == "json":
        reader = reader.option("multiLine", multiline)
    return reader.load(path)


def unpack_predictions(predictions: DataFrame) -> DataFrame:
    """Long ranked table (session_id, turn_number, track_id, rank) of prediction rows."""
    return predictions.select(
        "session_id", "turn_number",
        F.posexplode("predicted_track_ids").alias("pos", "track_id"),
    ).select("session_id", "turn_number", "track_id", (F.col("pos") + 1).alias("rank"))


def read_judge_scores(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Score table of files that hold a map from session to judge scores, one
    indented object per file or, without ``multiline``, one object per line. The
    means of the files' header come with every row."""
    fields = T.StructType([
        T.StructField("proxy_avg", T.DoubleType()), T.StructField("known_gemini", T.DoubleType()),
        T.StructField("sessions", T.MapType(T.StringType(), schemas.JUDGE_SCORE)),
    ])
    rows = spark.read.schema(fields).json(path, multiLine=multiline)
    return (rows.select("proxy_avg", "known_gemini", F.explode("sessions").alias("session_id", "s"))
            .select("session_id", "s.*", "proxy_avg", "known_gemini"))
