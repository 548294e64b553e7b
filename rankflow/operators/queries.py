"""Search queries built from conversations.

Weighted queries stay in long form (query_id, term, qtf): a repeated text is a
weight, and no session has to be gathered into one row to be searched with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.functions import text as X
from rankflow.operators.sessions import history, with_catalog

#: how often the last earlier user turn and the current query count
PRIOR_WEIGHT = 1
LAST_PRIOR_EXTRA = 1
CURRENT_WEIGHT = 3
TAGS_PER_TRACK = 5

_KEY = ["session_id", "target_turn"]


def query_parts(turns: DataFrame, targets: DataFrame, catalog: DataFrame | None) -> DataFrame:
    """Weighted texts per target: (session_id, target_turn, section, turn_number, pos, text, weight).

    Section 0 holds artists and tags of known played tracks, section 1 the earlier
    user turns, section 2 the last of these once more, section 3 the current query.
    """
    past = history(turns, targets).filter(F.col("role").isin("user", "music"))
    cols = [*_KEY, "section", "turn_number", "pos", "text", "weight"]

    def part(df: DataFrame, section: Column, text: Column, weight: int) -> DataFrame:
        return (df.withColumn("section", section).withColumn("text", text)
                .withColumn("weight", F.lit(weight)).select(*cols))

    music = F.col("role") == "music"
    if catalog is not None:
        known = X.nonblank(F.concat_ws(
            " ", F.array_join("artist_name", " "),
            F.array_join(F.slice("tag_list", 1, TAGS_PER_TRACK), " ")))
        said = part(with_catalog(past, catalog), F.when(music, 0).otherwise(1),
                    F.when(music, known).otherwise(F.col("content")), PRIOR_WEIGHT)
    else:
        said = part(past.filter(~music), F.lit(1), F.col("content"), PRIOR_WEIGHT)
    last = past.filter(~music).groupBy(*_KEY).agg(
        F.max_by(F.struct("turn_number", "pos", "content"), F.struct("turn_number", "pos")).alias("r"))
    again = part(last.select(*_KEY, "r.*"), F.lit(2), F.col("content"), LAST_PRIOR_EXTRA)
    current = part(
        targets.select("session_id", F.col("turn_number").alias("target_turn"), "turn_number",
                       F.lit(0).cast(turns.schema["pos"].dataType).alias("pos"), "query"),
        F.lit(3), F.col("query"), CURRENT_WEIGHT)
    return said.filter(F.col("text").isNotNull()).unionByName(again).unionByName(current)


def query_text(parts: DataFrame) -> DataFrame:
    """(session_id, target_turn, query_text): the weighted query written out."""
    repeated = F.array_join(F.array_repeat("text", F.col("weight")), " ")
    order = F.struct(F.when(F.col("section") == 2, 1).otherwise(F.col("section")),
                     "turn_number", "pos", "section")
    return parts.groupBy(*_KEY).agg(X.in_order(order, repeated, " ").alias("query_text"))


def query_terms(texts: DataFrame, stop_words=X.STOP_WORDS) -> DataFrame:
    """Term weights (query_id, term, qtf) of texts (query_id, text[, weight])."""
    weight = F.col("weight") if "weight" in texts.columns else F.lit(1)
    words = texts.select("query_id", weight.alias("weight"),
                         F.explode(X.tokens(F.col("text"), stop_words)).alias("term"))
    return words.groupBy("query_id", "term").agg(F.sum("weight").cast("long").alias("qtf"))


def plain_query(turns: DataFrame, targets: DataFrame) -> DataFrame:
    """(session_id, target_turn, query_text): ``role: content`` lines and the query."""
    line = F.concat_ws(": ", F.col("role"), F.col("content"))
    past = history(turns, targets).groupBy(*_KEY).agg(
        X.in_order(F.struct("turn_number", "pos"), line).alias("past"))
    t = targets.select("session_id", F.col("turn_number").alias("target_turn"), "query")
    current = F.when(X.nonblank(F.col("query")).isNotNull(),
                     F.concat(F.lit("\nUser: "), F.col("query"))).otherwise(F.lit(""))
    return t.join(past, _KEY, "left").select(
        *_KEY, F.concat(F.coalesce("past", F.lit("")), current).alias("query_text"))
