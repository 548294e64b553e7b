"""Session shaping: turns, targets, histories, ground truth.

A turn table has (session_id, turn_number, pos, role, content); ``pos`` orders
the rows of one turn. Per-session picks are aggregates, not windows: they are
combined within each task before the shuffle, whatever the session length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.functions import text as X
from rankflow.operators.joins import lookup

TURN_COLUMNS = ("session_id", "turn_number", "pos", "role", "content")


def flatten_sessions(sessions: DataFrame) -> DataFrame:
    """One row per turn row of nested sessions."""
    rows = sessions.select("session_id", "user_id",
                           F.posexplode("conversations").alias("pos", "turn"))
    return rows.select("session_id", "user_id", F.col("turn.turn_number"), "pos",
                       F.col("turn.role"), F.col("turn.content"))


def with_role(turns: DataFrame, role: str) -> DataFrame:
    return turns.filter(F.col("role") == role)


def _at(pick, value: Column) -> Column:
    return pick(value, F.struct("turn_number", "pos"))


def last_user_turn(turns: DataFrame) -> DataFrame:
    """(session_id, turn_number, query) of each session's last user row."""
    last = with_role(turns, "user").groupBy("session_id").agg(
        _at(F.max_by, F.struct("turn_number", "content")).alias("last"))
    return last.select("session_id", F.col("last.turn_number"), F.col("last.content").alias("query"))


def all_user_turns(turns: DataFrame) -> DataFrame:
    """(session_id, turn_number, pos, query) of every user row."""
    return with_role(turns, "user").select(
        "session_id", "turn_number", "pos", F.col("content").alias("query"))


def turn_grid(turns: DataFrame, first: int = 1, last: int = 8) -> DataFrame:
    """(session_id, turn_number, query) for a fixed range of turns.

    The query is the first row of the turn, of whatever role.
    """
    return (turns.filter(F.col("turn_number").between(first, last))
            .groupBy("session_id", "turn_number")
            .agg(F.min_by("content", "pos").alias("query")))


def history(turns: DataFrame, targets: DataFrame) -> DataFrame:
    """All rows of earlier turns per target (session_id, turn_number).

    The target's turn is carried as ``target_turn``.
    """
    t = targets.select("session_id", F.col("turn_number").alias("target_turn")).distinct()
    return turns.join(t, "session_id").filter(F.col("turn_number") < F.col("target_turn"))


def upto(turns: DataFrame, targets: DataFrame) -> DataFrame:
    """All rows of the target's turn and of earlier ones, per target (session_id, turn_number)."""
    t = targets.select("session_id", F.col("turn_number").alias("target_turn")).distinct()
    return turns.join(t, "session_id").filter(F.col("turn_number") <= F.col("target_turn"))


def history_window(turns: DataFrame) -> DataFrame:
    """User rows with the array of all rows of earlier turns."""
    frame = (Window.partitionBy("session_id").orderBy("turn_number")
             .rangeBetween(Window.unboundedPreceding, -1))
    row = F.struct("turn_number", "pos", "role", "content")
    return (turns.withColumn("history", F.array_sort(F.collect_list(row).over(frame)))
            .filter(F.col("role") == "user")
            .select("session_id", "turn_number", "pos", F.col("content").alias("query"), "history"))


def with_catalog(turns: DataFrame, catalog: DataFrame) -> DataFrame:
    """Turn rows with the catalogue fields of the music rows (left outer).

    Only music rows meet the catalogue; the texts of the others stay where they are.
    """
    music = F.coalesce(F.col("role") == "music", F.lit(False))
    played = turns.filter(music).withColumn("track_id", X.strip(F.col("content")))
    named = lookup(played, catalog, ["track_id"], "left", salt_by=["session_id", "turn_number"])
    return named.unionByName(turns.filter(~music), allowMissingColumns=True)


def remap_roles(turns: DataFrame, catalog: DataFrame, system_too: bool = False) -> DataFrame:
    """Music rows become assistant rows with display text.

    ``system_too`` turns system rows into assistant rows as well. A track that
    is not in the catalogue shows its id only.
    """
    shown = catalog.select("track_id", X.display_text().alias("display"))
    rows = with_catalog(turns, shown)
    music = F.col("role") == "music"
    unknown = F.concat(F.lit("track_id: "), F.col("track_id"))
    moved = music | (F.col("role") == "system") if system_too else music
    return rows.select(
        "session_id", "turn_number", "pos",
        F.when(moved, "assistant").otherwise(F.col("role")).alias("role"),
        F.when(music, F.coalesce("display", unknown)).otherwise(F.col("content")).alias("content"),
        *[c for c in turns.columns if c not in TURN_COLUMNS])


def played_text() -> Column:
    """``track by artist`` of a music row, without the artist if there is none."""
    artist = X.nonblank(F.array_join("artist_name", ", "))
    return F.concat(X.track_text(), F.coalesce(F.concat(F.lit(" by "), artist), F.lit("")))


def session_memory(turns: DataFrame, targets: DataFrame, catalog: DataFrame) -> DataFrame:
    """Readable memory per target, in long form (…, seq, role, content).

    Played tracks are named; the target's query comes last as a user row.
    """
    rows = with_catalog(history(turns, targets), catalog)
    music = F.col("role") == "music"
    past = rows.select(
        "session_id", F.col("target_turn"), F.struct("turn_number", "pos").alias("seq"),
        F.when(music, "assistant").otherwise(F.col("role")).alias("role"),
        F.when(music, F.concat(F.lit("[Played: "), played_text(), F.lit("]")))
        .otherwise(F.col("content")).alias("content"))
    current = targets.select(
        "session_id", F.col("turn_number").alias("target_turn"),
        F.struct(F.col("turn_number"), F.lit(0).cast(turns.schema["pos"].dataType).alias("pos"))
        .alias("seq"),
        F.lit("user").alias("role"), F.col("query").alias("content"))
    return past.unionByName(current)


def memory_array(memory: DataFrame) -> DataFrame:
    """Memory rows packed to one ordered array of (role, content) per target."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "role", "content")))
    return memory.groupBy("session_id", "target_turn").agg(
        F.transform(rows, lambda r: F.struct(r["role"].alias("role"),
                                             r["content"].alias("content"))).alias("memory"))


def ground_truth_first(turns: DataFrame) -> DataFrame:
    """(session_id, turn_number, truth): first music row of each turn."""
    return (with_role(turns, "music").groupBy("session_id", "turn_number")
            .agg(F.min_by("content", "pos").alias("truth")))


def ground_truth_last(turns: DataFrame) -> DataFrame:
    """(session_id, turn_number, truth): last music row of each turn, trimmed."""
    return (with_role(turns, "music").groupBy("session_id", "turn_number")
            .agg(F.max_by(X.strip(F.col("content")), F.col("pos")).alias("truth")))


def profiles(users: DataFrame) -> DataFrame:
    """(user_id, profile) with the one-line profile text."""
    return users.select("user_id", X.profile_text().alias("profile"))
