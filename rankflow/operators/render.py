"""Text for prompts and responses: conversations, candidates, templates."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.functions import text as X
from rankflow.operators.joins import lookup
from rankflow.operators.sessions import upto, with_catalog

# Styles of a rendered conversation. Per role the line format, the
# last line with the query, and the text of an empty conversation.
TURN_STYLES: dict[str, dict] = {
    "roles": {"any": "{Role}: {content}", "query": "User: {query}",
              "empty": "(no prior conversation)"},
    "played": {"music": "[Track played: {track} by {artist}]", "user": "User: {content}",
               "query": "User (latest): {query}", "empty": ""},
    "previously": {"music": "[Previously played: {track} by {artist}]", "user": "User: {content}",
                   "query": "User: {query}", "empty": ""},
    "quoted": {"music": "[Track played: {content}]", "user": 'User: "{content}"',
               "empty": "(no prior conversation)"},
    "judge": {"music": "[Track played: {content}]", "user": "User: {content}",
              "assistant": "Assistant: {short}...", "empty": "(no history)"},
}

#: shown characters of an assistant turn in the judge style
ASSISTANT_CHARS = 100


def _fill(template: str, values: Mapping[str, Column]) -> Column:
    """Concatenation of a format string with columns in place of its fields."""
    parts: list[Column] = []
    for piece in template.split("{"):
        field, closed, rest = piece.partition("}")
        if closed:
            parts.append(values[field])
            piece = rest
        if piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def render_turns(turns: DataFrame, style: str, catalog: DataFrame | None = None,
                 targets: DataFrame | None = None, key: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """(key…, conversation): the turns of each key as text in one of the styles.

    ``targets`` (key…, query) adds the query as last line where the style has one,
    and gives keys without any turn a row. Lines keep the order (turn, pos).
    """
    spec = TURN_STYLES[style]
    named = any("{track}" in v for v in spec.values())
    rows = with_catalog(turns, catalog) if named else turns
    values = {"content": F.col("content"), "Role": X.capitalized(F.col("role")),
              "short": F.substring("content", 1, ASSISTANT_CHARS)}
    if named:
        values |= {"track": X.track_text(), "artist": X.artist_text()}
    if "any" in spec:
        line = _fill(spec["any"], values)
    else:
        roles = [r for r in ("music", "user", "assistant") if r in spec]
        line = reduce(lambda c, r: c.when(F.col("role") == r, _fill(spec[r], values)), roles, F)
    text = rows.groupBy(*key).agg(
        X.in_order(F.struct("turn_number", "pos"), line).alias("conversation"))
    if targets is not None:
        text = targets.select(*key, "query").join(text, list(key), "left")
        if "query" in spec:
            last = _fill(spec["query"], {"query": F.col("query")})
            text = text.withColumn("conversation", F.concat_ws(
                "\n", X.nonblank(F.col("conversation")), last))
    return text.select(*key, F.coalesce(X.nonblank(F.col("conversation")),
                                        F.lit(spec["empty"])).alias("conversation"))


def render_upto(turns: DataFrame, targets: DataFrame, style: str, catalog: DataFrame | None = None) -> DataFrame:
    """(session_id, turn_number, conversation): what was said up to each target turn, that turn included."""
    rows = upto(turns, targets)
    return render_turns(rows, style, catalog, key=("session_id", "target_turn")).withColumnRenamed("target_turn", "turn_number")


def _candidate_line(style: str, tags: int) -> Column:
    number = F.col("rank").cast("string")
    item, track = F.col("track_id"), X.track_text()
    shown = X.tags_text(tags)
    if style == "tagged":
        return _fill("{n}. [{id}] {t} — {a} | tags: {g}", {
            "n": number, "id": item, "t": track, "a": X.artist_text(), "g": shown})
    if style == "dated":
        year = X.nonblank(F.substring("release_date", 1, 4))
        year = F.coalesce(F.concat(F.lit(" ("), year, F.lit(")")), F.lit(""))
        return _fill("{n}. [{id}] {t}{y} — {a} | {g}", {
            "n": number, "id": item, "t": track, "y": year, "a": X.artist_text(), "g": shown})
    if style == "quoted":
        bracket = F.when(shown != "", F.concat(F.lit(" ["), shown, F.lit("]"))).otherwise("")
        return _fill('{n}. "{t}" by {a}{g}', {
            "n": number, "t": track, "a": X.artist_text(), "g": bracket})
    if style == "bullet":
        return _fill("- {t} by {a} | {g}", {"t": track, "a": X.artist_text("Unknown"), "g": shown})
    if style == "fields":
        artists = X.nonblank(F.array_join("artist_name", ", "))
        all_tags = X.nonblank(F.array_join("tag_list", ", "))
        year = X.nonblank(F.substring("release_date", 1, 4))
        pairs = [("track_name", X.nonblank(F.col("track_name"))), ("artist_name", artists),
                 ("album_name", X.nonblank(F.col("album_name"))), ("release_year", year),
                 ("tag_list", all_tags)]
        meta = F.concat_ws(" | ", *[F.concat(F.lit(f"{n}: "), c) for n, c in pairs])
        return _fill("{n}. [track_id: {id}] {m}", {"n": number, "id": item, "m": meta})
    raise ValueError(f"unknown candidate style: {style}")


#: tags shown per candidate style
STYLE_TAGS = {"tagged": 6, "dated": 6, "quoted": 6, "bullet": 4, "fields": 0}


def candidate_lines(ranked: DataFrame, catalog: DataFrame, style: str,
                    tags: int | None = None) -> DataFrame:
    """Ranked rows with a ``line`` of candidate text; unknown items show their id."""
    rows = lookup(ranked.withColumn("track_id", F.col("item_id").cast("string")), catalog,
                  ["track_id"], "left", salt_by=["query_id"])
    return rows.select("query_id", "rank", _candidate_line(
        style, STYLE_TAGS[style] if tags is None else tags).alias("line"))


def render_candidates(ranked: DataFrame, catalog: DataFrame, style: str, n: int | None = None,
                      tags: int | None = None) -> DataFrame:
    """(query_id, candidates): candidate lines in rank order."""
    rows = ranked.filter(F.col("rank") <= n) if n else ranked
    return candidate_lines(rows, catalog, style, tags).groupBy("query_id").agg(
        X.in_order(F.col("rank"), F.col("line")).alias("candidates"))


# The wording of the template response.
NO_TRACKS = "Here are some tracks I think you'll enjoy based on our conversation!"
RESPONSE = ("Here are my top picks for you: {recs} — plus {extra} more tracks I think you'll love. "
            "Let me know if you'd like something more specific!")


def template_response(ranked: DataFrame, catalog: DataFrame, shown: int = 5) -> DataFrame:
    """(query_id, response): a fixed sentence naming one track per artist.

    Only the first ``shown`` ranks are considered; tracks without a name or an
    artist are passed over.
    """
    totals = ranked.groupBy("query_id").agg(F.count("*").alias("n_items"))
    head = ranked.filter(F.col("rank") <= shown).withColumn("track_id", F.col("item_id").cast("string"))
    rows = lookup(head, catalog, ["track_id"], "inner", salt_by=["query_id"])
    artist = X.nonblank(F.array_join("artist_name", " "))
    named = rows.select("query_id", "rank", X.nonblank(F.col("track_name")).alias("track"),
                        artist.alias("artist")).dropna(subset=["track", "artist"])
    one_each = named.groupBy("query_id", F.lower("artist").alias("who")).agg(
        F.min_by(F.struct("rank", "track", "artist"), "rank").alias("r"))
    quoted = F.concat(F.lit('"'), F.col("r.track"), F.lit('" by '), F.col("r.artist"))
    lines = F.array_sort(F.collect_list(F.struct(F.col("r.rank").alias("o"), quoted.alias("line"))))
    picks = one_each.groupBy("query_id").agg(F.transform(lines, lambda x: x["line"]).alias("picks"))
    n = F.size("picks")
    front = F.array_join(F.slice("picks", F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    final = F.element_at("picks", -1)
    recs = F.when(n > 1, F.concat(front, F.lit(", and "), final)).otherwise(final)
    text = _fill(RESPONSE, {"recs": recs, "extra": (F.col("n_items") - n).cast("string")})
    return totals.join(picks, "query_id", "left").select(
        "query_id", F.coalesce(text, F.lit(NO_TRACKS)).alias("response"))


def fill_prompt(template: str, **columns: Column) -> Column:
    """A caller's prompt template with its ``{field}`` places filled from columns."""
    return _fill(template, {k: F.coalesce(v, F.lit("")) for k, v in columns.items()})


def system_prompt(role: str, instructions: str, personal: str, profile: Column) -> Column:
    """System prompt; the personal part is added only for users with a profile."""
    base = F.lit(f"{role}\n{instructions}")
    extra = F.concat(F.lit(f"\n{personal}\n"), X.nonblank(profile))
    return F.concat(base, F.coalesce(extra, F.lit("")))
