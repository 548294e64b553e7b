"""Column expressions that read structured answers out of free reply text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankflow.functions.text import nonblank, strip

# Entity fields in the order they enter the query.
ENTITY_FIELDS = ("artists", "genres", "moods", "era", "instruments", "themes", "similar_to")

#: a fence that begins a line, with its language, or ends one
FENCE = r"(?m)^```(?:json)?\s*|```\s*$"


def strip_fences(reply: Column) -> Column:
    """Drop Markdown code fences around a reply."""
    return strip(F.regexp_replace(reply, FENCE, ""))


def array_part(reply: Column, greedy: bool = True) -> Column:
    """Text from the first ``[`` to the last (or first) ``]``; null without one."""
    pattern = r"(?s)\[.*\]" if greedy else r"(?s)\[.*?\]"
    return nonblank(F.regexp_extract(strip_fences(reply), pattern, 0))


def object_part(reply: Column) -> Column:
    """Text from the first ``{`` to the last ``}``; null without one."""
    return nonblank(F.regexp_extract(strip_fences(reply), r"(?s)\{.*\}", 0))


def null_if_empty(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def parse_id_array(reply: Column, valid: Column, k: int | None = None,
                   greedy: bool = True) -> Column:
    """Ids of a JSON array reply that are among the valid ones, first mention first.

    Null if there is no readable array or no valid id in it.
    """
    ids = F.from_json(array_part(reply, greedy), "array<string>")
    kept = F.array_distinct(F.filter(ids, lambda x: F.array_contains(valid, x)))
    return null_if_empty(F.slice(kept, 1, k) if k else kept)


def parse_rank_object(reply: Column, valid: Column) -> Column:
    """Struct (ranked, response) of a combined reply; null unless both are usable."""
    parsed = F.from_json(object_part(reply), "ranked_tracks array<string>, response string")
    ranked = null_if_empty(F.array_distinct(
        F.filter(parsed["ranked_tracks"], lambda x: F.array_contains(valid, x))))
    response = nonblank(strip(parsed["response"]))
    return F.when(ranked.isNotNull() & response.isNotNull(),
                  F.struct(ranked.alias("ranked"), response.alias("response")))


def _list_or_scalar(raw: Column) -> Column:
    """A JSON list joined by commas without its empty entries, or the scalar itself."""
    entries = F.from_json(F.when(raw.startswith("["), raw), "array<string>")
    joined = F.array_join(F.filter(entries, lambda x: x != ""), ", ")
    return nonblank(F.coalesce(joined, raw))


def entity_query(reply: Column, user_query: Column) -> Column:
    """Retrieval query from an entity object; the user's query if nothing is usable."""
    fields = ", ".join(f"{f} string" for f in (*ENTITY_FIELDS, "user_query"))
    parsed = F.from_json(object_part(reply), fields)
    parts = [_list_or_scalar(parsed[f]) for f in ENTITY_FIELDS]
    built = F.concat_ws(" ", *parts, nonblank(parsed["user_query"]))
    return F.coalesce(F.when(strip(built) != "", built), user_query)


def facet_queries(reply: Column, fallback: Column, n: int = 3) -> Column:
    """Array of the facet queries ``q1..qn`` that are present; else the fallback text."""
    names = [f"q{i}" for i in range(1, n + 1)]
    parsed = F.from_json(object_part(reply), ", ".join(f"{q} string" for q in names))
    found = F.array_compact(F.array(*[parsed[q] for q in names]))
    return F.coalesce(null_if_empty(found), F.array(fallback))


def parse_scores(reply: Column, low: float = 1.0, high: float = 5.0) -> Column:
    """Struct (personalization, explanation, reasoning) of a judge reply.

    Null unless both scores are numbers within the scale.
    """
    def scores(parsed: Column) -> Column:
        p = parsed["personalization"].try_cast("double")
        e = parsed["explanation"].try_cast("double")
        return F.when(
            p.between(low, high) & e.between(low, high),
            F.struct(p.alias("personalization"), e.alias("explanation"),
                     F.coalesce(parsed["reasoning"], F.lit("")).alias("reasoning")))

    # bound by a lambda, the reply is parsed once; else once for each use of a field
    parsed = F.from_json(object_part(reply), "personalization string, explanation string, reasoning string")
    return F.get(F.transform(F.array(parsed), scores), F.lit(0))
