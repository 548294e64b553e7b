"""Column expressions over text: tokens, catalogue texts, display forms."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The short English stop-word list of the common BM25 defaults.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in",
    "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)

#: letters, digits and underscores of any script; a word is a run of two or more
WORD_CHARS = r"\p{L}\p{N}_"
WORD_PATTERN = f"[{WORD_CHARS}]{{2,}}"

# The catalogue fields in display and indexing order.
LEXICAL_FIELDS = ("track_name", "artist_name", "album_name", "tag_list")
DISPLAY_FIELDS = ("track_name", "artist_name", "album_name", "release_date", "tag_list")
ARRAY_FIELDS = ("artist_name", "tag_list")

WHITESPACE = " \t\n\r\f\v"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def nonblank(text: Column) -> Column:
    """The text, or null if it is empty."""
    return F.nullif(text, F.lit(""))


def word_tokens(text: Column) -> Column:
    """Every word of the lower-cased text, stop words included."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def spaced_words(text: Column) -> Column:
    """The lower-cased text with one blank for all between its words; single letters stay."""
    return F.regexp_replace(F.lower(text), F.lit(f"[^{WORD_CHARS}]+"), F.lit(" "))


def tokens(text: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Index tokens of a text: lower-cased words without stop words."""
    stop = [w for w in stop_words]
    words = word_tokens(text)
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def blank_tokens(text: Column) -> Column:
    """Set of lower-cased blank-separated words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\S+"), F.lit(0)))


def jaccard_distance(left: Column, right: Column) -> Column:
    """1 - |a ∩ b| / |a ∪ b| of two word sets; null if both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, 1 - F.size(F.array_intersect(left, right)) / union)


def _field_text(field: str, separator: str, limit: int | None = None) -> Column:
    value = F.col(field)
    if field in ARRAY_FIELDS:
        if limit is not None:
            value = F.slice(value, 1, limit)
        value = F.array_join(value, separator)
    return value


def lexical_text(fields: Sequence[str] = LEXICAL_FIELDS) -> Column:
    """Index text: the fields joined by blanks, lists flattened, nulls skipped."""
    return F.concat_ws(" ", *[_field_text(f, " ") for f in fields])


def _labelled(fields: Sequence[str]) -> list[Column]:
    return [F.concat(F.lit(f"{f}: "), _field_text(f, ", ")) for f in fields]


def passage_text(fields: Sequence[str] = LEXICAL_FIELDS) -> Column:
    """Encoder text ``passage: field: value; field: a, b``."""
    return F.concat(F.lit("passage: "), F.concat_ws("; ", *_labelled(fields)))


def field_dump(fields: Sequence[str] = LEXICAL_FIELDS) -> Column:
    """``field: value`` lines of the chosen fields."""
    return F.concat_ws("\n", *_labelled(fields))


def display_text(id_col: str = "track_id") -> Column:
    """One-line display form: lower-cased values, five list entries, year only."""
    parts = [F.concat(F.lit("track_id: "), F.col(id_col))]
    for field in DISPLAY_FIELDS:
        value = _field_text(field, ", ", limit=5)
        if field == "release_date":
            value = F.substring(value, 1, 4)
        parts.append(F.concat(F.lit(f"{field}: "), F.lower(value)))
    return F.concat_ws(", ", *parts)


def query_text(text: Column) -> Column:
    """Encoder form of a query."""
    return F.concat(F.lit("query: "), text)


def artist_text(default: str = "Unknown Artist", separator: str = ", ") -> Column:
    """Artists joined; the default if there is none."""
    return F.coalesce(nonblank(F.array_join("artist_name", separator)), F.lit(default))


def track_text(id_col: str = "track_id") -> Column:
    """Track name; the id if the track is unknown."""
    return F.coalesce(F.col("track_name"), F.col(id_col))


def tags_text(n: int) -> Column:
    """First ``n`` tags joined by commas; empty without tags."""
    return F.coalesce(F.array_join(F.slice("tag_list", 1, n), ", "), F.lit(""))


def capitalized(text: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def profile_text(fields: Sequence[str] = ("age_group", "gender", "country")) -> Column:
    """``age_group: x, gender: y, country: z`` with blank fields left out."""
    return F.concat_ws(", ", *[
        F.when(nonblank(F.col(f)).isNotNull(), F.concat(F.lit(f"{f}: "), F.col(f)))
        for f in fields
    ])


def short_id(text: Column, n: int = 8) -> Column:
    """Leading characters of an id, for reports."""
    return F.substring(text, 1, n)


def in_order(order: Column, line: Column, separator: str = "\n") -> Column:
    """Aggregate: the group's lines joined in the given order, null lines left out."""
    # sort_array compares natively, array_sort by an interpreted function for every pair
    rows = F.sort_array(F.collect_list(F.struct(order.alias("o"), line.alias("line"))))
    return F.array_join(F.transform(rows, lambda r: r["line"]), separator)
