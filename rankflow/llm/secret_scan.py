"""Secret scans with multipart credential linking.

Strong finds stand alone: assignments to a secret's name, access identifiers, long
hexadecimal runs. Weak parts do not: an account or client name, a word that only looks
random, an endpoint. They are reported where parts that complete one another stand
within one scope: an identifier (weak or an access identifier) with a random-looking
word or an endpoint (of any scheme). A scope is a block of the text, from one blank line,
line of a section's name in brackets, or rule of hyphens or equals signs to the next; a
text without these is one scope. Neither parts nor scopes have an upper length.

Finds of all documents are rows of (document, kind, length, text before it), few against
the texts. Places come from running sums, a part's scope and the reach of the strong
finds before it from one pass over the finds of its document in order, so time grows
with the finds and not with their pairs. The interval join keeps a part if its scope
holds a complementary one wholly before or after it; as the first end and the last start
of each kind in a scope tell this, a part meets its scope's one row and not its parts.

Spans count code points, the end exclusive. Defined results: a null text counts as
empty and has no spans; rows are scanned one by one, so repeated rows have the same
spans each; an empty table has no rows. Only the id and text columns are read, whatever
other columns there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.llm.rows import ROW
from rankflow.session import materialize

#: Strong kinds in the order in which equal starts are listed, then the weak ones, then what parts scopes.
KINDS = ("assign", "access", "hex", "identifier", "random", "endpoint", "break")
STRONG = 3

ASSIGN = (r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
          r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
MIN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Words begin where no letter, digit or underscore of ASCII stands before.
WORD = r"(?<![A-Za-z0-9_])"
IDENTIFIER = WORD + (r"(?:user|username|login|account|client_id|access_key_id)[\"']?\x20*[:=]\x20*[\"']?"
                     r"[A-Za-z0-9_.@-]{3,}")
RANDOM = r"[A-Za-z0-9+/]{32,}={0,2}"
#: Any scheme, also one of several parts; possessive, so that long runs of words and hyphens are read once.
ENDPOINT = WORD + (r"(?:(?<!\w[+-])|(?=jdbc:))(?:jdbc:)?\w++(?:[+-]\w++)*+://"
                   r"[A-Za-z0-9_.:@/?&=%+-]{4,}")
BREAK = r"\n[\x20\t\r]*(?:(?:\[[^\]\n]*\]|-{3,}|={3,})[\x20\t\r]*)?\n"
PATTERNS = (ASSIGN, ACCESS, HEX, IDENTIFIER, RANDOM, ENDPOINT, BREAK)
#: What makes a weak part worth reporting: kinds that may complete it.
COMPLEMENTS = {"identifier": ("random", "endpoint"), "random": ("identifier", "access", "endpoint"),
               "endpoint": ("identifier", "access", "random")}


def finds_of(text: Column, kind: str) -> Column:
    """Array of (``kind``, ``k``, ``before``, ``size``, ``value``): the leftmost matches that do not overlap.

    The pieces between matches and the matches themselves alternate: ``before`` is the length of the piece before match
    ``k``. ``value`` is the length that must reach ``MIN_VALUE``; failing matches still take their place.
    """
    number = KINDS.index(kind)
    pattern = PATTERNS[number]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if kind == "assign" else found
    zipped = F.slice(F.arrays_zip(found.alias("m"), values.alias("v"), F.split(text, pattern).alias("p")), F.lit(1), F.size(found))
    finds = F.transform(zipped, lambda x, k: F.struct(
        F.lit(number).alias("order"), k.alias("k"), F.length(x["p"]).alias("before"), F.length(x["m"]).alias("size"),
        F.length(x["v"]).alias("value")))
    return F.when(text.rlike(pattern), finds).otherwise(F.array().cast(
        "array<struct<order:int,k:int,before:int,size:int,value:int>>"))


def parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Row number, ``doc_id``, ``order`` (of the kind), ``start``, ``end`` and ``scope`` of the strong finds and of the
    weak ones clear of them, in the shared folder; one row without a kind per document comes along."""
    plain = docs.select(F.monotonically_increasing_id().alias(ROW), F.col(id_col).alias("doc_id"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = plain.select("*", *[finds_of(F.col("text"), kind).alias(kind) for kind in KINDS[:-1]])
    weak = sum(F.when(F.size(kind) > 0, 1).otherwise(0) for kind in ("identifier", "random", "endpoint", "access"))
    breaks = F.when(weak > 1, finds_of(F.col("text"), "break"))
    finds = kinds.select(ROW, "doc_id", F.explode_outer(F.concat(
        *KINDS[:-1], F.coalesce(breaks, F.array().cast("array<struct<order:int,k:int,before:int,size:int,value:int>>")),
        F.array(F.struct(*[F.lit(None).cast("int").alias(n) for n in ("order", "k", "before", "size", "value")])))).alias("x"))
    finds = finds.select(ROW, "doc_id", "x.*").repartition(ROW)
    running = Window.partitionBy(ROW, "order").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    spans = finds.withColumn("end", F.sum(F.col("before") + F.col("size")).over(running)).withColumn(
        "start", F.col("end") - F.col("size")).where(f"order IS NULL OR order <> 0 OR value >= {MIN_VALUE}")
    # A strong find counts for the weak ones that end after its start, a break for the parts after it; no part holds a break.
    strong = F.col("order") < STRONG
    point = F.when(strong, F.col("start")).otherwise(F.col("end"))
    sweep = Window.partitionBy(ROW).orderBy(point, strong, "order").rowsBetween(Window.unboundedPreceding, 0)
    swept = spans.withColumn("reach", F.max(F.when(strong, F.col("end"))).over(sweep)).withColumn(
        "scope", F.count(F.when(F.col("order") == KINDS.index("break"), 1)).over(sweep))
    clear = F.col("order").isNull() | strong | (
        (F.col("order") < KINDS.index("break")) & (F.coalesce("reach", F.lit(0)) <= F.col("start")))
    return materialize(swept.where(clear).select(ROW, "doc_id", "order", "start", "end", "scope"), "secrets")


def link(found: DataFrame) -> DataFrame:
    """Weak parts whose scope holds a complementary part wholly before or after them."""
    rows = found.where((F.col("order") >= STRONG) | (F.col("order") == KINDS.index("access")))
    kinds = {kind: KINDS.index(kind) for kind in ("access", *COMPLEMENTS)}
    sides = [f(F.when(F.col("order") == number, F.col(name))).alias(f"{side}_{kind}")
             for kind, number in kinds.items() for f, name, side in ((F.min, "end", "first"), (F.max, "start", "last"))]
    scopes = rows.groupBy(F.col(ROW).alias("row2"), F.col("scope").alias("scope2")).agg(*sides)
    completes = F.lit(False)
    for kind, others in COMPLEMENTS.items():
        for other in others:
            apart = (F.col(f"first_{other}") <= F.col("start")) | (F.col(f"last_{other}") >= F.col("end"))
            completes = completes | ((F.col("order") == kinds[kind]) & apart)
    within = (F.col(ROW) == F.col("row2")) & (F.col("scope") == F.col("scope2")) & completes
    return rows.where(F.col("order") >= STRONG).join(scopes, within, "left_semi")


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["order"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, counts of the strong kinds, digest of the strong spans, and all ``spans`` with the linked weak ones."""
    found = parts(docs, id_col, text_col)
    kept = found.where(f"order IS NULL OR order < {STRONG}").unionByName(link(found))
    strong, span = F.col("order") < STRONG, F.struct("start", "order", "end")
    rows = kept.groupBy(ROW).agg(
        F.first("doc_id").alias("doc_id"),
        *[F.count(F.when(F.col("order") == k, 1)).alias(f"n_{KINDS[k]}") for k in range(STRONG)],
        F.array_sort(F.collect_list(F.when(strong, span))).alias("base"),
        F.array_sort(F.collect_list(F.when(F.col("order").isNotNull(), span))).alias("spans"))
    return rows.select("doc_id", *[f"n_{kind}" for kind in KINDS[:STRONG]],
                       F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
