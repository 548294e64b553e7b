"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once per document. The ledger stores the measurements and
one bit per failed rule; policies are masks over those bits, so a new version of a
policy, or the effect of leaving one rule out, needs no second look at a text.

Defined results: a null text counts as empty; an empty text has no words, so all
counts are 0 and it fails ``few_words``. Rows are judged one by one: repeated rows
and rows with a null id get a ledger row each, an empty table gives an empty ledger.
Of the other columns only those named in ``keep`` are read, and come out as one
struct ``row``, so that none can clash with a measurement.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Rules in the order of their bits: conditions over the measurements that a text fails by. Integer arithmetic only.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", f"n_words < {MIN_WORDS}"),
    ("repeats_itself", f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("repeats_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("shouts", "3 * n_upper > word_chars"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


def bit(rule: str) -> int:
    return 1 << [name for name, _ in RULES].index(rule)


BASE_BITS = bit("few_words") | bit("repeats_itself")


@dataclass(frozen=True)
class Policy:
    """Rules that reject a document; ``version`` tells the policies of one name apart."""

    name: str
    version: int
    rules: Sequence[str]

    @property
    def mask(self) -> int:
        return sum(bit(rule) for rule in set(self.rules))


#: The production policy: every rule rejects.
POLICY = Policy("pretraining", 1, tuple(name for name, _ in RULES))


def _hashes(words: str) -> Column:
    """A 64-bit hash of each window of ``words``, in order."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, WINDOW)]))


def _sorted(hashes: str) -> Column:
    """The hashes with their places, equal ones side by side; empty if no two are equal, as in most texts."""
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("window"), i.alias("place")))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(pairs)).otherwise(
        F.array().cast("array<struct<window:bigint,place:int>>"))


def _repeated(windows: str) -> Column:
    """Places of the windows that stand next to an equal one, ascending."""
    def has_equal(x: Column, k: Column) -> Column:
        return (F.get(windows, k - 1)["window"].eqNullSafe(x["window"])
                | F.get(windows, k + 1)["window"].eqNullSafe(x["window"]))

    return F.sort_array(F.transform(F.filter(windows, has_equal), lambda x: x["place"]))


def _covered(places: str) -> Column:
    """How many words the windows at these places cover."""
    steps = F.transform(places, lambda i, k: F.least(F.coalesce(F.get(places, k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(steps, F.lit(0), lambda total, x: total + x)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, the measurements (long), ``fail_bits`` (long) and ``row`` (the columns of ``keep``), one row per row.

    All is computed within the row: nothing is shuffled, and a hot source is as good as any other. Windows of one text
    are equal if their 64-bit hashes are.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def count_of(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, ""))

    split = docs.select(
        F.col(id_col).alias("doc_id"), *([F.struct(*keep).alias("row")] if keep else []),
        F.array_remove(F.split(text, SPACE), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        (F.length(text) - count_of(r"[#*$%&|<>]+")).alias("n_symbols"),
        count_of(r"[^\p{Lu}]+").alias("n_upper"))
    places = (split.withColumn("hashes", _hashes("words")).withColumn("windows", _sorted("hashes"))
              .withColumn("again", _repeated("windows")))
    counts = F.struct(
        F.size("words").alias("n_words"), F.length(F.array_join("words", "")).alias("word_chars"), "n_symbols",
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _covered("again").alias("n_repeat_words"), "n_upper")
    # A generator of one row: filters on the counts stay above it instead of repeating the expressions below.
    measured = places.select(*[c for c in ("doc_id", "row") if c in split.columns], F.inline(F.array(counts)))
    measured = measured.withColumns({m: F.col(m).cast("long") for m in MEASURES})
    bits = sum((F.when(F.expr(fails), F.lit(bit(rule))).otherwise(F.lit(0)) for rule, fails in RULES), F.lit(0))
    return measured.withColumn("fail_bits", bits.cast("long"))


def rejected(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(book: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept``; a document that fails a base rule is never kept."""
    base = F.col("fail_bits").bitwiseAND(F.lit(BASE_BITS).cast("long")) != 0
    return book.withColumn("base_failed", base).withColumn("kept", ~base & ~rejected(policy))


def ablation(book: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """Per policy and rule of it: documents that fail the rule, that only this rule rejects, and that are kept without it.

    The ledger shrinks to its distinct bit patterns (at most two to the number of
    rules) before policies and rules are looked at.
    """
    patterns = book.groupBy("fail_bits").agg(F.count("*").alias("n"))
    cases = F.array(*[F.struct(
        F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(rule).alias("rule"),
        F.lit(p.mask).cast("long").alias("mask"), F.lit(bit(rule)).cast("long").alias("rule_bit"))
        for p in policies for rule in dict.fromkeys(p.rules)])
    hit = F.col("fail_bits").bitwiseAND(F.col("c.mask"))
    fails = F.col("fail_bits").bitwiseAND(F.col("c.rule_bit")) != 0

    def documents(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))

    return (patterns.select("fail_bits", "n", F.explode(cases).alias("c"))
            .groupBy("c.policy", "c.version", "c.rule")
            .agg(documents(fails).alias("n_failed"), documents(hit == F.col("c.rule_bit")).alias("n_only_this"),
                 documents((hit == 0) | (hit == F.col("c.rule_bit"))).alias("n_kept_without")))


def screen(docs: DataFrame, policy: Policy = POLICY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their columns as they were."""
    judged = apply_policy(ledger(docs, id_col, text_col, keep=docs.columns), policy)
    return judged.where("kept").select("row.*")
