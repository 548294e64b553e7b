"""Chat formatting by quotation linking.

A message is its lines; each leading ``>`` of a line raises its quote level, the rest is
its own. Consecutive lines of one level are a quoted passage. Passages are normalised
(white space with line breaks, case) and hashed, and joined to the message of the same
conversation that last said the same before: as its whole text, or else by paragraphs,
by sentences (so a part wrapped anew is found too), by lines. The coarsest unit of a
passage that somebody said decides for it. The passages of the lowest level decide what
a message replies to: the original with most quoted characters, of equal ones the
latest. Messages come out in reply order, originals before replies, without quotes and
without the line that announces one, each also in chat markup.

A conversation of any length stays spread out: only units that are quoted somewhere in
their conversation are looked up, the latest earlier speaker comes from a sort by ranges
with what each range hands on to the next, and so do places in a conversation; no
conversation, and no line that many messages repeat, is a group in one task.

Defined results: a null or empty text is a message without text; a null role is written
``user``; messages without a conversation or turn are not linked and come first in
theirs (null conversations are one). Messages of one turn are ordered by role and text,
and equal rows one after the other. A quote that nobody said before has no link. Units
are equal if 128 bits of hashes are. Conversations and turns keep their types. An empty
table has no rows. Columns beyond the four are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.llm.rows import ROW
from rankflow.session import materialize

SPACE = r"[ \t\n\x0B\f\r]"
QUOTE = r"^(?:[ \t]*>)+"
#: The line that announces a quote, in the usual wording of mail programs.
ANNOUNCES = (rf"^{SPACE}*(?:On\b[^\n]+\bwrote|Le\b[^\n]+\ba écrit|Am\b[^\n]+\bschrieb\b[^:\n]*|El\b[^\n]+\bescribió)"
             rf"{SPACE}*:{SPACE}*$")
PARAGRAPHS = rf"\n{SPACE}*\n"
SENTENCES = r"[^.!?]*[.!?]+|[^.!?]+"


def parsed(text: Column) -> Column:
    """Array of (``level``, ``body``), a line each."""
    return F.transform(F.split(text, "\n"), lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 0), r"[^>]", "")).alias("level"),
        F.regexp_replace(x, QUOTE + r"[ \t]?", "").alias("body")))


def normal(passage: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(passage, SPACE + "+", " ")))


def units(passage: Column) -> Column:
    """Array of (``kind``, ``said``): the distinct normalised units of a passage, the coarsest kind (0) first."""
    paragraphs = F.transform(F.split(passage, PARAGRAPHS), normal)
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.transform(
        F.regexp_extract_all(p, F.lit(SENTENCES), F.lit(0)), lambda s: F.trim(s))))
    kinds = (F.array(normal(passage)), paragraphs, sentences, F.transform(F.split(passage, "\n"), normal))

    def of_kind(kind: int, texts: Column) -> Column:
        return F.transform(F.array_distinct(texts), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("said")))

    return F.filter(F.concat(*[of_kind(k, t) for k, t in enumerate(kinds)]), lambda u: u["said"] != "")


def passages(lines: Column) -> Column:
    """Array of (``level``, ``passage``): runs of consecutive quoted lines of one level."""
    turns = F.filter(F.transform(lines, lambda x, k: F.when(
        (k == 0) | (F.get(lines, k - 1)["level"] != x["level"]), k)), lambda k: k.isNotNull())
    runs = F.transform(turns, lambda k, j: F.struct(
        F.get(lines, k)["level"].alias("level"),
        F.array_join(F.transform(F.slice(lines, k + 1, F.coalesce(F.get(turns, j + 1), F.size(lines)) - k), lambda x: x["body"]),
                     "\n").alias("passage")))
    return F.filter(runs, lambda x: x["level"] > 0)


def ordered(rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` by ranges of conversation and ``names``, with partition and a number that grows in this order; written."""
    return materialize(
        rows.repartitionByRange("conv_id", *names).sortWithinPartitions("conv_id", *names)
        .withColumn("part", F.spark_partition_id()).withColumn(ROW, F.monotonically_increasing_id()), "messages")


def positions(dealt: DataFrame) -> DataFrame:
    """(row number, ``position``): places from 0 in the conversation.

    What each partition holds of a conversation is counted; the counts of the partitions before are added to the place
    within the partition.
    """
    keys = dealt.select(ROW, "conv_id", "part")
    held = keys.groupBy("conv_id", "part").agg(F.min(ROW).alias("from"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(
        Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = held.select(F.col("conv_id").alias("conv2"), F.col("part").alias("part2"), "from", before.alias("before"))
    return (keys.join(offsets, F.col("conv_id").eqNullSafe(F.col("conv2")) & (F.col("part") == F.col("part2")))
            .select(ROW, (F.col(ROW) - F.col("from") + F.col("before")).cast("long").alias("position")))


def hashed(rows: DataFrame, *names: str) -> DataFrame:
    """A row per unit of ``passage``, with ``names``, its kind, hashes and characters."""
    said = rows.select(ROW, "conv_id", "turn", *names, F.explode(units(F.col("passage"))).alias("u"))
    return said.select(ROW, "conv_id", "turn", *names, "u.kind", F.xxhash64("u.said").alias("h1"),
                       F.xxhash64("u.said", F.lit(1)).alias("h2"), F.length("u.said").alias("size"))


def speakers(asked: DataFrame, said: DataFrame) -> DataFrame:
    """(``conv_id``, ``turn``, ``h1``, ``h2``, ``original``): the last earlier turn of ``said`` for each row of ``asked``.

    Rows are sorted by ranges; the last speaker is looked for within a range first, then among the last speakers of the
    ranges before.
    """
    unit = ["conv_id", "h1", "h2"]
    both = said.select(*unit, "turn", F.lit(1).alias("asks")).unionByName(asked.select(*unit, "turn", F.lit(0).alias("asks")))
    speaks = F.when(F.col("asks") == 1, F.col("turn"))  # of one turn, who asks comes before who speaks
    dealt = materialize(both.distinct().repartitionByRange(*unit, "turn", "asks").withColumn("part", F.spark_partition_id()), "units")
    within = Window.partitionBy("part", *unit).orderBy("turn", "asks").rowsBetween(Window.unboundedPreceding, 0)
    near = dealt.withColumn("near", F.max(speaks).over(within)).where("asks = 0")
    ranges = Window.partitionBy(*unit).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy(*unit, "part").agg(F.max(speaks).alias("last")).withColumn("far", F.max("last").over(ranges))
    return near.join(before.select(*unit, "part", "far"), [*unit, "part"]).select(
        *unit, "turn", F.coalesce("near", "far").alias("original")).where("original IS NOT NULL")


def links(own: DataFrame) -> DataFrame:
    """(row number, ``reply_to``) of the messages that quote; ``own``: row number, ``conv_id``, ``turn``, ``lines``, ``said``."""
    told = own.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quoting = told.where(F.exists("lines", lambda x: x["level"] > 0))
    quoted = materialize(hashed(
        quoting.select(ROW, "conv_id", "turn", F.posexplode(passages(F.col("lines"))).alias("run", "p"))
        .select(ROW, "conv_id", "turn", "run", "p.level", "p.passage"), "run", "level"), "quoted")
    asked = quoted.select("conv_id", "turn", "h1", "h2").distinct()
    said = hashed(told.select(ROW, "conv_id", "turn", F.col("said").alias("passage"))).select("conv_id", "turn", "h1", "h2")
    said = said.join(asked.select("conv_id", "h1", "h2").distinct(), ["conv_id", "h1", "h2"], "left_semi")
    found = quoted.join(speakers(asked, said), ["conv_id", "turn", "h1", "h2"])
    coarsest = F.min("kind").over(Window.partitionBy(ROW, "run"))
    votes = found.withColumn("best", coarsest).where("kind = best").groupBy(ROW, "level", "original").agg(F.sum("size").alias("size"))
    best = F.max(F.struct((-F.col("level")).alias("level"), "size", "original"))
    return votes.groupBy(ROW).agg(best.alias("best")).select(ROW, F.col("best.original").alias("reply_to"))


def threads(messages: DataFrame) -> DataFrame:
    """``conv_id``, ``position``, ``turn``, ``role``, ``text`` without quotes, ``reply_to`` (turn), ``n_quoted`` lines and
    ``formatted``, a row per message."""
    plain = messages.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"),
                            F.coalesce("text", F.lit("")).alias("raw"))
    dealt = ordered(plain, "turn", "role", "raw")
    rows = dealt.withColumn("lines", parsed(F.col("raw")))
    own = rows.withColumn("mine", F.transform("lines", lambda x, k: F.when((x["level"] == 0) & ~(
        x["body"].rlike(ANNOUNCES) & F.coalesce(F.get("lines", k + 1)["level"] > 0, F.lit(False))), x["body"])))
    text = F.regexp_replace(F.array_join("mine", "\n"), rf"^{SPACE}+|{SPACE}+$", "")
    done = own.select(ROW, "conv_id", "turn", "role", text.alias("text"),
                      F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"))
    spoken = own.select(ROW, "conv_id", "turn", "lines", F.array_join("mine", "\n", "").alias("said"))
    markup = F.concat(F.lit("<|"), F.regexp_replace("role", rf"[<|>]|{SPACE}", ""), F.lit("|>\n"),
                      F.replace("text", F.lit("<|"), F.lit("< |")), F.lit("\n<|end|>"))
    return done.join(positions(dealt), ROW).join(links(spoken), ROW, "left").select(
        "conv_id", "position", "turn", "role", "text", "reply_to", "n_quoted", markup.alias("formatted"))
