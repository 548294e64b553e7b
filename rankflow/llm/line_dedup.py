"""Line dedup by a suffix array over line numbers.

A document is its sequence of lines with words. Lines that occur once in the corpus end
every repeat, so only the others enter. Their numbers, in an order of their own, rank
the suffixes by one line; prefix doubling ranks them by two, four and more lines: the
pair of a suffix's rank and that of the suffix as many lines on is ranked anew by a
distributed sort of the distinct pairs. Suffixes that stand alone leave the array.

Suffixes that agree on their first m lines are an interval of the array whose longest
common prefix is m or more; two overlapping ranks of a power of two name it. Of each
interval the earliest suffix (by id, then as written; null ids first) is the original.
A line is deleted if it lies in a run of consecutive lines, of ``MIN_WORDS`` words or
more, that a run before it equals. For that it suffices to look at the shortest such
runs from each line on and back: they cover each maximal repeated run.

Defined results: lines without words are kept and do not part their neighbours; a null
or empty text has no lines and stays as it is; a repeated row, and a passage repeated
within one document, is a later copy. An empty table gives an empty one. Other columns
are handed on untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankflow.llm.rows import ROW, numbered, renamed
from rankflow.session import materialize

MIN_WORDS = 50
SPACE = r"[\x20\x09-\x0D]+"


def lines_of(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per line with words: row number, ``id``, its ordinal ``i``, its place ``line``, two hashes and its words."""
    lines = F.filter(F.transform(F.split(text_col, "\n"), lambda x, j: F.struct(j.alias("line"), x.alias("x"))),
                     lambda s: s["x"].rlike(r"[^\x20\x09-\x0D]"))
    return (rows.select(ROW, F.col(id_col).alias("id"), F.posexplode(lines).alias("i", "s"))
            .select(ROW, "id", "i", "s.line", F.xxhash64("s.x").alias("h"), F.hash("s.x").alias("g"),
                    F.size(F.array_remove(F.split("s.x", SPACE), "")).alias("w")))


def ranks(keys: DataFrame, *names: str) -> DataFrame:
    """The distinct ``keys`` that occur twice or more, with ``rank`` in their order.

    Keys are counted before they are shuffled. A sort by ranges deals the distinct keys out; numbers that grow from
    partition to partition and within each are ranks, if with gaps.
    """
    repeated = keys.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1").select(*names)
    return materialize(repeated.repartitionByRange(*names).sortWithinPartitions(*names)
                       .withColumn("rank", F.monotonically_increasing_id()), "line-ranks")


def suffix_ranks(array: DataFrame, depth: int) -> list[DataFrame]:
    """The ranks by 1, 2, 4, ... lines, as far as runs of ``depth`` lines need them."""
    levels, step = [array], 1
    while 2 * step <= depth:
        on = F.max("rank").over(Window.partitionBy(ROW).orderBy("i").rangeBetween(step, step))
        pairs = levels[-1].withColumn("onward", on).where("onward IS NOT NULL").withColumnRenamed("rank", "first")
        named = ranks(pairs.select("first", "onward"), "first", "onward")
        levels.append(materialize(pairs.join(named, ["first", "onward"]).select(ROW, "i", "rank"), "line-suffixes"))
        step *= 2
    return levels


def shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(row, ``id``, ``s``, ``m``): the shortest runs of ``min_words`` words from each line on and from each line back.

    ``lines`` are those that repeat; only lines that follow one another in the document make a run, and as each has
    a word, none is longer than ``min_words`` lines.
    """
    order = Window.partitionBy(ROW).orderBy("i")
    parted = lines.withColumn("island", F.col("i") - F.row_number().over(order))
    island = Window.partitionBy(ROW, "island").orderBy("i")
    summed = parted.withColumn("sum", F.sum("w").over(island.rowsBetween(Window.unboundedPreceding, 0)))
    here = F.struct("i", F.col("sum").alias("to"), (F.col("sum") - F.col("w")).alias("before"))
    ahead = F.collect_list(here).over(island.rowsBetween(0, min_words - 1))
    behind = F.collect_list(here).over(island.rowsBetween(1 - min_words, 0))
    around = summed.select(ROW, "id", "i", (F.col("sum") - F.col("w")).alias("before"), "sum", ahead.alias("ahead"), behind.alias("behind"))
    end = F.get(F.filter("ahead", lambda x: x["to"] - F.col("before") >= min_words), F.lit(0))["i"]
    start = F.try_element_at(F.filter("behind", lambda x: F.col("sum") - x["before"] >= min_words), F.lit(-1))["i"]
    runs = around.select(ROW, "id", F.explode(F.array(
        F.struct(F.col("i").alias("s"), (end - F.col("i") + 1).alias("m")),
        F.struct(start.alias("s"), (F.col("i") - start + 1).alias("m")))).alias("r"))
    return runs.select(ROW, "id", "r.s", "r.m").where("m IS NOT NULL").distinct()


def later_copies(runs: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The runs that stand in an interval of the suffix array after its earliest suffix."""
    named = None
    for k, level in enumerate(levels):
        size = 1 << k
        mine = runs.where(F.col("m").between(size, 2 * size - 1)).withColumn("t", F.col("s") + F.col("m") - size)
        here = level.select(ROW, F.col("i").alias("s"), F.col("rank").alias("a"))
        there = level.select(ROW, F.col("i").alias("t"), F.col("rank").alias("b"))
        part = mine.join(here, [ROW, "s"]).join(there, [ROW, "t"]).select(ROW, "id", "s", "m", "a", "b")
        named = part if named is None else named.union(part)
    named = materialize(named, "line-runs")
    place = F.struct("id", ROW, "s")
    # Written on its own, so that the join may split a run that thousands of documents hold.
    first = materialize(named.groupBy("m", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n"))
                        .where("n > 1").drop("n"), "first-runs")
    return (named.join(first, ["m", "a", "b"]).where(~place.eqNullSafe(F.col("first")))
            .select(ROW, "s", (F.col("s") + F.col("m")).alias("end")))


def repeated_lines(rows: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, ``removed``: places of the lines to delete) of the rows that have any."""
    lines = materialize(lines_of(rows, id_col, text_col), "lines")
    alphabet = ranks(lines.select("h", "g"), "h", "g")
    known = materialize(lines.join(alphabet, ["h", "g"]).select(ROW, "id", "i", "line", "w", "rank"), "known-lines")
    runs = materialize(shortest_runs(known, min_words), "runs")
    depth = runs.agg(F.max("m")).first()[0]
    levels = suffix_ranks(known.select(ROW, "i", "rank"), depth or 1)
    copies = later_copies(runs, levels).groupBy(ROW, F.col("s").alias("i")).agg(F.max("end").alias("end"))
    reach = F.max("end").over(Window.partitionBy(ROW).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    covered = known.select(ROW, "i", "line").join(copies, [ROW, "i"], "left").withColumn("reach", reach).where("reach > i")
    return covered.groupBy(ROW).agg(F.collect_list("line").alias("removed"))


def _without(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> tuple[DataFrame, str]:
    """The numbered rows with the text that is left, ``n_lines`` and ``n_removed``, and the text column's name there."""
    rows = numbered(docs, "line-rows")
    key, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    removed = repeated_lines(rows, key, text, min_words)
    split = (rows.join(removed, ROW, "left").withColumn("lines", F.split(text, "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed")
    kept = F.array_join(F.transform(left, lambda j: F.get("lines", j)), "\n")
    worded = F.size(F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return split.withColumns({
        "n_lines": F.when(F.col(text).isNull(), F.lit(0)).otherwise(worded).cast("long"),
        "n_removed": F.when(F.col("removed").isNull(), F.lit(0)).otherwise(F.size("removed")).cast("long"),
        text: F.when(F.col("removed").isNull(), F.col(text)).otherwise(kept)}), text


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_removed`` and the ``text`` that is left, for each row."""
    done, text = _without(docs.select(id_col, text_col), id_col, text_col, min_words)
    return done.select(F.col("c0").alias("doc_id"), "n_lines", "n_removed", F.col(text).alias("text"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None,
                min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without repeated runs; rows of which no line is left go. ``length_col`` is set to the new code points."""
    done, text = _without(docs, id_col, text_col, min_words)
    left = done.where("n_removed = 0 OR n_removed < n_lines")
    if length_col:
        left = left.withColumn(f"c{docs.columns.index(length_col)}",
                               F.when(F.col("n_removed") > 0, F.length(text)).otherwise(
                                   F.col(f"c{docs.columns.index(length_col)}")).cast("long"))
    return renamed(left, docs)
