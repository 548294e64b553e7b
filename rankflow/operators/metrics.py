"""Ranking and text metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.functions import text as X
from rankflow.session import materialize, qualified, scratch_path

#: texts that are compared with one another, on average, where they are dealt to buckets
BUCKET_TEXTS = 64
#: different word sets of a block, and words of all of them, about
BLOCK_SETS = 2048
BLOCK_WORDS = 1 << 22
#: cells of texts x words that are compared at a time
CELLS = 1 << 18


def gain(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def ndcg_set(ranked: DataFrame, relevant: DataFrame, k: int = 20, by: tuple[str, ...] = ("query_id",),
             ideal_hits: bool = False, evaluated: DataFrame | None = None) -> DataFrame:
    """(by…, ndcg) for sets of relevant items (by…, item_id).

    The ideal gain is that of a single relevant item; ``ideal_hits`` takes the
    true ideal of all relevant items instead. Keys without relevant items get 0,
    and so do keys of ``evaluated`` (by…) that no item was ranked for.
    """
    key = list(by)
    hits = (ranked.filter(F.col("rank") <= k)
            .join(relevant.select(*key, "item_id").distinct(), [*key, "item_id"])
            .groupBy(*key).agg(F.sum(gain(F.col("rank"))).alias("dcg")))
    keys = ranked.select(*key) if evaluated is None else evaluated.select(*key)
    out = keys.distinct().join(hits, key, "left")
    ideal = F.lit(1.0)
    if ideal_hits:
        sizes = relevant.select(*key, "item_id").distinct().groupBy(*key).agg(
            F.count("*").alias("n_relevant"))
        out = out.join(sizes, key, "left")
        n = F.least(F.coalesce("n_relevant", F.lit(1)), F.lit(k)).cast("int")
        ideal = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, r: a + gain(r))
    return out.select(*key, (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def ndcg_single(predictions: DataFrame, truth: DataFrame, k: int = 20) -> DataFrame:
    """(session_id, turn_number, ndcg) against one relevant item per turn.

    ``predictions`` holds the ranked ids in ``predicted_track_ids``, ``truth`` the
    relevant id; turns without truth get a null.
    """
    rows = predictions.join(truth, ["session_id", "turn_number"], "left")
    position = F.array_position(F.slice("predicted_track_ids", 1, k), F.col("truth"))
    score = F.when(F.col("truth").isNotNull(),
                   F.when(position > 0, gain(position)).otherwise(0.0))
    return rows.withColumn("ndcg", score)


def last_turn_only(predictions: DataFrame) -> DataFrame:
    """Prediction rows of each session's last predicted turn."""
    last = F.max("turn_number").over(Window.partitionBy("session_id"))
    return predictions.withColumn("last", last).filter(F.col("turn_number") == F.col("last")).drop("last")


def ndcg_mean(scored: DataFrame) -> DataFrame:
    """(ndcg20, n, skipped): mean over the rows that have a ground truth, 0 of none."""
    return scored.agg(
        F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("ndcg20"),
        F.count("ndcg").alias("n"),
        F.count_if(F.col("ndcg").isNull()).alias("skipped"))


def lexical_diversity(texts: DataFrame, key: str, text: str, bucket_texts: int | None = None) -> DataFrame:
    """(lexdiv): mean Jaccard distance of the word sets of all pairs of texts.

    Texts with the same words are compared once, with their number, and blocks of different word sets meet each other, so
    memory is bounded; the work is quadratic in the different sets. With ``bucket_texts`` only texts that share a bucket are
    compared: the hash of their key deals them to one bucket per so many texts. Empty texts are left out, pairs without any
    word and pairs of one key do not count.
    """
    used = texts.filter(X.nonblank(F.col(text)).isNotNull())
    words = X.blank_tokens(F.col(text))
    if bucket_texts is None:
        return _whole_diversity(materialize(used.select(F.col(key).cast("string").alias("id"), F.array_sort(words).alias("words")), "diversity-texts"))
    number = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    rows = materialize(used.select(number.alias("number"), F.col(key).cast("string").alias("id"), words.alias("words")), "diversity-texts")
    buckets = F.greatest(F.ceil(rows.select(F.count("*")).scalar() / F.lit(bucket_texts)).cast("long"), F.lit(1))
    dealt = rows.where("id IS NOT NULL").select(F.pmod("number", buckets).alias("bucket"), "id", "words")
    sums = dealt.groupBy("bucket").applyInArrow(_distances, "total double, n long")
    return sums.agg(F.coalesce(F.sum("total") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("lexdiv"))


def _whole_diversity(texts: DataFrame) -> DataFrame:
    """(lexdiv) of all pairs of texts (id, words), whose words are in order."""
    spark, texts = texts.sparkSession, texts.where("id IS NOT NULL")
    sets = materialize(texts.groupBy("words").agg(F.count("*").alias("n")), "word-sets")
    different, n_words = sets.agg(F.count("*"), F.coalesce(F.sum(F.size("words").cast("long")), F.lit(0))).first()
    blocks = max(1, -(-different // BLOCK_SETS), -(-n_words // BLOCK_WORDS))
    path = scratch_path(spark, "set-blocks")
    block = F.pmod(F.xxhash64("words"), F.lit(blocks)).cast("int").alias("block")
    sets.select("words", "n", block).repartition(blocks, "block").write.partitionBy("block").parquet(path)
    uri = qualified(spark, path)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch["id"].to_pylist():
                own = _Sets(_stored_sets(uri, one))
                # each pair of blocks once, and as many for every block
                for step in range(blocks // 2 + 1):
                    if 2 * step != blocks or one < step:
                        other = own if not step else _Sets(_stored_sets(uri, (one + step) % blocks))
                        yield pa.RecordBatch.from_arrays([pa.array([own.similarity(other)])], ["total"])

    pair = lambda n: F.col(n) * (F.col(n) - 1) / 2
    some = F.size("words") > 0
    # pairs of texts with the same words, and of any
    same = sets.agg(F.sum(F.when(some, pair("n"))).alias("alike"), F.sum("n").alias("n"), F.sum(F.when(~some, pair("n"))).alias("blank"))
    counted = [same.select(F.coalesce("alike", F.lit(0.0)).alias("total"), (pair("n") - F.coalesce("blank", F.lit(0.0))).alias("n")),
               spark.range(0, blocks, 1, blocks).mapInArrow(compare, "total double").select("total", F.lit(0.0).alias("n")),
               _within_keys(texts)]
    sums = counted[0].union(counted[1]).union(counted[2]).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return sums.select(F.coalesce(1 - F.col("total") / F.nullif("n", F.lit(0.0)), F.lit(0.0)).alias("lexdiv"))


def _within_keys(texts: DataFrame) -> DataFrame:
    """(total, n), less than 0: Jaccard similarities and number of the pairs of texts of one key."""
    several = texts.groupBy("id").count().where("count > 1").select("id")
    rows = texts.join(several, "id", "left_semi").groupBy("id", "words").agg(F.count("*").alias("n"))
    left, right = (rows.select("id", F.col("words").alias(f"words{side}"), F.col("n").alias(f"n{side}")) for side in "ab")
    both = F.when(F.col("wordsa") == F.col("wordsb"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb"))
    alike = 1 - X.jaccard_distance(F.col("wordsa"), F.col("wordsb"))
    pairs = left.join(right, "id").where("wordsa <= wordsb").select(both.alias("n"), alike.alias("alike")).where("alike IS NOT NULL")
    return pairs.agg((-F.sum(F.col("alike") * F.col("n"))).alias("total"), (-F.sum("n")).cast("double").alias("n"))


def _stored_sets(uri: str, block: int) -> pa.Table:
    """The word sets (words, n) of a block, from their table in the shared folder."""
    files, folder = pf.FileSystem.from_uri(uri)
    parts = [pa.table({"words": pa.array([], pa.list_(pa.string())), "n": pa.array([], pa.int64())})]
    for info in files.get_file_info(pf.FileSelector(f"{folder}/block={block}", allow_not_found=True)):
        if info.base_name.startswith("part-"):
            with files.open_input_file(info.path) as source:
                parts.append(pq.ParquetFile(source).read(columns=["words", "n"]).cast(parts[0].schema))
    return pa.concat_tables(parts).combine_chunks()


class _Sets:
    """A block of different word sets (words, n)."""

    def __init__(self, sets: pa.Table) -> None:
        words = sets["words"].combine_chunks()
        self.n = sets["n"].to_numpy().astype(np.float64)
        self.size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = np.repeat(np.arange(len(self.n)), self.size)
        flat = pc.dictionary_encode(words.flatten())
        self.terms, self.code = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def similarity(self, other: _Sets) -> float:
        """Sum of the Jaccard similarities of all pairs of texts of both blocks, each of a set of its own."""
        # words of both blocks, by their place in this one
        place = pc.fill_null(pc.index_in(other.terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        code = place[other.code]
        shared = np.zeros((len(self.n), len(other.n)), np.float32)
        step = max(1, CELLS // max(1, *shared.shape))
        common = np.unique(code[code >= 0])
        for first in range(0, len(common), step):
            held = []
            for side, at in ((self, self.code), (other, code)):
                found = np.searchsorted(common[first:first + step], at).clip(max=len(common[first:first + step]) - 1)
                hit = common[first:first + step][found] == at
                held.append(np.zeros((len(side.n), step), np.float32))
                held[-1][side.row[hit], found[hit]] = 1
            shared += held[0] @ held[1].T
        alike = shared / np.maximum(self.size[:, None] + other.size[None, :] - shared, 1)
        if other is self:
            alike = np.triu(alike, 1)
        return float(self.n @ alike @ other.n)


def _distances(texts: pa.Table) -> pa.Table:
    """(total, n) of the Jaccard distances between the word sets of texts (id, words) of different ids."""
    words, (_, who) = texts["words"].combine_chunks(), np.unique(texts["id"].to_pylist(), return_inverse=True)
    size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    code = pc.dictionary_encode(words.flatten()).indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    shared = np.zeros((len(size), len(size)))
    step = max(1, CELLS // max(1, len(size)))
    for first in range(0, int(code.max(initial=-1)) + 1, step):
        part = slice(*np.searchsorted(code, [first, first + step]))
        held = np.zeros((len(size), step), np.float32)
        held[row[part], code[part] - first] = 1
        shared += held @ held.T
    union = size[:, None] + size[None, :] - shared
    pair = np.triu((who[:, None] != who[None, :]) & (union > 0))
    return pa.table({"total": [float((1 - shared[pair] / union[pair]).sum())], "n": [int(pair.sum())]})


def metric_record(ndcg: DataFrame, lexdiv: DataFrame, all_turns: bool = False) -> DataFrame:
    """(mode, ndcg20, lexdiv, n) of one evaluation."""
    return ndcg.select(F.lit("all-turns" if all_turns else "last-turn-only").alias("mode"),
                       "ndcg20", lexdiv.scalar().alias("lexdiv"), "n")
