"""BM25 retrieval over an inverted index of packed blocks with bounds.

A block is a few thousand items, neighbours of which share common terms, and is closed
by its items or words, whichever limit comes first. A posting row is one term in one block: the places and
counts of the items that hold it, the greatest count and the least length among them.
Rows are written in the order (term, block), so a search for few terms reads only the
row groups that hold them.

A search visits every block as one unit of work: the posting rows that are asked for meet
there, and the queries are read from a table in the shared folder. Within a block, places
are divided into strips of ``STRIP`` items. The greatest impact of a term in each strip
gives each query a bound per strip; strips are visited from the best bound on, each round
raises the threshold, and only strips whose bound reaches it are visited. Queries with
many postings in a block, where no bound would help, score all its items in single precision
to find their candidates: terms that stand for many postings of a batch of queries by a
matrix product, the others by adding their postings up. Many blocks are visited in rounds, each of four times as many
blocks as all before: what a query's k-th best item has scored so far holds as a threshold,
so a round hands on about three lists per query, however many blocks it has. Whichever way
an item is found, its score is summed in the order of terms, so neither blocks nor ways
change a digit, and no item is lost: a strip is passed over only if its bound says that none
of its items can be listed.

Items with the same words share one place of their block and are scored once; the place
lists them by id. Items of a table with many copies are dealt by text, so that copies meet.
Queries with the same weights are one query, whose list each of them gets.

An index is a list of segments. ``update_index`` adds a segment with new items and the
places that earlier segments lose; numbers of items, lengths and document frequencies are
added up when the index is opened, so lists are those of an index built anew.
``compact_index`` writes all segments as one. A version is a small table that names its
segments and is written last.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow.functions import text as X
from rankflow.operators.joins import lookup
from rankflow.operators.ranking import SCORE_DECIMALS, SPREAD, rank_score, reached, top_k
from rankflow.session import folders, is_small, materialize, qualified, scratch_path, spread, table_bytes, table_exists

K1 = 1.5
B = 0.75

#: upper bounds of a block
BLOCK_ITEMS = 8192
BLOCK_WORDS = 1 << 22
#: items of a block of a small table, about
FEW_ITEMS = 4096
#: items of a block that share a bound, and the common terms by which they are ordered
STRIP = 32
ORDER_TERMS = 6
#: postings that a term stands for in a batch of queries, against all cells of these, from which it is a row of a matrix,
#: and rows that a product has at most
DENSE = 0.004
ROWS = 1024
#: postings of a query, against the items of a block, beyond which all items are scored
WHOLE = 0.1
#: words that are counted at a time where no block needs them together
PIECE_WORDS = 1 << 18
#: bytes of texts whose words are counted at a time where only their terms are wanted
PIECE_BYTES = 8 << 20
#: items that share the places of a block, and items with one text beyond which these are dealt to several tasks
BLOCK_COPIES = 1 << 19
CROWD = 1 << 16
#: rows for each different one, from which copies are put together
COPIES = 1.5
#: blocks beyond which a search goes in rounds, and how many times the blocks so far a round reaches
SHARE = 16
REACH = 4
#: terms up to which a search names them in its filter on the postings
FEW_TERMS = 200
#: cells of queries x items, postings that are added up, and terms of candidates that a block works on at a time
CELLS = 1 << 22
PIECE = 1 << 16
WORK = 1 << 20
#: queries read at a time
QUERY_ROWS = 2048
#: bytes of packed postings, as they lie in Parquet, that one task sorts
SORT_BYTES = 8 << 20

LONGS = T.ArrayType(T.LongType())
INTS = T.ArrayType(T.IntegerType())


@dataclass(frozen=True)
class LexicalIndex:
    """``blocks`` (segment, block, item_ids, lens, copies, copy_places, dead), ``packed`` postings (segment, block, term, n,
    top_tf, least_len, places, tfs), ``terms`` (term, df) and totals of an opened index.

    ``copies`` are further items at the places ``copy_places``; ``n`` and ``df`` count items, ``dead`` numbers items and
    then copies."""

    path: str
    version: int
    segments: tuple[str, ...]
    blocks: DataFrame
    packed: DataFrame
    terms: DataFrame
    n_items: int
    n_words: int
    n_blocks: int
    fingerprint: int

    @property
    def mean_len(self) -> float:
        return self.n_words / self.n_items if self.n_items else 0.0


# -- building ------------------------------------------------------------------------


def _counted(words: pa.Array, rows: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, and code, row and count of each term of each row, by code, then row; ``rows`` numbers the lists of ``words``."""
    flat = pc.dictionary_encode(words.flatten())
    terms, codes = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = int(rows.max(initial=0)) + 1
    cell, count = np.unique(codes * n + np.repeat(rows, pc.list_value_length(words).to_numpy(zero_copy_only=False)), return_counts=True)
    return terms, cell // n, cell % n, count


def _pieces(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches with a column ``words``, closed by the row with which they have ``limit`` words."""
    for batch in batches:
        total = np.cumsum(pc.list_value_length(batch["words"]).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            end = min(int(np.searchsorted(total, before + limit)) + 1, batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def postings(items: DataFrame, stop_words=X.STOP_WORDS) -> DataFrame:
    """(item_id, term, tf, len) of items (item_id, text): one pass, about ``PIECE_WORDS`` words at a time; nothing but texts of
    small tables is shuffled."""
    limit = PIECE_WORDS
    words = spread(items, "item_id").select("item_id", X.tokens(F.coalesce("text", F.lit("")), stop_words).alias("words"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, limit):
            terms, code, row, tf = _counted(batch["words"], np.arange(batch.num_rows))
            length = pc.list_value_length(batch["words"]).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch["item_id"].take(pa.array(row)), terms.take(pa.array(code)), pa.array(tf, pa.int64()),
                                              pa.array(length[row], pa.int32())], ["item_id", "term", "tf", "len"])

    schema = T.StructType([items.schema["item_id"]]).add("term", "string").add("tf", "long").add("len", "integer")
    return words.mapInArrow(count, schema)


def _spaced_pieces(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches with a column ``spaced``, closed by the row with which they have ``limit`` bytes."""
    for batch in batches:
        total = np.cumsum(pc.binary_length(batch["spaced"]).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            end = min(int(np.searchsorted(total, (total[start - 1] if start else 0) + limit)) + 1, batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def term_counts(items: DataFrame, stop_words=X.STOP_WORDS) -> DataFrame:
    """(term, n, n_items) of items (item_id, text): how often a term occurs, and how many different ids have it.

    Pieces of about ``PIECE_BYTES`` are split and counted where they are read, so neither words nor pairs of a term and an item
    are shuffled or kept. A row counts as an item of its own; ids with several rows (none, as a rule) are found first, and what
    they count too often is taken off.
    """
    limit, stop = PIECE_BYTES, pa.array(list(stop_words), pa.string())
    several = materialize(items.where(F.col("item_id").isNotNull()).groupBy("item_id").count().where("count > 1").select("item_id"), "several")
    texts = items.select("item_id", X.spaced_words(F.coalesce("text", F.lit(""))).alias("spaced"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _spaced_pieces(batches, limit):
            terms, code, row, tf = _counted(pc.split_pattern(batch["spaced"], " "), np.arange(batch.num_rows))
            known = batch["item_id"].is_valid().to_numpy(zero_copy_only=False)
            n, n_items = (pa.array(np.bincount(code, weights, len(terms)).astype(np.int64)) for weights in (tf, known[row]))
            words = pc.and_(pc.greater(pc.utf8_length(terms), 1), pc.invert(pc.is_in(terms, stop.cast(terms.type))))
            yield pa.RecordBatch.from_arrays([terms, n, n_items], ["term", "n", "n_items"]).filter(words)

    counted = texts.mapInArrow(count, "term string, n long, n_items long")
    if not several.isEmpty():
        words = items.join(several, "item_id", "left_semi").select("item_id", F.explode(F.array_distinct(X.tokens(F.col("text"), stop_words))).alias("term"))
        over = words.groupBy("item_id", "term").agg((1 - F.count("*")).alias("over")).where("over < 0")
        counted = counted.unionByName(over.select("term", F.lit(0).cast("long").alias("n"), F.col("over").alias("n_items")))
    return counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_items").alias("n_items"))


def _alike(code: np.ndarray, row: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Order of the items of a block by their most common terms, then length: neighbours share terms, so bounds are close."""
    df = np.bincount(code, minlength=1)
    # entries of each item, the most common terms first
    entry = np.lexsort((code, -df[code], row))
    count = np.bincount(row, minlength=len(lens))
    first = np.cumsum(count) - count
    keys = [lens]
    for depth in range(ORDER_TERMS - 1, -1, -1):
        key = np.full(len(lens), -1)
        has = count > depth
        key[has] = code[entry[first[has] + depth]]
        keys.append(key)
    return np.lexsort(keys)


def _block_rows(items: pa.Table, copies: pa.Table, block: int) -> Iterator[dict[str, pa.Array]]:
    """The row of a block and its posting rows, as columns; ``copies`` have the row of ``items`` with their words."""
    words = items["words"].combine_chunks()
    lens = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    terms, code, row, tf = _counted(words, np.arange(len(lens)))
    order = _alike(code, row, lens)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at = place[row]
    sort = np.lexsort((at, code))
    code, at, tf = code[sort], at[sort], tf[sort]
    one = lambda values: pa.ListArray.from_arrays([0, len(values)], values)
    column = lambda table, name: table[name].combine_chunks()
    take, where = pa.array(order), place[column(copies, "row").to_numpy()]
    yield {"block": pa.array([block]), "item_ids": one(column(items, "item_id").take(take)), "hashes": one(column(items, "hash").take(take)),
           "lens": pa.array([lens[order]], pa.list_(pa.int32())), "copies": one(column(copies, "item_id")),
           "copy_hashes": one(column(copies, "hash")), "copy_places": pa.array([where], pa.list_(pa.int32()))}
    if len(code):
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        offsets = pa.array(np.r_[starts, len(code)], pa.int32())
        count = 1 + np.bincount(where, minlength=len(order))
        yield {"block": pa.array(np.full(len(starts), block)), "term": terms.take(pa.array(code[starts])),
               "n": pa.array(np.add.reduceat(count[at], starts)), "top_tf": pa.array(np.maximum.reduceat(tf, starts)),
               "least_len": pa.array(np.minimum.reduceat(lens[order][at], starts)),
               "places": pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32())), "tfs": pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32()))}


class _Packer:
    """Rows (item_id, hash, words) of one block as they arrive."""

    def __init__(self, limits: tuple[int, int, int]) -> None:
        self.limits = limits
        self.places: dict[str, int] = {}
        self.n_words = self.n_copies = 0
        self.items: list[pa.RecordBatch] = []
        self.copies: list[pa.RecordBatch] = []

    def add(self, batch: pa.RecordBatch, keys: list[str], lens: np.ndarray) -> int:
        """Take rows up to the one that fills the block, and say how many.

        A text of more words than there is room for still goes in and closes the block.
        """
        first, again, rows = [], [], []
        for i, key in enumerate(keys):
            known = len(self.places)
            row = self.places.setdefault(key, known)
            if row == known:
                first.append(i)
                self.n_words += int(lens[i])
            else:
                again.append(i)
                rows.append(row)
                self.n_copies += 1
            if self.full:
                break
        self.items.append(batch.take(pa.array(first, pa.int64())))
        self.copies.append(batch.select(["item_id", "hash"]).take(pa.array(again, pa.int64())).append_column("row", pa.array(rows, pa.int64())))
        return len(first) + len(again)

    @property
    def full(self) -> bool:
        return any(n >= limit for n, limit in zip((len(self.places), self.n_words, self.n_copies), self.limits))

    def rows(self, block: int) -> Iterator[dict[str, pa.Array]]:
        return _block_rows(pa.Table.from_batches(self.items), pa.Table.from_batches(self.copies), block)


def _write_segment(items: DataFrame, root: str, stop_words) -> None:
    """Blocks and postings of ``items`` below ``root``."""
    id_field = items.schema["item_id"]
    schema = (T.StructType().add("block", "long").add("term", "string").add("n", "long").add("top_tf", "long").add("least_len", "long")
              .add("places", INTS).add("tfs", INTS).add("item_ids", T.ArrayType(id_field.dataType)).add("lens", INTS).add("hashes", LONGS)
              .add("copies", T.ArrayType(id_field.dataType)).add("copy_hashes", LONGS).add("copy_places", INTS))
    words = _dealt(items).select("item_id", _hash().alias("hash"), X.tokens(F.coalesce("text", F.lit("")), stop_words).alias("words"))
    names, limits = [f.name for f in schema.fields], (BLOCK_ITEMS, BLOCK_WORDS, BLOCK_COPIES)
    empty = {"block": pa.int64(), "term": pa.string(), "n": pa.int64(), "top_tf": pa.int64(), "least_len": pa.int64()} | dict.fromkeys(
        ("places", "tfs", "lens", "copy_places"), pa.list_(pa.int32())) | dict.fromkeys(("hashes", "copy_hashes"), pa.list_(pa.int64()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, packer = TaskContext.get().partitionId() << 32, 0, _Packer(limits)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal packer, made
            ids = pa.list_(packer.items[0].schema.field("item_id").type)
            for columns in packer.rows(first + made):
                size = len(columns["block"])
                yield pa.RecordBatch.from_arrays([columns[n] if n in columns else pa.nulls(size, empty.get(n, ids)) for n in names], names)
            packer, made = _Packer(limits), made + 1

        for batch in batches:
            keys, lens = pc.binary_join(batch["words"], " ").to_pylist(), pc.list_value_length(batch["words"]).to_numpy(zero_copy_only=False)
            start = 0
            while start < batch.num_rows:
                start += packer.add(batch.slice(start), keys[start:], lens[start:])
                if packer.full:
                    yield from close()
        if packer.places:
            yield from close()

    packed = materialize(words.mapInArrow(pack, schema), "packed-postings")
    packed.where("term IS NULL").select("block", *_BLOCK).write.parquet(f"{root}/blocks")
    _write_postings(packed.where("term IS NOT NULL"), root)


_BLOCK = ("item_ids", "lens", "hashes", "copies", "copy_hashes", "copy_places")


def _dealt(items: DataFrame) -> DataFrame:
    """Items by text where many have the same, else those of a small table by id and those of a large one as they lie."""
    text = F.xxhash64("text")
    n, different = items.agg(F.count("*"), F.approx_count_distinct(text)).first()
    if n > COPIES * different:
        crowds = [r.h for r in items.groupBy(text.alias("h")).count().where(F.col("count") > CROWD).collect()]
        part = F.when(text.isin(crowds), F.pmod(F.xxhash64("item_id"), F.lit(SPREAD))).otherwise(0) if crowds else F.lit(0)
        return items.repartition(max(-(-different // FEW_ITEMS), -(-n // BLOCK_COPIES)), text, part)
    # a small table is gathered again after its words were counted, or every core would make a block of few items
    return items.repartition(max(1, -(-n // FEW_ITEMS)), "item_id") if is_small(items) else items


def _write_postings(packed: DataFrame, root: str) -> None:
    rows = packed.select("block", "term", "n", "top_tf", "least_len", "places", "tfs")
    # as many ranges as keep a task's sort in memory, however many the session's shuffles have
    ranges = -(-table_bytes(packed) // SORT_BYTES)
    usual = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, "term", "block") if ranges > usual else rows.repartitionByRange("term", "block")
    dealt.sortWithinPartitions("term", "block").write.option(
        "parquet.block.size", 16 << 20).parquet(f"{root}/postings")


def _hash() -> Column:
    return F.xxhash64("item_id", "text")


def _totals(spark: SparkSession, root: str) -> DataFrame:
    """Numbers of items, words and blocks of a segment and the sum of its items' hashes."""
    blocks = spark.read.parquet(f"{root}/blocks")
    total = lambda name, of=lambda x: x: F.aggregate(name, F.lit(0).cast("long"), lambda a, x: a + of(x))
    wide = lambda name: F.aggregate(name, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)"))
    words = total("lens") + total("copy_places", lambda place: F.get("lens", place))
    return blocks.select((F.size("item_ids") + F.size("copies")).cast("long").alias("n"), words.alias("w"),
                         (wide("hashes") + wide("copy_hashes")).cast("decimal(38,0)").alias("h")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("w"), F.lit(0)).alias("n_words"),
        F.count("*").alias("n_blocks"), F.coalesce(F.sum("h"), F.lit(0)).cast("decimal(38,0)").alias("fingerprint"))


def _publish(spark: SparkSession, path: str, version: int, segments: list[str]) -> None:
    """The table that makes a version; a version that stands already is not written over."""
    spark.createDataFrame(list(enumerate(segments)), "place int, segment string").coalesce(1).write.parquet(f"{path}/versions/{version:08d}")


def _fresh(path: str) -> tuple[str, str]:
    name = uuid.uuid4().hex
    return name, f"{path}/segments/{name}"


def _finish(spark: SparkSession, root: str, lost: DataFrame | None = None, totals: DataFrame | None = None) -> None:
    """Terms and totals of a segment, less what it takes from earlier ones."""
    terms = spark.read.parquet(f"{root}/postings").groupBy("term").agg(F.sum("n").alias("df"))
    if lost is not None:
        terms = terms.union(lost).groupBy("term").agg(F.sum("df").alias("df"))
    terms.write.parquet(f"{root}/terms")
    (_totals(spark, root) if totals is None else totals).coalesce(1).write.parquet(f"{root}/totals")


def build_index(items: DataFrame, path: str | None = None, stop_words=X.STOP_WORDS) -> LexicalIndex:
    """Write an index of items (item_id, text), one row per item, below ``path`` as its next version and open it."""
    spark = items.sparkSession
    path = path or scratch_path(spark, "lexical")
    name, root = _fresh(path)
    _write_segment(items, root, stop_words)
    _finish(spark, root)
    _publish(spark, path, (latest_version(spark, path) or 0) + 1, [name])
    return load_index(spark, path)


def latest_version(spark: SparkSession, path: str) -> int | None:
    whole = [int(v) for v in folders(spark, f"{path}/versions") if table_exists(spark, f"{path}/versions/{v}")]
    return max(whole, default=None)


def load_index(spark: SparkSession, path: str) -> LexicalIndex:
    """The latest version of the index at ``path``."""
    version = latest_version(spark, path)
    segments = tuple(r.segment for r in spark.read.parquet(f"{path}/versions/{version:08d}").orderBy("place").collect())

    def read(table: str) -> DataFrame:
        parts = [spark.read.parquet(f"{path}/segments/{s}/{table}").withColumn("segment", F.lit(s)) for s in segments]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    terms, blocks = read("terms").drop("segment"), read("blocks")
    gone = [s for s in segments if table_exists(spark, f"{path}/segments/{s}/gone")]
    if len(segments) > 1:
        terms = terms.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    if gone:
        dead = spark.read.parquet(*[f"{path}/segments/{s}/gone" for s in gone]).groupBy("segment", "block").agg(
            F.flatten(F.collect_list("places")).alias("dead"))
        blocks = blocks.join(dead, ["segment", "block"], "left")
    else:
        blocks = blocks.withColumn("dead", F.lit(None).cast(INTS))
    totals = read("totals").agg(*[F.sum(c).alias(c) for c in ("n_items", "n_words", "n_blocks", "fingerprint")]).first()
    return LexicalIndex(path, version, segments, blocks, read("postings"), terms, int(totals["n_items"]), int(totals["n_words"]),
                        int(totals["n_blocks"]), int(totals["fingerprint"]))


def open_index(items: DataFrame, path: str, check: bool = True) -> LexicalIndex:
    """The index at ``path``, built if there is none and brought up to date if ``items`` have changed since.

    ``check=False`` spares the pass over the texts that finds out.
    """
    spark = items.sparkSession
    if latest_version(spark, path) is None:
        return build_index(items, path)
    index = load_index(spark, path)
    if not check:
        return index
    now = items.select(F.count("*").alias("n"), F.coalesce(F.sum(_hash().cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return index if (now.n, int(now.h)) == (index.n_items, index.fingerprint) else sync_index(items, index)


# -- segments ------------------------------------------------------------------------


def live_items(index: LexicalIndex) -> DataFrame:
    """(segment, block, number, place, item_id, len, hash) of the items that count."""
    numbers = lambda size: F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast(INTS))
    both = index.blocks.select("segment", "block", "lens", F.coalesce("dead", F.array().cast(INTS)).alias("dead"),
                               F.concat(numbers(F.size("item_ids")), "copy_places").alias("places"), F.concat("item_ids", "copies").alias("ids"),
                               F.concat("hashes", "copy_hashes").alias("hashes"))
    alive = F.transform(F.array_except(numbers(F.size("ids")), "dead"), lambda i: F.struct(
        i.alias("number"), F.get("places", i).alias("place"), F.get("ids", i).alias("item_id"), F.get("lens", F.get("places", i)).alias("len"),
        F.get("hashes", i).alias("hash")))
    return both.select("segment", "block", F.explode(alive).alias("x")).select("segment", "block", "x.*").where("item_id IS NOT NULL")


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the lists of ``column``, none of which is empty, and where each list begins."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(sizes) - sizes


def _padded(df: DataFrame, key: list[str], kind: int, types: dict[str, T.DataType]) -> DataFrame:
    """``key``, ``kind`` and the columns ``types`` of ``df``, as the rows of a block and its postings travel together.

    A list that ``df`` lacks is empty: the writer of Arrow batches goes over a run of null lists again at every row.
    """
    lacking = lambda t: F.array().cast(t) if isinstance(t, T.ArrayType) else F.lit(None).cast(t)
    return df.select(*key, F.lit(kind).alias("kind"), *[F.col(c) if c in df.columns else lacking(t).alias(c) for c, t in types.items()])


def _beside(n_blocks: int, blocks: DataFrame, packed: DataFrame, work: Callable[[pa.RecordBatch, pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """``work`` of the row of each block and some of its posting rows at a time; both are (segment, block, ...)."""
    key = ["segment", "block"]
    types = {f.name: f.dataType for f in [*blocks.schema.fields, *packed.schema.fields] if f.name not in key}
    rows = _padded(blocks, key, 0, types).union(_padded(packed, key, 1, types)).repartition(max(1, min(2 * n_blocks, 100_000)), *key).sortWithinPartitions(*key, "kind", "term")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            segment, block, kind = (batch[n].to_numpy(zero_copy_only=False) for n in (*key, "kind"))
            edges = np.flatnonzero((segment[1:] != segment[:-1]) | (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, z in zip(np.r_[0, edges], np.r_[edges, batch.num_rows]):
                if z > a and kind[a] == 0:
                    own = batch.slice(a, z - a)
                elif z > a:
                    yield work(own, batch.slice(a, z - a))

    return rows.mapInArrow(visit, schema)


def _settled(row: pa.RecordBatch) -> pa.RecordBatch:
    """A block without its dead: a place goes to the first that is left there, or stays without an item."""
    both = lambda a, b: pa.concat_arrays([row[a].flatten(), row[b].flatten()])
    ids, hashes = both("item_ids", "copies"), both("hashes", "copy_hashes")
    n = len(row["item_ids"].flatten())
    place = np.r_[np.arange(n), row["copy_places"].flatten().to_numpy().astype(np.int64)]
    alive = pc.is_valid(ids).to_numpy(zero_copy_only=False).copy()
    alive[row["dead"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)] = False
    left = np.flatnonzero(alive)
    left = left[np.argsort(place[left], kind="stable")]
    leads = np.r_[True, place[left][1:] != place[left][:-1]] if len(left) else np.zeros(0, bool)
    at = np.full(n, -1)
    at[place[left[leads]]] = left[leads]
    lead, more = pa.array(at, mask=at < 0), pa.array(left[~leads])
    one = lambda values: pa.ListArray.from_arrays([0, len(values)], values)
    made = {"item_ids": one(ids.take(lead)), "lens": row["lens"], "hashes": one(hashes.take(lead)), "copies": one(ids.take(more)),
            "copy_hashes": one(hashes.take(more)), "copy_places": pa.array([place[left[~leads]]], pa.list_(pa.int32()))}
    return pa.RecordBatch.from_arrays([row["segment"], row["old"], row["block"], *[made[c] for c in _BLOCK]], ["segment", "old", "block", *_BLOCK])


def sync_index(items: DataFrame, index: LexicalIndex) -> LexicalIndex:
    """The index after what is new, changed or missing in ``items`` has become a segment."""
    held = live_items(index).select("item_id", F.col("hash").alias("old"))
    both = items.withColumn("new", _hash()).join(held, "item_id", "full")
    changed = both.where("old IS NULL OR new IS NOT NULL AND new <> old").select("item_id", "text")
    return update_index(index, changed, both.where("new IS NULL").select("item_id"))


def update_index(index: LexicalIndex, changed: DataFrame | None = None, deleted: DataFrame | None = None,
                 stop_words=X.STOP_WORDS) -> LexicalIndex:
    """Add a segment with the ``changed`` items (item_id, text; new ones too), without the ``deleted`` (item_id)."""
    spark = index.blocks.sparkSession
    if changed is None and deleted is None:
        return index
    if changed is None:
        changed = live_items(index).select("item_id", F.lit(None).cast("string").alias("text")).limit(0)
    changed = materialize(changed.select("item_id", "text"), "changed-items")
    touched = changed.select("item_id")
    if deleted is not None:
        touched = touched.union(deleted.select("item_id"))
    name, root = _fresh(index.path)
    _write_segment(changed, root, stop_words)
    hits = materialize(lookup(live_items(index), touched.distinct(), ["item_id"]), "lost-items")
    gone = materialize(hits.groupBy("segment", "block").agg(F.collect_list("number").alias("places"), F.collect_list("place").alias("away")), "gone")
    gone.select("segment", "block", "places").write.parquet(f"{root}/gone")

    def count(own: pa.RecordBatch, rows: pa.RecordBatch) -> pa.RecordBatch:
        flat, starts = _lists(rows["places"])
        away = np.bincount(own["away"].flatten().to_numpy(), minlength=int(flat.max(initial=-1)) + 1)
        df = np.add.reduceat(away[flat], starts)
        return pa.RecordBatch.from_arrays([rows["term"].take(pa.array(np.flatnonzero(df))), pa.array(-df[df > 0])], ["term", "df"])

    lost = _beside(index.n_blocks, gone.select("segment", "block", "away"), index.packed.join(gone.select("segment", "block"), ["segment", "block"], "left_semi").select(
        "segment", "block", "term", "places"), count, "term string, df long")
    less = hits.agg((-F.count("*")).alias("n_items"), (-F.coalesce(F.sum("len"), F.lit(0))).cast("long").alias("n_words"),
                    F.lit(0).cast("long").alias("n_blocks"), (-F.coalesce(F.sum(F.col("hash").cast("decimal(38,0)")), F.lit(0))).alias("fingerprint"))
    totals = _totals(spark, root).unionByName(less).agg(*[F.sum(c).cast("decimal(38,0)" if c == "fingerprint" else "long").alias(c)
                                                          for c in ("n_items", "n_words", "n_blocks", "fingerprint")])
    _finish(spark, root, lost.groupBy("term").agg(F.sum("df").alias("df")), totals)
    _publish(spark, index.path, index.version + 1, [*index.segments, name])
    return load_index(spark, index.path)


def compact_index(index: LexicalIndex) -> LexicalIndex:
    """All segments as one: postings of lost items go, their places stay without an item."""
    spark = index.blocks.sparkSession
    name, root = _fresh(index.path)
    fields = {f.name: f for f in index.blocks.schema.fields}
    schema = T.StructType([fields["segment"], T.StructField("old", T.LongType()), *[fields[c] for c in ("block", *_BLOCK)]])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _settled(batch.slice(i, 1))

    numbered = materialize(index.blocks.select("segment", F.col("block").alias("old"), F.monotonically_increasing_id().alias("block"), *_BLOCK, "dead")
                           .mapInArrow(settle, schema), "compacted-blocks")
    numbered.select("block", *_BLOCK).write.parquet(f"{root}/blocks")

    def kept(own: pa.RecordBatch, rows: pa.RecordBatch) -> pa.RecordBatch:
        flat, starts = _lists(rows["places"])
        held = pc.is_valid(own["item_ids"].flatten()).to_numpy(zero_copy_only=False).astype(np.int64)
        held += np.bincount(own["copy_places"].flatten().to_numpy(), minlength=len(held))
        alive, sizes = held[flat] > 0, np.add.reduceat(held[flat] > 0, starts, dtype=np.int64)
        some = pa.array(np.flatnonzero(sizes))
        offsets = pa.array(np.r_[0, np.cumsum(sizes[sizes > 0])], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, rows[c].flatten().filter(pa.array(alive))) for c in ("places", "tfs")]
        n = np.add.reduceat(held[flat], starts)[sizes > 0]
        return pa.RecordBatch.from_arrays([pa.repeat(own["number"][0], len(some)), rows["term"].take(some), pa.array(n), rows["top_tf"].take(some),
                                           rows["least_len"].take(some), *lists], ["block", "term", "n", "top_tf", "least_len", "places", "tfs"])

    held = numbered.select("segment", F.col("old").alias("block"), F.col("block").alias("number"), "item_ids", "copy_places")
    rows = _beside(index.n_blocks, held, index.packed.select("segment", "block", "term", "top_tf", "least_len", "places", "tfs"), kept, T.StructType(
        [T.StructField("block", T.LongType()), *[index.packed.schema[c] for c in ("term", "n", "top_tf", "least_len", "places", "tfs")]]))
    _write_postings(materialize(rows, "compacted-postings"), root)
    totals = spark.createDataFrame([(index.n_items, index.n_words, index.n_blocks, Decimal(index.fingerprint))],
                                   "n_items long, n_words long, n_blocks long, fingerprint decimal(38,0)")
    _finish(spark, root, totals=totals)
    _publish(spark, index.path, index.version + 1, [name])
    return load_index(spark, index.path)


# -- searching -----------------------------------------------------------------------


def idf(df: Column, n_items: int) -> Column:
    return F.log(1 + (F.lit(n_items) - df + 0.5) / (df + 0.5))


def term_saturation(tf: Column, length: Column, mean_len: float,
                    k1: float = K1, b: float = B) -> Column:
    return tf / (k1 * (1 - b + b * length / F.lit(mean_len)) + tf)


def _steps(scores: np.ndarray) -> np.ndarray:
    """Scores as whole numbers of the last decimal kept."""
    return np.floor(scores * 10 ** SCORE_DECIMALS + 0.5)


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``starts``, one after the other."""
    total = np.cumsum(lengths)
    return np.repeat(starts - total + lengths, lengths) + np.arange(total[-1] if len(total) else 0)


class Block:
    """One block with the postings of the terms that are asked for, by term and place."""

    def __init__(self, item_ids: pa.Array, lens: np.ndarray, dead: np.ndarray, terms: pa.Array, sizes: np.ndarray,
                 places: np.ndarray, tfs: np.ndarray, mean_len: float, k1: float = K1, b: float = B, copies: pa.Array | None = None,
                 copy_places: np.ndarray | None = None) -> None:
        self.terms, self.n = terms, len(item_ids)
        self.item_ids = item_ids if copies is None else pa.concat_arrays([item_ids, copies])
        home = np.arange(self.n) if copies is None else np.r_[np.arange(self.n), copy_places]
        self.order = np.empty(len(home), np.int64)
        self.order[pc.sort_indices(self.item_ids).to_numpy()] = np.arange(len(home))
        alive = pc.is_valid(self.item_ids).to_numpy(zero_copy_only=False).copy()
        alive[dead] = False
        # items that count, by place, then id
        self.items = np.flatnonzero(alive)
        self.items = self.items[np.lexsort((self.order[self.items], home[self.items]))]
        self.held = np.bincount(home[self.items], minlength=self.n)
        self.lead = np.cumsum(self.held) - self.held
        self.alive = self.held > 0
        self.by_id = np.zeros(self.n, np.int64)
        self.by_id[self.alive] = self.order[self.items[self.lead[self.alive]]]
        self.place, self.df = places, sizes
        self.impact = tfs / (k1 * (1 - b + b * lens[places] / mean_len) + tfs) if len(places) else np.zeros(0)
        # cells: a term's postings within a strip
        self.strips = -(-self.n // STRIP)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        key = owner * self.strips + places // STRIP
        self.start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.size = np.diff(np.r_[self.start, len(key)])
        self.strip = key[self.start] % self.strips if len(key) else self.start
        self.top = np.maximum.reduceat(self.impact, self.start) if len(key) else np.zeros(0)
        self.cells = np.searchsorted(key[self.start] // self.strips if len(key) else self.start, np.arange(len(sizes) + 1))
        self.first = np.cumsum(sizes) - sizes
        self.coarse = self.impact.astype(np.float32)
        # postings by place, then term: what is asked of an item lies together
        by_place = np.argsort(places.astype(np.uint16) if self.n <= 1 << 16 else places, kind="stable")
        self.keys, self.found = places[by_place] * len(sizes) + owner[by_place], self.impact[by_place]
        #: strips that were scored, and all that hold a term of their query
        self.visited = self.possible = 0

    def best(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, least: np.ndarray, k: int):
        """(query, place, rounded score in steps) of the ``k`` best items of each of ``len(least)`` queries.

        ``query``, ``term``, ``weight``: entries by query, then term. ``least``: steps that a listed item needs.
        """
        heavy = np.bincount(query, self.df[term], len(least)) > WHOLE * self.n
        out = []
        for which, way in ((heavy, self._whole), (~heavy, self._bounded)):
            own = np.flatnonzero(which)
            if len(own):
                mine = which[query]
                number = np.cumsum(which) - 1
                q, place, steps = way(number[query[mine]], term[mine], weight[mine], least[own], k)
                out.append((own[q], place, steps))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _whole(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, least: np.ndarray, k: int):
        """All scores in single precision; those near the k-th or beyond are then summed in order."""
        n = len(least)
        scores = self._coarse(query, term, weight, n)
        if not self.alive.all():
            scores[:, ~self.alive] = 0
        # what rounds to the same score is a tie, which the item decides; single precision may miss so much of a sum
        last = least / 10 ** SCORE_DECIMALS
        unknown = np.flatnonzero(least == 0)
        if k < self.n and len(unknown):
            last[unknown] = reached(scores if len(unknown) == n else scores[unknown], k)
        slack = (np.bincount(query, minlength=1).max() + 64) * 2.0 ** -22
        near = np.maximum(last * (1 - slack) - 1.01 * 10.0 ** -SCORE_DECIMALS, np.finfo(np.float32).tiny).astype(np.float32)
        q, place = np.divmod(np.flatnonzero(scores >= near[:, None]), self.n)
        return self._cut(q, place, _steps(self._ordered(q, place, query, term, weight)), least, k)

    def _coarse(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """Scores of all places for ``n`` queries in single precision."""
        # a term with many postings in these queries is cheaper as a row of a product than posting by posting
        worth = np.bincount(term, minlength=len(self.df)) * self.df
        rows = np.flatnonzero(worth > DENSE * n * self.n)
        rows = rows[np.argsort(-worth[rows], kind="stable")[:ROWS]]
        number = np.full(len(self.df), -1)
        number[rows] = np.arange(len(rows))
        matrix = np.zeros((len(rows), self.n), np.float32)
        posting = _spans(self.first[rows], self.df[rows])
        matrix[np.repeat(np.arange(len(rows)), self.df[rows]), self.place[posting]] = self.coarse[posting]
        row, weight = number[term], weight.astype(np.float32)
        hot = row >= 0
        weights = np.zeros((n, len(rows)), np.float32)
        weights[query[hot], row[hot]] = weight[hot]
        scores = weights @ matrix
        cells, start, w = query[~hot] * self.n, self.first[term[~hot]], weight[~hot]
        size = self.df[term[~hot]]
        total = np.cumsum(size)
        at = 0
        while at < len(size):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PIECE, side="right")))
            some = slice(at, end)
            posting = _spans(start[some], size[some])
            np.add.at(scores.reshape(-1), np.repeat(cells[some], size[some]) + self.place[posting], np.repeat(w[some], size[some]) * self.coarse[posting])
            at = end
        return scores

    def _ordered(self, q: np.ndarray, place: np.ndarray, query: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Scores of the pairs (q, place), summed in the order of the queries' entries."""
        first = np.searchsorted(query, np.arange(q.max(initial=-1) + 2))
        size = np.diff(first)[q]
        total = np.cumsum(size)
        out, at = np.zeros(len(q)), 0
        while at < len(q):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + WORK, side="right")))
            entry, pair = _spans(first[q[at:end]], size[at:end]), np.repeat(np.arange(end - at), size[at:end])
            key = place[at:end][pair] * len(self.df) + term[entry]
            found = np.searchsorted(self.keys, key).clip(max=len(self.keys) - 1)
            out[at:end] = np.bincount(pair, weight[entry] * np.where(self.keys[found] == key, self.found[found], 0.0), end - at)
            at = end
        return out

    def _bounded(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, least: np.ndarray, k: int):
        """Strips from the best bound on, as long as bounds reach the threshold."""
        strips, n = self.strips, len(least)
        count = self.cells[term + 1] - self.cells[term]
        cell = _spans(self.cells[term], count)
        at = np.repeat(query, count) * strips + self.strip[cell]
        w = np.repeat(weight, count)
        sums = np.bincount(at, w * self.top[cell], n * strips)
        # the order of additions may not lower a bound below a score
        bound = np.where(sums > 0, _steps(sums * (1 + 1e-12)), -1.0)
        self.possible += int((bound >= 0).sum())
        rank = np.empty((n, strips), np.int64)
        np.put_along_axis(rank, np.argsort(-bound.reshape(n, strips), axis=1), np.arange(strips)[None, :], axis=1)
        rank = rank.ravel()
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        done, size = 0, -(-k // STRIP) + 1
        while len(at):
            floor = np.repeat(least, strips)
            now = (rank >= done) & (rank < done + size) & (bound >= 0) & (bound >= floor)
            more = self._score(now, at, cell, w)
            found = self._cut(*[np.concatenate(x) for x in zip(found, more)], least, k)
            least = np.maximum(least, self._threshold(*found, n, k))
            done, size = done + size, size * 2
            rest = ((rank >= done) & (bound >= np.repeat(least, strips)))[at]
            at, cell, w = at[rest], cell[rest], w[rest]
        return found

    def _score(self, chosen: np.ndarray, at: np.ndarray, cell: np.ndarray, w: np.ndarray):
        """(query, place, steps) of the items of the chosen (query, strip) pairs."""
        pairs = np.flatnonzero(chosen)
        self.visited += len(pairs)
        number = np.zeros(len(chosen), np.int64)
        number[pairs] = np.arange(len(pairs))
        keep = chosen[at]
        cell, pair, w = cell[keep], number[at[keep]], w[keep]
        size = self.size[cell]
        posting = _spans(self.start[cell], size)
        scores = np.bincount(np.repeat(pair, size) * STRIP + self.place[posting] % STRIP, np.repeat(w, size) * self.impact[posting],
                             len(pairs) * STRIP)
        hit = np.flatnonzero(scores > 0)
        query, place = pairs[hit // STRIP] // self.strips, pairs[hit // STRIP] % self.strips * STRIP + hit % STRIP
        alive = self.alive[place]
        return query[alive], place[alive], _steps(scores[hit[alive]])

    def _cut(self, query: np.ndarray, place: np.ndarray, steps: np.ndarray, least: np.ndarray, k: int):
        keep = steps >= least[query]
        query, place, steps = query[keep], place[keep], steps[keep]
        order = np.lexsort((self.by_id[place], -steps, query))
        query, place, steps = query[order], place[order], steps[order]
        # a place goes if k items score more, or if k places come before it
        before = np.cumsum(self.held[place]) - self.held[place]
        own = np.searchsorted(query, query)
        new = np.flatnonzero(np.r_[True, (query[1:] != query[:-1]) | (steps[1:] != steps[:-1])]) if len(query) else own
        better = before[np.repeat(new, np.diff(np.r_[new, len(query)]))] - before[own]
        keep = (np.arange(len(query)) - own < k) & (better < k)
        return query[keep], place[keep], steps[keep]

    def _threshold(self, query: np.ndarray, place: np.ndarray, steps: np.ndarray, n: int, k: int) -> np.ndarray:
        """Steps of the k-th of each query's items (places in order); nothing where there are fewer."""
        out = np.zeros(n)
        total = np.cumsum(self.held[place])
        ends = np.searchsorted(query, np.arange(n), side="right")
        base = np.r_[0, total][np.searchsorted(query, np.arange(n))]
        last = np.searchsorted(total, base + k)
        full = last < ends
        out[full] = steps[last[full]]
        return out

    def _listed(self, query: np.ndarray, place: np.ndarray, steps: np.ndarray, k: int):
        """(query, item, steps): the first ``k`` items of the places."""
        count = np.minimum(self.held[place], k)
        item = self.items[_spans(self.lead[place], count)]
        query, steps = np.repeat(query, count), np.repeat(steps, count)
        order = np.lexsort((self.order[item], -steps, query))
        query, item, steps = query[order], item[order], steps[order]
        first = np.arange(len(query)) - np.searchsorted(query, query) < k
        return query[first], item[first], steps[first]

    def search(self, asked: pa.RecordBatch, k: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
        """Query ids, item ids and scores for queries (query_id, terms, weights, least), in pieces."""
        lists = asked["terms"]
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        query = np.repeat(np.arange(asked.num_rows), sizes)
        code = pc.index_in(lists.flatten(), value_set=self.terms)
        known = pc.is_valid(code).to_numpy(zero_copy_only=False)
        term = pc.fill_null(code, 0).to_numpy(zero_copy_only=False)[known].astype(np.int64)
        weight = asked["weights"].flatten().to_numpy(zero_copy_only=False)[known]
        query = query[known]
        least = np.floor(asked["least"].to_numpy(zero_copy_only=False) * 10 ** SCORE_DECIMALS + 0.5)
        step = max(1, CELLS // max(1, self.n))
        for first in range(0, asked.num_rows, step):
            last = min(first + step, asked.num_rows)
            part = slice(*np.searchsorted(query, [first, last]))
            if part.stop > part.start:
                q, item, steps = self._listed(*self.best(query[part] - first, term[part], weight[part], least[first:last], k), k)
                yield asked["query_id"].take(pa.array(q + first)), self.item_ids.take(pa.array(item)), steps / 10 ** SCORE_DECIMALS


def _stored(uri: str, group: int) -> Iterator[pa.RecordBatch]:
    """The queries of a group, from their table in the shared folder."""
    files, folder = pf.FileSystem.from_uri(uri)
    where = pf.FileSelector(f"{folder}/bucket={group}", allow_not_found=True)
    for info in files.get_file_info(where):
        if info.base_name.startswith("part-"):
            with files.open_input_file(info.path) as source:
                table = pq.ParquetFile(source, pre_buffer=False, buffer_size=1 << 20)
                yield from table.iter_batches(QUERY_ROWS, columns=["query_id", "terms", "weights", "least"])


class _Unit:
    """Rows of one block as they arrive: its items and its postings."""

    def __init__(self, key: tuple) -> None:
        self.key, self.own, self.rows = key, None, []

    def block(self, mean_len: float, k1: float, b: float) -> Block | None:
        if self.own is None or not self.rows:
            return None
        table = pa.Table.from_batches(self.rows).combine_chunks()
        flat = lambda name: table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pc.list_value_length(table["places"]).to_numpy().astype(np.int64)
        numbers = lambda name: self.own[name].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return Block(self.own["item_ids"].flatten(), numbers("lens"), numbers("dead"), table["term"].combine_chunks(), sizes,
                     flat("places"), flat("tfs"), mean_len, k1, b, self.own["copies"].flatten(), numbers("copy_places"))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[_Unit]:
    """Sorted rows by block and group; kind 0 is the block itself, 1 a posting row."""
    unit = None
    for batch in batches:
        if not batch.num_rows:
            continue
        segment, block, group, kind = (batch[n].to_numpy(zero_copy_only=False) for n in ("segment", "block", "bucket", "kind"))
        new = (segment[1:] != segment[:-1]) | (block[1:] != block[:-1]) | (group[1:] != group[:-1]) | (kind[1:] != kind[:-1])
        edges = np.r_[0, np.flatnonzero(new) + 1, batch.num_rows]
        for a, z in zip(edges[:-1], edges[1:]):
            key = (segment[a], block[a], group[a])
            if unit is None or unit.key != key:
                if unit is not None:
                    yield unit
                unit = _Unit(key)
            piece = batch.slice(a, z - a)
            if kind[a] == 0:
                unit.own = piece
            else:
                unit.rows.append(piece)
    if unit is not None:
        yield unit


@dataclass
class _Search:
    """One search: its index, its weights (query_id, term, weight; written) and parameters."""

    index: LexicalIndex
    weights: DataFrame
    k: int
    k1: float
    b: float

    @cached_property
    def held(self) -> DataFrame:
        """Posting rows of the terms that are asked for."""
        terms = self.weights.select("term").distinct()
        few = terms.limit(FEW_TERMS + 1).collect()
        if len(few) <= FEW_TERMS:
            return self.index.packed.where(F.col("term").isin([r.term for r in few]))
        return self.index.packed.join(terms, "term", "left_semi")

    @cached_property
    def queries(self) -> DataFrame:
        """A row per query: its terms in order with their weights."""
        pairs = F.array_sort(F.collect_list(F.struct("term", "weight")))
        return self.weights.groupBy("query_id").agg(pairs.alias("x")).select(
            "query_id", F.col("x.term").alias("terms"), F.col("x.weight").alias("weights"))

    def _run(self, groups: int, uri: str, part: Column | None = None) -> DataFrame:
        """(query_id, item_id, score): the best of each block, or of those that ``part`` says, for the queries at ``uri``."""
        id_field, item = self.weights.schema["query_id"], self.index.blocks.schema["item_ids"].dataType
        schema = T.StructType([id_field, T.StructField("item_id", item.elementType)]).add("score", "double")
        k, mean_len, k1, b = self.k, self.index.mean_len, self.k1, self.b
        groups_ = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("bucket")
        key = ["segment", "block", "bucket"]
        columns = {"term": T.StringType(), "places": INTS, "tfs": INTS, "item_ids": item, "lens": INTS, "copies": item, "copy_places": INTS, "dead": INTS}

        def padded(df: DataFrame, kind: int, *names: str) -> DataFrame:
            rows = df if part is None else df.where(part)
            return _padded(rows.select("segment", "block", groups_, *names), key, kind, columns)

        blocks = self.index.blocks.withColumn("dead", F.coalesce("dead", F.array().cast(INTS)))
        rows = padded(blocks, 0, "item_ids", "lens", "copies", "copy_places", "dead").union(padded(self.held, 1, "term", "places", "tfs"))
        tasks = max(1, min(self.index.n_blocks * groups, 100_000))
        rows = rows.repartition(tasks, *key).sortWithinPartitions(*key, "kind", "term")

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for unit in _units(batches):
                block = unit.block(mean_len, k1, b)
                if block is not None:
                    for asked in _stored(uri, int(unit.key[2])):
                        for columns in block.search(asked, k):
                            yield pa.RecordBatch.from_arrays([columns[0], columns[1], pa.array(columns[2])], ["query_id", "item_id", "score"])

        return rows.mapInArrow(search, schema)

    def _ask(self, queries: DataFrame, blocks: int, part: Column | None = None) -> DataFrame:
        """Candidates from about so many blocks for queries (query_id, terms, weights, least)."""
        spark, groups = self.weights.sparkSession, max(1, -(-SPREAD // max(1, blocks)))
        path = scratch_path(spark, "asked")
        bucket = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")
        queries.select("query_id", "terms", "weights", "least", bucket.alias("bucket")).write.partitionBy("bucket").parquet(path)
        return self._run(groups, qualified(spark, path), part)

    def _rounds(self, queries: DataFrame) -> DataFrame:
        """Candidates of all blocks: a round's lists are cut to ``k`` and give the next its thresholds."""
        n = self.index.n_blocks
        at = F.pmod(F.xxhash64("segment", "block"), F.lit(1 << 30)) / float(1 << 30)
        done, reach, lists = 0, max(1, SHARE // REACH), None
        while True:
            reach = n if reach * REACH > n else reach
            part = (at >= done / n) & (at < reach / n)
            least = F.lit(0.0)
            if lists is not None:
                last = lists.where(F.col("rank") == self.k).select("query_id", F.col("score").alias("least"))
                queries, least = queries.drop("least").join(last, "query_id", "left"), F.coalesce("least", F.lit(0.0))
            found = self._ask(queries.withColumn("least", least), reach - done, part)
            if lists is not None:
                found = found.union(lists.drop("rank"))
            if reach == n:
                return found
            lists = materialize(top_k(found, self.k), "round")
            done, reach = reach, reach * REACH

    def run(self) -> DataFrame:
        """(query_id, item_id, rank, score)."""
        queries, same = self.queries, None
        if self.index.n_blocks > SHARE or self.index.n_items > FEW_ITEMS:
            queries = materialize(queries, "queries")
            words = ["terms", "weights"]
            if queries.count() > COPIES * queries.select(F.xxhash64(*words)).distinct().count():
                one = queries.groupBy(*words).agg(F.min("query_id").alias("first"))
                same = materialize(lookup(queries, one, words).select("query_id", "first"), "same-queries")
                queries = one.withColumnRenamed("first", "query_id")
        if self.index.n_blocks > SHARE:
            found = self._rounds(queries)
        else:
            found = self._ask(queries.withColumn("least", F.lit(0.0)), self.index.n_blocks)
        lists = top_k(found, self.k)
        if same is not None:
            lists = same.join(lists.withColumnRenamed("query_id", "first"), "first")
        return lists.select("query_id", "item_id", "rank", "score")


def bm25_topk(index: LexicalIndex, query_terms: DataFrame, k: int = 20,
              k1: float = K1, b: float = B) -> DataFrame:
    """Ranked list (query_id, item_id, rank, score) of the ``k`` best items per query.

    ``query_terms`` is (query_id, term, qtf); a term counts as often as it occurs.
    Only items that share a term with the query are listed.
    """
    known = lookup(query_terms, index.terms, ["term"], salt_by=["query_id"])
    weights = materialize(known.select("query_id", "term", (
        F.col("qtf") * idf(F.col("df"), index.n_items)).alias("weight")), "query-weights")
    return _Search(index, weights, k, k1, b).run()


def bm25_rank_scored(index: LexicalIndex, query_terms: DataFrame, k: int = 20) -> DataFrame:
    """The same list with the reciprocal rank as score."""
    return rank_score(bm25_topk(index, query_terms, k))
