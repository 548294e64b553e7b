"""Benchmark decontamination with suffix arrays over the training documents.

Each task turns its documents, a bounded number of bytes at a time, into a shard: one
sequence of word numbers and the sorted array of its suffixes. Every suffix of the
benchmark items is looked up in every shard by binary search; the suffixes in the range
found are all verbatim occurrences, and occurrences that follow one another on both
sides join to the longest matches. A document's suffix can only be found if its first
words begin a benchmark suffix, so only those suffixes are sorted.

Benchmarks of any size are used in blocks of bounded size, one pass each; documents are
neither shuffled nor gathered.

Defined results: a null or empty text has no words and is never hit; an item without
words has no window and one of fewer words than a window is a window itself; an item
with a null id hits words but is not counted or named. Items with one id count once.
Repeated rows are judged one by one; an empty table on either side gives no hit. Other
columns are handed on untouched, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow.llm.batches import cut

WINDOW = 13
#: Hit words make a document contaminated from one in so many.
SHARE = 20
BLOCK_CHARS = 8 << 20
SHARD_BYTES = 16 << 20

_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(b if b in _KEEP else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

HITS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
MATCHES = T.ArrayType(T.StructType([
    T.StructField("item_id", T.StringType()), T.StructField("item_start", T.IntegerType()),
    T.StructField("start", T.IntegerType()), T.StructField("n_words", T.IntegerType())]))
FOUND = (("n_words", T.LongType()), ("hits", HITS), ("items", T.ArrayType(T.StringType())), ("matches", MATCHES))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words of UTF-8 text: runs of digits, letters and characters beyond ASCII."""
    return text.translate(_FOLD).split() if text else []


@dataclass(frozen=True)
class Suffixes:
    """The suffixes of a block of benchmark items, each cut to its window.

    ``place[s]`` and ``item[s]`` say where suffix ``s`` stands; ``window[s]`` is the row of ``words`` (padded with
    zeros) and of ``length`` that holds its window. ``heads`` are the first words of all windows, as sorted numbers.
    """

    numbers: dict[bytes, int]
    ids: list[str | None]
    item: np.ndarray
    place: np.ndarray
    window: np.ndarray
    words: np.ndarray
    length: np.ndarray
    head: int
    heads: np.ndarray


def suffixes(items: Sequence[tuple[str | None, bytes | None]]) -> Suffixes:
    numbers: dict[bytes, int] = {}
    rows: dict[tuple[int, ...], int] = {}
    ids, item, place, window = [], [], [], []
    for item_id, text in items:
        words = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(text)]
        if not words:
            continue
        width = min(WINDOW, len(words))
        for at in range(len(words) - width + 1):
            item.append(len(ids))
            place.append(at)
            window.append(rows.setdefault(tuple(words[at:at + width]), len(rows)))
        ids.append(item_id)
    length = np.array([len(r) for r in rows], np.int64)
    table = np.zeros((len(rows), WINDOW), np.int64)
    for r, k in rows.items():
        table[k, :len(r)] = r
    head = int(min(3, length.min())) if len(rows) else 1
    return Suffixes(numbers, ids, np.array(item, np.int64), np.array(place, np.int64), np.array(window, np.int64),
                    table, length, head, np.unique(_heads(table, head, len(numbers) + 1)))


def _heads(table: np.ndarray, head: int, base: int) -> np.ndarray:
    """The first ``head`` words of each row as one number."""
    out = np.zeros(len(table), np.int64)
    for k in range(head):
        out = out * base + table[:, k]
    return out


def suffix_array(tokens: np.ndarray, s: Suffixes) -> np.ndarray:
    """Places in ``tokens`` (ended by a window of zeros) whose first words begin a benchmark suffix, in the order of
    the suffixes there, as far as a window reaches."""
    base, n = len(s.numbers) + 1, len(tokens) - WINDOW
    first = np.zeros(n, np.int64)
    for k in range(s.head):
        first = first * base + tokens[k:n + k]
    at = np.searchsorted(s.heads, first).clip(max=len(s.heads) - 1)
    places = np.flatnonzero(s.heads[at] == first)
    return places[np.lexsort([tokens[places + k] for k in range(WINDOW - 1, -1, -1)])]


def _bound(tokens: np.ndarray, array: np.ndarray, s: Suffixes, past: bool) -> np.ndarray:
    """Where each window would stand in the suffix array: before its occurrences, or past them. Binary search of all."""
    low, high = np.zeros(len(s.words), np.int64), np.full(len(s.words), len(array), np.int64)
    columns = np.arange(WINDOW)
    inside = columns[None, :] < s.length[:, None]
    while len(busy := np.flatnonzero(low < high)):
        middle = (low[busy] + high[busy]) // 2
        there, want = tokens[array[middle][:, None] + columns], s.words[busy]
        differs = (there != want) & inside[busy]
        first = differs.argmax(axis=1)[:, None]
        sign = np.where(differs.any(axis=1), np.sign(
            np.take_along_axis(there, first, 1) - np.take_along_axis(want, first, 1))[:, 0], 0)
        right = sign <= 0 if past else sign < 0
        low[busy] = np.where(right, middle + 1, low[busy])
        high[busy] = np.where(right, high[busy], middle)
    return low


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def longest_matches(tokens: np.ndarray, s: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal verbatim matches as (place in ``tokens``, benchmark suffix it starts with, words), ascending by place."""
    array = suffix_array(tokens, s)
    none = np.zeros(0, np.int64)
    if not len(array):
        return none, none, none
    low = _bound(tokens, array, s, past=False)
    count = _bound(tokens, array, s, past=True) - low
    number = count[s.window]
    found = np.repeat(np.arange(len(s.window)), number)
    place = array[_ranges(low[s.window], number)]
    if not len(place):
        return none, none, none
    # Occurrences of consecutive suffixes of one item at consecutive places are one match.
    order = np.lexsort((place, place - found))
    place, found = place[order], found[order]
    joins = (np.diff(place) == 1) & (np.diff(found) == 1) & (s.item[found[1:]] == s.item[found[:-1]])
    start = np.flatnonzero(np.concatenate(([True], ~joins)))
    run = np.diff(np.concatenate((start, [len(place)])))
    words = run - 1 + s.length[s.window[found[start]]]
    order = np.argsort(place[start], kind="stable")
    return place[start][order], found[start][order], words[order]


def _search(texts: list[bytes | None], hits: list | None, items: list | None, matches: list | None,
            s: Suffixes) -> tuple[list, list, list, list]:
    """Per text: words, hit intervals, item ids and matches, joined to those of earlier blocks."""
    get = s.numbers.get
    numbers, sizes = [], []
    for text in texts:
        words = words_of(text)
        sizes.append(len(words))
        numbers.append(np.fromiter(map(get, words, repeat(0)), np.int64, len(words)))
        numbers.append(np.zeros(1, np.int64))
    tokens = np.concatenate([*numbers, np.zeros(WINDOW, np.int64)])
    starts = np.cumsum([0, *(n + 1 for n in sizes)])
    place, suffix, length = longest_matches(tokens, s) if len(s.words) else (np.zeros(0, np.int64),) * 3
    owner = np.searchsorted(starts, place, side="right") - 1
    out_hits, out_items, out_matches = [], [], []
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    for k in range(len(texts)):
        mine = slice(cuts[k], cuts[k + 1])
        at, words = (place[mine] - starts[k]).tolist(), length[mine].tolist()
        spans = [*zip(at, (a + n for a, n in zip(at, words))), *((h["start"], h["end"]) for h in (hits[k] if hits else ()))]
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out_hits.append([{"start": a, "end": b} for a, b in merged])
        ids = [s.ids[i] for i in s.item[suffix[mine]].tolist()]
        out_items.append(sorted({i for i in ids if i is not None}.union(items[k] if items else ())))
        out_matches.append([*(matches[k] if matches else ()), *(
            {"item_id": i, "item_start": q, "start": a, "n_words": n}
            for i, q, a, n in zip(ids, s.place[suffix[mine]].tolist(), at, words))])
    return sizes, out_hits, out_items, out_matches


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """The items in blocks of about ``BLOCK_CHARS`` characters, one block at a time on the driver."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))
    n = max(1, math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / BLOCK_CHARS))
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, None if r.text is None else r.text.encode()) for r in block.collect()]


def search(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with columns renamed by position, and what was found, as expressions over them.

    ``n_words``; ``hits`` (disjoint intervals of hit words); ``items`` (ids, sorted); ``matches`` (each longest
    verbatim match with its places on both sides); ``n_hit``; ``contaminated``.
    """
    width = len(docs.columns)
    text = f"c{docs.columns.index(text_col)}"
    out = docs.toDF(*[f"c{i}" for i in range(width)])
    base = out.schema
    for block in _blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(suffixes(block))
        schema = T.StructType([*base.fields, *[T.StructField(name, kind) for name, kind in FOUND]])

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in cut(batches, text, SHARD_BYTES):
                before = [batch.column(n).to_pylist() if n in batch.schema.names else None for n, _ in FOUND]
                found = _search(batch.column(text).cast(pa.binary()).to_pylist(), *before[1:], shared.value)
                kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
                         pa.list_(pa.string()), pa.list_(pa.struct([
                             ("item_id", pa.string()), ("item_start", pa.int32()), ("start", pa.int32()),
                             ("n_words", pa.int32())])))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:width], *(pa.array(x, k) for x, k in zip(found, kinds))],
                    [*batch.schema.names[:width], *(n for n, _ in FOUND)])

        out = out.mapInArrow(scan, schema)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, h: total + h["end"] - h["start"])
    return out, {"n_words": F.col("n_words"), "hits": F.col("hits"), "items": F.col("items"), "matches": F.col("matches"),
                 "n_hit": n_hit, "contaminated": (n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))}


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``n_items``, SHA-256 of the item ids, ``contaminated`` and the longest match."""
    found, c = search(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark)
    longest = F.coalesce(F.array_max(F.transform(c["matches"], lambda m: m["n_words"])), F.lit(0)).cast("long")
    return found.select(
        F.col("c0").alias("doc_id"), "n_words", c["n_hit"].alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), c["contaminated"].alias("contaminated"),
        longest.alias("longest_match"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns as they were."""
    found, c = search(docs, benchmark, text_col)
    return found.where(~c["contaminated"]).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)])
