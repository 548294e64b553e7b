"""SimHash near-duplicates by pigeonring filtering.

A fingerprint is a ring of eight segments of eight bits. If two differ in at most
three bits, then from some segment on every chain of consecutive segments keeps to its
share of the three: chains of up to two segments do not differ at all, of up to five in
one bit, of up to seven in two. Of the five segments from there on, four are thus equal,
the first two among them: each of the three ways and eight starts gives a key of 32
bits, and only fingerprints with a common key meet. The chains from the key's start are
then checked before the whole fingerprints are.

Equal fingerprints are one node from the start, so copies never meet. A crowded key is
dealt out in blocks, whose pairs meet in tasks of bounded size; what a task gives is a
spanning forest of the links it finds, so rows stay in proportion whatever the links.

Defined results: a text without words, empty or null, has the fingerprint zero and is
linked like any other; a component is named by its smallest id, null if it has none;
repeated rows are rows of their own in one component. An empty table has no rows. Other
columns are left out, or handed on untouched by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.llm.batches import cut
from rankflow.llm.components import components
from rankflow.llm.rows import ROW, numbered, renamed
from rankflow.session import materialize

SHINGLE = 3
SEED = 42
MAX_BITS = 3
SEGMENTS = 8
WIDTH = 64 // SEGMENTS
#: Places, counted from a chain's start, of the segments that make its keys.
WAYS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4))
#: Fingerprints of a crowded key that are compared in one task at most, about.
BLOCK = 4096


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of UTF-8 text: bits set in over half of its shingles' hashes, as a signed 64-bit number."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    n = max(1, len(words) - SHINGLE + 1)
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), "<u8", n)
    counts = np.zeros(64, np.int64)
    for start in range(0, n, 8192):
        part = hashes[start:start + 8192].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str) -> DataFrame:
    """The other columns of ``docs`` and ``fp``."""
    others = [c for c in docs.columns if c != text_col]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, text_col):
            fps = [fingerprint(t) for t in batch.column(text_col).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(fps, pa.int64())], [*others, "fp"])

    return docs.mapInArrow(run, ", ".join([*kinds, "fp long"]))


def _segment(fp: str, i: int) -> Column:
    return F.shiftrightunsigned(fp, WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long"))


def chain_keys(fp: str) -> Column:
    """The 24 keys: start and way in the upper half, four segments in the lower."""
    keys = []
    for start in range(SEGMENTS):
        for w, way in enumerate(WAYS):
            key = F.lit((start * len(WAYS) + w) << 32).cast("long")
            for k, place in enumerate(way):
                key = key.bitwiseOR(F.shiftleft(_segment(fp, start + place), WIDTH * k))
            keys.append(key)
    return F.array(*keys)


def chained(x: np.uint64, others: np.ndarray, start: int) -> np.ndarray:
    """Which of ``others`` keep to the budgets of all chains from segment ``start`` on, and then to that of the ring."""
    turn = np.uint64(WIDTH * start)
    differ = others ^ x
    if start:
        differ = (differ >> turn) | (differ << np.uint64(64 - WIDTH * start))
    held = np.arange(len(others))
    for length in range(3, SEGMENTS + 1):
        part = differ[held] & np.uint64((1 << (WIDTH * length)) - 1)
        held = held[np.bitwise_count(part) <= MAX_BITS * length // SEGMENTS]
    return held


def forest(fps: np.ndarray, start: int) -> Iterator[tuple[int, np.ndarray]]:
    """A spanning forest of the links among fingerprints of one key: a node and those first reached from it."""
    left = fps
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            x = reached.pop()
            near = chained(x, left, start)
            if len(near):
                yield x, left[near]
                reached.extend(left[near])
                left = np.delete(left, near)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Link rows of partitions whose rows of one cell (key and blocks) follow one another."""
    names = ["a", "b"]
    held: list[np.ndarray] = []
    cell = None

    def links(fps: np.ndarray, key: int) -> Iterator[pa.RecordBatch]:
        found = list(forest(np.unique(fps), (key >> 32) // len(WAYS)))
        if found:
            a = np.concatenate([np.full(len(near), x, np.uint64) for x, near in found]).view(np.int64)
            b = np.concatenate([near for _, near in found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names)

    for batch in batches:
        key, p, q, fp = (batch.column(c).to_numpy() for c in ("key", "p", "q", "fp"))
        if not len(key):
            continue
        new = np.flatnonzero((key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
        for start, end in zip([0, *new.tolist()], [*new.tolist(), len(key)]):
            here = int(key[start]), int(p[start]), int(q[start])
            if here != cell and held:
                yield from links(np.concatenate(held), cell[0])
                held = []
            cell = here
            held.append(fp[start:end].view(np.uint64))
    if held:
        yield from links(np.concatenate(held), cell[0])


def links(nodes: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) that connect all of the distinct fingerprints ``fp`` that a chain of links connects."""
    keyed = nodes.select("fp", F.explode(chain_keys("fp")).alias("key"))
    crowds = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = (keyed.join(crowds, "key").select("key", "fp", blocks.alias("blocks"))
           .withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .where("blocks = 1 or mine <> other")
           .select("key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "fp"))
    # Every two blocks of a crowded key meet once; a lone block meets itself.
    return met.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(_forests, "a long, b long")


def classes(prints: DataFrame) -> DataFrame:
    """(``fp``, ``root``) for each distinct ``fp`` of ``prints``."""
    nodes = materialize(prints.select("fp").distinct(), "fingerprints")
    found = components(links(nodes))
    return nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` for each row of ``docs``."""
    prints = materialize(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text"),
                         "prints")
    of_node = classes(prints).join(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp")
    least = of_node.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of_node.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that of smallest id, the first written of equal ones. Columns as they were."""
    rows = numbered(docs, "dedup-rows")
    key, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    prints = materialize(fingerprints(rows.select(ROW, F.col(key).alias("id"), F.col(text).alias("text")), "text"), "prints")
    first = F.min(F.struct(F.isnull("id").alias("none"), "id", ROW)).alias("first")
    of_node = classes(prints).join(prints.groupBy("fp").agg(first), "fp")
    kept = of_node.groupBy("root").agg(F.min("first").alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    return renamed(rows.join(kept, ROW, "left_semi"), docs)
