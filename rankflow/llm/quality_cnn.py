"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, whole, in chunks that overlap. Learned filters slide over
the bytes; each chunk keeps the strongest response of every filter, and the mean, the
least and the greatest of these over the chunks of a text give one probability. A
filter is a table of what each byte adds at each place under it, the product of a byte
embedding and the filter's weights, so sliding is looking up and adding.

Training takes at most ``SAMPLE`` labelled documents, those first by a hash of the id,
and of each at most ``SAMPLE_CHUNKS`` whole chunks, as scoring sees them, spread over its
whole length; scoring reads every byte. Labels of held-out documents are never read into the sample.

Defined results: a null or empty text is one chunk of padding and has its score; rows
are scored one by one; a null id is not held out; labels without a document or without
a value, and other columns of either table, are left out. Without any label every score
is 0.5. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from rankflow.llm.batches import cut

WIDTH, STRIDE, FILTERS, EMBEDDING = 8, 2, 24, 8
#: Bytes of a block; a chunk is ``CHUNK`` blocks and begins ``STEP`` blocks after the one before.
BLOCK, CHUNK, STEP = 128, 4, 3
SAMPLE, SAMPLE_CHUNKS = 3000, 42
#: Steps of training, whatever the size of the sample.
STEPS, BATCH, RATE = 500, 64, 0.01
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
#: Blocks scored at a time.
SCORED = 2048


@dataclass
class Network:
    """Byte embedding, filter weights and biases, and the weights that combine the pooled responses."""

    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray

    def table(self) -> np.ndarray:
        """What each byte adds to each filter at each place: (place, byte, filter)."""
        return np.einsum("be,kef->kbf", self.embedding, self.weights).astype(np.float32)


def blocks_of(text: bytes) -> np.ndarray:
    """The bytes of a text as blocks (rows), each followed by the bytes that filters at its end still see."""
    n = max(1, -(-len(text) // BLOCK))
    padded = np.zeros(n * BLOCK + WIDTH, np.uint8)
    padded[:len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (n, BLOCK + WIDTH), (BLOCK, 1))


def responses(table: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Filter responses at every position: (block, position, filter)."""
    out = table[0][blocks[:, 0:BLOCK:STRIDE]]
    for k in range(1, WIDTH):
        out += table[k][blocks[:, k:k + BLOCK:STRIDE]]
    return out


def chunk_rows(n_blocks: int, step: int = STEP) -> np.ndarray:
    """The blocks of each chunk (chunk, ``CHUNK``); the last chunk repeats the last block where the text ends within it."""
    return (np.arange(0, max(1, n_blocks - 1), step)[:, None] + np.arange(CHUNK)).clip(max=n_blocks - 1)


@dataclass
class Sample:
    """Blocks of a text to train on, and after how many of them the next chunk begins."""

    blocks: np.ndarray
    step: int = STEP

    @classmethod
    def of(cls, text: bytes) -> Sample:
        """All blocks, or those of ``SAMPLE_CHUNKS`` chunks one after the other, the first and last chunk among them."""
        blocks = blocks_of(text)
        rows = chunk_rows(len(blocks))
        if len(rows) <= SAMPLE_CHUNKS:
            return cls(blocks)
        return cls(blocks[rows[np.linspace(0, len(rows) - 1, SAMPLE_CHUNKS).astype(int)].ravel()], CHUNK)


def pool_chunks(pooled: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """For one text, the strongest response of each chunk, and in which block it is."""
    rows = chunk_rows(len(pooled), step)
    of = pooled[rows]
    best = of.argmax(axis=1)
    return np.take_along_axis(of, best[:, None], 1)[:, 0], np.take_along_axis(rows[:, :, None], best[:, None], 1)[:, 0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def scores(net: Network, table: np.ndarray, texts: Sequence[bytes]) -> np.ndarray:
    """The probability of each text."""
    parts = [blocks_of(t) for t in texts]
    sizes = [len(p) for p in parts]
    stacked = np.concatenate(parts) if parts else np.zeros((0, BLOCK + WIDTH), np.uint8)
    pooled = np.concatenate([responses(table, stacked[i:i + SCORED]).max(axis=1)
                             for i in range(0, len(stacked), SCORED)] or [np.zeros((0, FILTERS), np.float32)])
    features, at = [], 0
    for n in sizes:
        h = np.tanh(pool_chunks(pooled[at:at + n])[0] + net.bias)
        features.append(np.concatenate((h.mean(axis=0), h.min(axis=0), h.max(axis=0))))
        at += n
    return _sigmoid(np.array(features).reshape(len(texts), -1) @ net.out + net.shift)


def train(samples: Sequence[Sample], labels: np.ndarray, seed: int = 7) -> Network:
    """A network fitted to samples of texts, by Adam on the cross-entropy; the least share of labels weighs as much."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.3, (256, EMBEDDING)), rng.normal(0, 0.3, (WIDTH, EMBEDDING, FILTERS)),
                  np.zeros(FILTERS), rng.normal(0, 0.1, 3 * FILTERS), np.zeros(1))
    if not len(samples):
        net.out[:] = 0
        return net
    names = [f.name for f in fields(net)]
    first, second = ({n: np.zeros_like(getattr(net, n)) for n in names} for _ in range(2))
    step = 0
    while step < STEPS:
        order = rng.permutation(len(samples))
        for start in range(0, len(order), BATCH):
            batch = order[start:start + BATCH]
            grads = _gradients(net, [samples[i] for i in batch], labels[batch])
            step += 1
            for n in names:
                first[n] = 0.9 * first[n] + 0.1 * grads[n]
                second[n] = 0.99 * second[n] + 0.01 * grads[n] ** 2
                change = first[n] / (1 - 0.9 ** step) / (np.sqrt(second[n] / (1 - 0.99 ** step)) + 1e-8)
                setattr(net, n, getattr(net, n) - RATE * max(0.1, 1 - 0.9 * step / STEPS) * change)
    return net


def _gradients(net: Network, texts: Sequence[Sample], labels: np.ndarray) -> dict[str, np.ndarray]:
    table = net.table()
    stacked = np.concatenate([t.blocks for t in texts])
    all_ = responses(table, stacked)
    where = all_.argmax(axis=1)
    pooled = np.take_along_axis(all_, where[:, None], 1)[:, 0]
    hidden, source, cuts, at = [], [], [0], 0
    for t in texts:
        best, block = pool_chunks(pooled[at:at + len(t.blocks)], t.step)
        hidden.append(np.tanh(best + net.bias))
        source.append(block + at)
        cuts.append(cuts[-1] + len(best))
        at += len(t.blocks)
    x = np.array([np.concatenate((h.mean(axis=0), h.min(axis=0), h.max(axis=0))) for h in hidden])
    error = (_sigmoid(x @ net.out + net.shift) - labels) / len(texts)
    dx = error[:, None] * net.out
    dh = np.zeros((cuts[-1], FILTERS))
    lanes = np.arange(FILTERS)
    for k, h in enumerate(hidden):
        mine = dh[cuts[k]:cuts[k + 1]]
        mine += dx[k, :FILTERS] / len(h)
        mine[h.argmin(axis=0), lanes] += dx[k, FILTERS:2 * FILTERS]
        mine[h.argmax(axis=0), lanes] += dx[k, 2 * FILTERS:]
    dh *= 1 - np.concatenate(hidden) ** 2
    block = np.concatenate(source)
    position = where[block, lanes] * STRIDE
    dtable = np.stack([np.bincount((stacked[block, position + k].astype(np.int64) * FILTERS + lanes).ravel(), dh.ravel(),
                                   256 * FILTERS).reshape(256, FILTERS) for k in range(WIDTH)])
    return {"embedding": np.einsum("kbf,kef->be", dtable, net.weights) + 1e-5 * net.embedding,
            "weights": np.einsum("kbf,be->kef", dtable, net.embedding) + 1e-5 * net.weights,
            "bias": dh.sum(axis=0), "out": x.T @ error + 1e-4 * net.out, "shift": np.array([error.sum()])}


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
           text_col: str = "text", size: int = SAMPLE) -> tuple[list[Sample], np.ndarray]:
    """Samples and labels of the training documents, in the order of the hash that picks them."""
    picked = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
              .groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("double").alias("label"))
              .orderBy(F.xxhash64("id"), "id").limit(size))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "text"):
            samples = [Sample.of(text) for text in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array([x.blocks.tobytes() for x in samples], pa.binary()),
                 pa.array([x.step for x in samples], pa.int32())], ["id", "label", "blocks", "step"])

    # At most ``size`` ids, so they may be broadcast.
    rows = (texts.join(F.broadcast(picked), "id").select("id", "label", "text")
            .mapInArrow(spread, StructType([StructField("id", texts.schema["id"].dataType)]).add("label", "double")
                        .add("blocks", "binary").add("step", "integer"))
            .orderBy(F.xxhash64("id"), "id", F.xxhash64("blocks")).limit(size).collect())
    return ([Sample(np.frombuffer(r.blocks, np.uint8).reshape(-1, BLOCK + WIDTH), r.step) for r in rows],
            np.array([r.label for r in rows]))


def classify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of each row of ``docs``."""
    table = net.table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "text"):
            found = scores(net, table, batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return (texts.mapInArrow(run, StructType([texts.schema["doc_id"]]).add("score", "double"))
            .select("doc_id", held_out("doc_id").alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
