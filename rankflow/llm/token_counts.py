"""Token counts by the whole-token shortcut.

Before any text is read, the vocabulary is searched for the strings that are proved to
encode alone as one token. A word of a text that is such a string counts one; only the
other words are merged, each distinct one once while a worker remembers it.

Defined results: a null text counts as empty: no bytes, no tokens; a special token's
string within a text is one token, as in the public library; rows are counted one by
one, so repeated rows and an empty table need no rule. Only the id and text columns are
read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow.llm import bpe
from rankflow.llm.batches import cut

#: Fixed: how the vocabulary's tokenizer divides text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_TOKENS = 1024
#: Merged words of a generation that a worker remembers.
MEMORY = 200_000


class Counter:
    """Counts tokens; ``merged`` tells how many words the shortcut did not cover."""

    def __init__(self, vocabulary: bpe.Vocabulary) -> None:
        self.v = vocabulary
        self.proofs = bpe.Proofs(vocabulary)
        whole = bpe.whole_words(vocabulary, self.proofs.stable())
        self.whole = {text: 1 for w in whole if (text := _as_text(w)) is not None}
        self.known = bpe.Memory(len(self.whole) + MEMORY)
        self.known.young.update(self.whole)
        self.find = bpe.Splitter(WORDS, "isolated")
        self.specials = [s for s in vocabulary.special if s]
        self.split = regex.compile("|".join(map(regex.escape, self.specials)) or r"(?!)").split
        self.merged = 0

    def _of_words(self, words: list[str]) -> int:
        return sum(map(self.known.young.__getitem__, words))

    def learn(self, words: set[str]) -> None:
        """Count the tokens of the words that are not known."""
        rest = self.known.missing(words)
        if rest.intersection(self.whole):  # a new generation
            self.known.young.update(self.whole)
            rest.difference_update(self.whole)
        new = list(rest)
        self.merged += len(new)
        for word, ids in zip(new, self.proofs.merge_all([bpe.as_bytes(w) for w in new])):
            self.known.young[word] = len(ids)

    def counts(self, texts: list[str]) -> list[int]:
        """Numbers of tokens; the words of all texts are learnt at once."""
        parts = [self.split(t) if any(s in t for s in self.specials) else [t] for t in texts]
        words = [[self.find(p) for p in own] for own in parts]
        self.learn({w for own in words for part in own for w in part})
        return [len(own) - 1 + sum(map(self._of_words, own)) for own in words]

    def count(self, text: str) -> int:
        return self.counts([text])[0]


def _as_text(word: str) -> str | None:
    try:
        return word.encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return None


def counts(docs: DataFrame, vocabulary_path: str, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and whether these are more than ``max_tokens``, for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe.load(vocabulary_path))
    name = f"counter {bpe.fingerprint(vocabulary_path)}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = bpe.kept(name, lambda: Counter(shared.value))
        for batch in cut(batches, "text"):
            n = counter.counts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)]).add("n_bytes", "long").add("n_tokens", "long")
    return (docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                        text.alias("text"))
            .mapInArrow(count, schema)
            .withColumn("over_limit", F.col("n_tokens") > max_tokens))
