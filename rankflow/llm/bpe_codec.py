"""BPE encoding and decoding by speculation: propose greedily, verify pairs, merge only what fails.

A sequence of tokens is the BPE encoding of a word exactly if each token encodes alone
as itself and each two neighbours are compatible. The longest match from the left
proposes tokens for the distinct words of a batch, one vectorised check tests all
their neighbours at once, and only words with a failing pair are merged step by step.

Defined results: a null text counts as empty and has no tokens; strings of special
tokens within a text become those tokens, as in the public library; rows are coded one
by one, so repeated rows, ties and an empty table need no rule. Only the id and text
columns are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import normalizers

from rankflow.llm import bpe
from rankflow.llm.batches import cut

#: Fixed: how the vocabulary's tokenizer divides normalised text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Fixed: how it normalises a text; white space, which it also unifies, only divides words. ASCII needs lower case only.
NORMAL = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
#: Words of a generation that a worker remembers.
MEMORY = 250_000


class Codec:
    """Codes texts with one vocabulary; remembers words."""

    def __init__(self, vocabulary: bpe.Vocabulary) -> None:
        self.v = vocabulary
        self.proofs = bpe.Proofs(vocabulary)
        stable = self.proofs.stable()
        self.inner = {w: i for w, i in vocabulary.inner.items() if stable[i]}
        self.final = {w: i for w, i in vocabulary.final.items() if stable[i]}
        self.reach: dict[str, int] = {}
        for word in self.inner:
            self.reach[word[:2]] = max(self.reach.get(word[:2], 1), len(word))
        self.find = bpe.Splitter(WORDS, "removed")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")").split
        self.known, self.forms = bpe.Memory(MEMORY), bpe.Memory(MEMORY)
        self.merged = 0

    def words(self, text: str) -> list[str]:
        """Words of a text in order; special tokens stand as themselves after a NUL."""
        out: list[str] = []
        for k, part in enumerate(self.specials(text) if "<|" in text else (text,)):
            if k % 2:
                out.append("\0" + part)
            elif part:
                out += self.find(part.lower() if part.isascii() else NORMAL.normalize_str(part))
        return out

    def propose(self, word: str) -> list[int] | None:
        """Tokens of a word by longest match from the left; None where no token fits."""
        inner, final, reach = self.inner, self.final, self.reach
        ids, at, end = [], 0, len(word)
        while at < end:
            if (i := final.get(word[at:])) is not None:
                ids.append(i)
                return ids
            for stop in range(min(at + reach.get(word[at:at + 2], 1), end - 1), at, -1):
                if (i := inner.get(word[at:stop])) is not None:
                    ids.append(i)
                    at = stop
                    break
            else:
                return None
        return ids

    def codes(self, words: Iterable[str]) -> dict[str, list[int]]:
        """The codes of these distinct words."""
        out: dict[str, list[int]] = {}
        new, guesses, hard = [], [], []
        for word in words:
            if word.startswith("\0") and (i := self.v.special.get(word[1:])) is not None:
                out[word] = [i]
                continue
            raw = bpe.as_bytes(word)
            guess = self.propose(raw) if self.proofs.provable else None
            if guess is None:
                hard.append((word, raw))
            elif len(guess) == 1:
                out[word] = guess
            else:
                new.append((word, raw))
                guesses.append(guess)
        if new:
            flat = np.fromiter((i for g in guesses for i in g), np.int64)
            owner = np.repeat(np.arange(len(new)), [len(g) for g in guesses])
            seam = np.flatnonzero(owner[1:] == owner[:-1])
            size = self.proofs.size
            pairs, back = np.unique(flat[seam] * size + flat[seam + 1], return_inverse=True)
            fits = self.proofs.compatible(pairs // size, pairs % size)[back]
            wrong = np.zeros(len(new), bool)
            wrong[owner[seam[~fits]]] = True
            for pair, guess, fails in zip(new, guesses, wrong.tolist()):
                if fails:
                    hard.append(pair)
                else:
                    out[pair[0]] = guess
            self.merged += int(wrong.sum())
        for (word, _), ids in zip(hard, self.proofs.merge_all([raw for _, raw in hard])):
            out[word] = ids
        return out

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Token ids of each text."""
        split = [self.words(t) for t in texts]
        self.known.young.update(self.codes(self.known.missing({w for words in split for w in words})))
        known = self.known.young
        for words in split:
            yield [i for w in words for i in known[w]]

    def decode(self, ids: Iterable[int]) -> str:
        """Names of the tokens, a space between, as the library gives them for a file that names no decoder."""
        return " ".join(map(self.v.names.__getitem__, ids))

    def written(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text its number of tokens, and ids and names as text; each distinct word is written out once."""
        split = [self.words(t) for t in texts]
        new = self.codes(self.forms.missing({w for words in split for w in words}))
        forms = self.forms.young
        for word, ids in new.items():
            forms[word] = len(ids), " ".join(map(str, ids)), self.decode(ids)
        for words in split:
            n, ids, names = zip(*map(forms.__getitem__, words)) if words else ((), (), ())
            yield sum(n), " ".join(ids), " ".join(names)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (array<int>) and ``decoded`` (string) of each row."""
    columns = T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")
    return _coded(docs, vocabulary_path, id_col, text_col, columns, False)


def digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, and SHA-256 of the ids (decimal, space between) and of the decoded text."""
    columns = T.StructType().add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return _coded(docs, vocabulary_path, id_col, text_col, columns, True)


def _coded(docs: DataFrame, path: str, id_col: str, text_col: str, columns: T.StructType, digest: bool) -> DataFrame:
    spark = docs.sparkSession
    vocabulary, name = bpe.load(path), f"codec {bpe.fingerprint(path)}"
    shared = spark.sparkContext.broadcast(vocabulary)
    kinds = (pa.int64(), pa.string(), pa.string()) if digest else (pa.list_(pa.int32()), pa.string())
    names = ["doc_id", *columns.names]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.kept(name, lambda: Codec(shared.value))
        for batch in cut(batches, "text"):
            texts = batch.column("text").to_pylist()
            if digest:
                rows = [(n, _sha256(ids), _sha256(tokens)) for n, ids, tokens in codec.written(texts)]
            else:
                rows = [(ids, codec.decode(ids)) for ids in codec.encode(texts)]
            made = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names)

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *columns.fields])
    return (docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .mapInArrow(code, schema))
