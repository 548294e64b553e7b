"""Byte-pair vocabularies: exact merging, and proofs about tokens and pairs of tokens.

A vocabulary file is read once on the driver; what workers get of it is as large as
the file. Words are handled as Latin-1 text of their UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import regex
from tokenizers import Regex, pre_tokenizers

NEVER = np.iinfo(np.int64).max
NO_MERGE = (NEVER, -1)
#: Symbols from which a heap finds the next merge faster than a scan.
LONG_WORD = 64


def byte_letters() -> dict[str, str]:
    """The printable letter that byte-level vocabularies write for each byte, keyed by the byte as Latin-1."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): chr(b) for b in plain} | {chr(b): chr(256 + k) for k, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    """``inner`` and ``final`` map the bytes of tokens within and at the end of a word to ids.

    ``merges`` gives (rank, id) of what a pair of ids becomes; ``left``, ``right`` and ``made`` state for each id
    its two halves and the rank of their merge (-1 for single bytes). Without a word-end mark ``final`` is ``inner``.
    """

    names: list[str]
    inner: dict[str, int]
    final: dict[str, int]
    merges: dict[tuple[int, int], tuple[int, int]]
    left: np.ndarray
    right: np.ndarray
    made: np.ndarray
    special: dict[str, int]

    @property
    def provable(self) -> bool:
        """Whether each token comes from one merge only, later than those of its halves, as the proofs need."""
        once = len({new for _, new in self.merges.values()}) == len(self.merges)
        halves = self.made[self.left.clip(0)], self.made[self.right.clip(0)]
        return once and bool(np.all((self.made < 0) | ((halves[0] < self.made) & (halves[1] < self.made))))


def load(path: str) -> Vocabulary:
    """The vocabulary in a tokenizer file of the public JSON format."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    ids: dict[str, int] = model["vocab"]
    mark = model.get("end_of_word_suffix") or ""
    letters = {written: raw for raw, written in byte_letters().items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    size = max([*ids.values(), *special.values()]) + 1
    names = [""] * size
    for name, i in (ids | special).items():
        names[i] = name
    left, right, made = (np.full(size, -1, np.int64) for _ in range(3))
    ends = {i for name, i in ids.items() if mark and name.endswith(mark) and len(name) == 1 + len(mark)}
    merges: dict[tuple[int, int], tuple[int, int]] = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = (ids[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
        new = ids[names[a] + names[b]]
        merges.setdefault((a, b), (rank, new))
        left[new], right[new], made[new] = a, b, rank
        if b in ends:
            ends.add(new)
    inner, final = {}, {}
    for name, i in ids.items():
        bare = name[:-len(mark)] if i in ends else name
        if all(c in letters for c in bare):
            (final if i in ends else inner)["".join(letters[c] for c in bare)] = i
    return Vocabulary(names, inner, final if mark else inner, merges, left, right, made,
                      special)


def fingerprint(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


class Splitter:
    """Divides a text into words by a pattern, as the tokenizers library does.

    Scripts whose letters are long settled go through the faster pattern module; a text with any other character goes
    through the library, whose character classes may be of another Unicode version.
    """

    SETTLED = re.compile("[^\0-\u024f\u0370-\u0373\u0391-\u03a1\u03a3-\u03ff\u0400-\u0481\u2010-\u2027\u20ac\u3041-\u3096"
                         "\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]").search

    def __init__(self, pattern: str, gaps: str) -> None:
        """``gaps``: how the library names what to do with what the pattern leaves over."""
        self.fast = regex.compile(pattern).findall
        self.exact = pre_tokenizers.Split(Regex(pattern), gaps, invert=gaps == "removed").pre_tokenize_str

    def __call__(self, text: str) -> list[str]:
        return [w for w, _ in self.exact(text)] if self.SETTLED(text) else self.fast(text)


def as_bytes(word: str) -> str:
    return word if word.isascii() else word.encode("utf-8").decode("latin-1")


def merge(word: str, vocabulary: Vocabulary) -> list[int]:
    """Ids of one word by exact merging: always the pair of lowest rank, the leftmost of equal ones."""
    inner, merges = vocabulary.inner, vocabulary.merges
    ids = [inner[c] for c in word[:-1]] + [vocabulary.final[word[-1]]]
    return _merge_long(ids, merges) if len(ids) > LONG_WORD else _merge_short(ids, merges)


def _merge_short(ids: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """A scan for the lowest rank at each step: fast for few symbols."""
    get = merges.get
    found = [get(pair, NO_MERGE) for pair in zip(ids, ids[1:])]
    while found:
        best = min(found)
        if best is NO_MERGE:
            break
        i = found.index(best)
        ids[i:i + 2] = [best[1]]
        del found[i]
        if i:
            found[i - 1] = get((ids[i - 1], ids[i]), NO_MERGE)
        if i < len(found):
            found[i] = get((ids[i], ids[i + 1]), NO_MERGE)
    return ids


def _merge_long(ids: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The same in n log n steps, with a heap over a linked list."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(*found, i, i + 1) for i in range(n - 1) if (found := merges.get((ids[i], ids[i + 1])))]
    heapq.heapify(heap)
    while heap:
        rank, new, i, j = heapq.heappop(heap)
        if after[i] != j or j == n or merges.get((ids[i], ids[j])) != (rank, new):
            continue
        ids[i], ids[j] = new, -1
        after[i] = k = after[j]
        after[j] = -1
        if k < n:
            before[k] = i
            if found := merges.get((new, ids[k])):
                heapq.heappush(heap, (*found, i, k))
        if (h := before[i]) >= 0 and (found := merges.get((ids[h], new))):
            heapq.heappush(heap, (*found, h, i))
    return [x for x in ids if x >= 0]


#: What a Python worker keeps between tasks, by name.
_KEPT: dict[str, object] = {}


def kept(name: str, build: Callable[[], object]):
    """What ``build`` made at its first call with this name in this Python worker: memories outlive the task."""
    if name not in _KEPT:
        _KEPT[name] = build()
    return _KEPT[name]


class Memory:
    """What is known of words, in two generations.

    When the young one is full it becomes the old one, and the old one goes. A word that is asked for again moves to the
    young one, so frequent words stay.
    """

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, words: set[str]) -> set[str]:
        """Of these words those that are not known; the others are in ``young`` from then on."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        rest = words.difference(self.young)
        if self.old:
            young, old = self.young, self.old
            for word in rest.intersection(old):
                young[word] = old[word]
            rest.difference_update(young)
        return rest


class Proofs:
    """Which tokens stand as they are when encoded alone, and which may stand side by side."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.provable = vocabulary.provable
        self.size = len(vocabulary.names)
        self.bytes: np.ndarray | None = None
        pairs = np.array([a * self.size + b for a, b in vocabulary.merges], np.int64)
        order = np.argsort(pairs)
        self.pairs = pairs[order]
        self.ranks, self.news = np.array(list(vocabulary.merges.values()), np.int64).reshape(-1, 2)[order].T.copy()

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """Ids of each word by exact merging; words of one length take each step together.

        A step finds the lowest rank of each word, the leftmost of equal ones, and merges there. All words that are still
        open then have one symbol less, so they stay a matrix.
        """
        out: list[list[int]] = [[]] * len(words)
        lengths: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            lengths.setdefault(len(word), []).append(k)
        inner, final = self.v.inner, self.v.final
        for length, which in lengths.items():
            if not 1 < length <= LONG_WORD:
                for k in which:
                    out[k] = merge(words[k], self.v)
                continue
            letters = np.frombuffer("".join(words[k] for k in which).encode("latin-1"), np.uint8).reshape(-1, length)
            if self.bytes is None:
                self.bytes, self.last = (np.array([table.get(chr(c), -1) for c in range(256)], np.int64) for table in (inner, final))
            ids = self.bytes[letters]
            ids[:, -1] = self.last[letters[:, -1]]
            owner = np.array(which)
            rank, new = self._merges(ids[:, :-1].ravel(), ids[:, 1:].ravel())
            rank, new = rank.reshape(len(ids), -1), new.reshape(len(ids), -1)
            while True:
                at = rank.argmin(1)
                rows = np.arange(len(ids))
                open_ = rank[rows, at] != NEVER
                if not open_.all():
                    for k, done in zip(owner[~open_].tolist(), ids[~open_].tolist()):
                        out[k] = done
                    ids, rank, new, owner, at = ids[open_], rank[open_], new[open_], owner[open_], at[open_]
                    rows = np.arange(len(ids))
                if not len(ids):
                    break
                n = ids.shape[1]
                ids[rows, at] = new[rows, at]
                keep = np.ones(ids.shape, bool)
                keep[rows, at + 1] = False
                ids = ids[keep].reshape(-1, n - 1)
                if n == 2:
                    for k, done in zip(owner.tolist(), ids.tolist()):
                        out[k] = done
                    break
                keep = np.ones(rank.shape, bool)
                keep[rows, at] = False
                rank, new = rank[keep].reshape(-1, n - 2), new[keep].reshape(-1, n - 2)
                for seam in (at - 1, at):
                    r = rows[(seam >= 0) & (seam < n - 2)]
                    c = seam[r]
                    rank[r, c], new[r, c] = self._merges(ids[r, c], ids[r, c + 1])
        return out

    def _merges(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of what each pair becomes; NEVER where it stays."""
        keys = a * self.size + b
        at = np.searchsorted(self.pairs, keys).clip(max=len(self.pairs) - 1)
        found = self.pairs[at] == keys
        return np.where(found, self.ranks[at], NEVER), self.news[at]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.size + b
        at = np.searchsorted(self.pairs, keys).clip(max=len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | int = NEVER) -> np.ndarray:
        """For each pair of tokens, whether no merge before rank ``until`` joins a part of one to a part of the other.

        The merges that made both are taken back, the latest first. The pieces that touch at the seam then existed at
        the same time, and would have merged if their pair ranks before the merges that took them in: strictly so
        on the left, where an equal pair stands further left, and also in a tie on the right.
        """
        made, left, right = self.v.made, self.v.left, self.v.right
        ok = np.ones(len(a), bool)
        x, y = a.copy(), b.copy()
        gone_x = np.broadcast_to(np.asarray(until, np.int64), a.shape).copy()
        gone_y = gone_x.copy()
        open_ = np.arange(len(a))
        while len(open_):
            rank = self._rank(x, y)
            clash = (rank < gone_x) & (rank <= gone_y)
            ok[open_[clash]] = False
            undo_x = made[x] > made[y]
            go = ~clash & ((made[x] >= 0) | (made[y] >= 0))
            open_, x, y, gone_x, gone_y, undo_x = (z[go] for z in (open_, x, y, gone_x, gone_y, undo_x))
            gone_x, gone_y = np.where(undo_x, made[x], gone_x), np.where(undo_x, gone_y, made[y])
            x, y = np.where(undo_x, right[x], x), np.where(undo_x, y, left[y])
        return ok

    def stable(self) -> np.ndarray:
        """For each id, whether its bytes encode alone as this one token.

        Nothing but single bytes is claimed of a vocabulary whose merges do not allow the proof.
        """
        v = self.v
        if not self.provable:
            return v.made < 0
        out = v.made < 0
        made = np.flatnonzero(v.made >= 0)
        fits = self.compatible(v.left[made], v.right[made], v.made[made])
        for i, fit in sorted(zip(made.tolist(), fits.tolist()), key=lambda z: v.made[z[0]]):
            out[i] = fit and out[v.left[i]] and out[v.right[i]]
        return out


def whole_words(vocabulary: Vocabulary, stable: np.ndarray) -> Iterable[str]:
    """The words that encode as one token."""
    return (word for word, i in vocabulary.final.items() if stable[i])
