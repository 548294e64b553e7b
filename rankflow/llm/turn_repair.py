"""Conversation structure repair by a run-length dynamic programme.

A conversation is repaired by the cheapest edits after which the initials of its roles
read ``(s?(ua)+)?``. Every row is a symbol: its role's initial and its fault. Equal
consecutive symbols are a run; a symbol's transition is a 4 x 4 matrix of costs between
the states (start, after s, after u, after a), insertions before the row included, and a
run of n rows is passed at once by the cached powers 2^k of its min-plus matrix. The edits
follow from the costs to go: at each place the least of the initials D, I, K, R that lies
on a cheapest way. As an edit determines the next state and place, this is the least
string.

Rows are sorted by ranges of (conversation, turn, role, text), so that a crowded
conversation spans many tasks. Each task streams its rows and repairs what lies within
it. The first and last conversation of a task, and any of more than ``CHUNK_ROWS`` rows
or ``CHUNK_BYTES`` bytes, go on as chunks: repeated texts meet by an aggregate per
(conversation, text hash) of one row per chunk; each chunk gives its matrix; a pass over
the matrices from behind, holding four numbers, tells every chunk its costs to go; each
chunk then unrolls its edits from all four states, and a last pass in order picks the
state that holds and feeds the repaired text to the hash. Only those two passes see a
conversation's chunks in one task, one at a time, as a hash over its whole text must.

Defined results: a null role or text is one space; ``conv_id`` stays as it is, and rows
without one are a conversation. Rows of one turn go by role, then text. A role's initial
is its first character; an empty role has none and cannot be kept. Faults are told in
the order blank, duplicate, truncated. Repeated rows are duplicates. A conversation
without rows has zeros, an empty audit and the hash of the empty string. An empty table
has no rows. Columns beyond the four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow.llm.batches import cut
from rankflow.llm.rows import ROW
from rankflow.operators.joins import lookup
from rankflow.session import materialize

CHUNK_ROWS = 4096
CHUNK_BYTES = 4 << 20
#: Costs of the edits, and what a truncated row costs that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
INFINITE = 1 << 60
#: States: start, after s, after u, after a; the conversation may end at the start and after a.
STATES = range(4)
AFTER = {"s": 1, "u": 2, "a": 3}
NEXT = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
ENDS = (0, INFINITE, INFINITE, 0)
#: Faults of a row.
SOUND, GONE, CUT = 0, 1, 2
LEGAL = {"su", "ua", "au"}
#: A symbol is 3 * (place of the initial in ``INITIALS``) + fault; other initials are the last place.
INITIALS = "sua"
LONGS = T.ArrayType(T.LongType())

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]


def _best(m: Matrix, h: Vector) -> Vector:
    return tuple(min(min(c + x for c, x in zip(row, h)), INFINITE) for row in m)


def _times(a: Matrix, b: Matrix) -> Matrix:
    columns = list(zip(*b))
    return tuple(tuple(min(min(x + y for x, y in zip(row, col)), INFINITE) for col in columns) for row in a)


def _lead(initial: int, state: int) -> int | None:
    """State after a kept row of this initial, if it may stand there."""
    if initial == 0:
        return 1 if state == 0 else None
    if initial == 1:
        return 2 if state != 2 else None
    return 3 if initial == 2 and state == 2 else None


def _edits(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, state after) of the row in ``state``, without insertions, by initial."""
    initial, fault = divmod(symbol, 3)
    yield "D", DELETE, state
    if fault != GONE:
        late = TRUNCATED if fault == CUT else 0
        if (after := _lead(initial, state)) is not None:
            yield "K", late, after
        yield "R", REROLE + late, NEXT[state]


def _closure() -> Matrix:
    """Costs of insertions alone."""
    out = [[0 if i == j else INFINITE for j in STATES] for i in STATES]
    for i in STATES:
        at = i
        for n in (1, 2):
            at = NEXT[at]
            out[i][at] = min(out[i][at], n * INSERT)
    return tuple(map(tuple, out))


INSERTIONS = _closure()
FINAL = _best(INSERTIONS, ENDS)
UNIT: Matrix = tuple(tuple(0 if i == j else INFINITE for j in STATES) for i in STATES)


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> Matrix:
    """The matrix of 2^k rows of ``symbol``."""
    if k:
        return _times(power(symbol, k - 1), power(symbol, k - 1))
    m = [[INFINITE] * 4 for _ in STATES]
    for i in STATES:
        for _, cost, after in _edits(symbol, i):
            m[i][after] = min(m[i][after], cost)
    return _times(INSERTIONS, tuple(map(tuple, m)))


def runs(symbols: bytes) -> list[tuple[int, int]]:
    return [(symbol, sum(1 for _ in same)) for symbol, same in groupby(symbols)]


def _powers(symbol: int, n: int) -> Iterator[Matrix]:
    k = 0
    while n:
        if n & 1:
            yield power(symbol, k)
        n >>= 1
        k += 1


def back(symbols: bytes, h: Vector) -> Vector:
    """Costs to go before ``symbols``, given those after: each run by the powers of its matrix."""
    for symbol, n in reversed(runs(symbols)):
        for m in _powers(symbol, n):
            h = _best(m, h)
    return h


def total(symbols: bytes) -> Matrix:
    """The matrix of all ``symbols``."""
    out = UNIT
    for symbol, n in reversed(runs(symbols)):
        for m in _powers(symbol, n):
            out = _times(m, out)
    return out


@lru_cache(maxsize=1 << 16)
def _step(symbol: int, h: Vector) -> tuple[Vector, tuple[tuple[str, int], ...]]:
    """Costs to go before one row, less their least, and for each state the edits up to the row and the state after.

    ``h``: costs to go after the row, less their least. The choice depends on differences only.
    """
    here = _best(power(symbol, 0), h)
    chosen = []
    for state in STATES:
        edits, at = "", state
        while True:
            ways = [(e, cost + h[after], after) for e, cost, after in _edits(symbol, at)]
            ways.append(("I", INSERT + here[NEXT[at]], None))
            edit, _, after = min(w for w in ways if w[1] == here[at])
            edits += edit
            if edit != "I":
                break
            at = NEXT[at]
        chosen.append((edits, after))
    return _less(here), tuple(chosen)


def _less(h: Vector) -> Vector:
    least = min(h)
    return tuple(x - least for x in h)


def closing(state: int) -> str:
    """Insertions after the last row."""
    edits = ""
    while ENDS[state]:
        edits, state = edits + "I", NEXT[state]
    return edits


def unroll(symbols: bytes, h: Vector, states: Iterable[int] = (0,)) -> list[tuple[str, int]]:
    """The least cheapest edits of ``symbols`` from each of ``states`` and the state after, given the costs to go after."""
    h, steps = _less(h), []
    for symbol in reversed(symbols):
        h, chosen = _step(symbol, h)
        steps.append(chosen)
    steps.reverse()
    out = []
    for state in states:
        pieces = []
        for chosen in steps:
            edits, state = chosen[state]
            pieces.append(edits)
        out.append(("".join(pieces), state))
    return out


def repaired(edits: str, state: int, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """The lines ``role:text`` that ``edits`` leave of ``rows``, from ``state`` on."""
    for edit in edits:
        if edit == "I":
            state = NEXT[state]
            yield f"{ROLES[state]}:"
            continue
        role, text = next(rows)
        if edit == "K":
            state = AFTER[role[0]]
            yield f"{role}:{text}"
        elif edit == "R":
            state = NEXT[state]
            yield f"{ROLES[state]}:{text}"


# -- damage ------------------------------------------------------------------


def damaged(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` after the damage; a dropped row stays as one without a role."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    conv, turn = F.col(conv_col), F.col(turn_col)
    kind = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn))) % 20
    rows = messages.select(conv.alias("conv_id"), turn.alias("turn"), blank(F.col(role_col)).alias("role"),
                           blank(F.col(text_col)).alias("text"), kind.alias("kind"))
    text = (F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", r"[.!?]", ""))
            .otherwise(F.col("text")))
    role = F.when(F.col("kind") == 0, None).when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "kind")
    # the copy of a repeated row comes from an explode, not from a second scan
    times = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return out.withColumn("copy", F.explode(times)).select("conv_id", "turn", "role", "text")


def marked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``blank`` and ``cut``, what shows in a row alone."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    return rows.withColumn("blank", last == "").withColumn("cut", ~last.isin(".", "!", "?"))


# -- chunks ------------------------------------------------------------------


class _Chunk:
    """Consecutive rows of a conversation."""

    def __init__(self, conv) -> None:
        self.conv, self.turns, self.roles, self.texts, self.symbols = conv, [], [], [], bytearray()
        self.size, self.blank, self.duplicate, self.truncated = 0, 0, 0, 0
        self.first: dict[bytes, int] = {}
        self.gaps: list = []

    def add(self, turn, role: str | None, text: str, blank: bool, cut_off: bool) -> None:
        if role is None:
            return
        place = INITIALS.find(role[0]) if role else -1
        fault = GONE if blank else CUT if cut_off else SOUND
        if not blank:
            name = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            if name in self.first:
                fault = GONE
                self.duplicate += 1
            else:
                self.first[name] = len(self.roles)
        self.blank += blank
        self.truncated += fault == CUT
        self.symbols.append(3 * (place if place >= 0 else len(INITIALS)) + fault)
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text) + len(role)

    def n_turns(self) -> int:
        """Distinct turns, as they are in order; nulls come first."""
        known = [t for t in self.turns if t is not None]
        return sum(1 for i, t in enumerate(known) if not i or known[i - 1] != t)

    def illegal(self) -> int:
        initials = [r[:1] for r in self.roles]
        return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))

    def span(self) -> tuple:
        known = [t for t in self.turns if t is not None]
        return (known[0], known[-1]) if known else (None, None)


def _names(conv_type: T.DataType, turn_type: T.DataType) -> tuple[T.StructType, T.StructType]:
    """Schemas of a repaired conversation and of a chunk."""
    whole = T.StructType([T.StructField("conv_id", conv_type)]).add("gaps", "long").add("blank", "long").add("duplicate", "long")
    whole = whole.add("truncated", "long").add("illegal", "long").add("cost", "long").add("audit", "string").add("repaired_sha256", "string")
    texts = T.ArrayType(T.StringType())
    chunk = (T.StructType([T.StructField("conv_id", conv_type)]).add("symbols", "binary").add("roles", texts).add("texts", texts)
             .add("names", T.ArrayType(T.BinaryType())).add("places", T.ArrayType(T.IntegerType()))
             .add("n_turns", "long").add("from_turn", turn_type).add("to_turn", turn_type).add("blank", "long")
             .add("duplicate", "long").add("truncated", "long").add("illegal", "long"))
    return whole, chunk


def _gaps(first, last, distinct: int) -> int:
    return 0 if first is None else int(last - first + 1 - distinct)


def _whole(chunk: _Chunk) -> dict:
    """A conversation that is one chunk."""
    symbols = bytes(chunk.symbols)
    cost = back(symbols, FINAL)[0]
    edits, state = unroll(symbols, FINAL)[0]
    edits = (edits + closing(state)) if symbols else ""
    text = "\n".join(repaired(edits, 0, zip(chunk.roles, chunk.texts)))
    return {"conv_id": chunk.conv, "gaps": _gaps(*chunk.span(), chunk.n_turns()), "blank": chunk.blank, "duplicate": chunk.duplicate,
            "truncated": chunk.truncated, "illegal": chunk.illegal(), "cost": cost, "audit": edits,
            "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}


def _part(chunk: _Chunk) -> dict:
    first, last = chunk.span()
    return {"conv_id": chunk.conv, "symbols": bytes(chunk.symbols), "roles": chunk.roles, "texts": chunk.texts,
            "names": list(chunk.first), "places": list(chunk.first.values()), "n_turns": chunk.n_turns(), "from_turn": first, "to_turn": last,
            "blank": chunk.blank, "duplicate": chunk.duplicate, "truncated": chunk.truncated, "illegal": chunk.illegal()}


def _chunks(batches: Iterable[pa.RecordBatch], chunk_rows: int) -> Iterator[tuple[_Chunk, bool]]:
    """Chunks of sorted rows, each with whether it is a conversation that begins and ends between others of this task."""
    held, alone, first = None, True, True
    for batch in cut(batches, "text"):
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for conv, turn, role, text, blank, cut_off in zip(*columns):
            if held is None:
                held = _Chunk(conv)
            elif conv != held.conv:
                yield held, alone and not first
                held, alone, first = _Chunk(conv), True, False
            elif len(held.roles) >= chunk_rows or held.size >= CHUNK_BYTES:
                yield held, False
                held, alone = _Chunk(conv), False
            held.add(turn, role, text, bool(blank), bool(cut_off))
    if held is not None:
        yield held, False


def _flat(frame: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(frame)


def _batched(rows: Iterable[dict], schema: pa.Schema, limit: int = 500) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(map(len, (row.get("chunk") or {}).get("texts", ())))
        if len(held) == limit or size >= CHUNK_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def divided(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``whole`` (a repaired conversation) or ``chunk`` for each piece of the sorted ``rows``; written.

    ``ROW`` grows in the order of the rows.
    """
    whole, chunk = _names(rows.schema["conv_id"].dataType, rows.schema["turn"].dataType)
    schema = T.StructType().add("whole", whole).add("chunk", chunk)
    arrow = _flat(schema)

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(({"whole": _whole(c), "chunk": None} if alone else {"whole": None, "chunk": _part(c)}
                         for c, alone in _chunks(batches, chunk_rows)), arrow)

    # bounds are drawn from a sample of the keys; the start of a text suffices to divide equal turns
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64))
    dealt = dealt.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return materialize(marked(dealt).mapInArrow(divide, schema).withColumn(ROW, F.monotonically_increasing_id()), "conversations")


# -- conversations of several chunks ------------------------------------------


def _repeated(chunks: DataFrame) -> DataFrame:
    """(``ROW``, ``again``): places of a chunk whose role and text an earlier chunk of the conversation has."""
    said = chunks.select("conv_id", ROW, F.explode(F.arrays_zip("names", "places")).alias("x")).select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
        F.isnull("conv_id").alias("none"), F.col("x.names").alias("name"), F.col("x.places").alias("place"), ROW)
    key = ["conv", "none", "name"]
    first = said.groupBy(*key).agg(F.min(ROW).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return (lookup(said, first, key, salt_by=[ROW]).where(F.col(ROW) > F.col("first"))
            .groupBy(ROW).agg(F.collect_list("place").alias("again")))


def _streamed(rows: DataFrame, descending: bool) -> DataFrame:
    """All chunks of a conversation in one task, one after the other."""
    order = F.desc(ROW) if descending else F.asc(ROW)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", order)


def _linked(chunks: DataFrame) -> DataFrame:
    """Repaired conversations from their ``chunks`` (a written table)."""
    narrow = chunks.select("conv_id", "symbols", ROW).join(_repeated(chunks), ROW, "left")
    conv = chunks.schema["conv_id"]
    matrices = T.StructType([conv]).add(ROW, "long").add("symbols", "binary").add("duplicate", "long").add("truncated", "long").add(
        "matrix", LONGS)
    arrow_m = _flat(matrices)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(row: dict) -> dict:
            symbols, again = bytearray(row["symbols"]), row["again"] or []
            cut_off = sum(symbols[i] % 3 == CUT for i in again)
            for i in again:
                symbols[i] += GONE - symbols[i] % 3
            matrix = [x for line in total(bytes(symbols)) for x in line]
            return {"conv_id": row["conv_id"], ROW: row[ROW], "symbols": bytes(symbols), "duplicate": len(again),
                    "truncated": -cut_off, "matrix": matrix}
        return _batched((one(r) for b in batches for r in b.to_pylist()), arrow_m)

    tables = materialize(narrow.mapInArrow(summed, matrices), "chunk-matrices")
    costs = T.StructType().add(ROW, "long").add("after", LONGS).add("before", LONGS)
    arrow_c = _flat(costs)

    def behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            at, h = object(), FINAL
            for batch in batches:
                for row in batch.to_pylist():
                    if row["conv_id"] != at:
                        at, h = row["conv_id"], FINAL
                    after, m = h, row["matrix"]
                    h = _best(tuple(tuple(m[4 * i:4 * i + 4]) for i in STATES), h)
                    yield {ROW: row[ROW], "after": list(after), "before": list(h)}
        return _batched(each(), arrow_c)

    to_go = _streamed(tables.select("conv_id", "matrix", ROW), True).mapInArrow(behind, costs)
    ways = T.StructType().add(ROW, "long").add("edits", T.ArrayType(T.StringType())).add("states", LONGS).add("costs", LONGS).add(
        "more_duplicate", "long").add("more_truncated", "long")
    arrow_w = _flat(ways)

    def unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(row: dict) -> dict:
            found = unroll(bytes(row["symbols"]), tuple(row["after"]), STATES)
            return {ROW: row[ROW], "edits": [e for e, _ in found], "states": [s for _, s in found], "costs": row["before"],
                    "more_duplicate": row["duplicate"], "more_truncated": row["truncated"]}
        return _batched((one(r) for b in batches for r in b.to_pylist()), arrow_w)

    edits = tables.drop("conv_id", "matrix").join(materialize(to_go, "chunk-costs"), ROW).mapInArrow(unrolled, ways)
    full = chunks.drop("names", "places", "symbols").join(materialize(edits, "chunk-edits"), ROW)
    whole, _ = _names(conv.dataType, chunks.schema["from_turn"].dataType)
    arrow = _flat(whole)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(_joined(r for b in batches for r in b.to_pylist()), arrow)

    return _streamed(full, False).mapInArrow(finish, whole)


def _joined(rows: Iterator[dict]) -> Iterator[dict]:
    """One row per conversation from its chunks in order."""
    for conv, chunks in groupby(rows, key=lambda r: r["conv_id"]):
        out = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        digest, audit, state, begun, any_rows, any_line = hashlib.sha256(), [], 0, False, False, False
        first = last = before = None
        distinct = 0
        for c in chunks:
            for name in ("blank", "duplicate", "truncated", "illegal"):
                out[name] += c[name]
            out["duplicate"] += c["more_duplicate"]
            out["truncated"] += c["more_truncated"]
            if c["from_turn"] is not None:
                distinct += c["n_turns"] - (last is not None and last == c["from_turn"])
                first, last = c["from_turn"] if first is None else first, c["to_turn"]
            if not c["roles"]:
                continue
            if begun and before + c["roles"][0][:1] not in LEGAL:
                out["illegal"] += 1
            before = c["roles"][-1][:1]
            if not begun:
                out["cost"], begun = c["costs"][0], True
            piece = c["edits"][state]
            audit.append(piece)
            for line in repaired(piece, state, zip(c["roles"], c["texts"])):
                digest.update((("\n" if any_line else "") + line).encode())
                any_line = True
            state = c["states"][state]
        if begun:
            piece = closing(state)
            audit.append(piece)
            for line in repaired(piece, state, iter(())):
                digest.update((("\n" if any_line else "") + line).encode())
                any_line = True
        yield {"conv_id": conv, "gaps": _gaps(first, last, distinct), **out, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """A row per conversation of ``rows`` (``conv_id``, ``turn``, ``role``, ``text``; a row without a role only names its
    conversation): counts of faults, cost, ``audit`` and ``repaired_sha256``."""
    pieces = divided(rows, chunk_rows)
    whole = pieces.where("whole IS NOT NULL").select("whole.*")
    chunks = pieces.where("chunk IS NOT NULL").select("chunk.*", ROW)
    return whole.union(_linked(chunks))


def damage_and_repair(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text") -> DataFrame:
    """``messages`` damaged by their identifiers and repaired."""
    return repair(damaged(messages, conv_col, turn_col, role_col, text_col))
