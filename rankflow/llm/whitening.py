"""Whitening of embeddings by blockwise QR and a bidiagonal qd solver.

Each entry c counts as the whole number floor(1024 c) + 100000. One pass sums the
vectors exactly. A second centres them and reduces every task's rows to a triangle by
blockwise QR; triangles are merged, a bounded number in a task at a time, until one is
left, so only one d x d triangle reaches the driver, whatever the number of rows. There
Householder reflections make it bidiagonal, dqds finds its singular values to high
relative accuracy, and twisted factorisations give the vectors of the largest ones,
which the reflections carry back. A third pass projects the rows; the covariance of
what it wrote is the reported identity error.

Defined results: a row whose vector is null, empty, or holds a null, a NaN or an infinity
is left out, as is one with an entry whose whole number needs more than 53 bits. If
vectors of several lengths are left, those of the length that most have (of equal ones
the longest) are kept, as no component applies to the others. A component without
variance (fewer distinct rows than dimensions) has no whitening and no rows; equal
eigenvalues give any orthonormal basis of their space. A ``deviation`` beyond the range of
a long is null. Repeated rows count and come out as often as they stand. Without rows
left there is no result row. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow.session import materialize

COMPONENTS = 8
SCALE, SHIFT = 1024.0, 100_000
#: Numbers of a block of rows that are worked on at a time, and of triangles that one task merges.
BLOCK_VALUES = 1 << 20
MERGE = 64
#: Whole numbers beyond are not exact as doubles.
EXACT = float(1 << 52)
EPS = np.finfo(float).eps


# -- rows as whole numbers ------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and whole numbers of the rows that count, a block at a time."""
    for batch in batches:
        step = max(1, BLOCK_VALUES // width)
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            vectors = part.column("vector")
            flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            yield part.column("id"), np.floor(SCALE * flat).astype(np.int64) + SHIFT


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``vector`` (doubles) of the rows that count, of any length."""
    vector = F.col(vector_col).cast("array<double>")
    fits = F.forall("vector", lambda c: F.coalesce(F.abs(c) < EXACT / SCALE, F.lit(False)))  # NaN is greater than all
    return rows.select(F.col(id_col).alias("id"), vector.alias("vector")).where(
        F.col("vector").isNotNull() & (F.size("vector") > 0) & fits)


@dataclass(frozen=True)
class Sums:
    """Number of rows, their length and the exact sums of their whole numbers."""

    n: int
    width: int
    total: tuple[int, ...]

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole number and fraction."""
        whole, rest = zip(*(divmod(s, self.n) for s in self.total))
        return np.array(whole, np.int64), np.array([r / self.n for r in rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole, fraction = self.centre()
        return (x - whole) - fraction


def _width(rows: DataFrame) -> int | None:
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    return most.d if most else None


def sums(rows: DataFrame, width: int) -> Sums:
    """One row of partial sums per task; high and low halves are added apart, so none overflows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for _, x in _blocks(batches, width):
            n += len(x)
            high += (x >> 26).sum(0)
            low += (x & ((1 << 26) - 1)).sum(0)
        if n:
            yield pa.RecordBatch.from_pylist([{"place": -1, "high": n, "low": 0}] + [
                {"place": i, "high": h, "low": w} for i, (h, w) in enumerate(zip(high.tolist(), low.tolist()))])

    parts = rows.mapInArrow(add, "place long, high long, low long").groupBy("place").agg(
        *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]).collect()
    found = {r.place: (int(r.high) << (26 if r.place >= 0 else 0)) + int(r.low) for r in parts}
    n = found.pop(-1, 0)
    return Sums(n, width, tuple(found[i] for i in range(width)) if n else ())


# -- blockwise QR -----------------------------------------------------------------


def _triangle(r: np.ndarray, block: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.vstack([r, block]), mode="r")


def triangle(rows: DataFrame, of: Sums) -> np.ndarray:
    """R of the centred rows: a triangle per task, merged ``MERGE`` at a time."""
    width, spark = of.width, rows.sparkSession

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for _, x in _blocks(batches, width):
            r = _triangle(r, of.centred(x))
        if len(r):
            yield pa.RecordBatch.from_pylist([{"values": r.reshape(-1).tolist()}])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, at = np.zeros((0, width)), None
        for batch in batches:
            for bucket, values in zip(batch.column("bucket").to_pylist(), batch.column("values").to_pylist()):
                if bucket != at and len(r):
                    yield pa.RecordBatch.from_pylist([{"values": r.reshape(-1).tolist()}])
                    r = np.zeros((0, width))
                r, at = _triangle(r, np.array(values).reshape(-1, width)), bucket
        if len(r):
            yield pa.RecordBatch.from_pylist([{"values": r.reshape(-1).tolist()}])

    parts = materialize(rows.mapInArrow(reduce, "values array<double>").withColumn("part", F.monotonically_increasing_id()), "triangles")
    while (n := parts.count()) > 1:
        # one triangle per bucket, however many tasks the buckets are dealt to
        bucket = F.pmod(F.xxhash64("part"), F.lit(-(-n // MERGE)))
        dealt = parts.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "part").select("bucket", "values")
        parts = materialize(dealt.mapInArrow(merge, "values array<double>").withColumn(
            "part", F.monotonically_increasing_id()), "triangles")
    values = parts.first()["values"]
    r = np.array(values).reshape(-1, width)
    return np.vstack([r, np.zeros((width - len(r), width))]) if len(r) < width else r


# -- bidiagonal solver ------------------------------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of the upper bidiagonal U'RV, and V, by Householder reflections."""
    a, v = r.copy(), np.eye(len(r))
    d = len(a)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if size == 0 or np.all(x[1:] == 0):
            return None
        u = x / size
        u[0] += math.copysign(1.0, u[0])
        return u / np.linalg.norm(u)

    for k in range(d):
        if (u := reflector(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k < d - 2 and (u := reflector(a[k, k + 1:])) is not None:
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ u, u)
            v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One differential qd transform with a shift; None if the shift was too large."""
    qs, es, d = [], [], q[0] - shift
    if d < 0:
        return None
    least = d
    for i in range(len(e)):
        top = d + e[i]
        qs.append(top)
        if top == 0:
            es.append(0.0)
            d = q[i + 1] - shift
        else:
            t = q[i + 1] / top
            es.append(e[i] * t)
            d = d * t - shift
        if d < 0 or d != d:
            return None
        least = min(least, d)
    qs.append(d)
    return qs, es, least


def _least_of_two(a: float, b: float, c: float) -> float:
    """Smaller eigenvalue of the 2 x 2 matrix with qd elements q = (a, c), e = b."""
    t = a + b + c
    if t == 0:
        return 0.0
    return a * c / ((t + math.sqrt(max(0.0, t * t - 4 * a * c))) / 2) if a * c else 0.0


def singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Singular values of a bidiagonal matrix in falling order, by dqds with deflation and splitting."""
    size = max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    if size == 0:
        return np.zeros(len(diagonal))
    found: list[float] = []
    work = [([float(x) ** 2 for x in diagonal / size], [float(x) ** 2 for x in above / size], 0.0)]
    while work:
        q, e, sigma = work.pop()
        tries = 0
        while q:
            tries += 1
            if len(q) == 1:
                found.append(q[0] + sigma)
                break
            if e[-1] <= EPS * EPS * (sigma + q[-1]) or e[-1] == 0:
                found.append(q.pop() + sigma)
                e.pop()
                tries = 0
                continue
            # a negligible e within: the two sides have values of their own
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= EPS * EPS * min(q[i] + sigma, q[i + 1] + sigma)), None)
            if cut is not None:
                work.append((q[:cut + 1], e[:cut], sigma))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if tries % 2 == 0 and q[0] < q[-1] and len(q) > 2 and tries < 4:
                q, e = q[::-1], e[::-1]  # small values belong at the end
            guess = min(_least_of_two(q[-2], e[-1], q[-1]), min(q)) if tries > 1 else 0.0
            step = None
            for shift in (guess * (1 - 4 * EPS), guess * 0.75, guess * 0.25, 0.0):
                if (step := _dqds(q, e, shift)) is not None:
                    break
            q, e, _ = step
            sigma += shift
    return size * np.sqrt(np.sort(np.array(found))[::-1])


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """Unit vector z with B'B z close to ``value`` z, by the twisted factorisation with the least pivot.

    B'B - value I is factored from the top (stationary qd) and from the bottom (progressive qd); the twist is where
    both meet with the smallest pivot, and z follows from there by products alone.
    """
    n = len(diagonal)
    q, e, tiny = diagonal ** 2, above ** 2, np.finfo(float).tiny
    # B'B = L D L' with pivots q and multipliers above / diagonal; both qd transforms of it shifted by value
    s, p = np.empty(n), np.empty(n)
    down, up = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
    s[0] = -value
    for i in range(n - 1):
        pivot = q[i] + s[i]
        pivot = pivot if abs(pivot) > tiny else -EPS * max(value, tiny)
        # multiplier of row i+1: entry (i, i+1) of B'B over the pivot
        down[i] = diagonal[i] * above[i] / pivot
        s[i + 1] = s[i] * (e[i] / pivot) - value
    p[n - 1] = q[n - 1] - value
    for i in range(n - 2, -1, -1):
        pivot = e[i] + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else -EPS * max(value, tiny)
        up[i] = diagonal[i] * above[i] / pivot
        p[i] = p[i + 1] * (q[i] / pivot) - value
    pivots = s + p + value
    k = int(np.argmin(np.abs(pivots)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
        if z[i] == 0 and i + 2 < n and z[i + 1] == 0:
            break
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    norm = np.linalg.norm(z)
    return z / norm if np.isfinite(norm) and norm > 0 else np.eye(n)[k]


def right_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Orthonormal right singular vectors (columns) of the ``count`` largest ``values`` of a bidiagonal matrix.

    Values close to each other share what twisted factorisation finds of their space: a vector that falls together with
    earlier ones is sought anew, orthogonal to them, by inverse iteration.
    """
    b = np.diag(diagonal) + np.diag(above, 1)
    scale = values[0] ** 2
    out = np.zeros((len(diagonal), 0))
    rng = np.random.default_rng(0)
    for k in range(count):
        z = twisted(diagonal, above, values[k] ** 2)
        near = [j for j in range(k) if values[j] - values[k] <= 1e-3 * values[k]]
        if near:
            basis = out[:, near]
            rest = z - basis @ (basis.T @ z)
            if np.linalg.norm(rest) < 0.5:
                shifted = b.T @ b - (values[k] ** 2 * (1 - 2 * EPS) - EPS * scale) * np.eye(len(b))
                rest = rng.standard_normal(len(b))
                for _ in range(4):
                    rest = rest - basis @ (basis.T @ rest)
                    rest = np.linalg.lstsq(shifted, rest / np.linalg.norm(rest), rcond=None)[0]
            z = rest
        for _ in range(2):
            z = z - out @ (out.T @ z)
            z = z / np.linalg.norm(z)
        out = np.column_stack([out, z])
    return out


@dataclass(frozen=True)
class Whitening:
    """Directions (columns, one per component), eigenvalues of the covariance and its trace."""

    sums: Sums
    directions: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.sums.centred(x) @ (self.directions / np.sqrt(self.eigenvalues))


def solve(r: np.ndarray, of: Sums, components: int = COMPONENTS) -> Whitening:
    """The whitening from the triangle of the centred rows."""
    diagonal, above, v = bidiagonal(r)
    values = singular_values(diagonal, above)
    kept = int((values[:components] > values[0] * EPS * max(of.n, len(values)) ** 0.5 * 8).sum()) if values[0] > 0 else 0
    directions = v @ right_vectors(diagonal, above, values, kept) if kept else np.zeros((len(r), 0))
    return Whitening(of, directions, values[:kept] ** 2 / of.n, float((r ** 2).sum()) / of.n)


# -- the operator -----------------------------------------------------------------


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``rows`` (``id``, ``vector`` of one length); None without rows."""
    width = _width(rows)
    if width is None:
        return None
    rows = rows.where(F.size("vector") == width)
    of = sums(rows, width)
    return solve(triangle(rows, of), of, components)


def _deviation(x: np.ndarray, of: Sums) -> list[int | None]:
    """Sums of (n x - S)^2, exact; null beyond a long."""
    whole = np.array(of.total, dtype=object)
    bound = max(max(abs(of.n * int(hi) - int(s)), abs(of.n * int(lo) - int(s))) for hi, lo, s in zip(x.max(0), x.min(0), of.total))
    if bound ** 2 * of.width < 1 << 62 and of.n * int(np.abs(x).max()) < 1 << 62:
        return ((of.n * x - whole.astype(np.int64)) ** 2).sum(1).tolist()
    exact = ((of.n * x.astype(object) - whole) ** 2).sum(1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """``id``, ``deviation`` and ``whitened`` (one number per component) of ``rows``; written."""
    schema = T.StructType([rows.schema["id"]]).add("deviation", "long").add("whitened", T.ArrayType(T.DoubleType()))
    width = model.sums.width

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, width):
            w = model.apply(x)
            yield pa.RecordBatch.from_arrays([ids, pa.array(_deviation(x, model.sums), pa.int64()),
                                              pa.array(list(w), pa.list_(pa.float64()))], ["id", "deviation", "whitened"])

    return materialize(rows.where(F.size("vector") == width).mapInArrow(project, schema), "whitened")


def identity_error(whitened: DataFrame, of: Sums, components: int) -> float:
    """Largest entry of the covariance of ``whitened`` minus the identity.

    Its means vanish but for rounding, so sums of products and their correction by the means lose nothing.
    """
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    at = lambda i: F.get("whitened", F.lit(i))
    row = whitened.agg(*[F.sum(at(i)).alias(f"s{i}") for i in range(components)],
                       *[F.sum(at(i) * at(j)).alias(f"p{i}_{j}") for i, j in pairs]).first()
    mean = [row[f"s{i}"] / of.n for i in range(components)]
    return max(abs(row[f"p{i}_{j}"] / of.n - mean[i] * mean[j] - (i == j)) for i, j in pairs)


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error`` for each row and
    component."""
    spark = rows.sparkSession
    ready = usable(rows, id_col, vector_col)
    model = fit(ready, components)
    schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType)]).add("component", "integer").add("n", "long").add(
        "deviation", "long").add("whitened", "double").add("explained", "double").add("identity_error", "double")
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], schema)
    kept = len(model.eigenvalues)
    table = transform(ready, model)
    error = identity_error(table, model.sums, kept)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    return (table.select("id", "deviation", F.posexplode("whitened").alias("place", "value"))
            .select(F.col("id").alias(id_col), (F.col("place") + 1).cast("int").alias("component"), F.lit(model.sums.n).cast("long").alias("n"),
                    "deviation", F.col("value").alias("whitened"), F.get(explained, F.col("place")).alias("explained"),
                    F.lit(error).alias("identity_error")))
