"""Whitening of vectors by their leading principal components.

Blocks of centred rows are reduced to triangles by QR, in the tasks and then in a
tree of merges, so that nothing as tall as the data leaves a task. The last
triangle is brought to bidiagonal form by reflections. The dqds transform gives its
singular values with small relative errors, and a twisted factorisation per value
gives the direction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.llm.common import cut

#: Triangles that are merged at once.
BRANCHES = 8
#: Rows reduced at once, at least; wider vectors take twice their width.
ROWS = 2048
EPS = np.finfo(float).eps
_LONG = 2**62


# ---------------------------------------------------------------- the solver


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right factor W of a square matrix: r = U B W^T with B upper bidiagonal."""
    a = np.array(r, float)
    n = len(a)
    right = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        norm = np.linalg.norm(x)
        if norm == 0 or not np.any(x[1:]):
            return None
        v = x / norm
        v[0] += np.copysign(1.0, v[0])
        return v / np.linalg.norm(v)

    for k in range(n):
        v = reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        v = reflector(a[k, k + 1 :]) if k + 1 < n else None
        if v is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= 2 * np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One dqds transform: the new arrays and the least pivot; None where a pivot is not positive."""
    out_q, out_e = [], []
    least = d = q[0] - shift
    for here, after in zip(e, q[1:]):
        both = d + here
        if d < 0 or both <= 0:
            return None
        ratio = after / both
        out_q.append(both)
        out_e.append(here * ratio)
        d = d * ratio - shift
        least = min(least, d)
    if d < 0:
        return None
    return [*out_q, d], out_e, least


def _guess(q: list[float], e: list[float]) -> float:
    """The lesser eigenvalue of the last two rows: close to the least one as soon as it settles at the end."""
    a = q[-2] + (e[-2] if len(e) > 1 else 0.0)
    b = q[-1] + e[-1]
    product = q[-2] * e[-1]
    half = (a + b) / 2
    root = np.hypot((a - b) / 2, np.sqrt(product))
    return max(0.0, (a * b - product) / (half + root)) if half + root > 0 else 0.0


def squared_singular_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling, by dqds."""
    norm = float(max(np.abs(diagonal).max(initial=0), np.abs(upper).max(initial=0)))
    if norm == 0:
        return np.zeros(len(diagonal))
    # A zero on the diagonal would end the transform; what stands for it is far below rounding.
    floor = (norm * EPS) ** 2 * EPS
    work = [([max(x * x, floor) for x in map(float, diagonal)], [x * x for x in map(float, upper)], 0.0)]
    found: list[float] = []
    while work:
        q, e, total = work.pop()
        least = 0.0
        while len(q) > 1:
            small = lambda i: e[i] <= EPS * EPS * (total + min(q[i], q[i + 1])) or (
                e[i] + math.sqrt(e[i] * max(q[i], q[i + 1])) <= EPS / 4 * total
            )
            gone = next((i for i in range(len(e) - 1, -1, -1) if small(i)), None)
            if gone is not None:
                work.append((q[: gone + 1], e[:gone], total))
                q, e = q[gone + 1 :], e[gone + 1 :]
                continue
            if q[0] * 1.5 < q[-1]:
                # The mirrored matrix has the same values, and its least are sooner at the end.
                q, e = q[::-1], e[::-1]
            guess = _guess(q, e) * (1 - 4 * EPS)
            for shift in (guess, guess * 0.75, guess * 0.25, least * 0.75, least * 0.25, 0.0):
                tried = _sweep(q, e, shift)
                if tried is not None:
                    break
            q, e, least = tried
            total += shift
        found.append(total + q[0])
    return np.sort(np.array(found))[::-1]


class _Twisted:
    """L D L^T - shift, factored from both ends towards the row where the remainder is least."""

    def __init__(self, d: np.ndarray, low: np.ndarray, shift: float):
        n = len(d)
        tiny = np.abs(d).max() * EPS * EPS + np.finfo(float).tiny
        down, self.top = np.zeros(n), np.zeros(max(0, n - 1))
        s = np.zeros(n)
        s[0] = -shift
        for i in range(n - 1):
            down[i] = d[i] + s[i] or tiny
            self.top[i] = d[i] * low[i] / down[i]
            s[i + 1] = self.top[i] * low[i] * s[i] - shift
        down[n - 1] = d[n - 1] + s[n - 1] or tiny
        up, self.bottom = np.zeros(n), np.zeros(max(0, n - 1))
        p = np.zeros(n)
        p[n - 1] = d[n - 1] - shift
        for i in range(n - 2, -1, -1):
            up[i + 1] = d[i] * low[i] ** 2 + p[i + 1] or tiny
            t = d[i] / up[i + 1]
            self.bottom[i] = low[i] * t
            p[i] = p[i + 1] * t - shift
        rest = s + p + shift
        self.at = int(np.argmin(np.where(np.isfinite(rest), np.abs(rest), np.inf)))
        self.pivots = np.concatenate((down[: self.at], [rest[self.at] or tiny], up[self.at + 1 :]))

    def _back(self, w: np.ndarray) -> np.ndarray:
        for i in range(self.at - 1, -1, -1):
            w[i] -= self.top[i] * w[i + 1]
        for i in range(self.at, len(w) - 1):
            w[i + 1] -= self.bottom[i] * w[i]
        return w / np.linalg.norm(w)

    def direction(self) -> np.ndarray:
        """The vector that the factorisation gives by products alone."""
        w = np.zeros(len(self.pivots))
        w[self.at] = 1
        return self._back(w)

    def solve(self, v: np.ndarray) -> np.ndarray:
        """The direction of the solution for a right-hand side."""
        y = v.copy()
        for i in range(1, self.at + 1):
            y[i] -= self.top[i - 1] * y[i - 1]
        for i in range(len(y) - 2, self.at - 1, -1):
            y[i] -= self.bottom[i] * y[i + 1]
        w = y / self.pivots
        return self._back(w / np.abs(w).max())


def directions(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of B^T B for some of its eigenvalues, falling, as columns.

    Each is made orthogonal to those before it, which matters where values are close;
    where little is left it is found again by inverse iteration.
    """
    n = len(diagonal)
    norm = max(np.abs(diagonal).max(initial=0), np.abs(upper).max(initial=0), np.finfo(float).tiny)
    safe = np.where(np.abs(diagonal) < norm * EPS, norm * EPS, diagonal)
    upper = np.where(np.abs(upper) < norm * EPS, 0.0, upper)
    d, low = safe**2, upper / safe[:-1] if n > 1 else upper
    out = np.zeros((n, len(values)))
    rng = np.random.default_rng(3)
    for j, value in enumerate(values):
        apart = lambda v: v - out[:, :j] @ (out[:, :j].T @ v)
        factors = _Twisted(d, low, value)
        v = apart(apart(factors.direction()))
        if np.linalg.norm(v) < 0.5:
            v = apart(rng.standard_normal(n))
            for _ in range(4):
                v = apart(apart(factors.solve(v / np.linalg.norm(v))))
        out[:, j] = v / np.linalg.norm(v)
    return out


def principal_components(r: np.ndarray, rows: int, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues and unit eigenvectors (columns) of r^T r / rows, the largest first, and its trace."""
    diagonal, upper, right = bidiagonal(r)
    values = squared_singular_values(diagonal, upper)
    top = values[:components]
    return top / rows, right @ directions(diagonal, upper, top), float((r**2).sum() / rows)


# ---------------------------------------------------------------- the data


def whole_vectors(rows: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """(id, x) with x = floor(scale * component) of the vectors that are complete and finite."""
    usable = F.forall(vector_column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != F.lit(float("inf"))))
    named = rows.filter(F.col(vector_column).isNotNull() & usable)
    floors = F.transform(vector_column, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return named.select(F.col(id_column).alias("id"), floors.alias("x"))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of a list array; shorter vectors end in zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


@dataclass
class _Centre:
    """Number of fitted vectors and their sums, and differences from their mean."""

    n: int
    sums: list[int]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as 64-bit numbers where they fit, as Python's beyond."""
        largest = self.n * int(np.abs(x.astype(float)).max(initial=0) + 1) + max(map(abs, self.sums), default=0)
        if largest < _LONG:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(float)

    def deviation(self, x: np.ndarray) -> pa.Array:
        apart = self.scaled(x)
        if apart.dtype == object or np.abs(apart).max(initial=0).astype(float) ** 2 * max(1, apart.shape[1]) >= _LONG:
            apart = apart.astype(object)
        squares = (apart * apart).sum(axis=1) if apart.shape[1] else np.zeros(len(x), np.int64)
        if squares.dtype != object:
            return pa.array(squares).cast(pa.decimal128(38, 0))
        return pa.array([int(s) if s < 10**38 else None for s in squares], pa.decimal128(38, 0))


def _column_sums(fit: DataFrame, width: int) -> list[int]:
    """The sum of each dimension; a row per task and dimension is all that is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(width, object)
        for batch in batches:
            x = _matrix(batch.column(0), width)
            safe = np.abs(x.astype(float)).max(initial=0) * len(x) < _LONG
            sums += (x if safe else x.astype(object)).sum(axis=0).astype(object)
        found = [pa.array(range(width), pa.int32()), pa.array([int(s) for s in sums], pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(found, ["place", "total"])

    parts = fit.select("x").mapInArrow(run, "place int, total decimal(38,0)")
    rows = parts.groupBy("place").agg(F.sum("total").alias("total")).collect()
    return [int(r["total"]) for r in sorted(rows)]


def _stacked(r: np.ndarray, more: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.concatenate((r, more)), mode="r")


def _triangle(fit: DataFrame, centre: _Centre, width: int) -> np.ndarray:
    """R of the centred rows: one triangle per task, merged some at a time until one is left."""
    rows = max(ROWS, 2 * width)
    context = fit.sparkSession.sparkContext.broadcast(centre)

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, held, size = np.zeros((0, width)), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                held.append(context.value.centred(_matrix(batch.column(0).slice(at, rows), width)))
                size += len(held[-1])
                if size >= rows:
                    r, held, size = _stacked(r, np.concatenate(held)), [], 0
        if held:
            r = _stacked(r, np.concatenate(held))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        r = np.zeros((0, width))
        for part in frame["r"]:
            r = _stacked(r, np.frombuffer(part).reshape(-1, width))
        return pd.DataFrame({"r": [r.tobytes()]})

    parts = fit.select("x").mapInArrow(reduce_rows, "r binary")
    count = fit.rdd.getNumPartitions()
    # Tasks are dealt by their numbers, so the merge has a known number of levels.
    parts = parts.select("r", F.spark_partition_id().alias("part"))
    while True:
        count = max(1, -(-count // BRANCHES))
        merged = parts.groupBy((F.col("part") % count).alias("branch"))
        parts = merged.applyInPandas(lambda key, frame: merge(frame).assign(part=key[0]), "r binary, part int")
        if count == 1:
            break
    found = parts.select("r").collect()
    r = np.zeros((width, width))
    if found:
        last = np.frombuffer(bytes(found[0]["r"])).reshape(-1, width)
        r[: len(last)] = last
    return r


def _identity_error(fit: DataFrame, centre: _Centre, weights: np.ndarray, width: int) -> float | None:
    """Largest difference between the covariance of the whitened fitted rows and the identity."""
    k = weights.shape[1]
    if not k:
        return None
    shared = fit.sparkSession.sparkContext.broadcast((centre, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, weights = shared.value
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            white = centre.centred(_matrix(batch.column(0), width)) @ weights
            sums += white.sum(axis=0)
            products += white.T @ white
        values = np.concatenate((sums, products.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], ["place", "value"])

    parts = fit.select("x").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    values = np.array([r["value"] for r in sorted(parts.collect())]) / centre.n
    covariance = values[k:].reshape(k, k) - np.outer(values[:k], values[:k])
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(
    rows: DataFrame,
    components: int = 4,
    scale: float = 256.0,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """Rows ``vec_id, component, n, deviation, whitened, explained, identity_error`` for each usable vector and component.

    Components of vectors count as x = floor(scale * component), held within 64 bits.
    The covariance is that of the ``n`` distinct x. ``deviation`` is the squared
    length of n * x - S, S being their sums, as an exact decimal, NULL beyond 38
    digits. Components are
    unit eigenvectors, numbered from 1 by falling eigenvalue, ``explained`` has their
    part of the trace, and ``identity_error`` says how far the covariance of the
    whitened values is from the identity.

    Vectors that are NULL or hold a NULL, NaN or infinite component are left out;
    a shorter vector counts as ending in zeros. There are as many components as the
    vectors have dimensions, at most ``components``. One whose eigenvalue is zero up
    to rounding has NULL ``whitened``, and ``explained`` is NULL where all vectors are
    equal; ``identity_error`` covers the others and is NULL without any. Repeated rows
    give repeated results, a NULL id passes through, an empty table gives no rows,
    and so do vectors without dimensions. Other columns are not read.
    """
    named = whole_vectors(rows, id_column, vector_column, scale)
    kind = named.schema["id"].dataType.simpleString()
    width = named.agg(F.max(F.size("x"))).first()[0] or 0
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    fit = cut(named.select(padded.alias("x")).distinct())
    n = fit.count()
    centre = _Centre(n, _column_sums(fit, width) if n else [])
    many = min(components, width)
    values, vectors, trace = principal_components(_triangle(fit, centre, width), max(n, 1), many)
    usable = int((values > trace * EPS * 16).sum())
    weights = vectors[:, :usable] / np.sqrt(values[:usable])
    error = _identity_error(fit, centre, weights, width) if n else None
    shared = rows.sparkSession.sparkContext.broadcast((centre, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, weights = shared.value
        for batch in batches:
            x = _matrix(batch.column(1), width)
            white = pa.array(list(centre.centred(x) @ weights), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), centre.deviation(x), white], ["vec_id", "deviation", "white"])

    found = named.mapInArrow(run, f"vec_id {kind}, deviation decimal(38,0), white array<double>")
    parts = [float(v / trace) if trace > 0 else None for v in values]
    explained = F.array(*(F.lit(p).cast("double") for p in parts)) if many else F.array().cast("array<double>")
    each = found.select("vec_id", "deviation", "white", F.posexplode(explained).alias("place", "explained"))
    return each.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.get("white", F.col("place")).alias("whitened"),
        "explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
