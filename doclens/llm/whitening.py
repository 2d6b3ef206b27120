"""Whitening of embeddings: running covariances, merged, and a symmetric QR eigen-solve.

Each task goes once through its vectors and keeps their number, mean and scatter matrix by Welford's rank-one update; tasks'
states are merged two by two with the parallel form of the update, by as many mergers as the root of the number of states and
then by one. So a task holds one vector and one matrix, and what reaches the driver is one matrix. The matrix is brought to
tridiagonal form by reflections and its eigenvalues are found by implicitly shifted QR steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.llm.common import written

SCALE = 256
COMPONENTS = 4
#: Rows that are projected at a time.
ROWS = 4096
#: An eigenvalue below this share of the greatest is none: its component has no scale.
RANK_TOLERANCE = 1e-12
STATE = "n long, mean binary, scatter binary, sums binary"


class Moments:
    """Number, mean, scatter about the mean and integer sums of vectors seen so far."""

    def __init__(self, dim: int):
        self.n, self.mean, self.scatter, self.sums = 0, np.zeros(dim), np.zeros((dim, dim)), np.zeros(dim, np.int64)

    def add(self, x: np.ndarray) -> None:
        """Welford's rank-one update by one vector."""
        self.n += 1
        delta = x - self.mean
        self.mean += delta / self.n
        self.scatter += np.outer(delta, x - self.mean)

    def merge(self, other: Moments) -> None:
        if not other.n:
            return
        n, delta = self.n + other.n, other.mean - self.mean
        self.scatter += other.scatter + np.outer(delta, delta) * (self.n * other.n / n)
        self.mean += delta * (other.n / n)
        self.n, self.sums = n, self.sums + other.sums

    def batch(self) -> pa.RecordBatch:
        cells = [self.mean.tobytes(), self.scatter.tobytes(), self.sums.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([self.n]), *(pa.array([c], pa.binary()) for c in cells)], ["n", "mean", "scatter", "sums"])

    @staticmethod
    def of(row: dict, dim: int) -> Moments:
        m = Moments(dim)
        m.n, m.mean, m.sums = row["n"], np.frombuffer(row["mean"]).copy(), np.frombuffer(row["sums"], np.int64).copy()
        m.scatter = np.frombuffer(row["scatter"]).reshape(dim, dim).copy()
        return m


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls, each of dim entries, as rows."""
    return np.asarray(col.flatten()).reshape(-1, dim)


def moments(vectors: DataFrame, dim: int, column: str = "x", project: tuple[np.ndarray, np.ndarray] | None = None) -> Moments:
    """The moments of all vectors in a column, or of their projections (center, axes)."""
    size = dim if project is None else project[1].shape[1]
    held = vectors.sparkSession.sparkContext.broadcast(project)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Moments(size)
        for b in batches:
            x = matrix(b.column(column), dim)
            if held.value is None:
                m.sums += x.sum(axis=0)
            x = x.astype(float) if held.value is None else whiten(x, *held.value)
            for row in x:
                m.add(row)
        if m.n:
            yield m.batch()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Moments(size)
        for b in batches:
            for row in b.to_pylist():
                m.merge(Moments.of(row, size))
        if m.n:
            yield m.batch()

    states = written(vectors.select(column).mapInArrow(gather, STATE), "moments")
    mergers = max(1, isqrt(states.count()))
    total = Moments(size)
    # one state for each merger: their number grows as the root of the number of tasks
    for row in states.repartition(mergers).mapInArrow(merge, STATE).coalesce(1).mapInArrow(merge, STATE).toArrow().to_pylist():
        total.merge(Moments.of(row, size))
    held.destroy()
    return total


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with a = q T q', by Householder's reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x[0] += np.copysign(size, x[0])
        v = x / np.linalg.norm(x)
        a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix. Of each vector the entry of the greatest size,
    the first of equal ones, is positive."""
    d, e, q = tridiagonal(np.asarray(a, float))
    eps, end = np.finfo(float).eps, len(d) - 1
    while end > 0:
        small = np.abs(e[:end]) <= eps * (np.abs(d[:end]) + np.abs(d[1 : end + 1]))
        e[:end][small] = 0
        if small[end - 1]:
            end -= 1
            continue
        begin = end - 1
        while begin > 0 and e[begin - 1] != 0:
            begin -= 1
        # Wilkinson's shift, then the bulge is chased down the block by rotations
        half = (d[end - 1] - d[end]) / 2
        shift = d[end] - e[end - 1] ** 2 / (half + np.copysign(np.hypot(half, e[end - 1]), half if half else 1.0))
        x, z = d[begin] - shift, e[begin]
        for k in range(begin, end):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > begin:
                e[k - 1] = r
            dk, dn, ek = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * dk + 2 * c * s * ek + s * s * dn, s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            if k < end - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            left, right = q[:, k].copy(), q[:, k + 1].copy()
            q[:, k], q[:, k + 1] = c * left + s * right, c * right - s * left
    order = np.argsort(-d, kind="stable")
    q = q[:, order]
    lead = q[np.argmax(np.abs(q), axis=0), np.arange(len(d))]
    return d[order], q * np.where(lead < 0, -1, 1)


class Whitening(NamedTuple):
    n: int
    sums: np.ndarray
    #: Eigenvectors of the first components by the roots of their eigenvalues, as columns; nan where there is no scale.
    axes: np.ndarray
    #: Shares of the trace.
    explained: np.ndarray
    #: Greatest entry of the whitened fit list's covariance less the identity; nan without a component.
    identity_error: float


def whiten(x: np.ndarray, center: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return (x - center) @ axes


def scaled(vector: Column) -> Column:
    """floor(256 c) of each entry as a long; -0 is 0."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose vector is an array of finite entries."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return embeddings.where(F.col("embedding").isNotNull() & ~bad).select(F.col("vec_id").cast("long"), scaled(F.col("embedding")).alias("x"))


def dimension(rows: DataFrame) -> int | None:
    """The length that most vectors have, the greater one of equally frequent ones."""
    sizes = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"))
    best = sizes.agg(F.max(F.struct("n", "dim")).alias("b")).collect()[0]["b"]
    return best and best["dim"]


def fit(rows: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of the distinct vectors x of rows, each of dim entries."""
    distinct = written(rows.groupBy("x").agg(F.count("*").alias("copies")).select("x"), "vectors")
    total = moments(distinct, dim)
    values, vectors = symmetric_qr(total.scatter / max(total.n, 1))
    k, trace = min(components, dim), np.trace(total.scatter) / max(total.n, 1)
    firm = values[:k] > RANK_TOLERANCE * max(values[0], 0) if k else np.zeros(0, bool)
    axes = np.where(firm, vectors[:, :k] / np.sqrt(np.where(firm, values[:k], 1)), np.nan)
    error = float("nan")
    if firm.any():
        seen = moments(distinct, dim, project=(total.sums / total.n, axes[:, firm]))
        error = float(np.abs(seen.scatter / seen.n - np.eye(int(firm.sum()))).max())
    return Whitening(total.n, total.sums, axes, values[:k] / trace if trace > 0 else np.full(k, np.nan), error)


def apply(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row of embeddings(vec_id, embedding) with a
    vector, and each of the first components.

    Vectors that are null or hold null or non-finite entries have no rows; of vectors of several lengths those of the most
    frequent length count (the greater of equally frequent ones) and the others have none. Copies come out each, but are fitted
    once. whitened is null for a component without variance, explained where there is none at all (one distinct vector),
    identity_error where no component has any. A deviation beyond the range of a long is null. Vectors without entries have no
    components. Other columns are not read.
    """
    rows, schema = usable(embeddings), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dim = dimension(rows)
    if not dim:
        return embeddings.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("x") == dim)
    held = embeddings.sparkSession.sparkContext.broadcast(fit(rows, dim, components))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        k, center = w.axes.shape[1], w.sums / w.n
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                x = matrix(b.column("x"), dim)
                away = w.n * x - w.sums  # whole numbers wrap around, so that a sum in range is right
                deviation = (away * away).sum(axis=1)
                far = ((w.n * x.astype(float) - w.sums) ** 2).sum(axis=1) >= 2.0**63
                out = whiten(x, center, w.axes).reshape(-1)
                each = lambda v, **how: pa.array(np.repeat(v, k), **how)
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id").take(pa.array(np.repeat(np.arange(b.num_rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), each(np.full(b.num_rows, w.n)), each(deviation, mask=np.repeat(far, k)),
                     pa.array(out, mask=np.isnan(out)), pa.array(np.tile(w.explained, b.num_rows), from_pandas=True), pa.array(np.full(len(out), w.identity_error), from_pandas=True)],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(work, schema)
