"""Whitening of embeddings: leading principal components by LOBPCG over a distributed covariance.

Vectors become integers floor(SCALE * c). The fit list, each distinct integer vector once, is written to the shared folder; its size
and sums are exact. The covariance itself is never formed: Spark multiplies it with a narrow block, every partition adding up
(x - mean) ((x - mean)' block) over its centred rows, and partitions' sums are added in two levels, in a fixed order. On the driver
the locally optimal block method solves a Rayleigh-Ritz problem over the iterate, the residuals, and the previous directions: a few
columns of as many rows as there are dimensions. Its three blocks are kept orthonormal to each other, so one product with the
residuals a round suffices. It ends when the wanted residuals are certified by a fresh product.

Defined cases: a vector counts if it is as long as most are (ties: the longest), is not empty, and has no null or non-finite entry;
all other rows go, rows without an id stay. Repeated vectors count once in the fit and come back for every row. Components whose
variance is zero to working precision have no whitened values and are left out, so that constant or single vectors, like no
vectors at all, give no rows. A deviation beyond a long is null; integers beyond 2^62 stay there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightfield.llm.common import drop_materialised, materialise

COMPONENTS = 4
SCALE = 256
#: Integers end here, so that they fit a long.
LARGEST = 2.0**62
#: Columns of the block besides the wanted ones: they speed up convergence.
GUARD = 12
#: Wanted residuals in shares of the largest variance; the certificate; rounds at most, after which an uncertified result is refused.
RESIDUAL, CERTIFIED, ROUNDS = 4e-15, 1e-11, 1000
#: Rounds without progress after which the certificate decides.
STUCK = 3
SEED = 17
#: Partial sums that the driver adds itself.
PARTIALS = 64


def usable(vector: str) -> Column:
    good = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce((F.size(F.col(vector)) > 0) & good, F.lit(False))


def integers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * values.astype(np.float64)), -LARGEST, LARGEST).astype(np.int64)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return integers(flat.reshape(-1, dimension))


def packed(rows: np.ndarray) -> list[bytes]:
    """Equal integer vectors have equal bytes: two for every number if all of them fit, else eight."""
    small, short = (np.abs(rows) < 1 << 15).all(axis=1).tolist(), rows.astype("<i2")
    return [short[k].tobytes() if fits else rows[k].astype("<i8").tobytes() for k, fits in enumerate(small)]


def unpacked(column: pa.Array, dimension: int) -> np.ndarray:
    """The vectors of a batch as integers, those of two bytes first."""
    raw = column.to_pylist()
    parts = [np.zeros((0, dimension), np.int64)]
    for size, kind in ((2 * dimension, "<i2"), (8 * dimension, "<i8")):
        if some := b"".join(r for r in raw if len(r) == size):
            parts.append(np.frombuffer(some, kind).reshape(-1, dimension).astype(np.int64))
    return np.concatenate(parts)


@dataclass
class Moments:
    """Of the fit list: dimension, size, and whole sums of any size."""

    dimension: int
    n: int
    sums: list[int]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # the quotient of two whole numbers is rounded once

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """The exact sums of (n * x - sum)^2."""
        largest = self.n * int(np.abs(rows).max(initial=0)) + max(map(abs, self.sums))
        if largest * largest * self.dimension < 1 << 63:
            apart = self.n * rows - np.array(self.sums, np.int64)
            return (apart * apart).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in rows.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def fit_list(vectors: DataFrame, vector: str, dimension: int) -> tuple[DataFrame, Moments]:
    """Each distinct integer vector once, as bytes in a written table, and its moments."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(packed(_matrix(batch.column(0), dimension)), pa.binary())], ["x"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dimension
        for batch in batches:
            rows = unpacked(batch.column(0), dimension)
            n += len(rows)
            high, low = rows >> 20, rows & ((1 << 20) - 1)  # no sum of either overflows
            sums = [s + (h << 20) + x for s, h, x in zip(sums, high.sum(axis=0).tolist(), low.sum(axis=0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dimension + 1), pa.int32()), pa.array([str(v) for v in [*sums, n]])], ["at", "total"])

    rows = materialise(vectors.select(vector).mapInArrow(pack, "x binary").distinct(), "fit-list")
    totals = rows.mapInArrow(add, "at int, total string").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {r["at"]: int(r["total"]) for r in totals.collect()}  # dimension + 1 rows
    return rows, Moments(dimension, found[dimension], [found[k] for k in range(dimension)])


def summed(rows: DataFrame, moments: Moments, work: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over the fit list of ``work`` (centred rows to ``size`` numbers): partitions first, then their sums in two levels."""
    mean = moments.mean

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += work(unpacked(batch.column(0), moments.dimension) - mean)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()])], ["part", "total"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = sorted(x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if some:
            total = np.sum([np.frombuffer(r[1]) for r in some], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([some[0][0]], pa.int64()), pa.array([total.tobytes()])], ["part", "total"])

    parts = rows.mapInArrow(partial, "part bigint, total binary")
    if (count := rows.rdd.getNumPartitions()) > PARTIALS:
        groups = isqrt(count)
        parts = parts.repartition(groups, F.col("part") % groups).mapInArrow(join, "part bigint, total binary")
    return np.sum([np.frombuffer(r["total"]) for r in sorted(parts.collect(), key=lambda r: r["part"])], axis=0)


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to the orthonormal ``against``; columns that add nothing go."""
    room = max(0, len(against) - against.shape[1])
    for _ in range(3):
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 0] / size[size > 0]
        block = block - against @ (against.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-8][:, :room]
    return block


def leading_components(multiply: Callable[[np.ndarray], np.ndarray], dimension: int, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, eigenvectors as columns, certified residual over the largest) of what ``multiply`` multiplies a block with."""
    wanted = min(wanted, dimension)
    width = min(dimension, wanted + GUARD)
    x = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dimension, width)))[0]
    ax = multiply(x)
    p = ap = np.zeros((dimension, 0))
    best, stuck = np.inf, 0

    def turned(x: np.ndarray, ax: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        value, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        x, ax, value = x @ turn[:, ::-1], ax @ turn[:, ::-1], value[::-1]
        return x, ax, value, float(np.linalg.norm((ax - x * value)[:, :wanted], axis=0).max())

    for _ in range(ROUNDS):
        x, ax, value, worst = turned(x, ax)
        if worst < 0.9 * best:
            best, stuck = worst, 0
        else:
            stuck += 1
        fresh = _orthonormal(ax - x * value, np.hstack([x, p]))
        if worst <= RESIDUAL * value[0] or stuck >= STUCK or not fresh.shape[1]:
            image = multiply(np.hstack([x, p]))  # the certificate: images are no longer combined from earlier ones
            x, ax, value, worst = turned(x, image[:, :width])
            ap = image[:, width:]
            if worst <= CERTIFIED * value[0]:
                return value[:wanted], x[:, :wanted], worst / max(float(value[0]), np.finfo(float).tiny)
            best, stuck = np.inf, 0
            fresh = _orthonormal(ax - x * value, np.hstack([x, p]))
        basis, image = np.hstack([x, p, fresh]), np.hstack([ax, ap, multiply(fresh) if fresh.shape[1] else fresh])
        gram = basis.T @ image
        _, turn = np.linalg.eigh((gram + gram.T) / 2)
        chosen = turn[:, ::-1][:, :width]
        onward = chosen.copy()
        onward[:width] = 0
        onward = _orthonormal(onward, chosen)
        x, ax, p, ap = basis @ chosen, image @ chosen, basis @ onward, image @ onward
    raise ArithmeticError("the components did not converge")


@dataclass
class Whitening:
    moments: Moments
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    identity_error: float = 0.0

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.vectors / np.sqrt(self.values)


def dimension_of(vectors: DataFrame, vector: str) -> int:
    found = vectors.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return found["size"] if found else 0


def fit_whitening(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """None where no component has any variance. ``vectors``: usable ones."""
    dimension = dimension_of(vectors, vector)
    if not dimension:
        return None
    rows, moments = fit_list(vectors.where(F.size(vector) == dimension), vector, dimension)
    n = moments.n

    def multiply(block: np.ndarray) -> np.ndarray:
        return summed(rows, moments, lambda c: (c.T @ (c @ block)).ravel(), block.size).reshape(block.shape) / n

    trace = float(summed(rows, moments, lambda c: np.array([(c * c).sum()]), 1)[0]) / n
    if trace == 0:
        return None
    values, found, residual = leading_components(multiply, dimension, components)
    real = values > dimension * np.finfo(float).eps * trace
    made = Whitening(moments, values[real], found[:, real], trace, residual)
    k = len(made.values)
    sums = summed(rows, moments, lambda c: np.append((w := made.whiten(c)).sum(axis=0), (w.T @ w).ravel()), k + k * k) / n
    mean, square = sums[:k], sums[k:].reshape(k, k)
    made.identity_error = float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())
    drop_materialised(rows)
    return made


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    base = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector")).where(usable("vector"))
    schema = T.StructType([base.schema["vec_id"], *T.StructType.fromDDL("component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")])
    made = fit_whitening(base, "vector", components)
    if made is None:
        return base.sparkSession.createDataFrame([], schema)
    moments, mean, k = made.moments, made.moments.mean, len(made.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(1), moments.dimension)
            m = len(rows)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, moments.n, np.int64)),
                pa.array([v for v in moments.deviations(rows) for _ in range(k)], pa.int64()),
                pa.array(made.whiten(rows - mean).ravel()),
                pa.array(np.tile(made.values / made.trace, m)),
                pa.array(np.full(m * k, made.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return base.where(F.size("vector") == moments.dimension).mapInArrow(run, schema)
