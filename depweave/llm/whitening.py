"""Whitening of embeddings by matrix-free block subspace iteration.

Vectors are fixed to integers x = floor(scale * c); the fit runs over each distinct x once.
The covariance V (d x d) is never formed: each Spark pass over the fit list sends a block Q of
d x p orthonormal columns to the tasks, which centre their rows exactly, multiply them into
Q and back, and add up the d x p products X'(XQ); these sums meet in a bounded number of
partitions and then on the driver, which does a QR and a Rayleigh-Ritz step.  The residuals
|V q - e q| bound the error of each eigenvalue; the passes end when those of all k components
are at rounding error.  Where the spectrum is flat, one block converges slowly: whenever a
pass lowers the residuals by less than ``SLOW``, the block is doubled by random columns.  A
block of d columns spans everything, so its Rayleigh-Ritz step is exact: at most some
2 log2(d / p) passes more, whatever the spectrum.

What the driver holds is d x d numbers at most; it grows with the dimension, never with the rows.

Defined results: vectors that are null, empty, or hold null, NaN or infinite entries are
dropped, as are those whose length isn't the most frequent one (of equally frequent ones the
longest); a null id is an id; repeated rows each give a row; entries beyond 64-bit integers
are cut off at their ends; an exact deviation of more than 38 digits is null; components whose eigenvalue is
under ``RANK`` of the largest (constant or linearly dependent dimensions, a single vector)
don't exist, so there may be fewer than k or none; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depweave.session import materialise

from .textbytes import bounded_batches

SCALE = 256
COMPONENTS = 4
#: Residual, as a share of the largest eigenvalue, at which a component is certified.
TOLERANCE = 1e-13
#: A pass that lowers the residuals by a smaller factor doubles the block.
SLOW = 10.0
#: Least eigenvalue of a component, as a share of the largest.
RANK = 1e-11
#: Partitions in which the sums of all tasks meet before the driver adds them.
MEET = 32


@dataclass(frozen=True)
class Whitening:
    """A fitted model: rows of the fit list, their exact sums, unit components (columns) with eigenvalues, trace, and how the fit ended."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def _largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def differences(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, exact: 64-bit where they suffice, else Python's integers."""
    if n * _largest(x) + max(map(abs, sums), default=0) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x less its mean: the exact difference, rounded once."""
    return (differences(x, n, sums) / n).astype(float)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """Per row the sum over dimensions of (n * x - sums)^2, exact."""
    d = differences(x, n, sums)
    if d.dtype == object or _largest(d) ** 2 * d.shape[1] >= 1 << 62:
        d = d.astype(object)
    return (d * d).sum(axis=1).tolist()


def block(column: pa.Array) -> np.ndarray:
    """The rows of a column of equally long lists as a matrix; there is one at least."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> tuple[DataFrame, int]:
    """(id, x: array of longs) of the vectors that remain, and their length (0: there are none)."""
    whole = F.forall("__v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform("__v", lambda c: F.floor(c * float(scale)))
    rows = vectors.select(vectors[id_col], vectors[vec_col].cast("array<double>").alias("__v")).where((F.size("__v") > 0) & whole).select(id_col, x.alias("__x"))
    most = rows.groupBy(F.size("__x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    width = most[0]["d"] if most else 0
    return rows.where(F.size("__x") == width), width


def added(fit: DataFrame, shape: tuple[int, int], product: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of vectors (the only column of ``fit``) of ``product(block)``, which has the given shape.

    Each task adds its own blocks; their sums meet in ``MEET`` partitions, so the driver adds that many at most.
    """
    schema = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("total", T.BinaryType())])

    def emit(slot: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "total"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, slot = None, 0
        for b in batches:
            if b.num_rows:
                slot = b.column(0)[0].as_py() % MEET
                part = product(block(b.column(1)))
                total = part if total is None else total + part
        if total is not None:
            yield emit(slot, total)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for blob in b.column(1):
                part = np.frombuffer(blob.as_py()).reshape(shape)
                total = part if total is None else total + part
        if total is not None:
            yield emit(0, total)

    numbered = fit.select(F.spark_partition_id().alias("__slot"), *fit.columns)
    parts = numbered.mapInArrow(own, schema).repartition(MEET, "slot").mapInArrow(met, schema).collect()
    return sum((np.frombuffer(r["total"]).reshape(shape) for r in parts), np.zeros(shape))


def exact_sums(fit: DataFrame, width: int) -> tuple[int, tuple[int, ...]]:
    """Number of rows and the sum of each dimension, exact."""
    schema = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("total", T.DecimalType(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, totals = 0, [0] * width
        for b in batches:
            if b.num_rows:
                x = block(b.column(0))
                if _largest(x) * len(x) >= 1 << 62:
                    x = x.astype(object)
                n += len(x)
                totals = [a + int(c) for a, c in zip(totals, x.sum(axis=0).tolist(), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array(map(Decimal, [*totals, n]), pa.decimal128(38, 0))], names=schema.names)

    found = {r["place"]: int(r["total"]) for r in fit.mapInArrow(run, schema).groupBy("place").agg(F.sum("total").alias("total")).collect()}
    return found.get(width, 0), tuple(found.get(i, 0) for i in range(width))


def iterate(multiply: Callable[[np.ndarray], np.ndarray], d: int, k: int, seed: int = 0, tolerance: float = TOLERANCE, most: int = 1000) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(components as columns, eigenvalues, residuals, passes) of the symmetric d x d matrix that ``multiply`` applies to a block."""
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((d, min(d, max(16, 2 * k)))))[0]
    before = np.inf
    for passes in range(1, most + 1):
        z = multiply(q)
        h = q.T @ z
        e, u = np.linalg.eigh((h + h.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        ritz, z = q @ u, z @ u
        residuals = np.linalg.norm(z - ritz * e, axis=0)[:k]
        worst = residuals.max()
        if worst <= tolerance * max(e[0], 0) or q.shape[1] == d:
            return ritz[:, :k], e[:k], residuals, passes
        if worst * SLOW > before:
            z = np.hstack([z, rng.standard_normal((d, min(d - q.shape[1], q.shape[1]))) * max(e[0], 1e-300)])
            worst = np.inf
        before = worst
        q = np.linalg.qr(z)[0]
    raise ArithmeticError(f"residual {worst} after {most} passes")


def fit_whitening(rows: DataFrame, width: int, k: int = COMPONENTS, seed: int = 0) -> tuple[Whitening | None, DataFrame]:
    """The model of the distinct vectors among the rows of :func:`integers` (None if there are no rows), and the fit list."""
    bounded_batches(rows.sparkSession)
    fit = materialise(rows.select("__x").distinct(), "whitening-fit")
    n, sums = exact_sums(fit, width)
    if not n:
        return None, fit
    trace = float(added(fit, (1, 1), lambda x: np.array([[np.square(centred(x, n, sums)).sum()]]))[0, 0]) / n

    def multiply(q: np.ndarray) -> np.ndarray:
        def product(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            return c.T @ (c @ q)

        return added(fit, q.shape, product) / n

    vectors, values, residuals, passes = iterate(multiply, width, min(k, width), seed)
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])] < 0, -1.0, 1.0)
    there = (values > 0) & (values > RANK * values[0])
    return Whitening(n, sums, vectors[:, there], values[there], trace, residuals[there], passes), fit


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance less the identity."""
    k = len(model.values)
    if not k:
        return 0.0
    mean = added(fit, (1, k), lambda x: model.project(x).sum(axis=0, keepdims=True)) / model.n

    def product(x: np.ndarray) -> np.ndarray:
        w = model.project(x) - mean
        return w.T @ w

    return float(np.abs(added(fit, (k, k), product) / model.n - np.eye(k)).max())


def whiten(rows: DataFrame, model: Whitening, id_col: str = "vec_id") -> DataFrame:
    """One row per row of :func:`integers`: id, deviation (exact, decimal) and whitened (one double per component)."""
    bounded_batches(rows.sparkSession)
    schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = block(b.column(1))
            exact = [Decimal(v) if v < 10**38 else None for v in deviations(x, model.n, model.sums)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(exact, pa.decimal128(38, 0)), pa.array(list(model.project(x)), pa.list_(pa.float64()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def whitened(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = COMPONENTS, scale: int = SCALE, seed: int = 0) -> DataFrame:
    """Per remaining vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error."""
    rows, width = integers(vectors, id_col, vec_col, scale)
    model, fit = fit_whitening(rows, width, k, seed) if width else (None, rows)
    if model is None:
        model = Whitening(0, (), np.zeros((0, 0)), np.zeros(0), 0.0, np.zeros(0), 0)
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values]).cast("array<double>")
    out = whiten(rows.where(F.lit(len(model.values) > 0)), model, id_col)
    return out.select(id_col, "deviation", F.posexplode("whitened").alias("__at", "whitened")).select(
        id_col, (F.col("__at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("__at")).alias("explained"), F.lit(identity_error(fit, model)).alias("identity_error"),
    )
