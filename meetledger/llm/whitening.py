"""Embedding whitening by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance are found without forming it. A pass multiplies the
centred covariance with a block of vectors: each task centres its rows, computes its part of
X'(XQ), and the parts are added up in Spark. A polynomial recurrence over such passes (the
Chebyshev polynomial of the interval from 0 to the smallest Ritz value of the block) damps the
unwanted part of the spectrum; QR makes the block orthonormal again, and a Rayleigh-Ritz step
gives eigenvalues, vectors and residuals. It ends when the residuals of the wanted vectors
bound their errors, or when they are at rounding level and fall no further.

Vectors are made integers first, so that counts, sums, the trace and deviations are exact.
The driver holds the block (dimensions times ``BLOCK`` numbers), nothing that grows with rows.

Cases: vectors that are null, empty, hold a null or non-finite entry, or one beyond 2**52 are
left out, likewise those of another length than most (of equally many, the longer); a missing
id and repeated rows are rows like others; components without variance have no whitened value
(null) and explain 0; fewer dimensions than components give fewer components; no vectors give
no rows; a deviation that is no long is null; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meetledger.llm.common import empty, store

COMPONENTS = 8
BLOCK = 32  # vectors iterated on, the wanted ones among them
DEGREE = 10  # passes of a filter
ERROR = 1e-10  # of a wanted vector, by its residual and its distance to the next eigenvalue
FLOOR = 1e-12  # of the largest eigenvalue: residuals below that may stop falling
NO_VARIANCE = 1e-11  # of the largest eigenvalue
GROWTH = 1e8  # of the largest against the least wanted value in one filter
MAX_ROUNDS = 100
SCALE, SHIFT = 1024, 100_000
_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and x, an array of long, of the vectors that are whole."""
    c = F.col("embedding").cast("array<double>")
    bad = lambda e: F.coalesce(F.isnan(e) | (F.abs(e) > 2.0**52), F.lit(True))
    whole = embeddings.select("vec_id", c.alias("c")).where(F.col("c").isNotNull() & (F.size("c") > 0)).where(~F.exists("c", bad))
    return whole.select("vec_id", F.transform("c", lambda e: F.floor(e * SCALE) + SHIFT).alias("x"))


def _matrix(column: pa.ListArray, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dimensions)


@dataclass(frozen=True)
class Moments:
    """Number of rows, and exact sums and sums of squares of each dimension."""

    n: int
    sums: list[int]
    squares: list[int]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def trace(self) -> float:
        return sum(self.n * q - s * s for s, q in zip(self.sums, self.squares)) / self.n**2


def moments(vectors: DataFrame, dimensions: int) -> Moments:
    """Sums of integers, as halves of 32 bits where a long would not hold them."""

    def add(batches):
        n, sums, squares = 0, np.zeros(dimensions, object), np.zeros(dimensions, object)
        for batch in batches:
            x = _matrix(batch.column(0), dimensions)
            n += len(x)
            largest = int(np.abs(x).max()) if len(x) else 0
            exact = x if largest * largest * len(x) < 2**62 else x.astype(object)
            sums, squares = sums + exact.sum(axis=0).astype(object), squares + (exact * exact).sum(axis=0).astype(object)
        if n:
            numbers = [str(v) for v in (n, *sums, *squares)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(numbers)), pa.int32()), pa.array(numbers)], ["cell", "value"])

    parts = vectors.select("x").mapInArrow(add, "cell int, value string")
    total = parts.groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).toArrow().to_pydict()
    values = [int(v) for _, v in sorted(zip(total["cell"], total["value"]))]
    return Moments(values[0], values[1 : dimensions + 1], values[dimensions + 1 :])


def _summed(vectors: DataFrame, dimensions: int, part, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of ``part(x)``, a matrix for each batch; one row a cell and task is shuffled."""

    def add(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                here = part(_matrix(batch.column(0), dimensions))
                total = here if total is None else total + here
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["cell", "value"])

    parts = vectors.select("x").mapInArrow(add, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    result = np.zeros(shape[0] * shape[1])
    result[parts["cell"].to_numpy()] = parts["value"].to_numpy()
    return result.reshape(shape)


def covariance_times(vectors: DataFrame, known: Moments, q: np.ndarray) -> np.ndarray:
    """One pass: the covariance, never formed, times a block."""
    mean = known.mean

    def part(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ (centred @ q)

    return _summed(vectors, len(mean), part, q.shape) / known.n


def chebyshev_filter(times, q: np.ndarray, vq: np.ndarray, cut: float, top: float, degree: int) -> np.ndarray:
    """The block times the Chebyshev polynomial that is small from 0 to ``cut`` and 1 at ``top``.

    ``vq`` is the covariance times ``q``, known from the step before; ``degree - 1`` passes.
    """
    centre = half = cut / 2
    first = scale = half / (top - centre)
    before, now = q, (vq - centre * q) * (scale / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - scale)
        before, now = now, (times(now) - centre * now) * (2 * following / half) - scale * following * before
        scale = following
    return now


def _steps(cut: float, least: float, top: float, degree: int) -> int:
    """The degree at which the largest value outgrows the least wanted one by ``GROWTH`` at most.

    A steeper filter would leave nothing but rounding of the lesser vectors.
    """
    apart = np.arccosh(max(2 * top / cut - 1, 1)) - np.arccosh(max(2 * least / cut - 1, 1))
    return int(max(1, min(degree, np.log(GROWTH) // apart if apart > 0 else degree)))


@dataclass(frozen=True)
class Spectrum:
    """Leading eigenvalues, unit eigenvectors as columns, and the norms of their residuals."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int


def leading(times, dimensions: int, wanted: int, block: int = BLOCK, degree: int = DEGREE, seed: int = 7) -> Spectrum:
    """The leading eigenpairs of the symmetric positive operator ``times``."""
    wanted, block = min(wanted, dimensions), min(max(block, wanted), dimensions)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, block)))[0]
    passes, last = 0, np.inf
    for _ in range(MAX_ROUNDS):
        vq = times(q)
        passes += 1
        values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        residuals = np.linalg.norm(vq - q * values, axis=0)[:wanted]
        top = values[0]
        if top <= 0 or block == dimensions:
            break
        # Distance of each wanted value to the nearest one that is not its own.
        gaps = np.array([np.abs(np.delete(values, i) - values[i]).min() for i in range(wanted)])
        if (residuals <= ERROR * np.maximum(gaps, FLOOR * top)).all():
            break
        if residuals.max() <= FLOOR * top and residuals.max() > last / 2:
            break  # equal or nearly equal values: rounding is all that is left
        last = residuals.max()
        cut = max(values[-1], FLOOR * top)
        if cut >= top * (1 - 1e-9):
            cut = top / 2  # all Ritz values alike; any interval below them does
        steps = _steps(cut, values[wanted - 1], top, degree)
        q = np.linalg.qr(chebyshev_filter(times, q, vq, cut, top, steps))[0]
        passes += steps - 1
    else:
        raise RuntimeError(f"residuals of {residuals.max():.3g} after {passes} passes; eigenvalues from {values[0]:.6g} to {values[-1]:.6g}")
    vectors = q[:, :wanted]
    # The largest entry of a component is positive, so that reruns agree.
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(wanted)])
    return Spectrum(np.maximum(values[:wanted], 0), vectors, residuals, passes)


def _deviations(x: np.ndarray, n: int, sums: list[int], largest_sum: int) -> list[int | None]:
    """Sum of (n*x - S)**2 of each row, exact."""
    bound = n * int(np.abs(x).max()) + largest_sum
    kind = np.int64 if bound * bound * x.shape[1] < 2**62 else object
    far = x.astype(kind) * n - np.array(sums, kind)
    return [d if d < 2**63 else None for d in (far * far).sum(axis=1).tolist()]


def whiten(embeddings: DataFrame, components: int = COMPONENTS, block: int = BLOCK, degree: int = DEGREE) -> DataFrame:
    """One row a vector: vec_id, n, deviation, whitened (an array), explained (an array), identity_error, residual (an array)."""
    spark = embeddings.sparkSession
    arrays = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double, residual array<double>"
    found = integer_vectors(embeddings)
    lengths = found.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).take(1)
    if not lengths:
        return empty(spark, arrays)
    dimensions = lengths[0]["d"]
    vectors = store(found.where(F.size("x") == dimensions), "vectors")
    known = moments(vectors, dimensions)
    mean, sums, n, trace = known.mean, known.sums, known.n, known.trace
    spectrum = leading(lambda q: covariance_times(vectors, known, q), dimensions, components, block, degree)

    varying = spectrum.values > NO_VARIANCE * max(spectrum.values[0], 0)
    weights = spectrum.vectors[:, varying] / np.sqrt(spectrum.values[varying])
    k = weights.shape[1]

    def sums_of_products(x: np.ndarray) -> np.ndarray:
        white = (x - mean) @ weights
        return np.vstack([white.T @ white, white.sum(axis=0, keepdims=True)])

    identity_error = 0.0
    if k:
        products = _summed(vectors, dimensions, sums_of_products, (k + 1, k))
        centre = products[k] / n
        identity_error = float(np.abs(products[:k] / n - np.outer(centre, centre) - np.eye(k)).max())
    places = np.flatnonzero(varying)
    width, largest_sum = len(spectrum.values), max(abs(s) for s in sums)

    def project(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), dimensions)
                white = np.full((len(x), width), np.nan)
                white[:, places] = (x - mean) @ weights
                offsets = pa.array(np.arange(0, white.size + 1, width, dtype=np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(white.ravel(), from_pandas=True))
                deviation = pa.array(_deviations(x, n, sums, largest_sum), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), deviation, lists], ["vec_id", "deviation", "whitened"])

    white = vectors.select(F.col("vec_id").cast("long"), "x").mapInArrow(project, "vec_id long, deviation long, whitened array<double>")
    shares = [float(e / trace) if v else 0.0 for e, v in zip(spectrum.values, varying)]
    return white.select(
        "vec_id",
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*[F.lit(s) for s in shares]).alias("explained"),
        F.lit(identity_error).alias("identity_error"),
        F.array(*[F.lit(float(r)) for r in spectrum.residuals]).alias("residual"),
    )


def by_component(whitened: DataFrame) -> DataFrame:
    """One row a vector and component, numbered from 1 by falling eigenvalue."""
    return whitened.select(
        "vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained", "residual")).alias("at", "each")
    ).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
        F.col("each.whitened").alias("whitened"), F.col("each.explained").alias("explained"), "identity_error", F.col("each.residual").alias("residual"),
    )
