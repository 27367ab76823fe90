"""Whitening of embeddings: leading components of the covariance by spectrum slicing.

Every entry c becomes the whole number y = floor(64 * c), the contract's x without its constant 1000000: sums, covariance
and deviations are the same for both. Each different y vector counts once. Sums and products are added up exactly, so that
the covariance is centred without loss: its entries are (n * sum(y_i * y_j) - S_i * S_j) / n^2, rounded once.

The covariance V, as large as the square of the dimension and independent of the rows, is brought to tridiagonal form on
the driver. For a shift s the signs of D in V - s = L D L^T count the eigenvalues below s; halving by these counts isolates
each leading eigenvalue, Rayleigh quotient iteration inside its interval gives value and vector, and the counts on both
sides of the value prove its number. Eigenvalues that double precision cannot tell apart get orthogonal vectors.

Results in odd cases: rows whose vector is NULL, empty, or holds a NULL, NaN or infinite entry are dropped, and so are rows
whose length is not the most frequent one (the longest of equally frequent ones). Directions without variance are no
components: with fewer than two different vectors there are no rows. Repeated rows and rows without an id each get their
rows. An entry whose y does not fit 64 bits, or a deviation that does not, raises an error. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.llm.shared import stored

#: Components at most.
COMPONENTS = 16
#: Fineness of the grid that entries are put on.
GRID = 64
EPS = float(np.finfo(float).eps)
_EXACT = 2.0**53


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def _points(embeddings: DataFrame, vector: str) -> DataFrame:
    kept = embeddings.where(usable(F.col(vector)))
    return kept.select("vec_id", F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * F.lit(float(GRID)))).alias("y"))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, dimension)


def _products(dimension: int):
    """Exact sums of this task: entry (i, j) over products, (i, -1) over values, (-1, -1) over rows."""
    upper = np.triu_indices(dimension)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, values, rows = np.zeros(len(upper[0]), object), np.zeros(dimension, object), 0
        for batch in batches:
            y = _matrix(batch.column("y"), dimension)
            rows += len(y)
            most = float(np.abs(y.astype(float)).max(initial=0))
            if most * len(y) < 2.0**62:
                values += y.sum(axis=0).astype(object)
            else:
                values += y.astype(object).sum(axis=0)
            if most * most * len(y) < _EXACT:  # whole numbers that doubles hold exactly
                total += (y.T.astype(float) @ y.astype(float))[upper].astype(np.int64).astype(object)
            else:
                for row in y.astype(object):
                    total += np.outer(row, row)[upper]
        if rows:
            i = np.concatenate([upper[0], np.arange(dimension), [-1]])
            j = np.concatenate([upper[1], np.full(dimension + 1, -1)])
            sums = pa.array([str(x) for x in [*total, *values, rows]])
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), sums], ["i", "j", "s"])

    return run


def _moments(fit: DataFrame, dimension: int) -> tuple[int, list[int], np.ndarray, float]:
    """n, the sums of y, the covariance, and its trace."""
    sums = fit.select("y").mapInArrow(_products(dimension), "i int, j int, s string").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    by = {(row["i"], row["j"]): int(row["s"]) for row in sums.collect()}
    n, s = by[-1, -1], [by[i, -1] for i in range(dimension)]
    covariance = np.zeros((dimension, dimension))
    exact = 0
    for i in range(dimension):
        for j in range(i, dimension):
            scaled = n * by[i, j] - s[i] * s[j]
            covariance[i, j] = covariance[j, i] = scaled / (n * n)
            exact += scaled if i == j else 0
    return n, s, covariance, exact / (n * n)


def _tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and its neighbour after Householder reflections, which keep the inertia of every shift."""
    a = a.copy()
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        length = np.linalg.norm(v)
        if length == 0:
            continue
        v /= length
        block = a[k + 1 :, k + 1 :]
        p = block @ v
        q = p - (v @ p) * v
        block -= 2 * (np.outer(v, q) + np.outer(q, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy()


class _Slices:
    """Numbers of eigenvalues on either side of a shift, from the signs of D."""

    def __init__(self, a: np.ndarray):
        diagonal, off = _tridiagonal(a)
        self.diagonal, self.squares = diagonal.tolist(), [0.0, *(off * off).tolist()]
        reach = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
        self.low, self.high = float((diagonal - reach).min()), float((diagonal + reach).max())
        self.unit = EPS * max(abs(self.low), abs(self.high))

    def above(self, shift: float) -> int:
        count, d = 0, 1.0
        for x, square in zip(self.diagonal, self.squares, strict=True):
            d = x - shift - square / d
            d = d or -self.unit * EPS
            count += d > 0
        return count

    def interval(self, number: int) -> tuple[float, float]:
        """An interval with the eigenvalue of this number alone, or as narrow as rounding allows."""
        low, high = self.low - 4 * self.unit, self.high + 4 * self.unit
        over_low, over_high = len(self.diagonal), 0
        while (over_low, over_high) != (number, number - 1) and high - low > 4 * self.unit:
            middle = (low + high) / 2
            over = self.above(middle)
            if over >= number:
                low, over_low = middle, over
            else:
                high, over_high = middle, over
        return low, high

    def halved(self, number: int, low: float, high: float) -> tuple[float, float]:
        middle = (low + high) / 2
        return (middle, high) if self.above(middle) >= number else (low, middle)


def _across(v: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for u in found:
            v = v - (u @ v) * u
    return v / np.linalg.norm(v)


def _solved(a: np.ndarray, shift: float, v: np.ndarray, unit: float) -> np.ndarray:
    while True:
        try:
            w = np.linalg.solve(a - shift * np.eye(len(a)), v)
            if np.isfinite(w).all() and w.any():
                return w / np.abs(w).max()
        except np.linalg.LinAlgError:
            pass
        shift += unit


def leading(a: np.ndarray, most: int) -> list[tuple[float, np.ndarray]]:
    """The largest eigenvalues, from the largest on, with unit vectors; none that is zero to rounding."""
    slices, found, values = _Slices(a), [], []
    start = np.random.default_rng(1)
    tolerance = 8 * len(a) * slices.unit
    for number in range(1, min(most, len(a)) + 1):
        low, high = slices.interval(number)
        if high <= tolerance:
            break
        v = _across(start.standard_normal(len(a)), found)
        shift, tries = (low + high) / 2, 0
        while True:
            v = _across(_solved(a, shift, v, slices.unit), found)
            value = float(v @ a @ v)
            if np.linalg.norm(a @ v - value * v) <= tolerance and low - tolerance <= value <= high + tolerance:
                break
            if low <= value <= high and tries % 8 < 6:
                shift = value
            else:  # the quotient follows another eigenvalue: back into a narrower interval
                low, high = slices.halved(number, low, high)
                shift = (low + high) / 2
            tries += 1
            if tries > 400:
                raise ArithmeticError(f"eigenvalue {number} did not settle")
        if not slices.above(value + tolerance) < number <= slices.above(value - tolerance):
            raise ArithmeticError(f"{value} is not eigenvalue {number}")
        if value <= tolerance:
            break
        found.append(v)
        values.append(value)
    return sorted(zip(values, found, strict=True), key=lambda pair: -pair[0])


def _differences(y: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * y - S exactly: 64-bit numbers where all fit, else Python's."""
    most = max(int(np.abs(y.astype(float)).max(initial=0)) * 2, 1)
    if n * most + max(map(abs, s)) < 1 << 62:
        return n * y - np.array(s, np.int64)
    return n * y.astype(object) - np.array(s, object)


def _squares(z: np.ndarray) -> list[int]:
    if z.dtype != object and z.shape[1] * float(np.abs(z.astype(float)).max(initial=0)) ** 2 < 2.0**62:
        return (z * z).sum(axis=1).tolist()
    return [sum(int(x) ** 2 for x in row) for row in z]


def _whitened(y: np.ndarray, n: int, s: list[int], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    z = _differences(y, n, s)
    return z, (z.astype(float) / n) @ vectors


def _spread_of(dimension: int, n: int, s: list[int], vectors: np.ndarray, means: np.ndarray | None):
    """Sums of the whitened values (i, -1), or of their products about the means (i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = vectors.shape[1]
        sums = np.zeros(k) if means is None else np.zeros((k, k))
        for batch in batches:
            w = _whitened(_matrix(batch.column("y"), dimension), n, s, vectors)[1]
            sums += w.sum(axis=0) if means is None else (w - means).T @ (w - means)
        i, j = (np.arange(k), np.full(k, -1)) if means is None else (x.ravel() for x in np.indices((k, k)))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums.ravel())], ["i", "j", "s"])

    return run


def _rows(dimension: int, n: int, s: list[int], vectors: np.ndarray, explained: list[float], error: float):
    k = vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, w = _whitened(_matrix(batch.column("y"), dimension), n, s, vectors)
            rows = len(w)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                 pa.array(np.full(rows * k, n)), pa.array(np.repeat(np.array(_squares(z), np.int64), k)), pa.array(w.ravel()),
                 pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whitened(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component."""
    spark = embeddings.sparkSession
    schema = f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    points = _points(embeddings, vector)
    lengths = points.groupBy(F.size("y").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dimension = lengths[0]["length"]
    points = points.where(F.size("y") == dimension)
    fit = stored(points.select("y").distinct(), "fit")
    n, s, covariance, trace = _moments(fit, dimension)
    pairs = leading(covariance, components)
    if not pairs:
        return spark.createDataFrame([], schema)
    vectors = np.stack([v / np.sqrt(value) for value, v in pairs], axis=1)
    means, spread = np.zeros(len(pairs)), np.zeros((len(pairs), len(pairs)))
    for row in _summed(fit, _spread_of(dimension, n, s, vectors, None)):
        means[row["i"]] = row["s"] / n
    for row in _summed(fit, _spread_of(dimension, n, s, vectors, means)):
        spread[row["i"], row["j"]] = row["s"] / n
    error = float(np.abs(spread - np.eye(len(pairs))).max())
    return points.mapInArrow(_rows(dimension, n, s, vectors, [value / trace for value, _ in pairs], error), schema)


def _summed(fit: DataFrame, sums) -> list:
    return fit.select("y").mapInArrow(sums, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
