"""Embedding whitening: the covariance is recovered from variances alone (polarisation).

Entries are turned into whole numbers. For every dimension and for the sum of every two dimensions the squares of the centred
values are added up exactly, in tasks and then by Spark. Half of var(i + j) - var(i) - var(j) is the covariance of i and j;
the matrix is put together on the driver (dimension by dimension numbers, whatever the rows) and decomposed by ``eigh``.

Centring is exact without fractions: a task subtracts the whole part of the mean, and what is left of the mean is taken from
the sums as whole numbers. Sums that could leave 64 bits are made with Python's integers.

Vectors that are null or hold null, non-finite or enormous (2^51 and more) entries are left out. So are vectors whose length
is not the commonest one (of equally common ones the longest). Vectors of any number of copies count and are returned as often
as they occur. Components whose eigenvalue is below 1e-10 of the largest carry no signal in double precision: no rows come
out for them, and none at all if no vector is left or all are equal. Equal eigenvalues are numbered as ``eigh`` gives them.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
#: Entries must stay whole numbers of 64 bits after scaling.
ENORMOUS = 2.0**51
FLAT = 1e-10
_SAFE = 2**62
_ROWS = 4096


def whole(values: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100000."""
    return np.floor(values * SCALE).astype(np.int64) + SHIFT


def exact_sum(rows: np.ndarray) -> np.ndarray:
    """Column sums as Python integers."""
    if len(rows) and int(np.abs(rows).max()) * len(rows) >= _SAFE:
        rows = rows.astype(object)
    return rows.sum(0).astype(object)


def pair_squares(y: np.ndarray) -> np.ndarray:
    """At [i, i] the sum of the squares of column i, at [i, j > i] that of the squares of column i + column j; exact."""
    width = y.shape[1]
    out = np.zeros((width, width), object)
    if not len(y):
        return out
    small = 4 * int(np.abs(y).max()) ** 2 * len(y) < _SAFE
    y = np.asfortranarray(y) if small else y.astype(object)
    for apart in range(width):
        s = y[:, : width - apart] + y[:, apart:] if apart else y
        sums = np.einsum("ij,ij->j", s, s) if small else (s * s).sum(0)
        at = np.arange(width - apart)
        out[at, at + apart] = sums.astype(object)
    return out


def polarised(n: int, squares: np.ndarray, left: np.ndarray) -> np.ndarray:
    """n^2 times the covariance matrix, in Python integers.

    ``squares`` is what ``pair_squares`` gives for the values less a whole number per dimension, ``left`` the sums of those.
    """
    both = left[:, None] + left[None, :]
    centred = n * squares - both * both
    own = n * np.diagonal(squares) - left * left
    cross = (np.triu(centred, 1) - np.triu(own[:, None] + own[None, :], 1)) // 2
    return cross + cross.T + np.diag(own)


@dataclass(frozen=True)
class Whitening:
    """The fitted numbers; ``values`` fall, ``vectors`` has a component per column."""

    n: int
    width: int
    pivot: np.ndarray
    left: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def whitened(self, y: np.ndarray) -> np.ndarray:
        mean = np.array([int(t) / self.n for t in self.left])
        return (y.astype(float) - mean) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, y: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n x - S)^2, which is (n y - left)^2."""
        n, left = self.n, self.left
        most = int(np.abs(y).max()) if len(y) else 0
        most_left = max((abs(int(t)) for t in left), default=0)
        if max(most * most, most * most_left) * self.width < _SAFE and most_left < _SAFE:
            squares, crossed = np.einsum("ij,ij->i", y, y), y @ left.astype(np.int64)
        else:
            wide = y.astype(object)
            squares, crossed = (wide * wide).sum(1), wide @ left
        rest = sum(int(t) ** 2 for t in left)
        return [n * n * int(a) - 2 * n * int(b) + rest for a, b in zip(squares, crossed, strict=True)]


def _usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    rows = vectors.select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").cast("array<double>").alias("v")
    )
    # NaN is greater than every number here, so it is left out like infinity.
    return rows.where(
        F.col("v").isNotNull() & F.forall("v", lambda e: e.isNotNull() & (F.abs(e) < ENORMOUS))
    )


def _matrices(batches, width: int, at: int = 0):
    """Pairs of a slice of a batch and its vectors in whole numbers."""
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            part = batch.slice(start, _ROWS)
            yield part, whole(part.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))


def _fit(rows: DataFrame, width: int, most: int) -> Whitening | None:
    """Two passes: sums, then squares; each sends the driver as many numbers as the matrix has, however many rows there are."""
    number = pa.decimal128(38, 0)

    def sums(batches):
        n, total = 0, np.zeros(width, object)
        for _, x in _matrices(batches, width):
            n, total = n + len(x), total + exact_sum(x)
        at = pa.array([-1, *range(width)], pa.int32())
        yield pa.RecordBatch.from_arrays([at, pa.array(map(Decimal, [n, *total]), number)], ["at", "total"])

    added = (
        rows.select("v").mapInArrow(sums, "at int, total decimal(38,0)").groupBy("at").agg(F.sum("total").alias("total"))
    )
    found = {r["at"]: int(r["total"]) for r in added.collect()}
    n = found.get(-1, 0)
    if not n:
        return None
    total = np.array([found[i] for i in range(width)], object)
    pivot = np.array([int(t) // n for t in total], np.int64)
    left = total - n * pivot.astype(object)

    def squares(batches):
        out = np.zeros((width, width), object)
        for _, x in _matrices(batches, width):
            out = out + pair_squares(x - pivot)
        i, j = np.triu_indices(width)
        columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(map(Decimal, out[i, j]), number)]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "total"])

    table = (
        rows.select("v")
        .mapInArrow(squares, "i int, j int, total decimal(38,0)")
        .groupBy("i", "j")
        .agg(F.sum("total").alias("total"))
        .toArrow()
    )
    summed = np.zeros((width, width), object)
    for i, j, t in zip(*(c.to_pylist() for c in table.columns), strict=True):
        summed[i, j] = summed[j, i] = int(t)
    exact = polarised(n, summed, left)
    covariance = np.array([[int(v) / (n * n) for v in row] for row in exact], float)
    values, parts = np.linalg.eigh(covariance)
    values, parts = values[::-1], parts[:, ::-1]
    kept = int(((values > FLAT * max(values[0], 0)) & (values > 0))[:most].sum())
    trace = sum(int(v) for v in np.diagonal(exact)) / (n * n)
    return Whitening(n, width, pivot, left, values[:kept].copy(), parts[:, :kept].copy(), trace)


def _identity_error(rows: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity; one more pass, centred in each task."""
    width, kept = fitted.width, len(fitted.values)

    def moments(batches):
        n, mean, co = 0, np.zeros(kept), np.zeros((kept, kept))
        for _, x in _matrices(batches, width):
            w = fitted.whitened(x - fitted.pivot)
            m = w.mean(0)
            c = w - m
            both, step = n + len(w), m - mean
            co += c.T @ c + np.outer(step, step) * (n * len(w) / both)
            mean, n = mean + step * (len(w) / both), both
        if n:
            a, b = np.triu_indices(kept)
            columns = [a.astype(np.int32), b.astype(np.int32), np.full(len(a), n), mean[a], mean[b], co[a, b]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "n", "ma", "mb", "co"])

    n = F.sum("n")
    between = F.sum(F.col("n") * F.col("ma") * F.col("mb")) - F.sum(F.col("n") * F.col("ma")) * F.sum(F.col("n") * F.col("mb")) / n
    entries = (
        rows.select("v")
        .mapInArrow(moments, "a int, b int, n bigint, ma double, mb double, co double")
        .groupBy("a", "b")
        .agg(((F.sum("co") + between) / n).alias("entry"))
    )
    error = F.abs(F.col("entry") - F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0))
    return float(entries.agg(F.max(error)).first()[0])


SCHEMA = "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 8
) -> DataFrame:
    """A row per usable vector and component: the id, ``component, n, deviation, whitened, explained, identity_error``.

    ``deviation`` is exact; one of more than 38 digits is null.
    """
    rows = _usable(vectors, id_column, vector_column)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_column}` {kind}, {SCHEMA}"
    common = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = common["width"] if common else 0
    rows = rows.where(F.size("v") == width)
    fitted = _fit(rows, width, components) if width else None
    if fitted is None or not len(fitted.values):
        return vectors.sparkSession.createDataFrame([], schema)
    error = _identity_error(rows, fitted)
    kept = len(fitted.values)
    share = fitted.values / fitted.trace

    def written(batches):
        for part, x in _matrices(batches, width, at=1):
            y = x - fitted.pivot
            each = np.repeat(np.arange(len(y)), kept)
            far = [Decimal(d) if d < 10**38 else None for d in fitted.deviations(y)]
            columns = [
                part.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(y))),
                pa.array(np.full(len(each), fitted.n)),
                pa.array(far, pa.decimal128(38, 0)).take(pa.array(each)),
                pa.array(fitted.whitened(y).ravel()),
                pa.array(np.tile(share, len(y))),
                pa.array(np.full(len(each), error)),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"]
            )

    return rows.select(F.col("id").alias(id_column), "v").mapInArrow(written, schema)
