"""Whitening of embeddings: principal components of a distributed covariance, found in single precision and refined in higher ones.

Executors only add up: sums of whole numbers, products of centred vectors, and the whitened covariance, each as one small matrix a task.
The driver holds matrices of the vectors' dimension, never vectors. There ``eigh`` in float32 gives approximate eigenvectors, which
the iteration of Ogita and Aishima corrects by matrix products in double and then in extended precision; it converges quadratically.
Eigenvalues too close to be told apart at the present accuracy form clusters, whose part of the basis is turned by an
eigendecomposition of the shifted small matrix of the cluster alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import cut
from graphloom.shipping import ship

#: Bits of a whole number's lower half, where sums are kept in two halves.
_HALF = 32
_LONGEST = (1 << 63) - 1


# --- eigenvectors on the driver ------------------------------------------------------------------------------------


def refine(a: np.ndarray, x: np.ndarray, steps: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of a symmetric matrix from approximate eigenvectors ``x``, in extended precision, falling.

    Double precision is used while corrections are large, extended precision from then on.
    """
    d = len(a)
    a = np.asarray(a, np.longdouble)
    lam, small = np.diag(a).copy(), False
    for _ in range(steps):
        kind = np.longdouble if small else np.float64
        b, x = a.astype(kind), np.asarray(x, kind)
        r, s, lam, delta = _residuals(b, x)
        turned = False
        for cluster in _clusters(lam, delta):
            j = np.ix_(cluster, cluster)
            shifted = s[j] - lam[cluster].mean() * (np.eye(len(cluster), dtype=kind) - r[j])  # the cluster's own small matrix
            size = np.abs(shifted).max()
            if size > 0:
                x[:, cluster] = x[:, cluster] @ np.linalg.eigh(((shifted + shifted.T) / (2 * size)).astype(np.float64))[1].astype(kind)
                turned = True
        if turned:
            r, s, lam, delta = _residuals(b, x)
        gap = lam[None, :] - lam[:, None]
        apart = np.abs(gap) > delta
        e = np.where(apart, (s + lam[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        most = np.abs(e).max() if d else 0
        if small and most < 1e-17:
            break
        small = small or most < 1e-6
    x = np.asarray(x, np.longdouble)
    lam = _residuals(a, x)[2]
    order = np.argsort(-lam, kind="stable")
    return lam[order], x[:, order]


def _residuals(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """How far x is from orthogonal, x'ax, its Rayleigh quotients, and the gap below which two of them can't be told apart."""
    r = np.eye(len(a), dtype=x.dtype) - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2
    lam = np.diag(s) / (1 - np.diag(r))
    norm = lambda m: np.sqrt((m * m).sum())
    return r, s, lam, 2 * (norm(s - np.diag(lam)) + norm(a) * norm(r))


def _clusters(lam: np.ndarray, delta: float) -> list[np.ndarray]:
    """Groups of two and more eigenvalues in which each is within delta of the next."""
    order = np.argsort(-lam, kind="stable")
    cuts = np.flatnonzero(lam[order][:-1] - lam[order][1:] > delta) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first eigenvalues that aren't nought, and their unit vectors as columns; a vector's largest entry is positive."""
    d, trace = len(covariance), np.trace(covariance)
    if not d or trace <= 0:
        return np.zeros(0), np.zeros((d, 0))
    a = np.asarray(covariance, np.longdouble) / trace
    lam, x = refine(a, np.linalg.eigh(a.astype(np.float32))[1])
    k = int((lam[:most] > d * np.finfo(np.float64).eps).sum())
    x = x[:, :k] / np.sqrt((x[:, :k] ** 2).sum(0))
    x *= np.sign(x[np.abs(x).argmax(0), np.arange(k)])
    return (lam[:k] * trace).astype(np.float64), x.astype(np.float64)


# --- sums on the executors -----------------------------------------------------------------------------------------


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are numbers."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    """``floor(scale * c)`` of each entry, without zeros at the end: vectors that differ in them only are equal."""
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    last = F.coalesce(F.array_max(F.transform(x, lambda v, i: F.when(v != 0, i + 1).otherwise(0))), F.lit(0))
    return F.when(F.coalesce(F.try_element_at(x, F.lit(-1)), F.lit(0)) != 0, x).otherwise(F.slice(x, F.lit(1), last))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Vectors as rows of whole numbers, continued by zeros."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    if (sizes == d).all():
        return values.reshape(len(sizes), d)
    out = np.zeros((len(sizes), d), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values
    return out


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sum of each dimension. Tasks send one row a dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), int(np.diff(batch.column(0).offsets.to_numpy()).max(initial=0)))
            n += len(x)
            more = max(0, x.shape[1] - len(high))
            high, low = np.pad(high, (0, more)), np.pad(low, (0, more))
            high[: x.shape[1]] += (x >> _HALF).sum(0)
            low[: x.shape[1]] += (x & ((1 << _HALF) - 1)).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(high)), pa.int32()), pa.array([0, *high], pa.int64()), pa.array([n, *low], pa.int64())], names=["dim", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    got = {r.dim: (int(r.high) << _HALF) + int(r.low) for r in fit.mapInArrow(run, "dim int, high long, low long").groupBy("dim").agg(exact("high"), exact("low")).collect()}
    return got.pop(-1, 0), [got[k] for k in range(len(got))]


def _products(fit: DataFrame, d: int, k: int, project) -> tuple[np.ndarray, np.ndarray]:
    """Sums, and sums of products, of ``project(x)``, k numbers a vector. Tasks send k + 1 rows; added up by rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares, n = np.zeros(k), np.zeros((k, k)), 0
        for batch in batches:
            z = project(matrix(batch.column(0), d))
            total += z.sum(0)
            squares += z.T @ z
            n += len(z)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, k), pa.int32()), pa.array([total.tolist(), *squares.tolist()], pa.list_(pa.float64()))], names=["row", "v"])

    got = fit.mapInArrow(run, "row int, v array<double>").groupBy("row").agg(F.array(*(F.sum(F.col("v")[j]) for j in range(k))).alias("v")).collect()
    by = {r.row: np.array(r.v) for r in got}
    return by[-1], np.array([by[j] for j in range(k)])


# --- the operator --------------------------------------------------------------------------------------------------


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 4, scale: int = 256) -> DataFrame:
    """One row per vector and component: id, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Vectors that are null or hold null, NaN or infinite entries are left out. Entries become ``x = floor(scale * c)``; beyond 64 bits they
    are the largest or smallest long. The components are those of the covariance of the distinct x, each counted once; ``deviation`` is
    the sum over dimensions of ``(n * x - sum) ** 2``, exact, or null if it is beyond a long. Shorter vectors count as continued by zeros.
    Directions without variance (below ``dimension * 2 ** -52`` of the whole) are no components, so there may be fewer than ``most``, and if all
    vectors are equal the result is empty, as for an empty table. Repeated rows and repeated or null ids each have rows of their own;
    other columns are ignored, whatever their names.

    The driver holds a few matrices of dimension x dimension.
    """
    spark = vectors.sparkSession
    ship(spark)
    vector = F.col(vector_col)
    rows = vectors.filter(finite(vector)).select(F.col(id_col).alias("__id"), whole(vector, scale).alias("__x"))
    fit = cut(rows.select("__x").distinct())
    n, sums = _sums(fit)
    d = len(sums)
    schema = T.StructType([
        T.StructField(id_col, vectors.schema[id_col].dataType), *T._parse_datatype_string("component int, n long, deviation long, whitened double, explained double, identity_error double")])
    if not n or not d:
        return spark.createDataFrame([], schema)
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)  # whole, so that products of small numbers are exact
    total, squares = _products(fit, d, d, lambda x: (x - middle).astype(np.float64))
    rest = total.astype(np.longdouble) / n
    covariance = squares.astype(np.longdouble) / n - np.outer(rest, rest)
    values, basis = components(covariance, most)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    off = np.array([float((s - n * int(m)) / n) for s, m in zip(sums, middle, strict=True)])  # mean less middle
    project = lambda x: ((x - middle) - off) @ basis / np.sqrt(values)
    total, squares = _products(fit, d, k, project)
    error = float(np.abs(squares / n - np.outer(total / n, total / n) - np.eye(k)).max())
    explained = values / float(np.trace(covariance))
    widest = max(map(abs, sums))
    names = [f.name for f in schema]

    def deviations(x: np.ndarray) -> list[int | None]:
        largest = n * max(abs(int(x.max())), abs(int(x.min()))) + widest
        if largest * largest * d <= _LONGEST:
            y = n * x - np.array(sums, np.int64)
            return (y * y).sum(1).tolist()
        exact = (sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist())
        return [v if v <= _LONGEST else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = matrix(batch.column(1), d)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                pa.array(deviations(x), pa.int64()).take(each), pa.array(project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ], names=names)

    return rows.mapInArrow(run, schema)
