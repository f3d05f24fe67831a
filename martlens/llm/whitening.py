"""Whitening of embeddings: a distributed covariance, eigenvectors in single precision, refined by matrix products.

The covariance is summed in the tasks, centred before it is multiplied; what reaches the driver is one square matrix of the vectors'
length, however many rows there are. Its float32 eigenvectors are corrected by the iteration of Ogita and Aishima: from residuals of orthogonality and of
diagonality, in higher precision, each step gives a matrix that nearly doubles the right digits; the last steps run in extended
precision. The step can't part eigenvalues closer than the residuals. Such a cluster is solved by itself: the matrix, shifted by the
cluster's mean and projected on its vectors, is scaled up and given to the same procedure.

Cases: rows whose vector is null, empty or holds a null or a number that isn't finite are left out. Where vectors of several lengths occur, the
commonest length (of several, the greatest) is used and the other rows are left out. Each row has its own results, also rows with an equal or a
null vec_id; the fit takes each distinct vector once. Eigenvalues at the level of rounding (all, if all vectors are equal) give components
without a direction: ``whitened`` is null, and so is ``explained`` where the trace is 0; ``identity_error`` looks at the others. ``deviation`` is null where it
exceeds a long. No usable row gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.llm.common import pinned

WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _groups(values: np.ndarray, width: float) -> list[np.ndarray]:
    """Indexes of ascending ``values`` in chains whose neighbours are at most ``width`` apart, those of one value left out."""
    cut = np.flatnonzero(np.diff(values) > width) + 1
    return [g for g in np.split(np.arange(len(values)), cut) if len(g) > 1]


def refine(a: np.ndarray, x: np.ndarray, steps: int = 12) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (rising), eigenvectors and the least distance told apart, from approximate eigenvectors ``x``, in the precision of ``a``."""
    eps = float(np.finfo(a.dtype).eps)
    x, size, last = x.astype(a.dtype), float(np.abs(a).sum(axis=1).max()), np.inf
    one = np.eye(len(a), dtype=a.dtype)
    for _ in range(steps):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        told = 2 * (float(np.linalg.norm(off.astype(np.float64))) + size * float(np.linalg.norm(r.astype(np.float64))))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > told
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        moved = float(np.abs(e).max())
        if moved <= 4 * eps or moved >= last / 2 and moved < 1e-3:
            break
        last = moved
    r = one - x.T @ x
    values = np.diag(x.T @ (a @ x)) / (1 - np.diag(r))
    order = np.argsort(values, kind="stable")
    return values[order], x[:, order], told


def eigen(a: np.ndarray, depth: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in rising order and eigenvectors of a symmetric matrix of float64 or longdouble entries.

    depth: how often a cluster may be solved by itself; one whose spread is the rounding of ``a`` keeps the vectors that it has, any of
    which are eigenvectors.
    """
    one, whole = np.eye(len(a), dtype=a.dtype), a
    a = a - np.trace(a) / len(a) * one
    scale = float(np.abs(a).max())
    if scale <= 8 * len(a) * float(np.finfo(a.dtype).eps) * float(np.abs(whole).max()):
        return np.diag(whole).copy(), one
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1]
    values, x, told = refine(a.astype(np.float64), x)
    if a.dtype != np.float64:
        values, x, told = refine(a, x)
    for g in _groups(values.astype(np.float64), max(told, 1e-6)) if depth else ():
        own, middle = x[:, g], values[g].mean()
        inner = own.T @ (a @ own - middle * own)
        inner = (inner + inner.T) / 2
        if float(np.abs(inner).max()) > 8 * len(a) * float(np.finfo(a.dtype).eps):
            x[:, g] = own @ eigen(inner, depth - 1)[1]
    for _ in range(3):
        x = x + x @ ((one - x.T @ x) / 2)
    values = np.einsum("ij,ij->j", x, whole @ x)
    order = np.argsort(values, kind="stable")
    return values[order], x[:, order]


@dataclass
class Whitening:
    """What the fit list gives: its size, sums, mean, eigenvalues (falling), eigenvectors (columns), trace, and the error of the result."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def directions(self, components: int) -> np.ndarray:
        """The first components that have a variance above rounding, each divided by its root."""
        v = self.values[:components]
        v = v[v > len(self.values) * np.finfo(np.float64).eps * max(float(self.values[0]), 0.0)] if len(v) else v
        return self.vectors[:, : len(v)] / np.sqrt(v)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), len(flat) // max(1, len(column)))


def _summed(fit: DataFrame, partial: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], kind: str) -> np.ndarray:
    """The sum over tasks of ``partial`` (vectors of a batch), an array of ``shape``; its cells are added up by key, not in the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                total = total + partial(_matrix(batch.column(0)))
        if np.ndim(total):
            flat = np.asarray(total).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["cell", "v"])

    cells = fit.select("x").mapInArrow(run, f"cell long, v {kind}").groupBy("cell").agg(F.sum("v").alias("v"))
    out = np.zeros(int(np.prod(shape)), np.int64 if kind == "long" else np.float64)
    for r in cells.collect():
        out[r.cell] = r.v
    return out.reshape(shape)


def fit_whitening(fit: DataFrame, dims: int, n: int, components: int = 4) -> Whitening:
    """The whitening of the vectors ``x`` (arrays of ``dims`` longs) of ``fit``, of which there are ``n`` > 0."""
    sums = _summed(fit, lambda x: x.sum(axis=0), (dims,), "long")
    mean = np.array([float(s) / n for s in sums.tolist()])

    def product(x: np.ndarray) -> np.ndarray:
        z = x - mean
        return z.T @ z

    v = _summed(fit, product, (dims, dims), "double") / n
    v = (v + v.T) / 2
    values, vectors = eigen(v.astype(np.longdouble))
    model = Whitening(n, sums, mean, values[::-1].astype(np.float64), vectors[:, ::-1].astype(np.float64), float(np.trace(v)))
    w = model.directions(components)
    if k := w.shape[1]:
        middle = _summed(fit, lambda x: ((x - mean) @ w).sum(axis=0), (k,), "double") / n

        def whitened(x: np.ndarray) -> np.ndarray:
            y = (x - mean) @ w - middle
            return y.T @ y

        model.identity_error = float(np.abs(_summed(fit, whitened, (k, k), "double") / n - np.eye(k)).max())
    return model


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - S) ** 2, exact; null beyond a long."""
    most = max(n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0)), 1)
    if most * most * max(x.shape[1], 1) < 1 << 63:
        z = n * x - sums
        return (z * z).sum(axis=1).tolist()
    own = sums.tolist()
    exact = (sum((n * a - s) ** 2 for a, s in zip(row, own, strict=True)) for row in x.tolist())
    return [d if d < 1 << 63 else None for d in exact]


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * c) of every entry, as longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and vector of the rows whose vector is neither null nor empty and holds finite numbers only."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v")).filter((F.size("v") > 0) & F.forall("v", finite))


def whiten(rows: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """WHITENED of each usable row of ``rows`` (vec_id, embedding) and each of its first ``components``, numbered from 1 by falling variance."""
    spark = rows.sparkSession
    own = usable(rows)
    lengths = own.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if lengths is None:
        return spark.createDataFrame([], WHITENED)
    dims = lengths["dims"]
    own = own.filter(F.size("v") == dims).select("vec_id", quantised(F.col("v"), scale).alias("x"))
    fit = pinned(own.select("x").distinct(), "fit")
    model = fit_whitening(fit, dims, fit.count(), components)
    n, sums, mean, w, error, of = model.n, model.sums, model.mean, model.directions(components), model.identity_error, min(components, dims)
    explained = [float(e) / model.trace if model.trace > 0 else None for e in model.values[:of]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1)) if batch.num_rows else np.zeros((0, dims), np.int64)
            k, m = batch.num_rows, w.shape[1]
            y = np.full((k, of), np.nan)
            y[:, :m] = (x - mean) @ w
            ids = pa.array(np.repeat(np.arange(k), of))
            columns = [batch.column(0).take(ids), pa.array(np.tile(np.arange(1, of + 1, dtype=np.int32), k)), pa.array(np.full(k * of, n)), pa.array(_deviations(x, n, sums), pa.int64()).take(ids)]
            columns += [pa.array(y.ravel(), mask=np.tile(np.arange(of) >= m, k)), pa.array(explained * k, pa.float64()), pa.array(np.full(k * of, error))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return own.mapInArrow(run, WHITENED)
