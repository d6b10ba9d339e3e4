"""Whitening of embeddings: moments by Chan's merge formula over partitions, components on the driver, a second pass that checks the result."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from carrierscan.llm.common import discard, materialize
from carrierscan.llm.vectors import integer_matrix, integer_rows, matrix, width_of

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Moments:
    """Count, sums and centred scatter of some rows. Sums of whole numbers are Python's, of any size."""

    n: int
    total: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        n, total = len(x), x.sum(axis=0)
        y = centred(x, n, total)
        return cls(n, total.astype(object) if x.dtype == np.int64 else total, y.T @ y)

    def merge(self, other: Moments) -> Moments:
        """Chan's formula: both scatters, and the product of the means' distance with itself, weighted by n m / (n + m)."""
        if not self.n or not other.n:
            return self if self.n else other
        apart = ((other.total * self.n - self.total * other.n) / (self.n * other.n)).astype(np.float64)
        n = self.n + other.n
        return Moments(n, self.total + other.total, self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n))


def _most(x: np.ndarray, n: int, total: np.ndarray) -> int:
    """Bound of n x and total, and so of half their difference."""
    return max([n * int(np.abs(x).max(initial=0)), *(abs(int(t)) for t in total)])


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """``x`` less the mean ``total / n``: from whole numbers as (n x - total) / n, where these are exact."""
    if x.dtype != np.int64:
        return x - total / n
    if _most(x, n, total) < 1 << 62:
        return (n * x - total.astype(np.int64)) / n
    return ((x.astype(object) * n - total) / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """The sum over dimensions of (n x - total) squared, exact; None where 64 bits do not hold it."""
    if _most(x, n, total) < 1 << 62:
        y = n * x - total.astype(np.int64)
        if float((y.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0)) < float(1 << 62):
            return (y * y).sum(axis=1).tolist()
    rows = x.astype(object) * n - total
    return [int(s) if s < 1 << 63 else None for s in (rows * rows).sum(axis=1)]


def moments(rows: DataFrame, width: int, change: Callable[[np.ndarray], np.ndarray] = lambda x: x, out: int | None = None) -> Moments:
    """Moments of ``change(x)`` over all rows: each partition's by its batches, then pairs of partitions in a tree of tasks."""
    out = out or width

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            if batch.num_rows:
                own = Moments.of(change(matrix(batch.column(0), width)))
                found = found.merge(own) if found else own
        if found:
            totals = [[int(t) for t in found.total] if found.total.dtype == object else []]
            yield pa.RecordBatch.from_arrays(
                [pa.array([found.n], pa.int64()), pa.array(totals, pa.list_(pa.int64())), pa.array([np.asarray(found.total, np.float64).tobytes()], pa.binary()), pa.array([found.scatter.tobytes()], pa.binary())], names=["n", "total", "near", "scatter"]
            )

    def read(row) -> Moments:
        total = np.array(row["total"], object) if row["total"] else np.frombuffer(row["near"])
        return Moments(row["n"], total, np.frombuffer(row["scatter"]).reshape(out, out))

    return rows.select("x").mapInArrow(partials, "n long, total array<long>, near binary, scatter binary").rdd.map(read).treeReduce(Moments.merge, depth=2)


@dataclass(frozen=True)
class Whitening:
    """Fit of ``n`` different vectors: their sums, the leading components as columns, each one's eigenvalue and share of the trace; ``flat`` components have no variance."""

    n: int
    total: np.ndarray
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    flat: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; NaN on flat components."""
        return centred(x, self.n, self.total) @ self.components / np.where(self.flat, np.nan, np.sqrt(np.where(self.flat, 1.0, self.values)))


def fit(found: Moments, components: int = COMPONENTS) -> Whitening:
    cov = found.scatter / found.n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    trace, top = float(np.trace(cov)), float(values.max(initial=0.0))
    least = top * len(cov) * np.finfo(np.float64).eps
    kept = values[order]
    explained = np.maximum(kept, 0.0) / trace if trace > 0 else np.full(len(kept), np.nan)
    return Whitening(found.n, found.total, vectors[:, order], kept, explained, ~(kept > least))


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component.

    Components x are ``floor(scale * c) + shift``. The fit counts each different x vector once; a vector that a third of the rows repeat is
    one row of it after partial aggregation. Only one ``width`` by ``width`` matrix a partition moves; the driver gets one in all. Vectors that are null
    or hold null or non-finite entries give no row; repeated rows and null ids give theirs; shorter vectors count as if zeros
    followed, and integers beyond ``vectors.magnitude`` (2**27 for 64 entries) are held at it. On a component without variance (all vectors equal, fewer vectors than
    components) ``whitened`` is null and the check leaves it out; without any variance ``explained`` and ``identity_error`` are null. ``deviation`` is null where 64 bits
    do not hold it. An empty table gives no row.
    """
    width = width_of(vectors, vector_col)
    listed = materialize(integer_rows(vectors, {}, vector_col, scale, width, shift).distinct(), "fit")
    if listed.isEmpty():
        return vectors.sparkSession.createDataFrame([], OUT)
    model = fit(moments(listed, width), components)
    sound = np.flatnonzero(~model.flat)
    error = float("nan")
    if len(sound):
        again = moments(listed, width, lambda x: model.apply(x)[:, sound], len(sound))
        error = float(np.abs(again.scatter / again.n - np.eye(len(sound))).max())
    discard(listed)
    count = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x = integer_matrix(batch.column(1), scale, width, shift)
            n, ids = len(x), batch.column(0).filter(pa.array(keep))
            each, by = np.repeat(np.arange(n), count), np.tile(np.arange(count), n)
            deviation = pa.array(deviations(x, model.n, model.total), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(each)), pa.array((by + 1).astype(np.int32)), pa.array(np.full(n * count, model.n)), deviation.take(pa.array(each)),
                    pa.array(model.apply(x).reshape(-1), from_pandas=True), pa.array(model.explained[by], from_pandas=True), pa.array(np.full(n * count, error), from_pandas=True),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.selectExpr(f"cast(`{id_col}` as long) as vec_id", f"cast(`{vector_col}` as array<double>) as v").mapInArrow(run, OUT)
