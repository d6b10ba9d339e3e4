"""Whole-number vectors, as the exact search, the whitening and the vector codes take them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierscan.llm.common import small_batches

#: Whole numbers up to here are exact in double precision, products and sums included.
EXACT = 1 << 53


def magnitude(width: int) -> int:
    """Integers are held at plus or minus this, so that sums of products of differences over ``width`` of them fit in 62 bits."""
    return 1 << min(30, (60 - max(0, width - 1).bit_length()) // 2)


def integer_matrix(column: pa.ListArray, scale: float, width: int, add: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are no null and hold no null or non-finite component, and for those ``floor(scale * c) + add`` of each component, shorter rows with zeros at their end."""
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    keep, finite = column.is_valid().to_numpy(zero_copy_only=False).copy(), np.isfinite(values)
    keep[row[~finite]] = False
    most = magnitude(width)
    out = np.zeros((len(lengths), width), np.int64)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.clip(np.floor(scale * np.where(finite, values, 0.0)), -most, most).astype(np.int64)
    return keep, out[keep] + add


def width_of(df: DataFrame, vector_col: str, multiple: int = 1) -> int:
    """The longest vector's length, rounded up to a ``multiple``."""
    return max(1, -(-int(df.agg(F.max(F.size(vector_col))).head()[0] or 0) // multiple)) * multiple


def integer_rows(df: DataFrame, columns: dict[str, str], vector_col: str, scale: float, width: int, add: int = 0) -> DataFrame:
    """``columns`` (expressions by name) and the integers ``x`` of all rows that ``integer_matrix`` keeps."""
    small_batches(df.sparkSession)
    rows = df.select(*[F.expr(e).alias(n) for n, e in columns.items()], F.col(vector_col).cast("array<double>").alias("x"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]), "x array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x = integer_matrix(batch.column(batch.num_columns - 1), scale, width, add)
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], rows_array(x)], names=batch.schema.names)

    return rows.mapInArrow(run, schema)


def rows_array(x: np.ndarray) -> pa.ListArray:
    """A matrix as an array of 32-bit lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.astype(np.int32).reshape(-1)))


def matrix(column: pa.ListArray | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of one length as 64-bit integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two whole-number matrices: by doubles where every sum is small enough, else by 64-bit integers."""
    if len(a) and len(b) and a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) >= EXACT:
        return a @ b.T
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
