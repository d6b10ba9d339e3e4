"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carrierscan.shared import forget_at_exit

#: White space of the word contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is unset, a temporary folder serves a local master; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/carrierscan-shared"
        spark.conf.set("spark.checkpoint.dir", base) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return f"{base.rstrip('/')}/carrierscan/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold ``BATCH_BYTES`` where the session has Spark's default: with rows of whole texts, that default takes many times its size in both processes."""
    if spark.conf.get(BATCH_KEY, "64m") in ("64m", "64MB", "67108864", "67108864b"):
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, and gives the planner true sizes. It goes when the driver's Python ends."""
    small_batches(df.sparkSession)
    path = shared_dir(df.sparkSession, name)
    forget_at_exit(df.sparkSession, path)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing reads them any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._stored)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(spark: SparkSession, rows: int, per_group: int = 200_000) -> int:
    """Salts for a key that may hold all rows: as many as shuffle partitions, more when a salt would get over ``per_group`` rows."""
    return max(partitions(spark), -(-rows // per_group))


def whole_row(df: DataFrame, without: tuple[str, ...]) -> Column:
    """All columns of ``df`` but those in ``without`` (upper or lower case) as one struct, apart from an operator's own columns."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in without]).alias("_all")


def salt(column: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each slice holds about ``most`` bytes of ``column``, and one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column_data = batch.column(batch.schema.get_field_index(column))
        width = np.int64 if pa.types.is_large_string(column_data.type) or pa.types.is_large_binary(column_data.type) else np.int32
        offsets = np.frombuffer(column_data.buffers()[1], dtype=width)[column_data.offset : column_data.offset + len(column_data) + 1].astype(np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    release()


def with_text_columns(docs: DataFrame, score: Callable[[list[str | None]], list[pa.Array]], added: dict[str, str], keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, all by default) with the ``added`` columns (names and types), which ``score`` gives for whole texts.

    Texts go to the workers once, also where ``keep`` holds them. Columns named like an added one, in upper or lower case, are replaced.
    """
    small_batches(docs.sparkSession)
    wanted = {c.lower() for c in keep or docs.columns}
    kept = [f for f in docs.schema if f.name.lower() in wanted and f.name.lower() not in added]
    text = next((i for i, f in enumerate(kept) if f.name.lower() == text_col.lower()), None)
    columns = [F.col(f"`{f.name}`") for f in kept] + ([F.col(text_col).alias("_scan")] if text is None else [])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} {t}" for n, t in added.items())])
    at, name = (len(kept), "_scan") if text is None else (text, kept[text].name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, name):
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *score(batch.column(at).to_pylist())], names=[*batch.schema.names[: len(kept)], *added])

    return docs.select(*columns).mapInArrow(run, schema)


def release() -> None:
    """Give freed memory back to the system: an idle worker keeps none of a finished task's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """A function of one or two tables of a group that gives freed memory back after each group."""
    if len(inspect.signature(run).parameters) == 2:

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            try:
                return run(left, right)
            finally:
                release()

        return both

    def one(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            release()

    return one


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer over unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def binary_array(data: bytes | np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values that lie one after the other in ``data``."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(data)])


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.ascontiguousarray(offsets, np.int32)), pa.array(values))
