"""Vector codes: parts of vectors named by codebook entries that Lloyd rounds improve, with Hamerly's bounds in place of most distances."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierscan.llm.common import discard, materialize
from carrierscan.llm.vectors import integer_rows, matrix, products, width_of

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows whose vectors and bounds are one row of the persisted table.
BLOCK_ROWS = 2048
#: Relative room for rounding in every bound.
ROOM = 1e-9
BLOCK = "ids array<long>, labels array<string>, narrow boolean, x binary, codes binary, upper binary, lower binary, sums array<long>, counts array<long>, scanned long"


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry]``: whole-number centres of every part position."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Entries at the floor of their parts' mean; unused ones stay."""
        used = np.maximum(counts, 1).astype(object)[..., None]
        return Codebooks(np.where(counts[..., None] > 0, sums // used, self.entries.astype(object)).astype(np.int64))


def squared(part: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    return (part * part).sum(axis=1)[:, None] - 2 * products(part, entries) + (entries * entries).sum(axis=1)


def above(x: np.ndarray) -> np.ndarray:
    """Rounded up to single precision, with room."""
    return np.nextafter((x * (1 + ROOM)).astype(np.float32), np.float32(np.inf))


def below(x: np.ndarray) -> np.ndarray:
    """Rounded down to single precision, with room."""
    return np.nextafter((x - np.abs(x) * ROOM).astype(np.float32), np.float32(-np.inf))


def scan(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's nearest entry (ties to the lower index), a bound above its distance and a bound below the second nearest's."""
    found = squared(part, entries)
    code = found.argmin(axis=1)
    first = np.take_along_axis(found, code[:, None], axis=1)[:, 0]
    second = np.partition(found, 1, axis=1)[:, 1].astype(np.float64) if len(entries) > 1 else np.full(len(part), np.inf)
    return code.astype(np.uint8), above(np.sqrt(first.astype(np.float64))), below(np.sqrt(second))


def reassign(part: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes and bounds after the entries moved from ``old`` to ``new``, and how many rows were scanned.

    A row keeps its code unseen where its upper bound is strictly below the lower bound, or below half the way from its entry to the next one; equality
    might be a tie with a lower index, and is scanned. Bounds move by the way that the entries moved.
    """
    step = np.sqrt(((new - old) ** 2).sum(axis=1).astype(np.float64))
    order = np.argsort(-step, kind="stable")
    others = np.where(np.arange(len(step)) == order[0], step[order[1]] if len(step) > 1 else 0.0, step[order[0]])
    upper = above(upper.astype(np.float64) + step[code] * (1 + ROOM))
    lower = below(lower.astype(np.float64) - others[code] * (1 + ROOM))
    between = squared(new, new).astype(np.float64)
    np.fill_diagonal(between, np.inf)
    half = np.sqrt(between.min(axis=1)) / 2 * (1 - ROOM)
    need = np.maximum(lower, half[code])
    left = np.flatnonzero(~(upper < need))
    upper[left] = above(np.sqrt(((part[left] - new[code[left]]) ** 2).sum(axis=1).astype(np.float64)))
    left = left[~(upper[left] < need[left])]
    code, lower = code.copy(), lower.copy()
    code[left], upper[left], lower[left] = scan(part[left], new)
    return code, upper, lower, len(left)


def totals(x: np.ndarray, codes: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the parts of each entry: ``(parts, entries, part width)`` and ``(parts, entries)``."""
    n, parts, width = x.shape
    sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
    for p in range(parts):
        order = np.argsort(codes[:, p], kind="stable")
        used, at, count = np.unique(codes[order, p], return_index=True, return_counts=True)
        sums[p, used], counts[p, used] = np.add.reduceat(x[order, p], at, axis=0), count
    return sums, counts


def _block(ids: pa.Array, labels: pa.Array, x: np.ndarray, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray, entries: int, scanned: int) -> pa.RecordBatch:
    sums, counts = totals(x, codes, entries)
    narrow = bool(np.abs(x).max(initial=0) < 1 << 15)
    whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    data = [x.astype(np.int16 if narrow else np.int32), codes, upper, lower]
    return pa.RecordBatch.from_arrays(
        [whole(ids), whole(labels), pa.array([narrow]), *(pa.array([d.tobytes()], pa.binary()) for d in data), whole(pa.array(sums.reshape(-1))), whole(pa.array(counts.reshape(-1))), pa.array([scanned], pa.int64())],
        names=[c.split()[0] for c in BLOCK.split(", ")],
    )


def _read(batch: pa.RecordBatch, i: int, parts: int, width: int) -> tuple[np.ndarray, ...]:
    """``x, codes, upper, lower`` of the i-th block of a batch."""
    narrow, x, *rest = (batch.column(c)[i] for c in ("narrow", "x", "codes", "upper", "lower"))
    x = np.frombuffer(x.as_buffer(), np.int16 if narrow.as_py() else np.int32).astype(np.int64).reshape(-1, parts, width)
    return x, *(np.frombuffer(b.as_buffer(), t).reshape(-1, parts) for b, t in zip(rest, (np.uint8, np.float32, np.float32), strict=True))


def first_codebooks(rows: DataFrame, parts: int, entries: int, width: int) -> Codebooks:
    """The parts of the rows with the smallest ids, null ids last, the smaller vector first of repeated ids."""
    found = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    return Codebooks(np.array([r["x"] for r in found], np.int64).reshape(-1, parts, width // parts).transpose(1, 0, 2))


def vector_codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector.

    Vectors become integers ``floor(scale * c)`` and are cut into ``parts`` equal parts. Blocks of rows with their codes, and one upper and one second-nearest
    lower bound per part, are a table that each round writes anew; a part is compared with all entries only where its bounds do not decide. A round's sums are those of blocks, added up by
    entry in Spark; the driver sees one codebook. Groups of equal vectors or labels are never brought together, labels meet their sums by a join.

    Vectors that are null or hold null or non-finite components give no row. Repeated rows and null ids give theirs (null ids come last among the first entries). With fewer rows than ``entries`` the
    codebooks are that small. Shorter vectors, and widths that ``parts`` does not divide, count as if zeros followed; integers beyond ``vectors.magnitude`` (2**27 for 64 components) are
    held at it. ``label_error`` is null where 64 bits do not hold it; without a label column all labels are null. An empty table gives no row.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    spark, whole = vectors.sparkSession, width_of(vectors, vector_col, parts)
    width = whole // parts
    label = f"cast(`{label_col}` as string)" if label_col in vectors.columns else "cast(null as string)"
    rows = integer_rows(vectors, {"id": f"cast(`{id_col}` as long)", "label": label}, vector_col, scale, whole)
    book = first_codebooks(rows, parts, entries, whole)
    size = book.entries.shape[1]
    out = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if not size:
        return spark.createDataFrame([], out)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = matrix(part.column(2), whole).reshape(-1, parts, width)
                codes, upper, lower = (np.stack(c, axis=1) for c in zip(*(scan(x[:, p], book.entries[p]) for p in range(parts)), strict=True))
                yield _block(part.column(0), part.column(1), x, codes, upper, lower, size, len(x) * parts)

    def turn(old: Codebooks, new: Codebooks, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    x, codes, upper, lower = _read(batch, i, parts, width)
                    codes, upper, lower, scanned = zip(*(reassign(x[:, p], codes[:, p], upper[:, p], lower[:, p], old.entries[p], new.entries[p]) for p in range(parts)), strict=True)
                    ids, labels, codes = batch.column("ids")[i].values, batch.column("labels")[i].values, np.stack(codes, axis=1)
                    if not last:
                        yield _block(ids, labels, x, codes, np.stack(upper, axis=1), np.stack(lower, axis=1), size, sum(scanned))
                        continue
                    errors = sum(((x[:, p] - new.entries[p][codes[:, p]]) ** 2).sum(axis=1) for p in range(parts))
                    text = [bytes(c).hex() for c in codes]
                    yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

        return run

    blocks = materialize(rows.mapInArrow(begin, BLOCK), "codes")
    for k in range(rounds):
        sums, counts = (_added(blocks, c) for c in ("sums", "counts"))
        new = book.moved(sums.reshape(parts, size, width), counts.reshape(parts, size))
        last = k == rounds - 1
        found = materialize(blocks.mapInArrow(turn(book, new, last), "vec_id long, label string, code string, error long" if last else BLOCK), "coded" if last else "codes")
        discard(blocks)
        blocks, book = found, new
    by_label = blocks.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    return blocks.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(book.digest()).alias("codebooks_sha256"))


def _added(blocks: DataFrame, column: str) -> np.ndarray:
    """Sums of an array column by place, as Python integers: as many as a codebook has numbers."""
    got = blocks.select(F.posexplode(column).alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    out = np.zeros(len(got), object)
    for r in got:
        out[r["at"]] = int(r["v"])
    return out
