"""Exact largest inner products by an index of pivot distances: sorted annuli around pivots, expanded until the triangle inequality ends a search."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carrierscan.llm.common import discard, materialize, partitions, released
from carrierscan.llm.vectors import integer_rows, matrix, products, width_of

SCALE, NEAREST = 64, 20
#: Pivots are so many rows, and the square root of the rows below that.
MOST_PIVOTS = 2048
#: Rows of a run of the sorted index, its bytes, and how many chunks of runs the driver lists (40 bytes each).
MOST_RUN_ROWS, LEAST_RUN_ROWS, RUN_BYTES, MOST_CHUNKS = 8192, 256, 4 << 20, 1 << 16
#: Queries that meet a run together, and those whose products are held at once.
QUERY_ROWS, QUERY_GROUP = 4096, 256
#: How many chunks a query has met at the end of each round but the last, which takes all that the bounds leave.
ROUNDS = (2, 16)
#: Relative room for rounding in distances.
ROOM = 1e-9
RUN = "piece long, cells array<int>, lows array<double>, highs array<double>, counts array<int>, away array<double>, rows array<long>, ids array<long>, x array<int>"
FOUND = "query long, query_id long, row long, vec_id long, score long"


@dataclass(frozen=True)
class Pivots:
    """``points`` are vectors; ``lifts`` their last coordinates, which bring every vector to the norm ``top`` (squared), so that the nearest vector has the largest inner product."""

    points: np.ndarray
    top: int

    def lifts(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.top - (x * x).sum(axis=1)).astype(np.float64))

    def away(self, x: np.ndarray, lifts: np.ndarray) -> np.ndarray:
        """Distances of rows to all pivots."""
        flat = (x * x).sum(axis=1)[:, None] - 2 * products(x, self.points) + (self.points * self.points).sum(axis=1)
        return np.sqrt(flat + (lifts[:, None] - self.lifts(self.points)) ** 2)

    def reach(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance from queries (of last coordinate 0) within which vectors have at least ``score``, with room."""
        norms = (x * x).sum(axis=1)
        found = np.sqrt(np.maximum(0.0, norms + float(self.top) - 2.0 * score))
        return found + ROOM * (found + np.sqrt(norms.astype(np.float64)) + math.sqrt(self.top) + 1)


@dataclass(frozen=True)
class Annuli:
    """Every (chunk, cell) of the index: the chunk, the pivot, the least and largest distance to it, and the rows."""

    chunk: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    count: np.ndarray

    def bounds(self, away: np.ndarray) -> np.ndarray:
        """Of each query (rows of ``away``) and annulus, a distance below which none of its vectors is: the shell's, or half of how much nearer the query is to another pivot."""
        own = away[:, self.cell]
        return np.maximum(np.maximum(own - self.high, self.low - own), (own - away.min(axis=1, keepdims=True)) / 2)


def _runs(rows: int, width: int, run_rows: int | None) -> tuple[int, int]:
    """Rows of a run, and runs of a chunk."""
    size = run_rows or min(MOST_RUN_ROWS, max(LEAST_RUN_ROWS, rows // 64), max(1, RUN_BYTES // (4 * width)))
    return size, -(-rows // (size * MOST_CHUNKS))


def best(scores: np.ndarray, query: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores of each query, ties to the smaller ``tie``."""
    order = np.lexsort((tie, -scores, query))
    rank = np.arange(len(order)) - np.searchsorted(query[order], query[order], "left")
    return order[rank < k]


def search_run(x: np.ndarray, cells: np.ndarray, counts: np.ndarray, away: np.ndarray, rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, least: np.ndarray, pivots: Pivots, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query place, row place, score`` of rows of one run that may be among the ``k`` best of ``queries``; ``least`` are scores already reached by ``k`` rows.

    Cells are taken one after the other; in each, a query's window around its own distance to the pivot is as wide as the best score so far allows.
    """
    lines = pivots.away(queries, np.zeros(len(queries)))
    nearest, least = lines.min(axis=1), least.copy()
    none = np.iinfo(np.int64).min
    hit, place, score = (np.zeros(0, np.int64) for _ in range(3))
    ends = np.cumsum(counts)
    tie = np.empty(len(ids), np.int64)
    tie[np.lexsort((rows, ids))] = np.arange(len(ids))
    for cell, end, n in zip(cells, ends, counts, strict=True):
        reach = np.where(least == none, np.inf, pivots.reach(queries, np.maximum(least, -(1 << 62))))
        line, ring = lines[:, cell], away[end - n : end]
        low = end - n + np.searchsorted(ring, line - reach, "left")
        high = end - n + np.searchsorted(ring, line + reach, "right")
        live = np.flatnonzero((low < high) & ((line - nearest) / 2 <= reach))
        if not len(live):
            continue
        a, b = low[live].min(), high[live].max()
        got = products(queries[live], x[a:b])
        got[own[live][:, None] == rows[a:b]] = none
        floor = least[live]
        if b - a > k:
            floor = np.maximum(floor, np.partition(got, b - a - k, axis=1)[:, b - a - k])
        at, col = np.nonzero((got >= floor[:, None]) & (got != none))
        hit, place, score = np.concatenate([hit, live[at]]), np.concatenate([place, col + a]), np.concatenate([score, got[at, col]])
        keep = best(score, hit, tie[place], k)
        hit, place, score = hit[keep], place[keep], score[keep]
        number = np.bincount(hit, minlength=len(queries))
        full = np.flatnonzero(number >= k)
        least[full] = np.maximum(least[full], score[np.cumsum(number)[full] - 1])
    return hit, place, score


class PivotIndex:
    """The index of one table's vectors: runs sorted by nearest pivot and distance, and the list of annuli."""

    def __init__(self, rows: DataFrame, width: int, most_pivots: int = MOST_PIVOTS, run_rows: int | None = None):
        spark = rows.sparkSession
        size = F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v.cast("long") * v)
        n, top = rows.agg(F.count("*"), F.max(size)).head()
        count = max(1, min(most_pivots, math.isqrt(max(n, 1))))
        sample = rows.orderBy(F.xxhash64("row"), "row").limit(2 * count).select("x").collect()
        points = np.unique(np.array([r["x"] for r in sample], np.int64).reshape(-1, width), axis=0)
        self.rows, self.width = n, width
        self.pivots = Pivots(points[:: max(1, len(points) // count)][:count], int(top or 0))
        self.shared: Broadcast[Pivots] = spark.sparkContext.broadcast(self.pivots)
        self.run_rows, self.span = _runs(n, width, run_rows)
        self.runs = materialize(self._sorted(rows), "annuli")
        chunk = F.floor(F.col("piece") / self.span).alias("chunk")
        ring = F.explode(F.arrays_zip("cells", "lows", "highs", "counts")).alias("r")
        listed = self.runs.select(chunk, ring).groupBy("chunk", F.col("r.cells").alias("cell")).agg(F.min("r.lows").alias("low"), F.max("r.highs").alias("high"), F.sum("r.counts").alias("count"))
        got = listed.orderBy("chunk", "cell").toArrow()
        self.annuli = Annuli(*(got.column(c).to_numpy() for c in ("chunk", "cell", "low", "high", "count")))

    def _sorted(self, rows: DataFrame) -> DataFrame:
        shared, width, run_rows = self.shared, self.width, self.run_rows

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    x = matrix(part.column(2), width)
                    lines = pivots.away(x, pivots.lifts(x))
                    cell = lines.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(lines[np.arange(len(x)), cell]), *part.columns], names=["cell", "away", "row", "id", "x"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            first, held, waiting = TaskContext.get().partitionId() << 32, [], 0
            for batch in batches:
                at = 0
                while at < batch.num_rows:
                    part = batch.slice(at, run_rows - waiting)
                    held.append(part)
                    waiting += part.num_rows
                    at += part.num_rows
                    if waiting == run_rows:
                        yield _run(pa.Table.from_batches(held), first)
                        first, held, waiting = first + 1, [], 0
            if waiting:
                yield _run(pa.Table.from_batches(held), first)

        parts = max(1, min(-(-self.rows // run_rows), 4 * partitions(rows.sparkSession)))
        placed = rows.select("row", "id", "x").mapInArrow(place, "cell int, away double, row long, id long, x array<int>")
        runs = placed.repartitionByRange(parts, "cell", "away", "row").sortWithinPartitions("cell", "away", "row").mapInArrow(cut, RUN)
        return runs

    def routed(self, queries: DataFrame, begin: int, end: int | None) -> DataFrame:
        """``query, query_id, x, least, chunk, part``: the chunks that each query meets in a round, from place ``begin`` to ``end`` in the order of their bounds.

        The first places reach until more rows than any query wants are met. Chunks whose bound is beyond the reach of ``least`` are left out.
        """
        spark = queries.sparkSession
        shared, width, cuts = self.shared, self.width, spark.sparkContext.broadcast(self.annuli)

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, annuli = shared.value, cuts.value
            chunks, start = np.unique(annuli.chunk, return_index=True)
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    x, least = matrix(part.column(2), width), part.column(3)
                    bound = np.minimum.reduceat(annuli.bounds(pivots.away(x, np.zeros(len(x)))), start, axis=1)
                    known = least.is_valid().to_numpy(zero_copy_only=False)
                    reach = np.where(known, pivots.reach(x, least.fill_null(0).to_numpy(zero_copy_only=False)), np.inf)
                    order = np.argsort(bound, axis=1, kind="stable")
                    last = bound.shape[1] if end is None else end
                    near = np.take_along_axis(bound, order[:, begin:last], axis=1) <= reach[:, None]
                    query, turn = np.nonzero(near)
                    chosen = chunks[order[query, begin + turn]]
                    yield pa.RecordBatch.from_arrays([*part.take(pa.array(query)).columns, pa.array(chosen.astype(np.int64))], names=["query", "query_id", "x", "least", "chunk"])

        return queries.mapInArrow(route, "query long, query_id long, x array<int>, least long, chunk long")

    def search(self, asked: DataFrame, count: int, k: int) -> DataFrame:
        """``query, query_id, row, vec_id, score`` of the ``k`` best rows but its own for each of ``count`` queries (``row, id, x``)."""
        spark = asked.sparkSession
        shared, width, salts, span = self.shared, self.width, max(1, -(-count // QUERY_ROWS)), self.span

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if left.num_rows and right.num_rows:
                for run in left.to_batches():
                    for i in range(run.num_rows):
                        cells, counts, away, rows, x = (run.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("cells", "counts", "away", "rows", "x"))
                        names = run.column("ids")[i].values
                        ids = names.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                        x = x.astype(np.int64).reshape(-1, width)
                        for at in range(0, right.num_rows, QUERY_GROUP):
                            part = right.slice(at, QUERY_GROUP).combine_chunks()
                            least = part.column("least").fill_null(np.iinfo(np.int64).min).to_numpy()
                            hit, place, score = search_run(x, cells, counts, away, rows, ids, matrix(part.column("x"), width), part.column("query").to_numpy(), least, shared.value, k)
                            out.append((part.column("query").take(pa.array(hit)).combine_chunks(), part.column("query_id").take(pa.array(hit)).combine_chunks(), pa.array(rows[place]), names.take(pa.array(place)), pa.array(score)))
            names = [c.split()[0] for c in FOUND.split(", ")]
            return pa.table({n: pa.chunked_array([o[j] for o in out], pa.int64()) for j, n in enumerate(names)})

        runs = self.runs.select(F.floor(F.col("piece") / span).alias("chunk"), "piece", "cells", "counts", "away", "rows", "ids", "x")
        found, queries, first = None, asked.select(F.col("row").alias("query"), F.col("id").alias("query_id"), "x"), self._first(k)
        ends = sorted({max(first, r) for r in ROUNDS if max(first, r) < len(np.unique(self.annuli.chunk))})
        for begin, end in zip([0, *ends], [*ends, None], strict=True):
            least = found.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("least")) if found else None
            known = queries.join(least, "query", "left") if least else queries.withColumn("least", F.lit(None).cast("long"))
            salt = F.pmod(F.xxhash64("query"), F.lit(salts)).alias("part")
            routed = materialize(self.routed(known.select("query", "query_id", "x", "least"), begin, end).withColumn("part", salt), "routed")
            wanted = routed.select(F.col("chunk").alias("_chunk"), F.col("part").alias("_part")).distinct()
            pieces = F.explode(F.sequence(F.lit(0), F.lit(span - 1))).alias("k") if span > 1 else F.lit(0).alias("k")
            dealt = routed.select("*", pieces)
            left = runs.join(wanted, F.col("chunk") == F.col("_chunk")).select("*", F.pmod("piece", F.lit(span)).cast("int").alias("_k"))
            near = left.groupBy("_chunk", "_k", "_part").cogroup(dealt.groupBy("chunk", "k", "part")).applyInArrow(released(meet), FOUND)
            place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row"))
            kept = (found.unionByName(near) if found else near).withColumn("_place", place).where(F.col("_place") <= k).drop("_place")
            merged = materialize(kept, "found")
            discard(routed, *([found] if found else []))
            found = merged
        return found

    def _first(self, k: int) -> int:
        """So many chunks hold more than ``k`` rows, whichever they are."""
        _, at = np.unique(self.annuli.chunk, return_index=True)
        held = np.sort(np.add.reduceat(self.annuli.count, at))
        return int(np.searchsorted(np.cumsum(held), k + 1)) + 1


def top_products(
    vectors: DataFrame, is_query: Column, k: int = NEAREST, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", most_pivots: int = MOST_PIVOTS, run_rows: int | None = None
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query`` holds, the ``k`` other rows with the largest inner products of ``floor(scale * c)``, exact, ties to the smaller id.

    Every vector is keyed by its nearest pivot (rows of the table, by hash) and its distance to it; runs of the order by that key are the index, so a
    hot vector or pivot is many runs. A query takes the chunks of runs by their bounds, a few first, then those that the triangle inequality leaves within reach of its k-th best, and in a
    run only windows around its own distance to the pivot. Broadcast are pivots and the list of annuli, of bounded number; runs and groups of queries meet in
    tasks of bounded size.

    Rows are told apart by a number of their own: a row that repeats a query's id and vector is a candidate, and repeated queries have rows each. Null ids are candidates, last of a tie, and
    ids that are null for ``is_query`` are no queries. Vectors that are null or hold null or non-finite components take no part; zero and empty vectors do; shorter
    vectors count as if zeros followed; integers beyond ``vectors.magnitude`` (2**27 for 64 components) are held at it. Empty tables give no row.
    """
    width = width_of(vectors, vector_col)
    asks = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row"), F.col(vector_col).alias("v"))
    rows = materialize(integer_rows(asks, {"row": "row", "id": "id", "asks": "asks"}, "v", scale, width), "integers")
    asked = rows.where("asks")
    count = asked.count()
    if not count:
        discard(rows)
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    index = PivotIndex(rows, width, most_pivots, run_rows)
    found = index.search(asked, count, k)
    discard(rows, index.runs)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score")


def _run(table: pa.Table, piece: int) -> pa.RecordBatch:
    """One run as one row: its cells with bounds and counts, and all columns as lists."""
    cell, away = table.column("cell").to_numpy(), table.column("away").to_numpy()
    at = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    counts = np.diff(np.r_[at, len(cell)])
    lists = [pa.array(cell[at]), pa.array(away[at]), pa.array(away[at + counts - 1]), pa.array(counts.astype(np.int32)), pa.array(away), *(table.column(c).combine_chunks() for c in ("row", "id")), table.column("x").combine_chunks().flatten()]
    return pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), *(pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in lists)], names=[c.split()[0] for c in RUN.split(", ")])
