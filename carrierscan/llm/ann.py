"""Nearest neighbours by collision-counting hashing over sorted single projections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carrierscan.llm.common import materialize

NEAREST = 20
PROJECTIONS = 64
#: Windows reach so many times the distance of the k-th vector found, when a search ends.
REACH = 1.1
#: Collisions, as a share of the projections, that make a vector a candidate.
THRESHOLD = 0.7
#: Growth of the windows in each round, and their first half width in standard deviations of the projections.
GROWTH, FIRST_WIDTH = 1.25, 0.75
BLOCK_ROWS, QUERY_ROWS = 32768, 8192
#: Each sorted array is cut at so many places, to which windows are rounded outwards, and queries that are counted at once.
STEPS, GROUP = 128, 8
SEED = 20


def directions(width: int, count: int, seed: int) -> np.ndarray:
    """``count`` random directions as columns, orthogonal to each other as far as ``width`` allows, on which a step of length d has standard deviation d."""
    random = np.random.default_rng(seed)
    parts = [np.linalg.qr(random.standard_normal((width, width)))[0] for _ in range(-(-count // width))]
    return np.concatenate(parts, axis=1)[:, :count] * np.sqrt(width)


def at_least(sets: np.ndarray, need: int) -> np.ndarray:
    """Bitmap of the members of at least ``need`` of the bitmaps along the last axis but one.

    Counts are kept as bit planes: three bitmaps of one weight become a sum of that weight and a carry of twice the weight.
    """
    enough, left = ~np.zeros_like(sets[..., 0, :]), need
    while True:
        carries = []
        while (n := sets.shape[-2]) > 1:
            k = max(1, n // 3)
            x, y = sets[..., :k, :], sets[..., k : 2 * k, :]
            half, carry = x ^ y, x & y
            if n > 2:
                z = sets[..., 2 * k : 3 * k, :]
                carry |= half & z
                half ^= z
            carries.append(carry)
            sets = np.concatenate([half, sets[..., 3 * k :, :]], axis=-2) if n > 3 * k else half
        plane = sets[..., 0, :]
        enough = plane & enough if left & 1 else plane | enough
        left >>= 1
        if not carries:
            return enough if not left else np.zeros_like(enough)
        sets = np.concatenate(carries, axis=-2)


class CollisionIndex:
    """Sorted arrays of the projections of one block of vectors, and the sets of rows that come before each cut of an array, as bitmaps.

    Inner products become distances by one more coordinate, which lifts every vector to the largest norm ``top``; queries have 0 there.
    """

    def __init__(self, vectors: np.ndarray, top: float, projections: int = PROJECTIONS, seed: int = SEED):
        self.vectors, self.top, n = vectors, top, len(vectors)
        self.lines = directions(vectors.shape[1] + 1, projections, seed)
        lift = np.sqrt(np.maximum(0.0, top * top - (vectors * vectors).sum(axis=1)))
        values = (vectors @ self.lines[:-1] + lift[:, None] * self.lines[-1]).T
        self.spread = float(values.std(axis=1).mean())
        order = np.argsort(values, axis=1)
        self.sorted = np.take_along_axis(values, order, axis=1)
        self.step, words = -(-n // STEPS), -(-n // 64)
        cuts = -(-n // self.step)
        self.before = np.zeros((projections, cuts + 1, words), np.uint64)
        for line, rows in zip(self.before, order, strict=True):
            member = np.zeros((cuts + 1, words * 64), bool)
            member[np.arange(n) // self.step + 1, rows] = True
            np.bitwise_or.accumulate(np.packbits(member, axis=1, bitorder="little").view(np.uint64), axis=0, out=line)
        self.verified = 0

    def _windows(self, places: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and last cut of each query's window on each line."""
        low, high = (np.stack([line.searchsorted(p, side) for line, p in zip(self.sorted, (places + sign * width[:, None]).T, strict=True)], axis=1) for sign, side in ((-1, "left"), (1, "right")))
        return low // self.step, -(-high // self.step)

    def search(self, queries: np.ndarray, own: list[np.ndarray], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ``k`` nearest rows found and their inner products, ties to the smaller row; rows in ``own`` take no part.

        Query-centred windows grow by virtual rehashing: each round widens every projection's window. A row that is in
        enough windows and was not before is verified against the vectors at once. A search ends when
        the windows reach far enough for the k-th best distance found, or hold everything; they are never made wider than that.
        """
        n, m = len(self.vectors), len(self.sorted)
        need = max(1, int(np.ceil(THRESHOLD * m)))
        places, norms = queries @ self.lines[:-1], (queries * queries).sum(axis=1)
        want = np.minimum(k, n - np.array([len(hidden) for hidden in own], np.int64))
        fresh = np.tile(self.before[0, -1], (len(queries), 1))
        for row, hidden in zip(fresh, own, strict=True):
            np.bitwise_and.at(row, hidden >> 6, ~(np.uint64(1) << (hidden & 63).astype(np.uint64)))
        found = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        width = np.full(len(queries), max(FIRST_WIDTH * self.spread, 1e-9))
        active = np.flatnonzero(want)
        line = np.arange(m)
        while len(active):
            low, high = self._windows(places[active], width[active])
            done = ((high - low) * self.step >= n).all(axis=1)
            for at in range(0, len(active), GROUP):
                part = slice(at, at + GROUP)
                hits = at_least(self.before[line, high[part]] ^ self.before[line, low[part]], need) & fresh[active[part]]
                fresh[active[part]] ^= hits
                for i, bits in zip(range(at, at + len(hits)), np.unpackbits(hits.view(np.uint8), axis=1, bitorder="little"), strict=True):
                    q = active[i]
                    new = np.flatnonzero(bits)
                    self.verified += len(new)
                    rows, scores = np.concatenate([found[q][0], new]), np.concatenate([found[q][1], (self.vectors[new] * queries[q]).sum(axis=1)])
                    best = np.lexsort((rows, -scores))[:k]
                    found[q] = rows[best], scores[best]
                    enough = np.inf
                    if len(best) >= want[q]:
                        enough = REACH * np.sqrt(max(0.0, norms[q] + self.top**2 - 2 * scores[best[want[q] - 1]]))
                    done[i] |= width[q] >= enough
                    width[q] = min(width[q] * GROWTH, enough)
            active = active[~done]
        return found


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Different (id, vector) rows whose vector has only finite components, not all of them zero."""
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"))
    return rows.where(F.col("id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0.0), F.lit(False))).dropDuplicates(["id", "v"])


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, projections: int = PROJECTIONS, seed: int = SEED
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products found for each query, ties to the smaller id.

    Vectors go to blocks by hash and queries to blocks too; each pair of blocks is one task, which sorts the block's projections
    (a small part of the work beside thousands of queries) and searches them, and its ``k`` best for each query are merged by query. Every vector is indexed; nothing is broadcast but the
    largest norm. A query never finds rows with its own id. Vectors null, zero or with null or non-finite
    components take no part; rows that agree in id and vector count once; a query meets vectors of its own length. Equal vectors have equal scores.
    """
    rows, asked = materialize(_usable(vectors, id_col, vector_col), "vectors"), materialize(_usable(queries, id_col, vector_col), "queries")
    n, q = rows.count(), asked.count()
    top = float(rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).head()[0] or 0.0)
    blocks, parts = max(1, -(-n // block_rows)), max(1, -(-q // query_rows))
    keys = ["_n", "_d", "_q"]

    def dealt(df: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
        block = F.pmod(F.xxhash64("id", "v"), F.lit(count)).cast("int")
        return df.select("id", "v", F.size("v").alias("_n"), block.alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)).groupBy(*keys)

    def array(table: pa.Table) -> np.ndarray:
        return table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("id")
        ids, asks = left.column("id").to_numpy(), right.column("id").to_numpy()
        found: list[tuple] = []
        if len(ids) and len(asks):
            own = [np.arange(a, b) for a, b in zip(*(np.searchsorted(ids, asks, side) for side in ("left", "right")), strict=True)]
            for ask, (hit, score) in zip(asks, CollisionIndex(array(left), top, projections, seed).search(array(right), own, k), strict=True):
                found.append((np.full(len(hit), ask), ids[hit], score))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    local = dealt(rows, "_d", blocks, "_q", parts).cogroup(dealt(asked, "_q", parts, "_d", blocks)).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
