"""Shards of near equal bytes by histogram sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carrierscan.llm.common import materialize, partitions, salt, whole_row

#: Low bits of a sort key that tell documents with equal texts apart.
LOW = 24
#: Rows that agree in text and id are told apart by a number where together they are more than this share of a shard: under a hundred keys for each shard.
REPEATED = 0.01
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def bytes_below(keyed: DataFrame, probes: list[int]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows with a key below each of the sorted ``probes``, counted across partitions."""
    at = np.array(probes, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(at) + 1, np.int64), np.zeros(len(at) + 1, np.int64)
        for batch in batches:
            slot = np.searchsorted(at, batch.column(0).to_numpy(), "right")
            np.add.at(size, slot, batch.column(1).to_numpy())
            rows += np.bincount(slot, minlength=len(rows))
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(size[some]), pa.array(rows[some])], names=["slot", "size", "rows"])

    got = keyed.select("_key", "_size").mapInArrow(count, "slot long, size long, rows long").groupBy("slot").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).collect()
    size, rows = [0] * (len(probes) + 1), [0] * (len(probes) + 1)
    for r in got:
        size[r["slot"]], rows[r["slot"]] = r["size"], r["rows"]
    return np.cumsum(size).tolist(), np.cumsum(rows).tolist()


def splitters(keyed: DataFrame, shards: int, tolerance: float = 0.001, edge: float = 0.01, probes: int = 64) -> list[int]:
    """Keys that cut ``keyed`` (``_key, _size``) into ``shards`` of near equal bytes.

    Each round counts the exact bytes below ``probes`` candidates between the bounds of every splitter that is not
    yet within ``tolerance`` of a shard's mean size, and narrows its bounds to two neighbouring candidates; a splitter also ends
    when one row or one key is left between its bounds. A boundary inside a group of equal texts moves to the group's edge
    if that stays within ``edge`` of the mean size.
    """
    total, _ = bytes_below(keyed, [MOST])
    total = total[-1]
    mean = total / shards
    goals = [mean * (i + 1) for i in range(shards - 1)]
    # of each splitter: lower key, bytes and rows below it; upper key, bytes and rows below it
    lo, hi = [(LEAST, 0, 0)] * len(goals), [(MOST, total, 1 << 62)] * len(goals)
    done: list[tuple[int, int] | None] = [None if total else (MOST, 0)] * len(goals)
    first = True
    while not all(done):
        at: set[int] = set()
        for i, end in enumerate(done):
            if not end:
                a, b = lo[i][0], hi[i][0]
                n = min(probes * (16 if first else 1), b - a - 1)
                at |= {a + (b - a) * (j + 1) // (n + 1) for j in range(n)}
        first = False
        keys = sorted(at)
        size, rows = bytes_below(keyed, keys)
        for i, goal in enumerate(goals):
            if done[i]:
                continue
            for k, s, r in zip(keys, size, rows, strict=False):
                if lo[i][0] < k < hi[i][0]:
                    if s <= goal:
                        lo[i] = (k, s, r)
                    else:
                        hi[i] = (k, s, r)
                        break
            near = min((lo[i], hi[i]), key=lambda x: abs(x[1] - goal))
            if abs(near[1] - goal) <= tolerance * mean or hi[i][2] - lo[i][2] <= 1 or hi[i][0] - lo[i][0] <= 1:
                done[i] = (near[0], near[1])
    found = [x[0] for x in done]
    if total and found:
        edges = sorted({min(max(LEAST, ((k >> LOW) + up) << LOW), MOST) for k in found for up in (0, 1)})
        size, _ = bytes_below(keyed, edges)
        below = dict(zip(edges, size, strict=False))
        for i, (k, goal) in enumerate(zip(found, goals, strict=True)):
            best = min((e for e in edges if e >> LOW in (k >> LOW, (k >> LOW) + 1) or e == MOST), key=lambda e: abs(below[e] - goal))
            if abs(below[best] - goal) <= edge * mean:
                found[i] = best
    return sorted(found)


def shard_documents(docs: DataFrame, shards: int = 24, tolerance: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with ``size, shard, slot``; shards have near equal bytes.

    ``size`` is the text's UTF-8 bytes (null: none) plus 8. The sort key is the text's hash, then the id's, so
    copies are neighbours and a large group of copies can still be cut. Keys and sizes alone are probed; whole rows move
    once, by shard and salt. Slots are gapless from 0. Rows that agree in id and text have one key and stay together, unless they are many: then a number of their own tells them apart.
    An empty table gives an empty result. Null ids are ids like others. Columns named ``size, shard, slot`` in upper or lower case are replaced; any other names are kept.
    """
    spark = docs.sparkSession
    low = (1 << LOW) - 1
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64(F.col(id_col)).bitwiseAND(F.lit(low)))
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8
    rows = docs.select(whole_row(docs, ("size", "shard", "slot")), F.col(id_col).alias("_id"), key.alias("_key"), size.alias("_size"))
    keyed = materialize(rows.select("_key", "_size"), "keys")
    heavy = [r["_key"] for r in keyed.groupBy("_key").agg(F.sum("_size").alias("n"), F.count(F.lit(1)).alias("k")).where("k > 1").join(keyed.agg(F.sum("_size").alias("all"))).where(F.col("n") > F.col("all") * (REPEATED / shards)).select("_key").collect()]
    if heavy:
        # Written once, so that all passes see the same numbers.
        own = F.col("_key").bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit(low)))
        repeats = materialize(rows.where(F.col("_key").isin(heavy)).withColumn("_key", own), "repeated")
        rows = rows.where(~F.col("_key").isin(heavy)).unionByName(repeats)
        keyed = materialize(rows.select("_key", "_size"), "keys")
    cuts = splitters(keyed, shards, tolerance)
    salts = max(-(-4 * partitions(spark) // shards), -(-keyed.count() // (shards * 200_000)))
    placed = {"shard": F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: F.col("_key") >= cut)) if cuts else F.lit(0), "_salt": salt(F.col("_key"), salts)}
    counts = materialize(keyed.withColumns(placed).groupBy("shard", "_salt").agg(F.count(F.lit(1)).alias("_n")), "slots")
    base = counts.select("shard", "_salt", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_salt")) - F.col("_n")).alias("_base"))
    within = Window.partitionBy("shard", "_salt").orderBy("_key", "_id")
    return (
        rows.withColumns(placed)
        .withColumn("_row", F.row_number().over(within))
        .join(base, ["shard", "_salt"])
        .select("_all.*", F.col("_size").alias("size"), "shard", (F.col("_base") + F.col("_row") - 1).alias("slot"))
    )
