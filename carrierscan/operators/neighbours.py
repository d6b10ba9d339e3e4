"""Matching with ties at any group size: rows in blocks along a space-filling order, pairs of blocks pruned by their boxes, and distances in two passes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carrierscan.operators.order import ranked
from carrierscan.shared import write_shared

#: Rows of a block, bits of each feature in the order, and room for rounding beside a k-th distance.
BLOCK_ROWS, ORDER_BITS, TIE = 1024, 10, 1e-9


def _order(features: list[str], bounds) -> Column:
    """The bits of all features' places between their bounds, taken in turns."""
    key = F.lit(0).cast("long")
    bits = min(ORDER_BITS, 60 // len(features))
    cells = []
    for f in features:
        low, high = bounds[f"low_{f}"] or 0.0, bounds[f"high_{f}"] or 0.0
        share = (F.col(f) - F.lit(float(low))) / F.lit(float(high - low) or 1.0)
        cells.append(F.least(F.greatest(F.floor(share * (1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)).cast("long"))
    for b in range(bits - 1, -1, -1):
        for c in cells:
            key = F.shiftleft(key, 1).bitwiseOR(F.shiftright(c, b).bitwiseAND(F.lit(1).cast("long")))
    return key


def _blocks(rows: DataFrame, features: list[str], by: list[str], bounds, name: str, block_rows: int) -> DataFrame:
    """``g, block, ids, x`` with the block's box as ``low`` and ``high``: runs of ``block_rows`` in the order."""
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("_all"))
    known = F.lit(True)
    for f in features:
        known &= F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    held = rows.where(known).select(group.alias("g"), "id", *[F.col(f).cast("double").alias(f) for f in features])
    placed = ranked(held, [_order(features, bounds)], ["g"], "rank").withColumn("block", F.floor((F.col("rank") - 1) / block_rows))
    cell = F.collect_list(F.struct("id", F.array(*features).alias("x")))
    box = [F.array(*[f(c) for c in features]).alias(n) for n, f in (("low", F.min), ("high", F.max))]
    return write_shared(placed.groupBy("g", "block").agg(cell.alias("c"), *box).select("g", "block", F.col("c.id").alias("ids"), F.flatten("c.x").alias("x"), F.size("c").alias("n"), "low", "high"), name)


def nearest_with_ties(base: DataFrame, other: DataFrame, features: list[str], by: list[str], k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``by, id`` of every row of ``other`` within the k-th nearest distance (and 1e-9) of some base row of its group, each id once. With fewer than ``k`` others in a group, all of them.

    Rows of each side lie in blocks of bounded size with a bounding box. For a block of base rows, the boxes' largest distances say within which distance ``k`` others surely are; only blocks
    that may be nearer are met, which includes every tie. Pairs of blocks give each base row's least distances, the k-th of which is the bound of the second pass. Rows with a gap in a feature
    take no part; null groups are a group; repeated ids and rows count as rows.
    """
    both = base.select(*features).unionByName(other.select(*features))
    bounds = both.agg(*[f(F.when(~F.isnan(F.col(c).cast("double")), F.col(c))).alias(f"{n}_{c}") for c in features for n, f in (("low", F.min), ("high", F.max))]).head()
    left, right = _blocks(base, features, by, bounds, "base", block_rows), _blocks(other, features, by, bounds, "other", block_rows)
    width = len(features)

    def apart(near: bool) -> Column:
        gap = F.zip_with(F.zip_with("low", "ohigh", lambda a, b: a - b), F.zip_with("olow", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)) if near else F.greatest(F.abs(a), F.abs(b)))
        return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, d: s + d * d))

    boxes = left.select("g", "block", "low", "high").join(right.select(F.col("g").alias("og"), F.col("block").alias("oblock"), F.col("n"), F.col("low").alias("olow"), F.col("high").alias("ohigh")), F.col("g").eqNullSafe(F.col("og")))
    boxes = boxes.select("g", "block", "oblock", "n", apart(True).alias("near"), apart(False).alias("far"))
    mine = Window.partitionBy("g", "block")
    upto = F.sum("n").over(mine.orderBy("far", "oblock").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sure = F.min(F.when(F.col("upto") >= k, F.col("far"))).over(mine)
    pairs = write_shared(boxes.withColumn("upto", upto).withColumn("sure", F.coalesce(sure, F.lit(float("inf")))).where(F.col("near") <= F.col("sure") + 2 * TIE).select("g", "block", "oblock"), "pairs")
    ours = left.select("g", "block", F.col("x").alias("bx"))
    theirs = right.select(F.col("g").alias("og"), F.col("block").alias("ob"), F.col("ids").alias("oids"), F.col("x").alias("ox"))
    meet = pairs.join(theirs, F.col("g").eqNullSafe(F.col("og")) & (F.col("oblock") == F.col("ob"))).drop("og", "ob")
    group_kind, id_kind = left.schema["g"].dataType.simpleString(), other.schema["id"].dataType.simpleString()

    def distances(a: pa.Array, b: pa.Array, i: int) -> np.ndarray:
        one, two = (c[i].values.to_numpy(zero_copy_only=False).reshape(-1, width) for c in (a, b))
        return np.sqrt(sum((one[:, f, None] - two[None, :, f]) ** 2 for f in range(width)))

    def least(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                d = distances(batch.column("bx"), batch.column("ox"), i)
                few = np.sort(np.partition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else d, axis=1)
                out.append(pa.array(list(few), pa.list_(pa.float64())))
            rows = np.repeat(np.arange(batch.num_rows), [len(o) for o in out])
            at = np.concatenate([np.arange(len(o)) for o in out]) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("g").take(pa.array(rows)), batch.column("block").take(pa.array(rows)), pa.array(at), pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.float64()))], names=["g", "block", "at", "d"])

    arrays = meet.join(ours.withColumnsRenamed({"g": "bg", "block": "bb"}), F.col("g").eqNullSafe(F.col("bg")) & (F.col("block") == F.col("bb"))).select("g", "block", "oblock", "bx", "oids", "ox")
    lists = arrays.select("g", "block", "bx", "ox").mapInArrow(least, f"g {group_kind}, block long, at long, d array<double>")
    each = lists.select("g", "block", "at", F.explode("d").alias("d"))
    place = F.row_number().over(Window.partitionBy("g", "block", "at").orderBy("d"))
    kth = each.withColumn("_r", place).where(F.col("_r") <= k).groupBy("g", "block", "at").agg(F.max("d").alias("kth"))
    reach = kth.groupBy(F.col("g").alias("kg"), F.col("block").alias("kb")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "kth"))), lambda s: s["kth"]).alias("kth"))

    def within(batches):
        for batch in batches:
            groups, ids = [], []
            for i in range(batch.num_rows):
                d = distances(batch.column("bx"), batch.column("ox"), i)
                hit = np.flatnonzero((d <= batch.column("kth")[i].values.to_numpy()[:, None] + TIE).any(axis=0))
                ids.append(batch.column("oids")[i].values.take(pa.array(hit)))
                groups += [i] * len(hit)
            kind = batch.schema.field("oids").type.value_type
            yield pa.RecordBatch.from_arrays([batch.column("g").take(pa.array(groups, pa.int64())), pa.concat_arrays(ids) if ids else pa.array([], kind)], names=["g", "id"])

    final = arrays.join(reach, F.col("g").eqNullSafe(F.col("kg")) & (F.col("block") == F.col("kb"))).select("g", "bx", "oids", "ox", "kth")
    found = final.mapInArrow(within, f"g {group_kind}, id {id_kind}").distinct()
    return found.select(*[F.col(f"g.{c}").alias(c) for c in by], "id")
