"""Ranks over a whole table, or over groups of any size, without one task for all rows: sorted ranges, their counts, and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carrierscan.shared import write_shared


def ranked(rows: DataFrame, order: list[Column], by: list[str] | None = None, out: str = "rank", count: str | None = None) -> DataFrame:
    """``rows`` with their rank (from 1) in ``order`` among all rows or those that agree in ``by``, and with ``count`` the group's rows.

    Rows are sorted into ranges, ties split by a number of their own, so ranks of ties are theirs in any order. A task numbers its range; the list of ranges by
    group, with as many rows as ranges and groups together, gives each range the rows before it. Nulls in ``by`` are a group.
    """
    by = by or []
    spark = rows.sparkSession
    keys = [F.struct(*[F.col(f"`{c}`") for c in by]).alias("_group")] if by else [F.lit(0).alias("_group")]
    sorted_rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), *keys, F.struct(*[F.when(F.lit(True), c).alias(f"k{i}") for i, c in enumerate(order)]).alias("_order"), F.monotonically_increasing_id().alias("_tie"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = write_shared(sorted_rows.repartitionByRange(parts, "_group", "_order", "_tie").select("*", F.spark_partition_id().alias("_range")), "ranges")
    within = Window.partitionBy("_group", "_range").orderBy("_order", "_tie")
    sizes = spread.groupBy("_group", "_range").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("_group").alias("_g"), F.col("_range").alias("_r"), before.alias("_before"), F.sum("_n").over(whole).alias("_all"))
    numbered = spread.withColumn("_at", F.row_number().over(within)).join(offsets, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    found = [(F.col("_before") + F.col("_at")).alias(out)] + ([F.col("_all").alias(count)] if count else [])
    return numbered.select("_row.*", "_range", *found)


def running_least(rows: DataFrame, value: str, rank: str, by: list[str], out: str) -> DataFrame:
    """The least ``value`` of each row of ``ranked`` and all later ones of its group: within its range, and of the ranges after it."""
    keys = [*by, "_range"]
    # From the last row back: a frame that ends with the group is computed anew for each row, which takes the square of the rows.
    within = Window.partitionBy(*keys).orderBy(F.desc(rank)).rowsBetween(Window.unboundedPreceding, 0)
    least = rows.groupBy(*keys).agg(F.min(value).alias("_least"))
    later = F.min("_least").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1))
    ahead = least.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keys)], later.alias("_later"))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same &= F.col(f"`{c}`").eqNullSafe(F.col(f"_k{i}"))
    return rows.withColumn("_own", F.min(value).over(within)).join(ahead, same).withColumn(out, F.least("_own", "_later")).drop("_own", "_later", *[f"_k{i}" for i in range(len(keys))])


def average_ranks(rows: DataFrame, value: str, by: list[str], out: str = "rank", count: str | None = None) -> DataFrame:
    """``rows`` with their rank (from 1) by ``value`` within ``by``, ties sharing their mean, and with ``count`` the group's rows, those without a value too. Null stays null and takes no rank.

    Only different values are sorted and numbered, each with how often it is there, in ranges as in ``ranked``; rows take their value's rank back by a join. So no task holds a group.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = F.struct(*[F.col(f"`{c}`") for c in by]) if by else F.struct(F.lit(0).alias("all"))
    counts = rows.groupBy(keys.alias("_group"), F.col(f"`{value}`").alias("_value")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_known", F.col("_value").isNotNull())
    spread = write_shared(counts.repartitionByRange(parts, "_group", "_known", "_value").select("*", F.spark_partition_id().alias("_range")), "values")
    sizes = spread.groupBy("_group", "_range").agg(F.coalesce(F.sum(F.when(F.col("_known"), F.col("_n"))), F.lit(0)).alias("_some"), F.sum("_n").alias("_rows"))
    whole = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_some").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("_group").alias("_g"), F.col("_range").alias("_r"), before.alias("_before"), F.sum("_rows").over(whole).alias("_all"))
    upto = F.sum("_n").over(Window.partitionBy("_group", "_range", "_known").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    placed = spread.withColumn("_upto", upto).join(offsets, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    rank = F.when(F.col("_known"), F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2.0)
    found = write_shared(placed.select("_group", "_value", rank.alias("_rank"), "_all"), "value-ranks")
    same = keys.eqNullSafe(F.col("_group")) & F.col(f"`{value}`").eqNullSafe(F.col("_value"))
    return rows.join(found, same).select(*[F.col(f"`{c}`") for c in rows.columns], F.col("_rank").alias(out), *([F.col("_all").alias(count)] if count else []))


def exact_quantile(rows: DataFrame, value: Column, share: float = 0.5, most: int = 10_000) -> float | None:
    """The value at ``share`` of the sorted non-null values (between two, their line), exact: counting probes narrow the range until ``most`` values are left, which the driver sorts. Infinite values count; NaN does not.

    Each round reads the column once and moves a count for each probe; many equal values end the search by themselves.
    """
    known = rows.select(value.cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    n, low, high = known.agg(F.count("x"), F.min("x"), F.max("x")).head()
    if not n:
        return None
    place = (n - 1) * share
    picks = sorted({int(place), min(n - 1, int(place) + 1)})
    found = [_at(known, k, low, high, n, most) for k in picks]
    return found[0] if len(found) == 1 or place == int(place) else found[0] + (found[1] - found[0]) * (place - int(place))


def _at(known: DataFrame, k: int, low: float, high: float, n: int, most: int) -> float:
    """The k-th value (from 0). ``low`` and ``high`` are values, or bounds of them, that include it; ``below`` values are under ``low``."""
    below = 0
    while True:
        if low == high:
            return low
        if n <= most:
            values = sorted(r[0] for r in known.where(F.col("x").between(low, high)).collect())
            return values[k - below]
        span = known.where(F.col("x").between(low, high))
        cuts = sorted({c for c in span.stat.approxQuantile("x", [i / 32 for i in range(1, 32)], 0.005) if low < c < high})
        if not cuts:
            cuts = [low] if span.where(F.col("x") == low).count() + below > k else []
        edges = [low, *cuts, high]
        counts = span.agg(*[F.count(F.when(F.col("x") < e, 1)) for e in edges], *[F.count(F.when(F.col("x") <= e, 1)) for e in edges]).head()
        under, upto = [below + c for c in counts[: len(edges)]], [below + c for c in counts[len(edges) :]]
        for e, a, b in zip(edges, under, upto, strict=True):
            if a <= k < b:
                return e
        i = max(j for j in range(len(edges) - 1) if upto[j] <= k)
        inside = known.where((F.col("x") > edges[i]) & (F.col("x") < edges[i + 1]))
        below = upto[i]
        n, low, high = inside.agg(F.count("x"), F.min("x"), F.max("x")).head()
