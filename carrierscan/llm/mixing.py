"""Mixing sources to target weights by entropy balancing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carrierscan.llm.common import WORD, materialize, salt, spread, whole_row

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """``_key, source_size, target`` of each source.

    ``weights`` repeat over sources by code point, null last. ``share`` of all sizes is dealt by weight; a target stops at ``most``
    times its source's size and the excess is dealt again, which is one water level: sources in order of the level at which they
    fill up, and the first level that its own source does not reach.
    """
    order = Window.orderBy("_key")
    rank = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int"))
    rows = sources.withColumn("_weight", weight).withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    fill = Window.orderBy(F.col("_cap") / F.col("_weight"), "_key")
    everything = Window.partitionBy()
    before = F.sum("_cap").over(fill) - F.col("_cap")
    weight_left = F.sum("_weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_level", (F.lit(float(share)) * F.sum("source_size").over(everything) - before) / weight_left)
    level = F.min(F.when(F.col("_level") <= F.col("_cap") / F.col("_weight"), F.struct(F.col("_cap") / F.col("_weight"), "_key", "_level"))).over(everything)["_level"]
    return rows.select("_key", "source_size", F.when(F.lit(share >= most), F.col("_cap")).otherwise(F.coalesce(F.least("_cap", level * F.col("_weight")), F.col("_cap"))).cast("double").alias("target"))


def _rate(most: float) -> Column:
    """The document rate that the dual gives: an exponential tilt by size, at most ``most``."""
    return F.when(F.col("_full"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.lit(30.0), F.col("_tilt") * F.col("_size") / F.col("_scale")))))


def balance(cells: DataFrame, targets: DataFrame, most: float = MOST_COPIES, tolerance: float = 1e-7, rounds: int = 60) -> DataFrame:
    """The dual's solution: ``_key, source_size, target, _tilt, _scale, _full``.

    Entropy of the rates is largest, subject to each source's sum of rate times size being its target and rates being at most
    ``most``. The convex dual separates by source; each Newton step needs one distributed sum of value and slope
    over ``cells`` (``_key, _size, _n``), and falls back to halving its bracket where the step leaves it.
    """
    some = F.when(F.col("_size") > 0, F.col("_size"))
    shape = cells.groupBy("_key").agg(F.try_divide(F.sum(F.col("_size") * F.col("_n")).cast("double"), F.sum(F.when(F.col("_size") > 0, F.col("_n"))).cast("double")).alias("_scale"), F.min(some).alias("_least"))
    ratio = F.log(F.try_divide("target", F.col("source_size").cast("double")))
    state = materialize(
        targets.join(shape, "_key")
        .withColumn("_scale", F.coalesce("_scale", F.lit(1.0)))
        .withColumn("_full", (F.col("source_size") <= 0) | (F.col("target") >= F.lit(most * (1 - 1e-12)) * F.col("source_size")))
        .withColumn("_steep", F.col("_scale") / F.coalesce("_least", F.lit(1)))
        .withColumns({"_low": F.coalesce(F.least(F.lit(0.0), ratio) * F.col("_steep"), F.lit(0.0)) - 1, "_high": F.lit(1.0) + F.log(F.lit(float(most))) * F.col("_steep"), "_tilt": F.coalesce(ratio, F.lit(0.0)), "_error": F.lit(1.0)})
        .select("_key", "source_size", "target", "_scale", "_full", "_low", "_high", "_tilt", F.when(F.col("_full"), 0.0).otherwise(F.col("_error")).alias("_error")),
        "dual",
    )
    for _ in range(rounds):
        if not state.where(F.col("_error") > tolerance).head(1):
            break
        got = F.col("_n") * F.col("_size") * F.col("_r")
        sums = (
            cells.join(state.where(~F.col("_full")), "_key")
            .withColumn("_r", _rate(most))
            .groupBy("_key")
            .agg(F.sum(got).alias("_value"), F.sum(F.when(F.col("_r") < most, got * F.col("_size") / F.col("_scale")).otherwise(0.0)).alias("_slope"))
        )
        off = F.col("_value") - F.col("target")
        low, high = F.when(off <= 0, F.col("_tilt")).otherwise(F.col("_low")), F.when(off > 0, F.col("_tilt")).otherwise(F.col("_high"))
        step = F.col("_tilt") - F.try_divide(off, F.col("_slope"))
        state = materialize(
            state.join(sums, "_key", "left")
            .withColumns({"_low": F.when(off.isNull(), F.col("_low")).otherwise(low), "_high": F.when(off.isNull(), F.col("_high")).otherwise(high), "_step": step, "_error": F.coalesce(F.try_divide(F.abs(off), F.col("target")), F.lit(0.0))})
            .withColumn("_tilt", F.when(F.col("_error") <= tolerance, F.col("_tilt")).when((F.col("_step") > F.col("_low")) & (F.col("_step") < F.col("_high")), F.col("_step")).otherwise((F.col("_low") + F.col("_high")) / 2))
            .select(*state.columns),
            "dual",
        )
    return state


def _settle(cells: DataFrame, most: int, rounds: int) -> DataFrame:
    """Add or take copies of one size per source and round: of the size that leaves the least of what the source still lacks."""
    for _ in range(rounds):
        lack = cells.groupBy("_key").agg((F.first("target") - F.sum(F.col("_take") * F.col("_size"))).alias("_lack"))
        rows = cells.join(lack, "_key")
        room = F.when(F.col("_lack") > 0, most * F.col("_n") - F.col("_take")).otherwise(F.col("_take"))
        times = F.least(room, F.round(F.abs("_lack") / F.greatest("_size", F.lit(1))).cast("long"))
        left = F.abs(F.abs("_lack") - times * F.col("_size"))
        best = rows.where((F.col("_size") > 0) & (times > 0)).groupBy("_key").agg(F.min(F.struct(left, F.col("_size").alias("s"), (times * F.signum("_lack")).cast("long").alias("d"))).alias("_best"))
        hit = F.coalesce(F.when(F.col("_best.s") == F.col("_size"), F.col("_best.d")), F.lit(0))
        cells = materialize(rows.join(best, "_key", "left").withColumn("_take", F.col("_take") + hit).select(*cells.columns), "cells")
    return cells


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, settle: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """All rows and columns of ``docs`` with ``size, source_size, target, copies``.

    ``size`` counts the words of the text (null: 0). Rates are one for equal sizes of a source, so they are solved on counts of
    (source, size). Whole copies come from the rates by systematic rounding along the sizes: running sums of rates are rounded, which
    keeps the words of any run of sizes within one document of what the rates ask for; then copies of up to ``settle`` sizes
    per source make up what is left. Within a cell, ranks from salted windows say who gets the odd copy, by id.
    Null sources are one source, last in order; empty texts take part with size 0 and their rate's copies; an empty table gives
    an empty result; repeated rows are separate rows and null ids are ids like others. Columns named like the added ones, in upper or lower case, are replaced; any other names are kept.
    """
    spark = docs.sparkSession
    salts = spread(spark, docs.count())
    key = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(whole_row(docs, ("size", "source_size", "target", "copies")), F.col(id_col).alias("_id"), size.alias("_size"), key.alias("_key"), salt(F.col(id_col), salts).alias("_salt"))
    grains = materialize(rows.groupBy("_key", "_size", "_salt").agg(F.count(F.lit(1)).alias("_n")), "grains")
    cells = materialize(grains.groupBy("_key", "_size").agg(F.sum("_n").alias("_n")), "cells")
    targets = source_targets(cells.groupBy("_key").agg(F.sum(F.col("_n") * F.col("_size")).alias("source_size")), weights, share, most)
    dual = balance(cells, targets, most)
    run = Window.partitionBy("_key").orderBy("_size")
    expected = F.sum(F.col("_n") * F.col("_r")).over(run)
    rated = cells.join(dual, "_key").withColumn("_r", _rate(most)).withColumn("_upto", F.floor(expected + 0.5))
    rated = rated.withColumn("_take", F.col("_upto") - F.coalesce(F.lag("_upto").over(run), F.lit(0)))
    taken = _settle(materialize(rated.select("_key", "_size", "_n", "source_size", "target", "_take"), "cells"), most, settle)
    before = F.sum("_n").over(Window.partitionBy("_key", "_size").orderBy("_salt")) - F.col("_n")
    plan = (
        grains.withColumn("_before", before)
        .join(taken.select("_key", "_size", "source_size", "target", F.col("_n").alias("_all"), "_take"), ["_key", "_size"])
        .select("_key", "_size", "_salt", "source_size", "target", "_before", F.floor(F.col("_take") / F.col("_all")).alias("_each"), F.expr("_take % _all").alias("_odd"))
    )
    within = Window.partitionBy("_key", "_size", "_salt").orderBy("_id")
    return (
        rows.withColumn("_row", F.row_number().over(within))
        .join(plan, ["_key", "_size", "_salt"])
        .select("_all.*", F.col("_size").alias("size"), "source_size", "target", (F.col("_each") + F.when(F.col("_before") + F.col("_row") <= F.col("_odd"), 1).otherwise(0)).cast("int").alias("copies"))
    )
