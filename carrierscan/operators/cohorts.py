"""Relational operators over samples, cohorts, results and their states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``, by a window over the key; Spark drops later rows before they move."""
    rest = [c for c in rows.columns if c not in key]
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rank = 1").select(*key, *rest)


def cohort_samples(env: DataFrame, mapping: DataFrame, cohort) -> DataFrame:
    """Samples of one cohort: environment rows with the cohort map's entry."""
    return env.join(mapping, "sample_id", "left").where(F.col("cohort") == cohort)


def resolve_cohort(env: DataFrame, mapping: DataFrame | None, cohort, strict: bool = False) -> DataFrame:
    """The cohort by map, else by a column of the table, else all rows; ``strict`` raises instead of the last."""
    if mapping is not None:
        return cohort_samples(env, mapping, cohort)
    if "cohort" in env.columns:
        return env.where(F.col("cohort") == cohort)
    if strict:
        raise ValueError("no cohort map and no cohort column")
    return env


def with_covariates(samples: DataFrame, pcs: DataFrame, how: str = "left") -> DataFrame:
    """Principal components beside samples; an id that repeats among the components is an error when rows are read."""
    once = pcs.groupBy("sample_id").agg(*[F.first(c).alias(c) for c in pcs.columns if c != "sample_id"], F.count(F.lit(1)).alias("_n"))
    once = once.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("an id repeats among the components"))).otherwise(F.col("_n")))
    return samples.join(once.where("_n >= 1").drop("_n"), "sample_id", how)


def lost_and_kept(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` that an inner join on ``key`` keeps and loses, in one pass."""
    seen = right.select(key).distinct().withColumn("_in", F.lit(1))
    return left.join(seen, key, "left").agg(F.count("_in").alias("kept"), F.count(F.when(F.col("_in").isNull(), 1)).alias("lost"))


def replicated(results: DataFrame, first, second, alpha: float = 0.05) -> DataFrame:
    """Results significant in two cohorts with one sign of the coefficient, side by side."""
    def side(cohort, tag: str) -> DataFrame:
        rows = results.where((F.col("cohort") == cohort) & (F.col("empirical_p") <= alpha))
        return rows.select("variant", "exposure", *[F.col(c).alias(f"{c}_{tag}") for c in ("empirical_p", "obs_coef")])

    both = side(first, "g1").join(side(second, "g2"), ["variant", "exposure"])
    return both.where(F.signum("obs_coef_g1") == F.signum("obs_coef_g2"))


def pending(universe: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return universe.join(done, key, "left_anti")


def restricted(rows: DataFrame, wanted: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with a wanted key, and wanted keys without a row."""
    return rows.join(wanted, key, "left_semi"), wanted.join(rows, key, "left_anti")


def grid(candidates: DataFrame, exposures: DataFrame) -> DataFrame:
    """Every candidate with every exposure; both are lists of names, and the smaller is what repeats."""
    return candidates.crossJoin(exposures)


def point_in_interval(points: DataFrame, intervals: DataFrame, width: int = 100_000, none: str = "NO-GENE") -> DataFrame:
    """Each point (``variant, chrom, pos``) with the first interval (``gene, chrom, start, end``) around it, by start and name.

    An interval that ends no later than one before it is the first around no position. What is left ends ever later, so each is first only behind the end of those before it:
    pieces that do not overlap, however many intervals do. They repeat once for each block of ``width`` that they touch, so that the range join is an equi-join on chromosome and block.
    """
    once = intervals.where("start <= end").groupBy("chrom", "start", "end").agg(F.min("gene").alias("gene"))
    before = F.max("end").over(Window.partitionBy("chrom").orderBy("start", "gene").rowsBetween(Window.unboundedPreceding, -1))
    pieces = once.withColumn("_past", before).where("_past is null or end > _past")
    blocks = F.explode(F.sequence(F.expr(f"greatest(start, _past) div {width}"), F.expr(f"end div {width}")))
    spans = pieces.select("chrom", "gene", "start", "end", "_past", blocks.alias("_block"))
    hit = points.select("variant", "chrom", "pos", F.expr(f"pos div {width}").alias("_block")).join(spans, ["chrom", "_block"]).where("pos between start and end and (_past is null or pos > _past)")
    best = hit.groupBy("variant").agg(F.min(F.struct("start", "gene")).alias("_g")).select("variant", F.col("_g.gene").alias("gene"))
    return points.join(best, "variant", "left").withColumn("gene", F.coalesce("gene", F.lit(none)))


def filled_counts(tested: DataFrame, observed: DataFrame, key: list[str]) -> DataFrame:
    """Tested counts beside observed counts and their variant lists; what is not observed is 0 and empty."""
    return tested.join(observed, key, "left").withColumns({"n_significant": F.coalesce("n_significant", F.lit(0)), "sig_variants": F.coalesce("sig_variants", F.array().cast("array<string>"))})


def latest(batches: DataFrame, key: list[str], version: str) -> DataFrame:
    """The newest row of each key of an append-only results table."""
    rest = [c for c in batches.columns if c not in [*key, version]]
    newest = batches.groupBy(*key).agg(F.max(F.struct(version, *rest)).alias("_r"))
    return newest.select(*key, F.col(f"_r.{version}").alias(version), *[F.col(f"_r.{c}").alias(c) for c in rest])


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows without a new version, and the new rows."""
    return old.join(new, key, "left_anti").unionByName(new)


def duplicated(rows: DataFrame, key: str, group: str) -> DataFrame:
    """Keys that occur in more than one group, with their groups."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(group)).alias("groups")).where(F.size("groups") > 1)


def value_counts(rows: DataFrame, column: str, missing: str = "Unknown") -> DataFrame:
    counts = rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def token_counts(rows: DataFrame, tokens: Column) -> DataFrame:
    return rows.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def attrition(stages: DataFrame) -> DataFrame:
    """Losses of each stage against the one before, and what is left of the first (``stage_no, stage, n``)."""
    order = Window.orderBy("stage_no")
    return stages.withColumns({"dropped": F.coalesce(F.lag("n").over(order) - F.col("n"), F.lit(0)), "pct_of_first": 100.0 * F.col("n") / F.first("n").over(order)})


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts by equal bins of ``[low, high]``; the last bin holds its upper end, values outside have none."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
    return rows.where(F.col(column).between(low, high)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def split_scores(rows: DataFrame, column: str) -> DataFrame:
    """Rows by the sign of their score: positive, zero, missing."""
    return rows.withColumn("part", F.when(F.col(column).isNull(), "missing").when(F.col(column) > 0, "positive").when(F.col(column) == 0, "zero").otherwise("negative"))


def same_batch(pairs: DataFrame, batches: DataFrame) -> DataFrame:
    """Pairs of samples (``id1, id2``) with each one's batch (of ``sample_id, batch``), and whether both are known and equal."""
    first, second = (batches.select(F.col("sample_id").alias(f"id{k}"), F.col("batch").alias(f"batch{k}")) for k in (1, 2))
    return pairs.join(first, "id1", "left").join(second, "id2", "left").withColumn("same_batch", F.coalesce(F.col("batch1") == F.col("batch2"), F.lit(False)))


def relatedness_verdict(pairs: DataFrame, above: float = 0.125, copy: float = 0.9, most_pct: float = 1.0) -> DataFrame:
    """One row: how many pairs have a share of identity (``pi_hat``) over ``above``, how many of those are copies of one sample, and whether a mixed model seems needed."""
    over = F.count(F.when(F.col("pi_hat") > above, 1))
    pct = F.coalesce(F.try_divide(100.0 * over, F.count(F.lit(1))), F.lit(0.0))
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), over.alias("n_above"), F.count(F.when((F.col("pi_hat") > above) & (F.col("pi_hat") <= copy), 1)).alias("n_related"), F.count(F.when(F.col("pi_hat") > copy, 1)).alias("n_copies"), pct.alias("pct_above"), (pct >= most_pct).alias("needs_model"))


def truth_recap(truth: DataFrame, results: DataFrame, key: list[str], p: str, alpha: float = 0.05) -> DataFrame:
    """Every true effect with its result, if any: whether it was tested, and whether it was found at ``alpha``."""
    found = results.select(*key, F.col(p).alias("p"), F.lit(True).alias("_in"))
    return truth.join(found, key, "left").withColumns({"tested": F.coalesce("_in", F.lit(False)), "detected": F.coalesce(F.col("p") <= alpha, F.lit(False))}).drop("_in")


def pooled_means(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``column, mean, n, mode`` of each column; the mode of all is ``binary`` where every known value is 0 or 1 and there is one, else ``continuous``."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("r")).select("r.*")
    means = long.groupBy("column").agg(F.avg("x").alias("mean"), F.count("x").alias("n"), F.count(F.when(~F.col("x").isin(0.0, 1.0), 1)).alias("_other"))
    everything = Window.partitionBy()  # a row for each column name
    binary = (F.sum("_other").over(everything) == 0) & (F.sum("n").over(everything) > 0)
    return means.select("column", "mean", "n", F.when(binary, "binary").otherwise("continuous").alias("mode"))
