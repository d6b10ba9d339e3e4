"""Report tables as DataFrames: the two-cohort table, and what filters leave of each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carrierscan.operators import genotypes, linkage, scans, statistics


def p_text(p: Column) -> Column:
    return F.when(p.isNull(), "-").when(p < 0.001, "<0.001").otherwise(F.format_string("%.3f", p))


def cohort_table(rows: DataFrame, cohort: str, first, second, numeric: list[str], categorical: list[str], labels: dict[str, str] | None = None) -> DataFrame:
    """``place, variable, type, group1_n, group1_stat, group2_n, group2_stat, test, p_value, p_value_fmt``: the laid-out table of two cohorts, categories first.

    Numbers are mean and deviation with Welch's test where neither cohort departs from the normal, else median and quartiles with the rank-sum. A category has a line for each level, its
    test (Fisher's for two levels with a count under five, else chi-square) on the first alone. All variables are one long table, so each step is one job whatever their number. Gaps and rows of other cohorts take no part.
    """
    labels, order = labels or {}, {c: i for i, c in enumerate([*categorical, *numeric])}
    arm = F.when(F.col(cohort) == first, 1).when(F.col(cohort) == second, 0)
    held = rows.withColumn("_arm", arm).where(F.col("_arm").isNotNull())
    name = lambda c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in labels.items()], c) if labels else c
    place = F.coalesce(*[F.when(F.col("variable") == c, F.lit(i)) for c, i in order.items()])
    columns = ["variable", "type", "group1_n", "group1_stat", "group2_n", "group2_stat", "test", "p_value", "p_value_fmt"]
    parts = []
    if categorical:
        long = held.select("_arm", F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in categorical])).alias("v")).select("_arm", "v.*").where("level is not null")
        counts = long.groupBy("variable", "level").agg(F.count(F.when(F.col("_arm") == 1, 1)).alias("n1"), F.count(F.when(F.col("_arm") == 0, 1)).alias("n0"))
        tests = scans.table_p(statistics.table_test(long, "_arm", "level", ["variable"])).select("variable", F.col("test").alias("_test"), F.col("p").alias("_p"))
        whole = Window.partitionBy("variable")
        lines = counts.withColumns({"t1": F.sum("n1").over(whole), "t0": F.sum("n0").over(whole), "line": F.row_number().over(whole.orderBy("level"))}).join(tests, "variable")
        stat = lambda n, t: F.format_string("%d (%.1f%%)", n, F.coalesce(F.try_divide(100.0 * n, t), F.lit(0.0)))
        top = F.col("line") == 1
        parts.append(lines.select(
            place.alias("_place"), F.col("line").cast("long").alias("_line"), F.when(top, name(F.col("variable"))).otherwise(F.concat(name(F.col("variable")), F.lit(" - "), "level")).alias("variable"), F.lit("categorical").alias("type"),
            F.col("t1").alias("group1_n"), stat(F.col("n1"), F.col("t1")).alias("group1_stat"), F.col("t0").alias("group2_n"), stat(F.col("n0"), F.col("t0")).alias("group2_stat"),
            F.when(top, F.when(F.col("_test") == "fisher", "Fisher exact").otherwise("Chi-square")).otherwise("").alias("test"), F.when(top, F.col("_p")).alias("p_value"), F.when(top, p_text(F.col("_p"))).otherwise("").alias("p_value_fmt"),
        ))
    if numeric:
        long = held.select("_arm", F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in numeric])).alias("v")).select("_arm", "v.*").where("value is not null and not isnan(value)")
        tests = scans.numeric_test(long, "value", "_arm", ["variable"]).select("variable", "test", "p")
        sums = statistics.numeric_summary(long, "value", ["variable", "_arm"])
        mean, median = F.format_string("%.2f ± %.2f", "mean", "sd"), F.format_string("%.2f [%.2f-%.2f]", "median", "q1", "q3")
        side = lambda a, g: sums.where(F.col("_arm") == a).select("variable", F.col("n").alias(f"group{g}_n"), mean.alias(f"_mean{g}"), median.alias(f"_median{g}"))
        both = tests.join(side(1, 1), "variable", "left").join(side(0, 2), "variable", "left")
        welch = F.col("test") == "welch"
        parts.append(both.select(
            place.alias("_place"), F.lit(1).cast("long").alias("_line"), name(F.col("variable")).alias("variable"), F.lit("numeric").alias("type"),
            F.coalesce("group1_n", F.lit(0)).alias("group1_n"), F.when(welch, F.col("_mean1")).otherwise(F.col("_median1")).alias("group1_stat"), F.coalesce("group2_n", F.lit(0)).alias("group2_n"),
            F.when(welch, F.col("_mean2")).otherwise(F.col("_median2")).alias("group2_stat"), F.when(welch, "Welch t-test").otherwise("Mann–Whitney U").alias("test"), F.col("p").alias("p_value"), p_text(F.col("p")).alias("p_value_fmt"),
        ))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_place", "_line")).alias("place"), *columns)


def filter_statistics(cells: DataFrame, file: str, excluded: list[str], least_maf: float, window: int = 50, step: int = 5, r2: float = 0.8, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """``file, n_samples_total, n_samples_removed, n_variants_raw, n_variants_after_maf, n_variants_after_pruning`` of each file of cells.

    Samples whose id begins with one of ``excluded`` are removed before frequencies are taken. A file without anything left has zeros.
    """
    named = cells.withColumn("_file", F.col(file))
    gone = F.lit(False)
    for p in excluded:
        gone |= F.startswith(F.col("sample_id").cast("string"), F.lit(p))
    per = named.groupBy("_file").agg(F.countDistinct("sample_id").alias("n_samples_total"), F.countDistinct(F.when(gone, F.col("sample_id"))).alias("n_samples_removed"), F.countDistinct("variant").alias("n_variants_raw"))
    left = genotypes.drop_prefixed_samples(named, excluded)
    p = F.avg("dosage") / 2
    frequent = left.groupBy("_file", "variant").agg(F.least(p, 1 - p).alias("maf")).where(F.col("maf") >= least_maf)
    kept = left.join(frequent.select("_file", "variant"), ["_file", "variant"], "left_semi")
    # A chromosome of one file is pruned by itself.
    pruned = linkage.ld_prune(kept.withColumn("_unit", F.struct("_file", chrom)).drop(chrom), window, step, r2, "_unit", pos)
    out = per.join(frequent.groupBy("_file").agg(F.count(F.lit(1)).alias("n_variants_after_maf")), "_file", "left").join(pruned.groupBy(F.col("_unit._file").alias("_file")).agg(F.count(F.lit(1)).alias("n_variants_after_pruning")), "_file", "left")
    return out.na.fill(0, ["n_variants_after_maf", "n_variants_after_pruning"]).select(F.col("_file").alias("file"), "n_samples_total", "n_samples_removed", "n_variants_raw", "n_variants_after_maf", "n_variants_after_pruning")
