"""Estimators that built-in aggregates and windows express; none of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carrierscan.functions import expressions as X
from carrierscan.operators import order

#: Fixed value: the median of chi-square with one degree of freedom.
CHI2_MEDIAN = 0.4549364
#: Levels of a text column that become columns of their own at most.
MOST_LEVELS = 1000


def balance(rows: DataFrame, arm: str, covariates: list[str], by: list[str]) -> DataFrame:
    """Standardised mean difference of each covariate between the two arms (1 and 0): absolute difference over pooled sd, 0 where that is 0 or unknown.

    Gaps take their arm's mean; the pooled variance weighs each arm's by its rows less one.
    """
    aggs = []
    for c in covariates:
        for a in (1, 0):
            x = F.when(F.col(arm) == a, F.col(c))
            aggs += [F.avg(x).alias(f"_m{a}_{c}"), (F.var_pop(x) * F.count(x)).alias(f"_s{a}_{c}")]
    n1, n0 = F.count(F.when(F.col(arm) == 1, 1)), F.count(F.when(F.col(arm) == 0, 1))
    out = rows.groupBy(*by).agg(*aggs, F.when((n1 >= 2) & (n0 >= 2), n1 + n0 - 2).alias("_free"))
    smd = {}
    for c in covariates:
        sd = F.sqrt((F.col(f"_s1_{c}") + F.col(f"_s0_{c}")) / F.col("_free"))
        smd[f"smd_{c}"] = F.coalesce(F.when(sd > 0, F.abs(F.col(f"_m1_{c}") - F.col(f"_m0_{c}")) / sd), F.lit(0.0))
    return out.withColumns(smd).select(*by, *smd)


def level_balance(rows: DataFrame, arm: str, column: str, by: list[str]) -> DataFrame:
    """``level, smd`` of each level of a category but the first: the arms' difference in its share over the sd of the pooled share. A gap is the level ``nan``."""
    cells = rows.where(F.col(arm).isin(0, 1)).groupBy(*by, F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("level")).agg(F.count(F.when(F.col(arm) == 1, 1)).alias("_k1"), F.count(F.when(F.col(arm) == 0, 1)).alias("_k0"))
    group = Window.partitionBy(*by)
    n1, n0 = F.sum("_k1").over(group), F.sum("_k0").over(group)
    p1, p0, pooled = F.try_divide("_k1", n1), F.try_divide("_k0", n0), F.try_divide(F.col("_k1") + F.col("_k0"), n1 + n0)
    sd = F.sqrt(pooled * (1 - pooled))
    out = cells.withColumns({"smd": F.coalesce(F.when(sd > 0, F.abs(p1 - p0) / sd), F.lit(0.0)), "_first": F.min("level").over(group)})
    return out.where("level != _first").select(*by, "level", "smd")


def table_test(rows: DataFrame, arm: str, column: str, by: list[str]) -> DataFrame:
    """The descriptive test of a category between arms 1 and 0: ``n_levels, least, test, statistic, dof`` and the cells ``a, b, c, d`` of a two by two table.

    Two levels with a cell under five ask for Fisher's exact test; other tables for chi-square, with Yates' correction for two by two.
    Rows without a level take no part; an empty arm or a single level has a null statistic.
    """
    cells = rows.where(F.col(arm).isin(0, 1) & F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("_level")).agg(F.count(F.when(F.col(arm) == 1, 1)).alias("_k1"), F.count(F.when(F.col(arm) == 0, 1)).alias("_k0"))
    group = Window.partitionBy(*by)
    n, share = F.col("_k1") + F.col("_k0"), F.try_divide(F.sum("_k1").over(group), F.sum(F.col("_k1") + F.col("_k0")).over(group))
    cells = cells.withColumns({"_n": n, "_p": share, "_off": F.abs(F.col("_k1") - n * share)})
    edge = F.struct("_level", "_k1", "_k0")
    table = cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_levels"), F.min(F.least("_k1", "_k0")).alias("least"), F.first("_p").alias("_p"), F.max("_off").alias("_off"),
        F.sum(F.col("_off") * F.col("_off") / F.col("_n")).alias("_sum"), F.sum(1 / F.col("_n")).alias("_inverse"), F.min(edge).alias("_low"), F.max(edge).alias("_high"),
    )
    off = F.greatest(F.col("_off") - 0.5, F.lit(0.0))
    square = F.when(F.col("n_levels") == 2, off * off * F.col("_inverse")).otherwise(F.col("_sum"))
    two = F.col("n_levels") == 2
    found = {
        "test": F.when(two & (F.col("least") < 5), "fisher").otherwise("chi2"),
        "statistic": F.when(F.col("n_levels") > 1, F.try_divide(square, F.col("_p") * (1 - F.col("_p")))),
        "dof": F.col("n_levels") - 1,
        **{name: F.when(two, F.col(at)) for name, at in (("a", "_low._k1"), ("b", "_low._k0"), ("c", "_high._k1"), ("d", "_high._k0"))},
    }
    return table.withColumns(found).select(*by, "n_levels", "least", "test", "statistic", "dof", "a", "b", "c", "d")


def welch_test(rows: DataFrame, value: str, arm: str, by: list[str]) -> DataFrame:
    """``t, df, d`` of the arms' means (1 less 0) with unequal variances; ``d`` is the difference in pooled standard deviations. Null where an arm has under two values or none differ."""
    x = {a: F.when(F.col(arm) == a, F.col(value)) for a in (1, 0)}
    out = rows.groupBy(*by).agg(*[f(x[a]).alias(f"_{name}{a}") for a in (1, 0) for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    n1, n0, v1, v0 = F.col("_n1"), F.col("_n0"), F.col("_v1"), F.col("_v0")
    e1, e0, gap = F.try_divide(v1, n1), F.try_divide(v0, n0), F.col("_m1") - F.col("_m0")
    known = (n1 > 1) & (n0 > 1) & (e1 + e0 > 0)
    pooled = F.sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2))
    found = {"t": gap / F.sqrt(e1 + e0), "df": (e1 + e0) * (e1 + e0) / (e1 * e1 / (n1 - 1) + e0 * e0 / (n0 - 1)), "d": gap / pooled}
    return out.select(*by, n1.alias("n1"), n0.alias("n0"), *[F.when(known, c).alias(k) for k, c in found.items()])


def dummies(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Text columns as one 0/1 column for each level but the first in order, and the new names; a gap has 0 in all. Numeric columns stay. The driver gets the levels' names."""
    kinds = dict(rows.dtypes)
    names: list[str] = []
    for c in columns:
        if kinds[c] != "string":
            names.append(c)
            continue
        levels = sorted(r[0] for r in rows.select(c).where(F.col(c).isNotNull()).distinct().limit(MOST_LEVELS + 1).collect())[1:]
        if len(levels) >= MOST_LEVELS:
            raise ValueError(f"{c} has over {MOST_LEVELS} levels: it is no category")
        rows = rows.withColumns({f"{c}_{x}": F.when(F.col(c) == x, 1.0).otherwise(0.0) for x in levels}).drop(c)
        names += [f"{c}_{x}" for x in levels]
    return rows, names


def genotype_fits(rows: DataFrame, y: str, x: str, dosage: str, by: list[str]) -> DataFrame:
    """Points of a plot: line of ``y`` on ``x`` and quartiles of ``y`` for each rounded dosage."""
    q = F.percentile(y, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.where(F.col(dosage).isNotNull()).groupBy(*by, F.round(dosage).cast("int").alias("genotype")).agg(F.count(y).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), q.alias("_q"))
    return out.select(*by, "genotype", "n", "slope", "intercept", *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(("q1", "median", "q3"))])


def rank_sum(rows: DataFrame, value: str, arm: str, by: list[str]) -> DataFrame:
    """Mann-Whitney U of arm 1 with the rank-biserial effect, the arms' sizes and medians; from average ranks by window.

    ``ties`` is the sum of the cubes less the counts of equal values, and ``z`` the normal score of the larger U with tie and continuity corrections: 0 at least, and where nothing differs.
    """
    known = rows.where(F.col(value).isNotNull() & F.col(arm).isNotNull())
    ranked = known.withColumns({"_rank": X.average_rank(F.col(value), *by), "_same": F.count(F.lit(1)).over(Window.partitionBy(*by, value))})
    one = F.col(arm) == 1
    sums = ranked.groupBy(*by).agg(
        F.count(F.when(one, 1)).alias("n_carrier"), F.count(F.when(~one, 1)).alias("n_noncarrier"), F.median(F.when(one, F.col(value))).alias("median_carrier"), F.median(F.when(~one, F.col(value))).alias("median_noncarrier"), F.sum(F.when(one, F.col("_rank"))).alias("_r1"), F.sum(F.col("_same") * F.col("_same") - 1).alias("ties")
    )
    u = F.col("_r1") - F.col("n_carrier") * (F.col("n_carrier") + 1) / 2.0
    all_pairs, n = (F.col("n_carrier") * F.col("n_noncarrier")).cast("double"), F.col("n_carrier") + F.col("n_noncarrier")
    spread = all_pairs / 12 * (n + 1 - F.try_divide(F.col("ties").cast("double"), (n * (n - 1)).cast("double")))
    score = F.when(all_pairs > 0, F.when(spread > 0, F.greatest(F.lit(0.0), (F.abs(u - all_pairs / 2) - 0.5) / F.sqrt(spread))).otherwise(0.0))
    return sums.withColumns({"u_stat": u, "effect_size": 1 - 2 * u / F.nullif((F.col("n_carrier") * F.col("n_noncarrier")).cast("double"), F.lit(0.0)), "delta_median": F.col("median_carrier") - F.col("median_noncarrier"), "z": score}).drop("_r1")


def onset_summary(rows: DataFrame, value: str, arm: str, by: list[str], least: int = 5, low_power: int = 10) -> DataFrame:
    """``rank_sum`` with statistics null unless both arms have ``least`` rows, and a flag where either has fewer than ``low_power``."""
    return gated_summary(rank_sum(rows, value, arm, by), least, low_power)


def gated_summary(out: DataFrame, least: int, low_power: int) -> DataFrame:
    """Rank-sum rows with the gate on small arms and the flag of low power."""
    enough = (F.col("n_carrier") >= least) & (F.col("n_noncarrier") >= least)
    stats = ("median_carrier", "median_noncarrier", "delta_median", "u_stat", "effect_size", "z")
    return out.withColumns({c: F.when(enough, F.col(c)) for c in stats}).withColumn("low_power", (F.col("n_carrier") < low_power) | (F.col("n_noncarrier") < low_power))


def benjamini_hochberg(rows: DataFrame, p: str, by: list[str], out: str = "fdr") -> DataFrame:
    """Adjusted p-values: the running minimum, from the largest p down, of p times count over rank. Null p stays null.

    Without ``by``, ranks and minima of the whole table come from sorted ranges (see ``order``), else from a window over each group.
    """
    if by:
        known = F.when(F.col(p).isNotNull(), 1)
        w = Window.partitionBy(*by, known)
        # From the largest p down: a frame that ends with the group is computed anew for each row, which takes the square of the rows.
        down = w.orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
        numbered = rows.withColumns({"_at": F.row_number().over(w.orderBy(p)), "_raw": F.count(F.lit(1)).over(w)}).withColumn("_raw", F.col(p) * F.col("_raw") / F.col("_at"))
        return numbered.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_raw").over(down)))).drop("_raw", "_at")
    # Null values are a group of their own, so that they count for no rank.
    ranks = order.ranked(rows.withColumn("_known", F.col(p).isNotNull()), [F.col(p)], ["_known"], "_rank", "_count")
    least = order.running_least(ranks.withColumn("_raw", F.col(p) * F.col("_count") / F.col("_rank")), "_raw", "_rank", ["_known"], "_running")
    return least.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col("_running")))).drop("_known", "_rank", "_count", "_raw", "_running", "_range")


def genomic_control(rows: DataFrame, z: str, by: list[str]) -> DataFrame:
    """Inflation factor and corrected chi-square of each row; a factor of 0 leaves the statistic as it is. Without ``by`` the median is found by counting probes."""
    square = F.col(z) * F.col(z)
    if by:
        factor = F.median(square).over(Window.partitionBy(*by)) / CHI2_MEDIAN
    else:
        median = order.exact_quantile(rows, square)
        factor = F.lit(None if median is None else median / CHI2_MEDIAN).cast("double")
    return rows.withColumn("lambda_gc", factor).withColumn("chi2_gc", F.when(F.col("lambda_gc") > 0, square / F.col("lambda_gc")).otherwise(square))


def inflation(rows: DataFrame, z: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg((F.median(F.col(z) * F.col(z)) / CHI2_MEDIAN).alias("lambda_gc"), F.count(z).alias("n"))


def simple_ols(rows: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def interaction_slope(rows: DataFrame, y: str, arm: str, x: str, by: list[str]) -> DataFrame:
    """Coefficient of arm times exposure without covariates: the difference of the arms' slopes."""
    one, zero = (F.when(F.col(arm) == a, F.col(x)) for a in (1, 0))
    out = rows.groupBy(*by).agg(F.regr_slope(F.col(y), one).alias("slope_carrier"), F.regr_slope(F.col(y), zero).alias("slope_noncarrier"), F.regr_count(F.col(y), one).alias("n_carrier"), F.regr_count(F.col(y), zero).alias("n_noncarrier"))
    return out.withColumn("beta_interaction", F.col("slope_carrier") - F.col("slope_noncarrier"))


def eta_squared(rows: DataFrame, value: str, group: str, by: list[str]) -> DataFrame:
    """Between-group share of the sum of squares, null for fewer than two groups."""
    groups = rows.where(F.col(value).isNotNull()).groupBy(*by, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count(value)).alias("w"))
    total_n, grand = F.sum("n"), F.sum(F.col("n") * F.col("m")) / F.sum("n")
    sums = groups.groupBy(*by).agg(F.count(F.lit(1)).alias("n_groups"), total_n.alias("n"), grand.alias("_g"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("_s"), F.sum("w").alias("_w"))
    between = F.col("_s") - F.col("n") * F.col("_g") * F.col("_g")
    return sums.select(*by, "n_groups", "n", F.when((F.col("n_groups") >= 2) & (between + F.col("_w") > 0), between / (between + F.col("_w"))).alias("eta2"))


def levene(rows: DataFrame, value: str, group: str, by: list[str], least: int = 2) -> DataFrame:
    """Brown-Forsythe statistic with its degrees of freedom, over groups of at least ``least`` rows; null for fewer than two groups."""
    w = Window.partitionBy(*by, group)
    known = rows.where(F.col(value).isNotNull()).withColumn("_k", F.count(F.lit(1)).over(w)).where(F.col("_k") >= least)
    spread = known.withColumn("_d", F.abs(F.col(value) - F.median(value).over(w)))
    groups = spread.groupBy(*by, group).agg(F.count("_d").alias("n"), F.avg("_d").alias("m"), (F.var_pop("_d") * F.count("_d")).alias("w"))
    sums = groups.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("_t"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("_s"), F.sum("w").alias("_w"))
    between = F.col("_s") - F.col("_t") * F.col("_t") / F.col("n")
    return sums.select(*by, "k", "n", F.when((F.col("k") >= 2) & (F.col("_w") > 0), (F.col("n") - F.col("k")) / (F.col("k") - 1) * between / F.col("_w")).alias("w_stat"))


def binary_quantile_index(rows: DataFrame, value: str, arm: str, by: list[str], taus: list[float], least: int = 20) -> DataFrame:
    """Quantile-based variance effect for a 0/1 arm: the mean over taus of the upper less the lower quantile effect.

    With one binary regressor the quantile regression separates by arm, so each coefficient is a difference of
    group quantiles; the discrete quantile is a minimiser of the check loss. Null below ``least`` rows or with one arm.
    """
    def effect(tau: float) -> Column:
        return F.expr(f"percentile_disc({tau}) WITHIN GROUP (ORDER BY CASE WHEN {arm} = 1 THEN {value} END)") - F.expr(f"percentile_disc({tau}) WITHIN GROUP (ORDER BY CASE WHEN {arm} = 0 THEN {value} END)")

    mean = sum((effect(round(t + 0.5, 4)) - effect(t) for t in taus), F.lit(0.0)) / len(taus)
    known = rows.where(F.col(value).isNotNull() & F.col(arm).isNotNull())
    enough = (F.count(F.lit(1)) >= least) & (F.min(arm) < F.max(arm))
    return known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(enough, mean).alias("beta_qi"))


def enrichment(rows: DataFrame, tested: str, found: str, by: list[str]) -> DataFrame:
    """Expected hits of each row at the pooled rate of ``by``, and the fold over it."""
    w = Window.partitionBy(*by)
    rate = F.try_divide(F.sum(found).over(w), F.sum(tested).over(w))
    out = rows.withColumn("p_rate", F.coalesce(rate, F.lit(0.0))).withColumn("expected", F.col(tested) * F.col("p_rate"))
    return out.withColumn("fold", F.try_divide(F.col(found).cast("double"), F.col("expected")))


def sd_outliers(rows: DataFrame, value: str, by: list[str], times: float = 3.0) -> DataFrame:
    """Rows beyond ``times`` sample deviations of their group's mean, or of the whole table's, which one aggregate gives; null values are none."""
    if by:
        w = Window.partitionBy(*by)
        off = F.abs(F.col(value) - F.avg(value).over(w)) > times * F.stddev_samp(value).over(w)
    else:
        mean, sd = rows.agg(F.avg(value), F.stddev_samp(value)).head()
        off = F.abs(F.col(value) - F.lit(mean)) > F.lit(None if sd is None else times * sd).cast("double")
    return rows.withColumn("is_outlier", F.coalesce(off, F.lit(False)))


def numeric_summary(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, sample deviation, median and quartiles by linear interpolation."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), q.alias("_q"))
    return out.select(*by, "n", "mean", "sd", *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(("q1", "median", "q3"))])


def plausibility(genes: DataFrame) -> DataFrame:
    """A gene's score from its flags: brain, neurons, glia and chemicals one each, a pesticide-mediated link 3 or else a direct one 2, panel confidence 3 or 1.5, and twice the disease score."""
    flag = lambda c: F.when(F.col(c), 1.0).otherwise(0.0)
    link = F.when(F.col("pesticide_mediated"), 3.0).when(F.col("direct_link"), 2.0).otherwise(0.0)
    panel = F.when(F.col("panel_confidence") == "3", 3.0).when(F.col("panel_confidence") == "2", 1.5).otherwise(0.0)
    return genes.withColumn("score", flag("in_brain") + flag("in_neurons") + flag("in_glia") + flag("has_chemicals") + link + panel + 2 * F.coalesce("disease_score", F.lit(0.0)))
