"""The study's pipelines as compositions of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierscan.config import StudyConfig
from carrierscan.operators import cohorts, genotypes, kernels, scans, statistics
from carrierscan.shared import write_shared


def settings_of(config: StudyConfig) -> kernels.ScanSettings:
    names = ("match_k", "min_treated", "min_sample", "max_smd", "min_obs_coef", "n_perm", "n_perm_high", "check_every", "futility_p", "p_threshold")
    return kernels.ScanSettings(**{n: getattr(config, n) for n in names})


def prepared_samples(env: DataFrame, config: StudyConfig, mapping: DataFrame | None = None, cohort=None, pcs: DataFrame | None = None) -> DataFrame:
    """Samples of a cohort with components, and exposures standardised within it."""
    from carrierscan.functions.expressions import standardized

    rows = cohorts.resolve_cohort(env, mapping, cohort) if cohort is not None else env
    if pcs is not None and config.use_pca:
        rows = cohorts.with_covariates(rows, pcs)
    if config.standardize:
        rows = rows.withColumns({e: standardized(F.col(e).cast("double")) for e in config.exposures})
    return rows


def replicate(results: DataFrame, first, second, alpha: float) -> DataFrame:
    return cohorts.replicated(results, first, second, alpha)


def variance_candidates(scan: DataFrame, config: StudyConfig) -> DataFrame:
    """Scan rows with genomic control, adjusted p and the candidate mark: the smallest p-values, or all below the threshold."""
    # Median, ranks and result each read the scan: it runs once.
    scan = write_shared(scan, "scan")
    rows = scans.with_p_values(statistics.genomic_control(scan, "z", []), "chi2_gc")
    rows = statistics.benjamini_hochberg(rows, "p_gc", [], "fdr_gc")
    if config.candidate_top:
        top = rows.where("p_gc is not null").orderBy("p_gc", "variant").limit(config.candidate_top).select("variant", F.lit(True).alias("is_candidate"))
        return rows.join(top, "variant", "left").withColumn("is_candidate", F.coalesce("is_candidate", F.lit(False)))
    return rows.withColumn("is_candidate", F.coalesce(F.col("p_gc") < config.candidate_p, F.lit(False)))


def quality_attrition(geno: DataFrame, samples: DataFrame, config: StudyConfig) -> DataFrame:
    """Cells, variants and samples after each filter of the quality chain."""
    stages = [("raw", geno)]
    stages.append(("called", genotypes.keep_called(geno, samples, config.most_missing)))
    stages.append(("polymorphic", genotypes.drop_monomorphic(stages[-1][1])))
    stages.append(("frequent", genotypes.keep_frequent(stages[-1][1], config.least_maf)))
    rows = None
    for i, (name, df) in enumerate(stages):
        one = df.agg(F.countDistinct("variant").alias("n")).select(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return cohorts.attrition(rows)
