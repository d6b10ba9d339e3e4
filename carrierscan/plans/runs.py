"""Whole studies from files to tables: steps that are committed once, short-circuit when they are there, and go on where a run broke off."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrierscan.config import StudyConfig
from carrierscan.operators import scans, statistics
from carrierscan.plans import pipelines
from carrierscan.shared import exists, remove

#: Parts of a scan that are committed one by one.
SCAN_PARTS = 8


class Generation:
    """Tables of one generation and one set of settings, below a path that names both.

    A table is written beside its place and moved there when it is whole; of two runs that make the same one, the first to move it wins and the other reads that. So a table that
    can be read is whole, is never changed by later runs, and what later steps took from it stays true.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, config: StudyConfig):
        self.spark, self.config = spark, config
        self.path = f"{root.rstrip('/')}/{name}-{config.fingerprint(name)}"
        #: Names of the tables that this object made rather than found.
        self.made: list[str] = []

    def table(self, name: str) -> DataFrame | None:
        path = f"{self.path}/{name}"
        return self.spark.read.parquet(path) if exists(self.spark, f"{path}/_SUCCESS") else None

    def get_or_make(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        found = self.table(name)
        if found is None:
            staging = f"{self.path}/_staging/{name.replace('/', '-')}-{uuid.uuid4().hex}"
            make().write.parquet(staging)
            self._move(staging, f"{self.path}/{name}")
            self.made.append(name)
            found = self.table(name)
        return found

    def _move(self, staging: str, place: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        source, target = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(place)
        store = source.getFileSystem(conf)
        store.mkdirs(target.getParent())
        # A rename onto a folder that is there would move into it.
        if store.exists(target) or not store.rename(source, target):
            store.delete(source, True)

    def forget(self) -> None:
        """Drop all tables, so that the next run makes them anew."""
        remove(self.spark, self.path)

    def status(self, names: list[str]) -> DataFrame:
        """``step, done, rows`` of the named tables."""
        tables = {n: self.table(n) for n in names}
        return self.spark.createDataFrame([(n, t is not None, t.count() if t is not None else None) for n, t in tables.items()], "step string, done boolean, rows long")


def _by_parts(run: Generation, name: str, geno: DataFrame, work: Callable[[DataFrame], DataFrame], parts: int) -> DataFrame:
    """The results of ``work`` on all variants of the frozen list, part by part; parts that are there are not made again."""
    listed = run.get_or_make("variants", lambda: geno.select(F.col("variant").cast("string").alias("variant")).distinct())
    part = F.pmod(F.xxhash64("variant"), F.lit(parts))
    cells = geno.withColumn("variant", F.col("variant").cast("string"))
    rows = None
    for k in range(parts):
        one = run.get_or_make(f"{name}/part-{k:03}", lambda k=k: work(cells.join(listed.where(part == k), "variant", "left_semi")))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def run_model(run: Generation, geno: DataFrame, samples: DataFrame, covariates: list[str], absent: float = float("nan"), parts: int = SCAN_PARTS) -> dict[str, DataFrame]:
    """``model``: interaction results of every variant and exposure with adjusted p-values; ``significant``: those below the threshold."""
    config = run.config
    cov = scans.Covariates(samples, [config.target, *config.exposures, *covariates])
    kept = geno.join(samples.select("sample_id"), "sample_id", "left_semi")
    scan = _by_parts(run, "scan", kept, lambda cells: scans.two_phase_model(cells, cov, config.target, list(config.exposures), covariates, pipelines.settings_of(config), config.seed, absent), parts)
    model = run.get_or_make("model", lambda: statistics.benjamini_hochberg(scan, "empirical_p", ["exposure"]))
    return {"model": model, "significant": run.get_or_make("significant", lambda: model.where(F.col("empirical_p") < config.p_threshold))}


def run_variance(run: Generation, geno: DataFrame, samples: DataFrame, covariates: list[str], absent: float = float("nan"), parts: int = SCAN_PARTS) -> dict[str, DataFrame]:
    """The variance study's steps in order: scan, candidates (frozen), interaction, correlation and spread, robustness, permutation.

    A step that is there is read, with all that hangs on it; settings that differ are another generation.
    """
    config, exposures = run.config, list(run.config.exposures)
    rows = scans.residualize(samples, config.target, covariates)
    cov = scans.Covariates(rows, ["residual", config.target, *exposures, *covariates])
    scan = _by_parts(run, "scan", geno, lambda cells: scans.variance_scan(cells, cov, "residual", config.scan_reps, config.seed, absent=absent), parts)
    candidates = run.get_or_make("candidates", lambda: pipelines.variance_candidates(scan, config))
    cells = geno.withColumn("variant", F.col("variant").cast("string"))
    chosen = cells.join(candidates.where("is_candidate").select("variant"), "variant", "left_semi")
    tests = run.get_or_make("interaction", lambda: scans.interaction_tests(chosen, cov, config.target, exposures, covariates, absent=absent).withColumn("is_significant", F.coalesce(F.col("pval") < config.alpha, F.lit(False))))
    top = run.get_or_make("loci", lambda: tests.where("pval is not null").groupBy("variant").agg(F.min("pval").alias("pval")).orderBy("pval", "variant").limit(config.top_loci))
    loci = cells.join(top.select("variant"), "variant", "left_semi")
    return {
        "scan": candidates,
        "interaction": tests,
        "rge": run.get_or_make("rge", lambda: scans.rge_and_spread(chosen, cov, config.target, exposures, covariates, config.alpha, absent)),
        "robustness": run.get_or_make("robustness", lambda: scans.interaction_tests(loci, cov, config.target, exposures, covariates, scans.TRANSFORMS, absent)),
        "permutation": run.get_or_make("permutation", lambda: scans.permutation_checks(loci, cov, config.target, exposures, covariates, config.n_perm_high, config.seed, absent)),
    }


STEPS = {"model": ["variants", "model", "significant"], "variance": ["variants", "candidates", "interaction", "loci", "rge", "robustness", "permutation"]}
