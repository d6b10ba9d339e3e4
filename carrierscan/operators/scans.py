"""Per-variant estimators on the cluster: one row per variant with its dosage array goes to numpy kernels in Arrow batches.

Covariates of all samples are one small table; they are gathered once, in sample order, under a checked bound, and
broadcast. So a scan shuffles genotypes once, by variant, and never joins covariates per variant. Results do not depend
on partitions: seeds come from labels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carrierscan.functions.expressions import SEED_MODULUS
from carrierscan.operators import kernels as K
from carrierscan.operators import statistics
from carrierscan.functions import distributions as D
from carrierscan.shared import write_shared

#: Bytes of one study's covariates that are broadcast at most (8 for each sample and column).
MOST_BYTES = 1 << 30
#: Variants that share permutations in a task at most: each holds its dosages and a few arrays of all samples.
TOGETHER = 8


def label_seed(label: str, base: int = 42) -> int:
    """The seed that ``expressions.stable_seed`` gives."""
    return base + int(hashlib.md5(label.encode()).hexdigest()[:8], 16) % SEED_MODULUS


class Covariates:
    """Named sample columns as arrays in the order of sample ids."""

    def __init__(self, samples: DataFrame, columns: list[str]):
        rows = samples.select(F.col("sample_id"), *[F.col(c).cast("double").alias(c) for c in columns])
        if 8 * len(columns) * samples.count() > MOST_BYTES:
            raise ValueError("more samples than the covariates' broadcast allows")
        table = rows.orderBy("sample_id").toArrow()
        self.count = table.num_rows
        if pc.count_distinct(table.column("sample_id"), "all").as_py() != self.count:
            raise ValueError("a sample id repeats")
        self.values = {c: pc.fill_null(table.column(c), np.nan).to_numpy() for c in columns}
        #: ``sample_id`` and its place in the arrays.
        self.places = write_shared(samples.sparkSession.createDataFrame(table.select(["sample_id"]).append_column("_at", pa.array(np.arange(self.count), pa.int32()))), "places")

    def __getstate__(self) -> dict:
        return {"count": self.count, "values": self.values}

    def stack(self, names: list[str]) -> np.ndarray:
        return np.column_stack([self.values[c] for c in names]) if names else np.zeros((self.count, 0))


def _cells(geno: DataFrame, covariates: Covariates) -> DataFrame:
    """``variant``, its samples' places ``s`` and their dosages ``d``."""
    known = geno.where(F.col("dosage").isNotNull()).join(covariates.places, "sample_id", "left")
    cell = F.when(F.col("_at").isNotNull(), F.struct("_at", F.col("dosage").cast("double").alias("d")))
    return known.groupBy(F.col("variant").cast("string").alias("variant")).agg(F.collect_list(cell).alias("c")).select("variant", F.col("c._at").alias("s"), F.col("c.d").alias("d"))


def per_variant(geno: DataFrame, covariates: Covariates, kernel: Callable[..., list[dict]], schema: str, absent: float = np.nan, parts: DataFrame | None = None) -> DataFrame:
    """Rows that ``kernel(label, dosages, covariates)`` gives for each variant; samples without a cell have ``absent``.

    ``parts`` (``variant`` and more columns, which the kernel gets by name) deals a variant's work to many tasks.

    A kernel's failure becomes a row with status ``failed`` and the message, when the schema has those columns.
    """
    shared = geno.sparkSession.sparkContext.broadcast(covariates)
    arrays = _cells(geno, covariates)
    extra = [c for c in parts.columns if c != "variant"] if parts is not None else []
    if parts is not None:
        arrays = arrays.join(parts, "variant")
    # Few short rows that take long: a fixed number of tasks keeps adaptive execution from merging them, and many tasks keep those that the hash puts into one few.
    arrays = arrays.repartition(max(int(geno.sparkSession.conf.get("spark.sql.shuffle.partitions")), 32 * geno.sparkSession.sparkContext.defaultParallelism), "variant", *extra)
    names = [x.strip().split()[0] for x in schema.split(",")]
    target = F.lit(None).cast(f"struct<{', '.join(f'{x.strip().split()[0]}:{x.strip().split()[1]}' for x in schema.split(','))}>")
    kind = pa.schema([(f.name, {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}[f.dataType.simpleString()]) for f in geno.sparkSession.range(1).select(target.alias("r")).schema["r"].dataType])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cov = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                label, *rest = (batch.column(c)[i].as_py() for c in ("variant", *extra))
                part = dict(zip(extra, rest, strict=True))
                dosages = np.full(cov.count, absent)
                dosages[batch.column("s")[i].values.to_numpy()] = batch.column("d")[i].values.to_numpy()
                try:
                    rows = kernel(label, dosages, cov, **part)
                except (ValueError, ArithmeticError, np.linalg.LinAlgError) as error:
                    if "status" not in names:
                        raise
                    rows = [{"status": "failed", "error_message": str(error)}]
                if rows:
                    yield pa.RecordBatch.from_pylist([{n: (label if n == "variant" else part[n] if n in part else r.get(n)) for n in names} for r in rows], schema=kind)

    return arrays.select("variant", "s", "d", *extra).mapInArrow(run, schema)


RESULT = "variant string, exposure string, status string, error_message string, gate string, n_carrier bigint, n_noncarrier bigint, n_matched bigint, max_smd double, obs_coef double, mean_coef double, sd_coef double, empirical_p double, iterations bigint"


def _carriers(v: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(v), np.nan, v > 0)


def interaction_model(geno: DataFrame, cov: Covariates, y: str, exposures: list[str], covariates: list[str], settings: K.ScanSettings, base_seed: int = 42, absent: float = 0.0) -> DataFrame:
    """Matched permutation test of every variant with each exposure."""
    def kernel(label: str, v: np.ndarray, c: Covariates) -> list[dict]:
        return [K.interaction_scan(_carriers(v), c.values[y], c.stack([e]), c.stack(covariates), settings, label_seed(label, base_seed)) | {"exposure": e, "status": "done"} for e in exposures]

    return per_variant(geno, cov, kernel, RESULT, absent)


def two_phase_model(geno: DataFrame, cov: Covariates, y: str, exposures: list[str], covariates: list[str], settings: K.ScanSettings, base_seed: int = 42, absent: float = 0.0) -> DataFrame:
    """As ``interaction_model``: a light pass over all variants, then the heavy permutations of those that stay significant, dealt to tasks by (variant, exposure, some blocks)."""
    def light_kernel(label: str, v: np.ndarray, c: Covariates) -> list[dict]:
        out = []
        for e in exposures:
            found, betas = K.light_scan(_carriers(v), c.values[y], c.stack([e]), c.stack(covariates), settings, label_seed(label, base_seed))
            out.append(found | {"exposure": e, "status": "done", "betas": betas.tolist()})
        return out

    def heavy_kernel(label: str, v: np.ndarray, c: Covariates, exposure: str, blocks: list[int]) -> list[dict]:
        return [{"block": b, "status": "done", "betas": K.heavy_block(_carriers(v), c.values[y], c.stack([exposure]), c.stack(covariates), settings, label_seed(label, base_seed), b).tolist()} for b in blocks]

    light = per_variant(geno, cov, light_kernel, f"{RESULT}, betas array<double>", absent).cache()
    count = len(K.blocks(settings.n_perm_high - settings.n_perm))
    if not count:
        return light.drop("betas")
    again = light.where((F.col("gate") == "tested") & (F.col("empirical_p") <= settings.p_threshold)).select("variant", "exposure")
    # A row holds a variant's cells, so blocks share one where the variants alone are enough rows for all tasks.
    spread = max(1, min(count, -(-8 * geno.sparkSession.sparkContext.defaultParallelism // max(1, again.count()))))
    parts = again.withColumn("blocks", F.explode(F.array(*[F.array(*map(F.lit, range(i, count, spread))) for i in range(spread)])))
    chosen = geno.withColumn("variant", F.col("variant").cast("string")).join(again.select("variant").distinct(), "variant", "left_semi")
    heavy = per_variant(chosen, cov, heavy_kernel, "variant string, exposure string, block int, status string, error_message string, betas array<double>", absent, parts)
    heavy = heavy.groupBy("variant", "exposure").agg(F.array_sort(F.collect_list(F.struct("block", "betas"))).alias("more"), F.max("error_message").alias("failure"))
    rows = light.join(heavy, ["variant", "exposure"], "left")
    betas = F.concat("betas", F.flatten(F.transform("more", lambda x: F.coalesce(x["betas"], F.array().cast("array<double>")))))
    n = F.size("all").cast("double")
    full = {
        "iterations": F.size("all").cast("long"),
        "empirical_p": F.size(F.filter("all", lambda x: F.abs(x) >= F.abs(F.col("obs_coef")))) / n,
        "mean_coef": F.col("mean"),
        "sd_coef": F.sqrt(F.aggregate("all", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean"))) / n),
    }
    rows = rows.withColumn("all", betas).withColumn("mean", F.aggregate("all", F.lit(0.0), lambda s, x: s + x) / n)
    rows = rows.withColumns({c: F.when(F.col("failure").isNotNull(), None).when(F.col("more").isNotNull(), x).otherwise(F.col(c)) for c, x in full.items()})
    rows = rows.withColumns({"status": F.when(F.col("failure").isNotNull(), "failed").otherwise(F.col("status")), "error_message": F.coalesce("failure", "error_message")})
    return rows.select(*[x.strip().split()[0] for x in RESULT.split(",")])


def onset_intervals(geno: DataFrame, cov: Covariates, y: str, reps: int = 2000, alpha: float = 0.05, least: int = 5, seed: int = 42, absent: float = 0.0) -> DataFrame:
    """Mann-Whitney p and the bootstrap interval of the median difference, for variants with ``least`` rows in both arms."""
    def kernel(label: str, v: np.ndarray, c: Covariates) -> list[dict]:
        known = ~(np.isnan(c.values[y]) | np.isnan(v))
        one, zero = c.values[y][known & (v > 0)], c.values[y][known & (v == 0)]
        if min(len(one), len(zero)) < least:
            return [{"n_carrier": len(one), "n_noncarrier": len(zero)}]
        u, p, effect = D.mann_whitney(one, zero)
        low, high = K.median_difference_ci(one, zero, reps, alpha, np.random.default_rng(seed))
        return [{"n_carrier": len(one), "n_noncarrier": len(zero), "u_stat": u, "p_value": p, "effect_size": effect, "delta_median": float(np.median(one) - np.median(zero)), "ci_low": low, "ci_high": high}]

    return per_variant(geno, cov, kernel, "variant string, n_carrier bigint, n_noncarrier bigint, u_stat double, p_value double, effect_size double, delta_median double, ci_low double, ci_high double", absent)


def variance_scan(geno: DataFrame, cov: Covariates, residual: str, reps: int = 200, base_seed: int = 42, least_maf: float = 0.0, least_call_rate: float = 0.0, absent: float = 0.0, failed_as_zero: bool = False) -> DataFrame:
    """Quantile-based variance effects. A filtered or degenerate variant is done with null statistics."""
    def kernel(label: str, v: np.ndarray, c: Covariates) -> list[dict]:
        v = np.where((v >= 0) & (v <= 2), v, np.nan)
        called = ~np.isnan(v)
        p = float(v[called].mean() / 2) if called.any() else 0.0
        if min(p, 1 - p) < least_maf or called.mean() < least_call_rate or not called.any():
            return [{"status": "done", "n": int(called.sum()), "maf": p}]
        return [K.variance_scan(v, c.values[residual], reps, np.random.default_rng(label_seed(label, base_seed)), failed_as_zero) | {"status": "done"}]

    return per_variant(geno, cov, kernel, "variant string, status string, error_message string, n bigint, maf double, beta_qi double, se double, z double, p double", absent)


TRANSFORMS = ("original", "log", "rint", "no_outliers")


def transformed(y: np.ndarray, kind: str) -> np.ndarray:
    """Phenotype as it is, logged, rank-inverse-normal, or without values beyond three deviations."""
    known = ~np.isnan(y)
    out = np.full(len(y), np.nan)
    some = y[known]
    if kind == "log":
        some = np.log(some - (min(0.0, some.min(initial=0.0)) - 1))
    elif kind == "rint":
        values, inverse, counts = np.unique(some, return_inverse=True, return_counts=True)
        some = D.normal_quantile(((np.cumsum(counts) - (counts - 1) / 2)[inverse] - 0.5) / len(some))
    elif kind == "no_outliers":
        sd = some.std()
        some = np.where(np.abs(some - some.mean()) <= 3 * sd, some, np.nan) if sd > 0 else some
    out[known] = some
    return out


def interaction_tests(geno: DataFrame, cov: Covariates, y: str, exposures: list[str], covariates: list[str], transforms: tuple[str, ...] = ("original",), absent: float = 0.0) -> DataFrame:
    """Robust interaction tests of every variant, exposure and phenotype transform."""
    def kernel(label: str, v: np.ndarray, c: Covariates) -> list[dict]:
        return [K.interaction_test(v, transformed(c.values[y], t), c.values[e], c.stack(covariates)) | {"exposure": e, "phenotype_variant": t} for e in exposures for t in transforms]

    return per_variant(geno, cov, kernel, "variant string, exposure string, phenotype_variant string, beta_i double, se double, pval double, n bigint, maf double", absent)


def rge_and_spread(geno: DataFrame, cov: Covariates, y: str, exposures: list[str], covariates: list[str], alpha: float = 0.05, absent: float = 0.0) -> DataFrame:
    """Gene-exposure correlation and heteroscedasticity of the interaction-free model."""
    def kernel(label: str, v: np.ndarray, c: Covariates) -> list[dict]:
        out = []
        for e in exposures:
            x, cs = c.values[e], c.stack(covariates)
            known = ~(np.isnan(v) | np.isnan(c.values[y]) | np.isnan(x) | np.isnan(cs).any(axis=1))
            row: dict = {"exposure": e, "n": int(known.sum())}
            if known.sum() >= 20 and len(np.unique(v[known])) >= 2:
                rge = K.gene_exposure_correlation(v[known], x[known], cs[known])
                het = K.breusch_pagan(np.column_stack([np.ones(int(known.sum())), v[known], x[known], cs[known]]), c.values[y][known])
                row |= {"rge_beta": rge[0], "rge_p": rge[1], "rge_flag": rge[1] < alpha} if rge else {}
                row |= {"het_lm": het[0], "het_p": het[1], "het_f": het[2], "het_f_p": het[3], "het_flag": het[1] < alpha} if het else {}
            out.append(row)
        return out

    return per_variant(geno, cov, kernel, "variant string, exposure string, n bigint, rge_beta double, rge_p double, rge_flag boolean, het_lm double, het_p double, het_f double, het_f_p double, het_flag boolean", absent)


def permutation_checks(geno: DataFrame, cov: Covariates, y: str, exposures: list[str], covariates: list[str], count: int = 10_000, base_seed: int = 42, absent: float = 0.0) -> DataFrame:
    """Freedman-Lane p of each interaction, and the permuted Brown-Forsythe p of each variant.

    Replicates are dealt to tasks by (some variants, some blocks). Variants with the same complete rows share a block's permutations, whose seed is the block's: a variant's result does not
    depend on those it meets, but results of different variants are not independent draws.
    """
    spark = geno.sparkSession
    shared = spark.sparkContext.broadcast(cov)
    sizes = K.blocks(count)
    arrays = write_shared(_cells(geno, cov), "cells")
    groups = max(1, -(-arrays.count() // TOGETHER))
    # A row holds a variant's cells, so blocks share one where the groups alone are enough rows for all tasks.
    slices = max(1, min(len(sizes), -(-4 * spark.sparkContext.defaultParallelism // groups)))
    some = F.array(*[F.struct(F.lit(i).alias("_p"), F.array(*map(F.lit, range(i, len(sizes), slices))).alias("blocks")) for i in range(slices)])
    dealt = arrays.withColumns({"_w": F.explode(some), "_g": F.pmod(F.xxhash64("variant"), F.lit(groups))}).select("variant", "_g", "_w._p", "_w.blocks", "s", "d")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(8 * groups * slices, 4096))
    dealt = dealt.repartition(tasks, "_g", "_p").sortWithinPartitions("_p", "_g", "variant").select("variant", "blocks", "s", "d")

    def hits(blocks: list[int], held: list[tuple[str, np.ndarray]], c: Covariates) -> list[dict]:
        """Rows of some variants' blocks: variants with the same complete rows go together."""
        outcome, cs = c.values[y], c.stack(covariates)
        work: dict[tuple, list] = {}
        out = {(label, e, b): {"variant": label, "exposure": e, "block": b, "n": sizes[b]} for b in blocks for label, _ in held for e in exposures}
        for label, v in held:
            some = ~(np.isnan(v) | np.isnan(outcome))
            alone = True
            for i, e in enumerate(exposures):
                known = some & ~(np.isnan(c.values[e]) | np.isnan(cs).any(axis=1))
                if known.sum() >= 20 and len(np.unique(v[known])) >= 2:
                    both = alone and known.sum() == some.sum()
                    alone &= not both
                    work.setdefault((known.tobytes(), i, True, both), []).append((label, v))
            if alone:
                work.setdefault((some.tobytes(), 0, False, True), []).append((label, v))
        for (mask, i, lane, spread), some in work.items():
            at = np.frombuffer(mask, bool)
            x, z = (c.values[exposures[i]][at], cs[at]) if lane else (np.zeros(at.sum()), np.zeros((at.sum(), 0)))
            found = K.permutation_blocks([v[at] for _, v in some], outcome[at], x, z, [sizes[b] for b in blocks], [np.random.default_rng([base_seed, b, i]) for b in blocks], lane, spread)
            for b, rows in zip(blocks, found, strict=True):
                for (label, _), r in zip(some, rows, strict=True):
                    for e in exposures:
                        out[label, e, b] |= {k: x for k, x in r.items() if k.startswith("levene") or e == exposures[i]}
        return list(out.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, at, held = shared.value, None, []

        for batch in batches:
            for i in range(batch.num_rows):
                blocks = batch.column("blocks")[i].as_py()
                if held and (blocks != at or len(held) == TOGETHER):
                    yield pa.RecordBatch.from_pylist(hits(at, held, c), schema=kind)
                    held = []
                dosages = np.full(c.count, absent)
                dosages[batch.column("s")[i].values.to_numpy()] = batch.column("d")[i].values.to_numpy()
                at = blocks
                held.append((batch.column("variant")[i].as_py(), dosages))
        if held:
            yield pa.RecordBatch.from_pylist(hits(at, held, c), schema=kind)

    names = {"variant": pa.string(), "exposure": pa.string(), "block": pa.int32(), "n": pa.int64(), "beta_i_observed": pa.float64(), "lane_hits": pa.int64(), "levene_stat": pa.float64(), "levene_hits": pa.int64()}
    kind = pa.schema(list(names.items()))
    found = dealt.mapInArrow(run, "variant string, exposure string, block int, n bigint, beta_i_observed double, lane_hits bigint, levene_stat double, levene_hits bigint")

    def p(hits: str):
        return (1 + F.sum(hits)) / (1 + F.sum(F.when(F.col(hits).isNotNull(), F.col("n"))))

    return found.groupBy("variant", "exposure").agg(
        F.min_by("beta_i_observed", "block").alias("beta_i_observed"), p("lane_hits").alias("empirical_pval"), F.sum(F.when(F.col("lane_hits").isNotNull(), F.col("n"))).alias("n_perm_valid"),
        F.min_by("levene_stat", "block").alias("levene_stat"), p("levene_hits").alias("levene_p"),
    )


def with_p_values(rows: DataFrame, chi2: str, out: str = "p_gc") -> DataFrame:
    """P of a chi-square statistic with one degree of freedom; ``erfc`` is no built-in, so an Arrow batch function."""

    @F.pandas_udf("double")
    def tail(x):
        import pandas as pd

        return pd.Series(D.normal_two_sided(np.sqrt(x.to_numpy(float)))).where(x.notna(), None)

    return rows.withColumn(out, tail(F.col(chi2).cast("double")))


def binomial_tails(rows: DataFrame, k: str, n: str, p: str, out: str = "binom_p") -> DataFrame:
    """One-sided exact binomial p; zero totals give 1."""

    @F.pandas_udf("double")
    def tail(k, n, p):
        import pandas as pd

        return pd.Series([D.binomial_sf(int(a), int(b), float(c)) if b > 0 and c > 0 else 1.0 for a, b, c in zip(k, n, p, strict=True)])

    return rows.withColumn(out, tail(F.col(k).cast("long"), F.col(n).cast("long"), F.col(p).cast("double")))


def table_p(tests: DataFrame, out: str = "p") -> DataFrame:
    """The p of each row of ``statistics.table_test``; null where there is no statistic."""

    @F.pandas_udf("double")
    def p_of(test, statistic, dof, a, b, c, d):
        import pandas as pd

        cells = zip(test, statistic, dof, a, b, c, d, strict=True)
        return pd.Series([None if x != x else D.fisher_exact(*map(int, four)) if t == "fisher" else D.chi2_sf(float(x), float(n)) for t, x, n, *four in cells], dtype="float64")

    return tests.withColumn(out, p_of("test", "statistic", "dof", "a", "b", "c", "d"))


def rank_sum_p(sums: DataFrame, out: str = "p") -> DataFrame:
    """The two-sided p of each row of ``statistics.rank_sum``: exact for a small arm without ties, else of its ``z``; null where ``z`` is."""

    @F.pandas_udf("double")
    def p_of(u, n, m, ties, z):
        import pandas as pd

        rows = zip(u, n, m, ties, z, strict=True)
        return pd.Series([None if s != s else D.rank_sum_exact(a, int(b), int(c)) if min(b, c) <= D.EXACT_ARM and t == 0 else float(D.normal_two_sided(s)) for a, b, c, t, s in rows], dtype="float64")

    return sums.withColumn(out, p_of("u_stat", "n_carrier", "n_noncarrier", "ties", F.col("z").cast("double")))


def normality(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``n, w, normal_p`` of the Shapiro-Wilk test of each group: order scores by window, then sums, so that no task holds a group's array. Null under eight values; gaps take no part."""

    @F.pandas_udf("double")
    def score(i, n):
        import pandas as pd

        return pd.Series(D.normal_scores(i.to_numpy(), n.to_numpy()))

    @F.pandas_udf("w double, p double")
    def test(n, sx, ss, x1, x2, y2, y1, squares):
        import pandas as pd

        found = [D.shapiro_wilk(int(k), a, b, (c, d), (e, f), q) if k >= D.SHAPIRO_LEAST else (None, None) for k, a, b, c, d, e, f, q in zip(n, sx, ss, x1, x2, y2, y1, squares, strict=True)]
        return pd.DataFrame(found, columns=["w", "p"], dtype="float64")

    group = Window.partitionBy(*by)
    known = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    ranked = known.withColumns({"_i": F.row_number().over(group.orderBy("_x")), "_n": F.count(F.lit(1)).over(group)}).withColumn("_s", score("_i", "_n"))
    x = F.col("_x")
    ends = [F.max(F.when(F.col("_i") == i, x)) for i in (F.lit(1), F.lit(2), F.col("_n") - 1, F.col("_n"))]
    sums = ranked.groupBy(*by).agg(
        F.count(x).alias("n"), F.sum(F.col("_s") * x).alias("_sx"), F.sum(F.col("_s") * F.col("_s")).alias("_ss"), *[e.alias(f"_e{i}") for i, e in enumerate(ends)], (F.var_pop(x) * F.count(x)).alias("_q")
    )
    return sums.withColumn("_t", test("n", "_sx", "_ss", "_e0", "_e1", "_e2", "_e3", "_q")).select(*by, "n", F.col("_t.w").alias("w"), F.col("_t.p").alias("normal_p"))


def numeric_test(rows: DataFrame, value: str, arm: str, by: list[str], alpha: float = 0.05) -> DataFrame:
    """The descriptive test of a number between arms 1 and 0: ``n1, n0, test, statistic, p``.

    Welch's where neither arm departs from the normal at ``alpha`` (an arm of under eight values does not), else the rank-sum. The
    test's statistic and p are null where it is undefined; a null in ``by`` has no test.
    """

    @F.pandas_udf("double")
    def t_p(t, df):
        import pandas as pd

        return pd.Series([None if x != x else D.t_two_sided(x, k) for x, k in zip(t, df, strict=True)], dtype="float64")

    rows = rows.where(F.col(arm).isin(0, 1))
    departs = normality(rows, value, [*by, arm]).groupBy(*by).agg(F.coalesce(F.min("normal_p") <= alpha, F.lit(False)).alias("_departs"))
    means = statistics.welch_test(rows, value, arm, by)
    ranks = rank_sum_p(statistics.rank_sum(rows, value, arm, by), "_rank_p").select(*by, "u_stat", "_rank_p")
    both = means.join(departs, by, "left").join(ranks, by, "left").withColumn("_mean_p", t_p("t", "df"))
    pick = F.coalesce("_departs", F.lit(False))
    return both.select(*by, "n1", "n0", F.when(pick, "rank_sum").otherwise("welch").alias("test"), F.when(pick, F.col("u_stat")).otherwise(F.col("t")).alias("statistic"), F.when(pick, F.col("_rank_p")).otherwise(F.col("_mean_p")).alias("p"))


#: Shares of the exposure's variance that components explain, above which they belong in the model.
COMPONENT_BANDS = ((0.10, "main model"), (0.03, "base model"), (0.0, "sensitivity only"))


def component_links(rows: DataFrame, exposure: str, components: list[str]) -> DataFrame:
    """``component, n, r, p`` of each component with the exposure, and the ``joint_r2`` of the exposure on all of them with its ``verdict``.

    Rows with a gap take no part. Correlations come from one aggregate; the driver solves a matrix of components by components.
    A column that does not vary has null ``r`` and ``p`` and no share in the joint model.
    """
    names = [*components, exposure]
    known = rows.select(*[F.col(c).cast("double").alias(c) for c in names]).dropna()
    pairs = [(i, j) for j in range(len(names)) for i in range(j)]
    sums = known.agg(F.count(F.lit(1)).alias("n"), *[F.try_divide(F.covar_pop(names[i], names[j]), F.stddev_pop(names[i]) * F.stddev_pop(names[j])).alias(f"r{i}_{j}") for i, j in pairs]).head()
    n, last = sums["n"], len(components)
    corr = np.eye(len(names))
    for i, j in pairs:
        r = sums[f"r{i}_{j}"]
        corr[i, j] = corr[j, i] = np.nan if r is None else r
    used = [i for i in range(last) if corr[i, last] == corr[i, last]]
    joint = float(corr[used, last] @ np.linalg.lstsq(corr[np.ix_(used, used)], corr[used, last], rcond=None)[0]) if used else None
    verdict = None if joint is None else next((name for least, name in COMPONENT_BANDS if joint > least), COMPONENT_BANDS[-1][1])
    out = []
    for i, name in enumerate(components):
        r = float(corr[i, last]) if i in used else None
        p = None if r is None or n < 3 else 0.0 if abs(r) >= 1 else D.t_two_sided(r * np.sqrt((n - 2) / (1 - r * r)), n - 2)
        out.append((name, n, r, None if p is None else float(p), joint, verdict))
    return rows.sparkSession.createDataFrame(out, "component string, n long, r double, p double, joint_r2 double, verdict string")


def full_model(geno: DataFrame, cov: Covariates, y: str, exposures: list[str], covariates: list[str], settings: K.ScanSettings, base_seed: int = 42, absent: float = 0.0) -> DataFrame:
    """Every coefficient of the matched interaction model of each variant: ``term, obs, perm_mean, perm_sd, p_emp`` over ``n_perm`` permutations, without the gate on small effects. A variant that a gate stops has no rows."""
    terms = ["intercept", "variant", *exposures, *(f"variant:{e}" for e in exposures), *covariates]

    def kernel(label: str, v: np.ndarray, c: Covariates) -> list[dict]:
        found = K.coefficient_table(_carriers(v), c.values[y], c.stack(exposures), c.stack(covariates), settings, label_seed(label, base_seed))
        return [{"term": t, **row} for t, row in zip(terms, found, strict=True)] if found else []

    return per_variant(geno, cov, kernel, "variant string, term string, obs double, perm_mean double, perm_sd double, p_emp double, iterations bigint", absent)


def residualize(samples: DataFrame, y: str, covariates: list[str], out: str = "residual") -> DataFrame:
    """Residual of ``y`` on a constant and covariates over complete rows; null elsewhere.

    Cross products come from one aggregate; the small normal equations are solved on the driver.
    """
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in covariates]]
    complete = F.col(y).isNotNull()
    for c in covariates:
        complete &= F.col(c).isNotNull()
    sums = samples.where(complete).agg(*[F.sum(a * b).alias(f"x{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x)], *[F.sum(a * F.col(y)).alias(f"y{i}") for i, a in enumerate(x)]).head()
    k = len(x)
    if sums["y0"] is None:
        return samples.withColumn(out, F.lit(None).cast("double"))
    beta = np.linalg.lstsq(np.array([[sums[f"x{i}_{j}"] for j in range(k)] for i in range(k)], float), np.array([sums[f"y{i}"] for i in range(k)], float), rcond=None)[0]
    fitted = sum((a * float(b) for a, b in zip(x, beta, strict=True)), F.lit(0.0))
    return samples.withColumn(out, F.when(complete, F.col(y) - fitted))
