"""Estimators from carried cells against those from every cell."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from carrierscan.operators import genotypes, sparse, statistics


@pytest.fixture(scope="module")
def both(spark):
    random = np.random.default_rng(2)
    people = [(i, None if i % 17 == 0 else float(random.integers(0, 25)), None if i % 13 == 0 else float(random.standard_normal()), i % 5) for i in range(120)]
    samples = spark.createDataFrame(people, "sample_id long, y double, e double, c int")
    cells = spark.createDataFrame([(i, v, int(random.integers(1, 3))) for v in range(7) for i in range(120) if v == 5 or (v != 6 and random.random() < 0.1 * (v + 1))], "sample_id long, variant int, dosage int")
    variants = spark.createDataFrame([(v,) for v in range(7)], "variant int")
    dense = genotypes.densify(samples, variants, cells).join(samples, "sample_id").withColumn("v", (F.col("dosage") > 0).cast("int"))
    return cells, variants, samples, dense


def same(got, want, columns):
    a, b = ({r["variant"]: r for r in df.collect()} for df in (got, want))
    assert set(a) == set(b)
    for k in a:
        for c in columns:
            assert a[k][c] == (pytest.approx(b[k][c], rel=1e-9, abs=1e-9) if b[k][c] is not None else None), (k, c)


def test_carried_cells_give_what_all_cells_give(both):
    cells, variants, samples, dense = both
    n = samples.count()
    same(sparse.allele_frequency(cells, variants, n), genotypes.allele_frequency(dense), ["n_called", "alt_freq", "maf", "carrier_freq", "call_rate", "variance"])
    same(sparse.balance(cells, variants, samples, ["e", "c"]), statistics.balance(dense, "v", ["e", "c"], ["variant"]), ["smd_e", "smd_c"])
    same(sparse.interaction_slope(cells, variants, samples, "y", "e"), statistics.interaction_slope(dense, "y", "v", "e", ["variant"]), ["n_carrier", "n_noncarrier", "slope_carrier", "slope_noncarrier", "beta_interaction"])
    ranks = ["n_carrier", "n_noncarrier", "median_carrier", "median_noncarrier", "delta_median", "ties", "effect_size", "z"]
    full = statistics.rank_sum(dense, "y", "v", ["variant"])
    same(sparse.rank_sum(cells, variants, samples, "y"), full, ranks)
    same(sparse.rank_sum(cells, variants, samples, "y").where("n_carrier > 0"), full.where("n_carrier > 0"), ["u_stat"])
    same(sparse.onset_summary(cells, variants, samples, "y", 5), statistics.onset_summary(dense, "y", "v", ["variant"], 5), [*ranks, "u_stat", "low_power"])


def test_plans_have_no_cross_join(both):
    cells, variants, samples, _ = both
    for df in (sparse.onset_summary(cells, variants, samples, "y"), sparse.balance(cells, variants, samples, ["e"]), sparse.interaction_slope(cells, variants, samples, "y", "e"), sparse.allele_frequency(cells, variants, 9)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan and "Join Inner\n" not in plan


def test_no_samples_at_all(spark, both):
    cells, variants, samples, _ = both
    none = samples.where("sample_id < 0")
    assert {r["n_carrier"] + r["n_noncarrier"] for r in sparse.onset_summary(cells, variants, none, "y").collect()} == {0}
    assert {r["smd_e"] for r in sparse.balance(cells, variants, none, ["e"]).collect()} == {0.0}


def test_mean_does_not_depend_on_the_order_of_rows(spark):
    from carrierscan.plans.study import exact_mean

    values = [0.1, 0.2, 0.3, 1e6 + 0.7, 0.6]
    rows = [(0, x) for x in values] + [(1, x) for x in reversed(values)] + [(2, 1 / 3), (2, 2 / 3), (3, None), (4, float("nan")), (5, float("inf")), (6, 1e300)]
    got = {r["g"]: r["m"] for r in spark.createDataFrame(rows, "g int, x double").coalesce(1).groupBy("g").agg(exact_mean(F.col("x")).alias("m")).collect()}
    assert got[0] == got[1] == 1000001.9 / 5
    assert got[2] == 0.5 and got[3] is None and got[4] != got[4] and got[5] == float("inf") and got[6] == 1e300


def test_quantile_index_of_carriers_and_others(both):
    cells, variants, samples, dense = both
    taus = [0.05, 0.13, 0.37]
    got = {r["variant"]: r for r in sparse.binary_quantile_index(cells, variants, samples, "y", taus).collect()}
    want = {r["variant"]: r for r in statistics.binary_quantile_index(dense, "y", "v", ["variant"], taus).collect()}
    assert got.keys() == want.keys() and any(r["beta_qi"] is not None for r in want.values())
    for v, r in want.items():
        assert got[v]["n"] == r["n"] and got[v]["beta_qi"] == (None if r["beta_qi"] is None else pytest.approx(r["beta_qi"], abs=1e-12))


def test_interval_pieces_do_not_overlap(spark, monkeypatch):
    from carrierscan.operators import cohorts

    random = np.random.default_rng(5)
    genes = [(f"G{i}", int(random.integers(2)), int(a), int(a + random.integers(-3, 60))) for i, a in enumerate(random.integers(0, 200, 120))]
    points = [(i, int(random.integers(2)), int(random.integers(-5, 300))) for i in range(400)]
    got = {r["variant"]: r["gene"] for r in cohorts.point_in_interval(spark.createDataFrame(points, "variant int, chrom int, pos int"), spark.createDataFrame(genes, "gene string, chrom int, start int, end int"), 10).collect()}
    for v, c, p in points:
        assert got[v] == min(((s, g) for g, k, s, e in genes if k == c and s <= p <= e), default=(0, "NO-GENE"))[1]
    # Rows that meet in the join: one piece at most for each position and point, instead of all intervals around it.
    met, where = [], spark.range(1).__class__.where
    monkeypatch.setattr(spark.range(1).__class__, "where", lambda df, c: (met.append(df.count()) if "pos between" in str(c) else None, where(df, c))[1])
    one = [("A", 0, 0, 50)] * 1 + [(f"B{i}", 0, 1, 50) for i in range(100)]
    cohorts.point_in_interval(spark.createDataFrame(points, "variant int, chrom int, pos int"), spark.createDataFrame(one, "gene string, chrom int, start int, end int"), 1000)
    assert met[0] <= len(points)


def test_called_variants_from_carried_cells(both):
    cells, variants, samples, dense = both
    hole = F.expr("(sample_id * 7 + variant * 13) % 10 < variant")
    holes = dense.withColumn("dosage", F.when(~hole, F.col("dosage")))
    want = genotypes.keep_called(holes, samples, 0.45).groupBy("variant").agg(F.count("dosage").alias("called"), *[F.sum(genotypes.fill_missing(s)).alias(f"carriers_{s}") for s in ("zero", "nan")])
    # A cell of no sample counts nowhere.
    stray = cells.unionByName(cells.sparkSession.createDataFrame([(999, 1, 2)], cells.schema))
    got = sparse.keep_called(stray, variants, samples, hole, 0.45)
    same(got, want, ["called", "carriers_zero", "carriers_nan"])
    assert 0 < got.count() < variants.count()
    # Pairs of samples and variants go no further than the count: neither joined with cells nor exchanged.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter, ((sample_id" not in plan and plan.count("Join Cross") + plan.count("Join Inner") == 1


def test_equal_means_of_different_counts_are_equal(spark):
    from carrierscan.plans.study import exact_mean

    rows = [(n, x) for n, xs in enumerate([[0.1], [0.1, 0.05, 0.15], [123456.78] * 7, [123456.78], [9e13, 9e13], [-0.1] * 3, [0.0]]) for x in xs]
    got = {r["g"]: r["m"] for r in spark.createDataFrame(rows, "g int, x double").groupBy("g").agg(exact_mean(F.col("x")).alias("m")).collect()}
    assert got == {0: 0.1, 1: 0.1, 2: 123456.78, 3: 123456.78, 4: 9e13, 5: -0.1, 6: 0.0}
