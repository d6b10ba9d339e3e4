"""Kernels and distributions against closed forms and the JVM's own distributions."""

import itertools
import math

import numpy as np
import pytest

from carrierscan.functions import distributions as D
from carrierscan.operators import kernels as K
from carrierscan.operators import scans, statistics


def test_distributions_match_the_jvm(spark):
    m = spark.sparkContext._jvm.org.apache.commons.math3.distribution
    for x, df in ((0.3, 3), (2.0, 10), (5.5, 40)):
        assert D.t_two_sided(x, df) == pytest.approx(2 * (1 - m.TDistribution(float(df)).cumulativeProbability(x)), rel=1e-8)
        assert D.chi2_sf(x, df) == pytest.approx(1 - m.ChiSquaredDistribution(float(df)).cumulativeProbability(x), rel=1e-8)
        assert D.f_sf(x, df, 7) == pytest.approx(1 - m.FDistribution(float(df), 7.0).cumulativeProbability(x), rel=1e-8)
    assert D.binomial_sf(3, 10, 0.2) == pytest.approx(1 - m.BinomialDistribution(10, 0.2).cumulativeProbability(2), rel=1e-10)
    assert D.normal_quantile(np.array([0.025, 0.5, 0.975])) == pytest.approx([-1.959964, 0, 1.959964], abs=1e-6)


def test_rank_sum_exact_and_tied():
    x, y = np.array([1.1, 2.2, 5.5]), np.array([0.3, 3.3, 4.4, 6.6])
    both = np.concatenate([x, y])
    u, p, effect = D.mann_whitney(x, y)
    assert u == sum(a > b for a in x for b in y) and effect == pytest.approx(1 - 2 * u / 12)
    stats = [sum(both[i] > both[j] for i in pick for j in range(7) if j not in pick) for pick in itertools.combinations(range(7), 3)]
    assert p == pytest.approx(min(1, 2 * np.mean([s >= max(u, 12 - u) for s in stats])))
    assert D.mann_whitney(np.ones(5), np.ones(6))[1] == 1.0


def test_tables():
    assert D.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert D.chi2_table(np.array([[10, 20], [30, 40.0]]))[0] == pytest.approx(0.446428571)


def study(n=400, seed=0):
    r = np.random.default_rng(seed)
    v, e, c = (r.random(n) < 0.3).astype(float), r.normal(size=n), r.normal(size=(n, 1))
    return v, e, c, 60 + 2 * v - e + 3 * v * e + r.normal(size=n), r


def test_interaction_coefficient_is_the_difference_of_slopes():
    v, e, _, y, _ = study()
    slopes = [np.polyfit(e[v == a], y[v == a], 1)[0] for a in (1, 0)]
    assert K.interaction_beta(v, y, e[:, None], np.zeros((len(v), 0))) == pytest.approx(slopes[0] - slopes[1])


def test_matching_takes_all_ties():
    v = np.array([1, 0, 0, 0, 0, 0.0])
    f = np.array([[0], [1], [-1], [2], [2], [9.0]])
    assert K.matched_rows(v, f, 1).tolist() == [0, 1, 2]
    assert K.matched_rows(v, f, 3).tolist() == [0, 1, 2, 3, 4]
    assert K.matched_rows(np.array([1, 1, 0, 0.0]), np.zeros((4, 1)), 1).tolist() == [0, 1, 2, 3]


def test_scan_gates_and_power():
    v, e, c, y, _ = study()
    s = K.ScanSettings(n_perm=60, n_perm_high=120, check_every=30, max_smd=1.0)
    got = K.interaction_scan(v, y, e[:, None], c, s, 1)
    assert got["gate"] == "tested" and got["empirical_p"] < 0.05 and got["iterations"] == 120
    assert got == K.interaction_scan(v, y, e[:, None], c, s, 1)
    few = np.zeros(len(v))
    few[:4] = 1
    assert K.interaction_scan(few, y, e[:, None], c, s, 1)["gate"] == "too few in an arm"
    flat = K.interaction_scan(v, y - 3 * v * e, e[:, None], c, s, 1)
    assert flat["gate"] == "small effect" and flat["empirical_p"] == 1.0


def test_robust_errors_and_tests():
    v, e, c, y, r = study(3000)
    x = K.design(v, e[:, None], c)
    beta, se = K.robust_ols(x, y)
    plain = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * ((y - x @ beta) ** 2).sum() / (len(y) - x.shape[1]))
    assert se == pytest.approx(plain, rel=0.15)
    assert K.interaction_test(v, y, e, c)["pval"] < 1e-6
    binary = (r.random(len(v)) < 1 / (1 + np.exp(-(0.2 + 1.5 * v * e)))).astype(float)
    fit = K.robust_logit(x, binary)
    assert fit[0][3] == pytest.approx(1.5, abs=0.4)
    assert K.breusch_pagan(x, y * 1.0)[1] > 1e-4
    assert K.breusch_pagan(x, y + v * r.normal(size=len(v)) * 6)[1] < 1e-6
    assert K.freedman_lane(v, y, e, c, 50, r)[1] == pytest.approx(1 / 51)


def test_levene_and_quantiles():
    r = np.random.default_rng(1)
    a, b = r.normal(size=200), 3 * r.normal(size=200)
    v, y = np.repeat([0.0, 1.0], 200), np.concatenate([a, b])
    assert K.levene_permutation(v, y, 40, r)[1] == pytest.approx(1 / 41)
    assert K.quantile_index(v, y) > 1
    assert K.quantile_index(v[:5], y[:5]) is None
    line = K.quantile_fit(np.column_stack([np.ones(400), v]), y, 0.5)
    assert line[0] == pytest.approx(np.median(a), abs=0.1)
    assert K.variance_scan(v, y, 20, r)["p"] < 0.01


def test_seeds_do_not_depend_on_partitions(spark):
    from carrierscan.functions.expressions import stable_seed
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("1_100_A_G",)], "v string").select(stable_seed(F.col("v"))).head()
    assert row[0] == scans.label_seed("1_100_A_G")


def test_transforms():
    y = np.array([1.0, 2, 2, 50, math.nan])
    assert np.isnan(scans.transformed(y, "rint")[4]) and scans.transformed(y, "rint")[1] == scans.transformed(y, "rint")[2]
    assert scans.transformed(y, "log")[0] == pytest.approx(math.log(2))


def brute_matches(v, features, k):
    """All distances at once."""
    one, zero = np.flatnonzero(v == 1), np.flatnonzero(v == 0)
    base, other = (one, zero) if len(one) <= len(zero) else (zero, one)
    d = np.sqrt(((features[base][:, None, :] - features[other][None, :, :]) ** 2).sum(axis=2))
    kth = np.sort(d, axis=1)[:, k - 1]
    return np.sort(np.concatenate([base, other[(d <= kth[:, None] + K.TIE).any(axis=0)]])).tolist()


def test_neighbour_lists_give_the_matches_of_all_distances():
    r = np.random.default_rng(3)
    for n, features in ((700, r.normal(size=(700, 2))), (700, r.integers(0, 4, (700, 2)).astype(float)), (20, r.normal(size=(20, 3))), (500, np.column_stack([r.normal(size=500), r.integers(0, 3, 500)]))):
        near = K.neighbours(features, 3)
        for share in (0.05, 0.5, 0.9):
            v = np.zeros(n)
            v[r.permutation(n)[: int(n * share)]] = 1
            want = brute_matches(v, features, 3)
            assert K.matched_rows(v, features, 3, near).tolist() == want == K.matched_rows(v, features, 3).tolist()


def test_registered_queries_do_the_settings_own_counts(spark, monkeypatch):
    from carrierscan.config import StudyConfig
    from carrierscan.plans import queries

    seen = {}
    for name in ("two_phase_model", "onset_intervals", "permutation_checks", "variance_scan"):
        monkeypatch.setattr(scans, name, lambda *args, name=name, **_: seen.update({name: args}))
    monkeypatch.setattr(queries.statistics, "benjamini_hochberg", lambda *_: None)
    monkeypatch.setattr(queries.pipelines, "variance_candidates", lambda *_: None)
    monkeypatch.setattr(queries, "_covariates", lambda *_: None)
    for name in ("interaction_permutation", "onset_bootstrap", "permutation_checks", "variance_scan"):
        queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    config = StudyConfig()
    settings = seen["two_phase_model"][5]
    assert (settings.n_perm, settings.n_perm_high, settings.check_every) == (config.n_perm, config.n_perm_high, config.check_every)
    assert seen["onset_intervals"][3] == config.n_boot
    assert seen["permutation_checks"][5] == config.n_perm_high
    assert seen["variance_scan"][3] == config.scan_reps


def test_blocks_over_tasks_give_one_tasks_result(spark):
    v, e, c, y, _ = study(300)
    samples = spark.createDataFrame([(i, float(y[i]), float(e[i]), float(c[i, 0])) for i in range(len(v))], "sample_id long, y double, e double, c double")
    geno = spark.createDataFrame([("1_1_A_G", i, int(v[i])) for i in range(len(v)) if v[i]] + [("1_2_A_G", i, 1) for i in range(0, 300, 2)], "variant string, sample_id long, dosage int")
    cov = scans.Covariates(samples, ["y", "e", "c"])
    s = K.ScanSettings(n_perm=60, n_perm_high=1260, check_every=30, max_smd=1.0, min_obs_coef=0.0)
    one = {r["variant"]: r for r in scans.interaction_model(geno, cov, "y", ["e"], ["c"], s).collect()}
    spread = {r["variant"]: r for r in scans.two_phase_model(geno, cov, "y", ["e"], ["c"], s).collect()}
    assert set(one) == set(spread) == {"1_1_A_G", "1_2_A_G"} and one["1_1_A_G"]["iterations"] == 1260
    for variant, row in one.items():
        got, want = spread[variant].asDict(), row.asDict()
        assert {k: got[k] for k in got if not isinstance(got[k], float)} == {k: want[k] for k in want if not isinstance(want[k], float)}
        assert [got[k] for k in got if isinstance(got[k], float)] == pytest.approx([want[k] for k in got if isinstance(got[k], float)])
    checks = {r["variant"]: r for r in scans.permutation_checks(geno, cov, "y", ["e"], ["c"], 1100, absent=0.0).collect()}
    assert checks["1_1_A_G"]["n_perm_valid"] == 1100 and checks["1_1_A_G"]["empirical_pval"] == pytest.approx(1 / 1101)
    assert checks["1_2_A_G"]["levene_p"] > 0.001


def test_table_tests_choose_and_give_p(spark):
    counts = {"few": [[3, 9], [8, 2]], "many": [[12, 30], [25, 14]], "three": [[12, 3], [25, 14], [4, 9]], "single": [[5, 6]], "one_arm": [[5, 0], [7, 0]]}
    rows = [(name, arm, f"l{i}") for name, cells in counts.items() for i, (one, zero) in enumerate(cells) for arm, k in ((1, one), (0, zero)) for _ in range(k)]
    rows += [("few", 1, None), ("few", None, "l0")]
    found = {r["g"]: r for r in scans.table_p(statistics.table_test(spark.createDataFrame(rows, "g string, arm int, level string"), "arm", "level", ["g"])).collect()}
    assert {g: r["test"] for g, r in found.items()} == {"few": "fisher", "many": "chi2", "three": "chi2", "single": "chi2", "one_arm": "fisher"}
    assert found["few"]["p"] == pytest.approx(D.fisher_exact(3, 9, 8, 2))
    for g in ("many", "three"):
        assert (found[g]["statistic"], found[g]["p"]) == pytest.approx(D.chi2_table(np.array(counts[g])))
    assert found["single"]["p"] is None and found["one_arm"]["statistic"] is None and found["one_arm"]["p"] is None


def test_welch_matches_kernel(spark):
    x = {1: [1.0, 2.5, 4.0, 9.0], 0: [2.0, 2.0, 7.5, 8.0, 1.5]}
    rows = [("a", a, v) for a, values in x.items() for v in values] + [("b", 1, 3.0), ("b", 0, 3.0)]
    found = {r["g"]: r for r in statistics.welch_test(spark.createDataFrame(rows, "g string, arm int, y double"), "y", "arm", ["g"]).collect()}
    t, p, d = D.welch(np.array(x[1]), np.array(x[0]))
    assert (found["a"]["t"], D.t_two_sided(found["a"]["t"], found["a"]["df"]), found["a"]["d"]) == pytest.approx((t, p, d))
    assert found["b"]["t"] is None


def shapiro(x):
    x = np.sort(np.array(x, float))
    m = D.normal_scores(np.arange(1, len(x) + 1), len(x))
    return D.shapiro_wilk(len(x), float(m @ x), float(m @ m), tuple(x[:2]), tuple(x[-2:]), float(((x - x.mean()) ** 2).sum()))


def test_shapiro_wilk_of_published_samples():
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    skewed = [0.11, 7.87, 4.61, 10.14, 7.95, 3.14, 0.46, 4.43, 0.21, 4.75, 0.71, 1.52, 3.24, 0.93, 0.42, 4.97, 9.53, 4.55, 0.47, 6.66]
    assert shapiro(weights) == pytest.approx((0.78881, 0.006704), rel=1e-4)
    assert shapiro(skewed) == pytest.approx((0.900473, 0.0420897), rel=1e-5)
    assert np.isnan(shapiro(range(7))[0]) and shapiro([3.0] * 9) == (1.0, 1.0)


def test_descriptive_tests_of_numbers(spark):
    r = np.random.default_rng(5)
    samples = {
        "normal": (r.normal(5, 1, 60), r.normal(5.5, 2, 40)),
        "skewed": (r.exponential(1, 60), r.normal(1, 1, 40)),
        "ties": (r.integers(0, 3, 50).astype(float), r.integers(0, 4, 30).astype(float)),
        "exact": (r.normal(0, 1, 7), r.exponential(1, 90) ** 2),
        "few": (r.normal(0, 1, 3), r.normal(0, 1, 4)),
        "flat": (np.ones(9), np.ones(10)),
        "one": (np.ones(1), r.normal(0, 1, 4)),
    }
    rows = [(k, a, float(x)) for k, pair in samples.items() for a, arm in zip((1, 0), pair, strict=True) for x in arm]
    rows += [("normal", 1, None), ("normal", None, 3.0), ("empty", 1, None), ("one arm", 1, 2.0)]
    df = spark.createDataFrame(rows, "g string, arm int, x double")
    got = {row["g"]: row for row in scans.numeric_test(df, "x", "arm", ["g"]).collect()}
    for k, (one, zero) in samples.items():
        normal = all(len(x) < 8 or shapiro(x)[1] > 0.05 for x in (one, zero))
        assert got[k]["test"] == ("welch" if normal else "rank_sum")
        if k in ("flat", "one"):
            assert got[k]["p"] is None
            continue
        want = D.welch(one, zero)[:2] if normal else D.mann_whitney(one, zero)[:2]
        assert (got[k]["statistic"], got[k]["p"]) == pytest.approx(want, rel=1e-9)
    assert {got[k]["test"] for k in ("skewed", "ties", "exact")} == {"rank_sum"} and got["normal"]["test"] == "welch"
    assert (got["normal"]["n1"], got["normal"]["n0"]) == (60, 40) and got["empty"]["p"] is None and got["one arm"]["p"] is None
    ranks = scans.rank_sum_p(statistics.rank_sum(df, "x", "arm", ["g"]))
    for row in ranks.where("g in ('normal', 'skewed', 'ties', 'exact', 'few', 'flat')").collect():
        assert row["p"] == pytest.approx(D.mann_whitney(*samples[row["g"]])[1], rel=1e-9)
    assert scans.numeric_test(df.limit(0), "x", "arm", ["g"]).count() == 0


def test_component_links(spark):
    r = np.random.default_rng(2)
    c = r.normal(size=(80, 2))
    e = c[:, 0] + r.normal(size=80)
    rows = [(*map(float, x), 7.0, float(y)) for x, y in zip(c, e, strict=True)] + [(None, 1.0, 7.0, 1.0), (1.0, 1.0, 7.0, None)]
    df = spark.createDataFrame(rows, "pc1 double, pc2 double, same double, e double")
    got = {x["component"]: x for x in scans.component_links(df, "e", ["pc1", "pc2", "same"]).collect()}
    x = np.column_stack([np.ones(80), c])
    off = e - x @ np.linalg.lstsq(x, e, rcond=None)[0]
    assert got["pc1"]["n"] == 80 and got["same"]["r"] is None and got["same"]["p"] is None
    assert got["pc1"]["joint_r2"] == pytest.approx(1 - (off @ off) / ((e - e.mean()) ** 2).sum())
    assert got["pc1"]["verdict"] == "main model"
    for i, name in enumerate(("pc1", "pc2")):
        one = np.corrcoef(c[:, i], e)[0, 1]
        assert got[name]["r"] == pytest.approx(one)
        assert got[name]["p"] == pytest.approx(D.t_two_sided(one * np.sqrt(78 / (1 - one**2)), 78))
    assert scans.component_links(df.limit(0), "e", ["pc1"]).head()["r"] is None


def test_coefficient_table():
    v, e, c, y, _ = study()
    s = K.ScanSettings(n_perm=40, max_smd=1.0, min_obs_coef=1e9)
    got = K.coefficient_table(v, y, e[:, None], c, s, 3)
    assert [x["iterations"] for x in got] == [40] * 5 and got == K.coefficient_table(v, y, e[:, None], c, s, 3)
    features = K.scaled(np.column_stack([e, c]))
    rows = K.matched_rows(v, features, s.match_k)
    x = np.column_stack([np.ones(len(rows)), v[rows], e[rows], (v * e)[rows], c[rows]])
    assert [g["obs"] for g in got] == pytest.approx(np.linalg.lstsq(x, y[rows], rcond=None)[0])
    r, fits = np.random.default_rng(3), []
    for _ in range(40):
        w = r.permutation(v)
        at = K.matched_rows(w, features, s.match_k)
        fits.append(np.linalg.lstsq(np.column_stack([np.ones(len(at)), w[at], e[at], (w * e)[at], c[at]]), y[at], rcond=None)[0])
    fits = np.array(fits)
    assert [g["perm_mean"] for g in got] == pytest.approx(fits.mean(axis=0))
    assert [g["perm_sd"] for g in got] == pytest.approx(fits.std(axis=0))
    assert [g["p_emp"] for g in got] == [np.mean(np.abs(fits[:, i]) >= abs(g["obs"])) for i, g in enumerate(got)]
    few = np.zeros(len(v))
    assert K.coefficient_table(few, y, e[:, None], c, s, 3) == []


def test_resampled_medians_follow_whole_resamples():
    r = np.random.default_rng(3)
    for n in (1, 2, 5, 40, 41):
        z = np.sort(r.standard_normal(n))
        whole, own = np.median(r.choice(z, (40_000, n)), axis=1), K.resampled_medians(z, 40_000, r)
        at = np.unique(np.concatenate([whole, own]))
        gap = np.abs(np.searchsorted(np.sort(whole), at, "right") - np.searchsorted(np.sort(own), at, "right")).max() / 40_000
        assert gap < 0.015
        assert set(own) <= set(np.add.outer(z, z).ravel() / 2)


def test_resamples_solved_at_once_are_bounded_and_change_nothing(monkeypatch):
    r = np.random.default_rng(4)
    v, y = r.integers(0, 3, 60).astype(float), r.standard_normal(60)
    seen, solve = [], K._three_level_index
    monkeypatch.setattr(K, "_three_level_index", lambda v, y, levels, weights, taus: seen.append(len(weights)) or solve(v, y, levels, weights, taus))
    one = K.bootstrap_indices(v, y, 9, np.random.default_rng(1))
    monkeypatch.setattr(K, "DRAWN", 130)
    assert K.bootstrap_indices(v, y, 9, np.random.default_rng(1)) == pytest.approx(one, abs=1e-12)
    assert seen[0] == 9 and max(seen[1:]) == 2


def test_shared_permutations_give_each_variants_own_result():
    r = np.random.default_rng(4)
    n, copies = 50, 6
    y, e, c = np.round(r.standard_normal(n), 1), r.standard_normal(n), r.integers(0, 3, n).astype(float)
    vs = [np.tile(r.integers(0, levels, n), copies).astype(float) for levels in (3, 2, 5, 1)]
    y, e, c = (np.tile(x, copies) for x in (y, e, c))
    vs[1][:20] = 1 - vs[1][:20]  # not every copy alike
    c = c[:, None]
    count = 200
    together = K.permutation_hits(vs, y, e, c, count, np.random.default_rng(7))
    for v, got in zip(vs, together, strict=True):
        assert got == pytest.approx(K.permutation_hits([v], y, e, c, count, np.random.default_rng(7))[0])
        assert got["beta_i_observed"] == pytest.approx(float((np.linalg.pinv(K.design(v, e[:, None], c)) @ y)[3]))
        stat = K.levene_stat([y[v == g] for g in np.unique(v)])
        assert got.get("levene_stat") == (None if stat is None else pytest.approx(stat))
    # The same permutations by a plain loop over rows: residuals of the model without the interaction, and dosages.
    order = np.lexsort(np.column_stack([c, e, y]).T)
    some = []
    for v, got in zip(vs[:3], together, strict=False):
        v, yy, x = v[order], y[order], K.design(v, e[:, None], c)[order]
        reduced = np.delete(x, 3, axis=1)
        resid = yy - reduced @ np.linalg.lstsq(reduced, yy, rcond=None)[0]
        rows, random, lane, spread = np.arange(len(v)), np.random.default_rng(7), 0, 0
        for _ in range(count):
            random.shuffle(rows)
            lane += abs(np.linalg.pinv(x)[3] @ (yy - resid + resid[rows])) >= abs(got["beta_i_observed"])
            spread += K.levene_stat([yy[v[rows] == g] for g in np.unique(v)]) >= got["levene_stat"]
        assert abs(lane - got["lane_hits"]) <= 1 and abs(spread - got["levene_hits"]) <= 1
        some.append((lane, spread))
    assert {0 < x < count for x, _ in some} == {True} and any(x > 0 for _, x in some)


def test_covariates_are_bounded_by_their_bytes(spark, monkeypatch):
    rows = spark.range(2_000_001).selectExpr("id AS sample_id", "double(id) AS x")
    cov = scans.Covariates(rows, ["x"])
    assert cov.count == 2_000_001 and cov.values["x"][-1] == 2_000_000.0
    assert cov.places.agg({"_at": "max"}).head()[0] == 2_000_000
    monkeypatch.setattr(scans, "MOST_BYTES", 8 * 99)
    few = spark.range(99).selectExpr("id AS sample_id", "double(id) AS x", "double(id) AS z")
    assert scans.Covariates(few, ["x"]).count == 99
    with pytest.raises(ValueError, match="more samples"):
        scans.Covariates(few, ["x", "z"])
