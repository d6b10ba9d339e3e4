"""The matched permutation scan of the cluster against plain loops over the contract: gates, light and heavy passes, all coefficients."""

import math

import numpy as np
import pytest

from carrierscan.operators import kernels as K
from carrierscan.operators import scans

SETTINGS = K.ScanSettings(match_k=2, min_treated=5, min_sample=10, max_smd=0.6, min_obs_coef=0.01, n_perm=40, n_perm_high=640, check_every=20, futility_p=0.5, p_threshold=0.4)
TERMS = ["intercept", "variant", "e", "variant:e", "c"]


def plainly_matched(arm, features, k):
    """Rows of the smaller arm, and all of the other within some base row's k-th distance."""
    ones, zeros = ([i for i, a in enumerate(arm) if a == x] for x in (1, 0))
    base, other = (ones, zeros) if len(ones) <= len(zeros) else (zeros, ones)
    taken = set(base)
    for i in base:
        far = sorted(math.dist(features[i], features[j]) for j in other)
        taken |= {j for j in other if math.dist(features[i], features[j]) <= far[min(k, len(far)) - 1] + 1e-9}
    return sorted(taken)


def plainly_fitted(rows, arm, y, e, c):
    x = np.array([[1.0, arm[i], e[i], arm[i] * e[i], c[i]] for i in rows])
    return np.linalg.pinv(x) @ np.array([y[i] for i in rows])


def smd(rows, arm, features):
    worst = 0.0
    for f in range(len(features[0])):
        a, b = ([features[i][f] for i in rows if arm[i] == x] for x in (1, 0))
        ma, mb = sum(a) / len(a), sum(b) / len(b)
        sd = math.sqrt((sum((x - ma) ** 2 for x in a) + sum((x - mb) ** 2 for x in b)) / (len(a) + len(b) - 2))
        worst = max(worst, abs(ma - mb) / sd if sd else 0.0)
    return worst


def plainly_scanned(label, arm, y, e, c, settings):
    """Gate, observed coefficients, and the coefficients of every permutation: light ones, then heavy ones by block."""
    known = [i for i in range(len(y)) if not any(math.isnan(v[i]) for v in (arm, y, e, c))]
    if min(sum(a == 1 for a in arm), sum(a == 0 for a in arm)) < settings.min_treated:
        return "too few in an arm", None, []
    arm, y, e, c = ([v[i] for i in known] for v in (arm, y, e, c))
    columns = []
    for v in (e, c):
        mean = sum(v) / len(v)
        sd = math.sqrt(sum((x - mean) ** 2 for x in v) / len(v))
        columns.append([(x - mean) / sd for x in v])
    features = list(zip(*columns, strict=True))
    rows = plainly_matched(arm, features, settings.match_k)
    if smd(rows, arm, features) > settings.max_smd:
        return "not balanced", None, []
    observed = plainly_fitted(rows, arm, y, e, c)
    if abs(observed[3]) < settings.min_obs_coef:
        return "small effect", observed, []

    def permuted(rng, count, stop):
        out = []
        for i in range(count):
            w = rng.permutation(np.array(arm))
            out.append(plainly_fitted(plainly_matched(w, features, settings.match_k), w, y, e, c))
            if stop and (i + 1) % settings.check_every == 0 and i + 1 < count and sum(abs(b[3]) >= abs(observed[3]) for b in out) / len(out) >= settings.futility_p:
                break
        return out

    seed = scans.label_seed(label)
    betas = permuted(np.random.default_rng(seed), settings.n_perm, True)
    if sum(abs(b[3]) >= abs(observed[3]) for b in betas) / len(betas) <= settings.p_threshold:
        for block, size in enumerate(K.blocks(settings.n_perm_high - settings.n_perm)):
            betas += permuted(np.random.default_rng([seed, block]), size, False)
    return "tested", observed, betas


@pytest.fixture(scope="module")
def study():
    random = np.random.default_rng(12)
    n = 64
    e, c = random.gamma(2.0, 1.0, n), np.round(random.standard_normal(n), 1)
    arms = {f"v{k}": np.where(random.random(n) < share, random.integers(1, 3, n), 0).astype(float) for k, share in enumerate((0.5, 0.35, 0.5, 0.45, 0.02))}
    arms["v5"] = (c > 0).astype(float)
    y = 60 + 1.5 * random.standard_normal(n) - 1.2 * (arms["v0"] > 0) * e + 0.5 * (arms["v1"] > 0) * e
    y[3], e[5] = np.nan, np.nan
    arms["v2"][[7, 9]] = np.nan
    return arms, y, e, c


def tables(spark, study):
    arms, y, e, c = study
    none = lambda x: None if np.isnan(x) else float(x)
    samples = spark.createDataFrame([(f"s{i:02}", none(y[i]), none(e[i]), none(c[i])) for i in range(len(y))], "sample_id string, y double, e double, c double")
    geno = spark.createDataFrame([(f"s{i:02}", v, None if np.isnan(x) else int(x)) for v, one in arms.items() for i, x in enumerate(one)] + [("other", "v0", 2)], "sample_id string, variant string, dosage int")
    return geno, scans.Covariates(samples, ["y", "e", "c"])


def carriers(one):
    return [math.nan if math.isnan(x) else float(x > 0) for x in one]


def test_both_passes_equal_a_plain_loop(spark, study):
    geno, cov = tables(spark, study)
    got = {r["variant"]: r for r in scans.two_phase_model(geno, cov, "y", ["e"], ["c"], SETTINGS, absent=math.nan).collect()}
    arms, y, e, c = study
    gates = set()
    for label, one in arms.items():
        gate, observed, betas = plainly_scanned(label, carriers(one), y, e, c, SETTINGS)
        r = got[label]
        gates.add(gate)
        assert (r["status"], r["gate"]) == ("done", gate)
        if gate == "tested":
            b = np.array([x[3] for x in betas])
            assert r["obs_coef"] == pytest.approx(observed[3]) and r["iterations"] == len(b)
            assert r["empirical_p"] == pytest.approx(np.mean(np.abs(b) >= abs(observed[3])))
            assert (r["mean_coef"], r["sd_coef"]) == (pytest.approx(b.mean()), pytest.approx(b.std()))
        else:
            assert r["empirical_p"] == 1.0 and r["iterations"] == 0
    assert gates >= {"tested", "too few in an arm", "not balanced"} and {got[f"v{k}"]["iterations"] for k in range(4)} >= {640}


def test_all_coefficients_equal_a_plain_loop(spark, study):
    geno, cov = tables(spark, study)
    settings = K.ScanSettings(match_k=2, max_smd=0.6, n_perm=25, n_perm_high=25, futility_p=2.0, p_threshold=-1.0, min_obs_coef=0.0)
    got = {(r["variant"], r["term"]): r for r in scans.full_model(geno, cov, "y", ["e"], ["c"], settings, absent=math.nan).collect()}
    arms, y, e, c = study
    some = 0
    for label, one in arms.items():
        gate, observed, betas = plainly_scanned(label, carriers(one), y, e, c, settings)
        if gate != "tested":
            assert (label, "variant") not in got
            continue
        some += 1
        for i, term in enumerate(TERMS):
            b, r = np.array([x[i] for x in betas]), got[label, term]
            assert r["obs"] == pytest.approx(observed[i]) and r["iterations"] == 25
            assert (r["perm_mean"], r["perm_sd"], r["p_emp"]) == (pytest.approx(b.mean()), pytest.approx(b.std()), pytest.approx(np.mean(np.abs(b) >= abs(observed[i]))))
    assert some >= 3


def test_copies_are_counted_and_matched_and_fitted_as_rows():
    random = np.random.default_rng(8)
    n, copies = 60, 40
    e, c, y = random.gamma(2.0, 1.0, n), random.integers(0, 3, n).astype(float), random.standard_normal(n)
    e[1], c[1] = e[0], c[0]
    one = np.column_stack([y, e, c])
    rows = np.tile(one, (copies, 1))[random.permutation(n * copies)]
    y, e, c = rows[:, 0], rows[:, 1:2], rows[:, 2:]
    points = K.points_of(y, e, c, 3)
    assert len(points.size) == n and (points.size == copies).all() and len(points.places) == n - 1
    features = K.scaled(np.column_stack([e, c]))
    for share in (0.02, 0.3, 0.8):
        v = (random.random(n * copies) < share).astype(float)
        arms = points.matched(points.carriers(v))
        at = K.matched_rows(v, features, 3)
        plain = [np.bincount(points.of[at][v[at] == a], minlength=n) for a in (1, 0)]
        assert arms.tolist() == np.array(plain).tolist()
        assert points.fit(arms) == pytest.approx(K.least_squares(K.design(v[at], e[at], c[at]), y[at]), rel=1e-9)
        assert K.largest_smd(arms, points.features) == pytest.approx(smd(at, v, features))
    drawn = np.array([points.permuted(v, random) for _ in range(3000)])
    assert (drawn.sum(axis=1) == v.sum()).all() and drawn.min() >= 0 and drawn.max() <= copies
    # Mean and variance of the hypergeometric law, which permuted rows have.
    p, total = v.mean(), n * copies
    assert drawn.mean(axis=0) == pytest.approx(np.full(n, copies * p), abs=0.35)
    assert drawn.var() == pytest.approx(copies * p * (1 - p) * (total - copies) / (total - 1), rel=0.03)


def test_fits_without_full_rank_have_least_norm():
    random = np.random.default_rng(9)
    y, e = random.standard_normal(30), random.standard_normal((30, 1))
    for c in (np.ones((30, 1)), 2 * e):
        points = K.points_of(y, e, c, 3)
        v = (random.random(30) < 0.5).astype(float)
        arms = np.stack([points.carriers(v), points.carriers(1 - v)])
        assert points.fit(arms) == pytest.approx(K.least_squares(K.design(v, e, c), y), rel=1e-6)


def test_blocks_of_many_variants_share_their_cells(spark, study, monkeypatch):
    geno, cov = tables(spark, study)
    arms, _, _, _ = study
    geno = geno.where("variant = 'v0'").selectExpr("sample_id", "explode(sequence(1, 40)) AS variant", "dosage")
    settings = K.ScanSettings(match_k=2, max_smd=9.0, n_perm=2, n_perm_high=702, futility_p=2.0, p_threshold=2.0, min_obs_coef=0.0)
    seen, plain = [], scans.per_variant
    monkeypatch.setattr(scans, "per_variant", lambda *args: seen.append(args[5].count() if len(args) > 5 else 0) or plain(*args))
    got = scans.two_phase_model(geno, cov, "y", ["e"], ["c"], settings, absent=math.nan).collect()
    assert len(got) == 40 and {(r["status"], r["iterations"]) for r in got} == {("done", 702)}
    # Two blocks each, and 32 rows are enough for four cores.
    assert seen == [0, 40]
