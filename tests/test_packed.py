"""Permuted arms as bits of words: matching and fits of every bit equal those of its rows."""

import numpy as np
import pytest

from carrierscan.operators import kernels as K
from carrierscan.operators import packed


@pytest.fixture(params=["apart", "copies", "ties", "ramp"])
def rows(request, monkeypatch):
    monkeypatch.setattr(K, "PACKED_FROM", 100)
    monkeypatch.setattr(packed, "LISTED", 20)
    monkeypatch.setattr(packed, "FIRST", 3)
    monkeypatch.setattr(packed, "ROWS", 70)
    r = np.random.default_rng(5)
    n = 500
    e = {"apart": r.uniform(-3, 3, n), "copies": np.repeat(r.uniform(-3, 3, n // 2), 2), "ties": r.integers(0, 400, n) / 100.0, "ramp": np.arange(n) * 6e-10}[request.param]
    return r, r.standard_normal(n), e[:, None], np.repeat([0.0, 40.0, 90.0], [200, 200, 100])[:, None]


@pytest.mark.parametrize("share", [0.1, 0.5, 0.8])
def test_each_bit_is_matched_and_fitted_as_its_rows(rows, share):
    r, y, e, c = rows
    n, k = len(y), 3
    points = K.Points(y, e, c, k)
    assert points.packed is not None
    features = K.scaled(np.column_stack([e, c]))
    m, count = int(share * n), 40
    words = packed.random_subsets(n, m, count, r)
    one, zero = points.packed.matched(words, m, count)
    for bit in range(count):
        v = np.zeros(n)
        v[points.packed.rows_of(words, bit)] = 1
        assert v.sum() == m
        want = K.matched_rows(v, features, k)
        arms = [points.packed.rows_of(w, bit) for w in (one, zero)]
        assert (v[arms[0]] == 1).all() and (v[arms[1]] == 0).all()
        assert sorted(np.concatenate(arms).tolist()) == want.tolist()
        if bit < 5:
            assert points.kept(v).tolist() == points.matched(points.carriers(v)).tolist()
    assert not (one | zero)[(words >> np.uint64(count)) != 0].any()
    sums = points.packed.sums(one, count)
    assert sums == pytest.approx(np.array([points.products[points.of[points.packed.rows_of(one, b)]].sum(axis=0) for b in range(count)]), abs=1e-9)


def test_fits_of_permuted_arms_equal_those_of_their_rows(rows):
    _, y, e, c = rows
    v = (np.arange(len(y)) % 3 == 0).astype(float)
    for z in (c, np.column_stack([c, 2 * e])):  # the second without full rank
        points = K.Points(y, e, z, 3)
        if points.packed is None:
            continue
        got = points.permuted_fits(v, 7, 10, np.random.default_rng(3))
        words = packed.random_subsets(len(v), int(v.sum()), 7, np.random.default_rng(3))
        features = K.scaled(np.column_stack([e, z]))
        for bit, beta in enumerate(got):
            w = np.zeros(len(v))
            w[points.packed.rows_of(words, bit)] = 1
            at = K.matched_rows(w, features, 3)
            assert beta == pytest.approx(K.least_squares(K.design(w[at], e[at], z[at]), y[at]), rel=1e-6, abs=1e-9)
    points = K.Points(y, e, c, 3)
    assert points.permuted_fits(v, 7, len(y) + 1, np.random.default_rng(3)) == [None] * 7


def test_permutations_by_words_end_where_single_ones_do(rows):
    _, y, e, c = rows
    v = (np.arange(len(y)) % 3 == 0).astype(float)
    points = K.Points(y, e, c, 3)
    settings = K.ScanSettings(n_perm=500)
    assert len(K.permuted_betas(v, points, settings, 500, np.random.default_rng(1), 0.0, 1.0)) == 100
    assert len(K.permuted_betas(v, points, settings, 130, np.random.default_rng(1))) == 130
    assert len(K.permuted_betas(v, points, settings, 250, np.random.default_rng(1), 2.0, 1.0)) == 250


@pytest.mark.parametrize(("n", "m"), [(40, 1), (40, 13), (40, 39), (7, 3)])
def test_random_subsets_have_the_law_of_permutations(n, m):
    r = np.random.default_rng(2)
    words = np.concatenate([packed.random_subsets(n, m, 64, r)[:, None] for _ in range(150)], axis=1)
    bits = np.unpackbits(words.view(np.uint8).reshape(n, -1), axis=1).astype(float)
    count = bits.shape[1]
    assert (bits.sum(axis=0) == m).all()
    p = m / n
    assert np.abs(bits.mean(axis=1) - p).max() < 5 * np.sqrt(p * (1 - p) / count)
    # Any two rows together, and any two bits.
    both = bits @ bits.T / count
    q = m * (m - 1) / (n * (n - 1))
    assert np.abs(both[np.triu_indices(n, 1)] - q).max() < 5.5 * np.sqrt(max(q * (1 - q), 1 / count) / count)
    shared = (bits[:, :4000].T @ bits[:, 4000:8000]).mean()
    assert shared == pytest.approx(m * m / n, rel=0.1)


def test_many_different_rows_are_packed_and_copies_are_not():
    r = np.random.default_rng(4)
    n = K.PACKED_FROM
    y, e, c = r.standard_normal(n), r.uniform(0, 1, (n, 1)), r.integers(0, 25, n)[:, None].astype(float)
    points = K.Points(y, e, c, 3)
    assert points.packed is not None
    v = (r.random(n) < 0.4).astype(float)
    betas = K.permuted_betas(v, points, K.ScanSettings(), 64, r)
    assert betas.shape == (64, 5) and "near" not in vars(points)
    copies = K.Points(*(np.repeat(x[: n // 8], 8, axis=0) for x in (y, e, c)), 3)
    assert copies.packed is None


def test_heavy_blocks_by_words_follow_the_light_ones(rows):
    r, y, e, c = rows
    v = (r.random(len(y)) < 0.5).astype(float)
    y = y + 30 * v * (e[:, 0] - e.mean()) / e.std()
    settings = K.ScanSettings(n_perm=100, n_perm_high=1200, min_obs_coef=0.0, max_smd=9.0)
    found = K.interaction_scan(v, y, e, c, settings, 5)
    assert found["gate"] == "tested" and found["iterations"] == 1200
    points = K.points_of(y, e, c, settings.match_k)
    assert points.packed is not None and "near" not in vars(points)
    light = K.interactions(K.permuted_betas(v, points, settings, 100, np.random.default_rng(5)), points)
    heavy = [K.heavy_block(v, y, e, c, settings, 5, b) for b in range(3)]
    assert [len(b) for b in heavy] == [500, 500, 100]
    betas = np.concatenate([light, *heavy])
    assert found["mean_coef"] == pytest.approx(betas.mean()) and found["empirical_p"] == np.mean(np.abs(betas) >= abs(found["obs_coef"]))
