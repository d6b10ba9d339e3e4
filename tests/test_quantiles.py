"""Three-level quantile regression against every line through two values, and the variance scan against refits of each resample."""

import itertools

import numpy as np
import pytest

from carrierscan.operators import kernels as K
from carrierscan.operators.quantiles import three_level_slopes


def loss(x, y, w, a, b, tau):
    r = y - a - b * x
    return float((w * np.where(r >= 0, tau * r, (tau - 1) * r)).sum())


def least_loss(x, y, w, tau):
    """The least check loss of all lines through two weighted values of different levels, and the slopes that have it."""
    found = []
    for i, j in itertools.combinations(np.flatnonzero(w), 2):
        if x[i] != x[j]:
            b = (y[j] - y[i]) / (x[j] - x[i])
            found.append((loss(x, y, w, y[i] - b * x[i], b, tau), b))
    least = min(found)[0]
    return least, [b for f, b in found if f <= least + 1e-9 * max(1, abs(least))]


@pytest.mark.parametrize("seed", range(8))
def test_every_slope_is_a_minimiser(seed):
    random = np.random.default_rng(seed)
    levels = np.array([0.0, 1.0, 2.0] if seed % 3 else [0.0, 0.5, 2.0])
    n = 12 + 5 * seed
    x = levels[np.r_[0, 1, 2, random.integers(0, 3, n - 3)]]
    y = np.round(random.standard_normal(n) * (1 + x), 1 if seed % 2 else 6)
    weights = np.array([np.ones(n, int), *(np.bincount(random.integers(0, n, n), minlength=n) for _ in range(5))])
    weights = weights[[all(w[x == g].sum() for g in levels) for w in weights]]
    taus = np.array([0.05, 0.25, 0.5, 0.7, 0.95])
    got = three_level_slopes(levels, [y[x == g] for g in levels], [weights[:, x == g] for g in levels], taus)
    for r, w in enumerate(weights):
        for t, tau in enumerate(taus):
            least, slopes = least_loss(x, y, w, tau)
            b = got[r, t]
            reached = min(loss(x, y, w, y[i] - b * x[i], b, tau) for i in np.flatnonzero(w))
            assert reached <= least + 1e-9 * max(1, abs(least)), (seed, r, tau)
            assert min(slopes) - 1e-9 <= b <= max(slopes) + 1e-9


def test_scan_of_three_levels_refits_each_resample():
    random = np.random.default_rng(3)
    v = random.integers(0, 3, 83).astype(float)
    y = random.standard_normal(83) * (1 + v)
    got = K.variance_scan(v, y, 60, np.random.default_rng(9))
    rng = np.random.default_rng(9)
    some = [K.quantile_index(v[r], y[r]) for r in (rng.integers(0, 83, 83) for _ in range(60))]
    assert got["beta_qi"] == pytest.approx(K.quantile_index(v, y)) and got["se"] == pytest.approx(np.std(some, ddof=1))
    # Where several lines are minimisers, any of their slopes will do.
    low = high = 0.0
    for tau in K.TAUS:
        lower, upper = (least_loss(v, y, np.ones(83, int), t)[1] for t in (tau, tau + 0.5))
        low, high = low + min(upper) - max(lower), high + max(upper) - min(lower)
    assert low / len(K.TAUS) - 1e-9 <= got["beta_qi"] <= high / len(K.TAUS) + 1e-9
