"""Permutations as shifts of random orders: sums and statistics equal those of the same permutations row by row."""

import numpy as np
import pytest

from carrierscan.operators import kernels as K
from carrierscan.operators import shifts


@pytest.mark.parametrize(("n", "count"), [(300, 40), (97, 97), (5000, 300), (50, 80)])
def test_sums_of_all_shifts(n, count):
    r = np.random.default_rng(1)
    moves = shifts.Shifts(n, count, r)
    x, z = r.standard_normal((2, n))
    got = moves.sums(moves.fixed(x), moves.moved(z))
    assert got == pytest.approx(np.array([x @ z[moves.drawn(s)] for s in range(count)]))
    assert sorted(moves.drawn(count - 1).tolist()) == list(range(n))


@pytest.mark.parametrize("width", [6.0, 0.4])
def test_hits_equal_a_plain_loop(monkeypatch, width):
    monkeypatch.setattr(K, "SHIFTED_FROM", 100)
    monkeypatch.setattr(shifts, "WIDTH", width)  # the narrow window leaves many medians to the whole order
    r = np.random.default_rng(4)
    n, count = 600, 200
    y, e, c = np.round(r.standard_normal(n), 2), r.standard_normal(n), r.integers(0, 3, n).astype(float)[:, None]
    vs = [r.choice(len(p), n, p=p).astype(float) for p in ([0.4, 0.4, 0.2], [0.5, 0.5], [0.3, 0.3, 0.2, 0.2], [1.0])]
    y = y + 0.1 * vs[0] * e
    got = K.permutation_hits(vs, y, e, c, count, np.random.default_rng(7))
    assert "levene_stat" not in got[3] and got[3]["beta_i_observed"] == pytest.approx(0, abs=9)
    for v, one in zip(vs[:3], got, strict=False):
        assert one == pytest.approx(K.permutation_hits([v], y, e, c, count, np.random.default_rng(7))[0])
        order = np.argsort(y, kind="stable")
        v, yy, x = v[order], y[order], K.design(v, e[:, None], c)[order]
        assert one["beta_i_observed"] == pytest.approx(float((np.linalg.pinv(x) @ yy)[3]))
        assert one["levene_stat"] == pytest.approx(K.levene_stat([yy[v == g] for g in np.unique(v)]))
        reduced = np.delete(x, 3, axis=1)
        resid = yy - reduced @ np.linalg.lstsq(reduced, yy, rcond=None)[0]
        moves, lane, spread = shifts.Shifts(n, count, np.random.default_rng(7)), 0, 0
        for s in range(count):
            rows = moves.drawn(s)
            lane += abs(np.linalg.pinv(x)[3] @ resid[rows]) >= abs(one["beta_i_observed"])
            spread += K.levene_stat([yy[v[rows] == g] for g in np.unique(v)]) >= one["levene_stat"]
        assert abs(lane - one["lane_hits"]) <= 1 and abs(spread - one["levene_hits"]) <= 1
        assert 0 < lane + spread < 2 * count


def test_shifts_have_the_law_of_permutations():
    r = np.random.default_rng(3)
    n, count = 40, 20
    x, z = np.sort(r.standard_normal((2, n)))  # orders of the rows must not matter
    x, z = x - x.mean(), z - z.mean()
    got = []
    for _ in range(2000):
        moves = shifts.Shifts(n, count, r)
        got.append(moves.sums(moves.fixed(x), moves.moved(z)))
    got = np.array(got)
    plain = np.array([x @ r.permutation(z) for _ in range(40_000)])
    assert got.mean() == pytest.approx(0, abs=0.15) and got.var() == pytest.approx((x @ x) * (z @ z) / (n - 1), rel=0.03)
    for q in (1, 5, 25, 75, 95, 99):
        assert np.percentile(got, q) == pytest.approx(np.percentile(plain, q), abs=0.06 * plain.std())
    apart = np.corrcoef(got.T)[np.triu_indices(count, 1)]
    assert apart.mean() == pytest.approx(-1 / (n - 1), abs=0.01)
