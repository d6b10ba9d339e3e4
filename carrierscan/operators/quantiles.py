"""Exact quantile regression on a dosage of three levels, for many taus and weightings at once."""

from __future__ import annotations

import numpy as np

#: Halvings of each bracket: a range shrinks to 1e-12 of it.
HALVINGS = 40


class _Level:
    """Sorted values of one dosage level with weights by replicate: sums of weights, and of weighted values, up to each place."""

    def __init__(self, values: np.ndarray, weights: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.values = values[order]
        zero = np.zeros((len(weights), 1))
        self.weight = np.concatenate([zero, np.cumsum(weights[:, order], axis=1)], axis=1)
        self.product = np.concatenate([zero, np.cumsum(weights[:, order] * self.values, axis=1)], axis=1)
        self.row = np.arange(len(weights))[:, None]
        # Of each place, the last value before it and the first from it on that the replicate has; the other one where there is none.
        has, n = weights[:, order] > 0, len(values)
        before = np.maximum.accumulate(np.where(has, np.arange(n), -1), axis=1)
        after = np.minimum.accumulate(np.where(has, np.arange(n), n)[:, ::-1], axis=1)[:, ::-1]
        none, end = np.full((len(weights), 1), -1), np.full((len(weights), 1), n)
        before, after = np.concatenate([none, before], axis=1), np.concatenate([after, end], axis=1)
        self.before, self.after = np.where(before < 0, after, before), np.where(after == n, before, after)

    def slopes(self, q: np.ndarray, tau: np.ndarray, side: str = "right") -> np.ndarray:
        """Derivative of the check loss at ``q`` (replicates by taus) from the right, or from the left."""
        return self.weight[self.row, np.searchsorted(self.values, q, side)] - tau * self.weight[:, -1:]

    def loss(self, q: np.ndarray, tau: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.values, q, "right")
        weight, product = self.weight[self.row, at], self.product[self.row, at]
        return tau * (self.product[:, -1:] - product - q * (self.weight[:, -1:] - weight)) + (1 - tau) * (q * weight - product)

    def near(self, q: np.ndarray) -> list[np.ndarray]:
        """The replicate's values on both sides of ``q``."""
        at = np.searchsorted(self.values, q)
        return [self.values[side[self.row, at]] for side in (self.before, self.after)]


def three_level_slopes(levels: np.ndarray, groups: list[np.ndarray], weights: list[np.ndarray], taus: np.ndarray) -> np.ndarray:
    """Slopes ``(replicates, taus)`` of the quantile regression of values on a dosage of three ``levels``, each an exact minimiser.

    ``groups`` are the values of each level, ``weights`` how often each replicate has them; each has some of every level. A line is its value in the middle level and its slope. The best slope for a middle value, and the
    best middle value, are zeros of monotone derivatives, which are sums of weights found by binary search; so both are found by halving, for all replicates and taus together, the least of several. The
    minimum is at a line through two values of different levels: of those next to what was found, the one of least loss is taken, of equals the nearest.
    """
    low, mid, high = (_Level(g, w) for g, w in zip(groups, weights, strict=True))
    down, up = levels[1] - levels[0], levels[2] - levels[1]
    tau = np.asarray(taus, float)[None, :]
    shape = (len(weights[0]), tau.shape[1])
    least, most = min(g.min() for g in groups), max(g.max() for g in groups)
    wide = (most - least + 1e-12 * max(abs(least), abs(most))) / min(down, up)
    a, b = np.full(shape, least), np.full(shape, most)

    def best_slope(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.full(shape, -wide), np.full(shape, wide)
        for _ in range(HALVINGS):
            s = (lo + hi) / 2
            rising = up * high.slopes(m + s * up, tau) - down * low.slopes(m - s * down, tau) >= 0
            hi, lo = np.where(rising, s, hi), np.where(rising, lo, s)
        return lo, hi

    for _ in range(HALVINGS):
        m = (a + b) / 2
        lo, hi = best_slope(m)
        # Derivatives of both outer levels at the best slope lie in these bounds, and balance each other.
        l0, u0 = low.slopes(m - hi * down, tau, "left"), low.slopes(m - lo * down, tau)
        l2, u2 = high.slopes(m + lo * up, tau, "left"), high.slopes(m + hi * up, tau)
        steepest = np.maximum(np.minimum(u0, u2 * up / down), np.maximum(l0, l2 * up / down))
        falls = steepest * (1 + down / up) + mid.slopes(m, tau) < 0
        a, b = np.where(falls, m, a), np.where(falls, b, m)
    m = (a + b) / 2
    lo, hi = best_slope(m)
    s = (lo + hi) / 2
    parts, fits = (low, mid, high), (m - s * down, m, m + s * up)
    best = slope = off = None
    for g, h in ((0, 1), (0, 2), (1, 2)):
        for x in parts[g].near(fits[g]):
            for y in parts[h].near(fits[h]):
                one = (y - x) / (levels[h] - levels[g])
                loss = sum(p.loss(x + one * (levels[k] - levels[g]), tau) for k, p in enumerate(parts))
                apart = np.abs(x - fits[g]) + np.abs(y - fits[h])
                if best is None:
                    best, slope, off = loss, one, apart
                    continue
                room = 1e-11 * (np.abs(loss) + np.abs(best))
                better = (loss < best - room) | ((loss <= best + room) & (apart < off))
                slope, off, best = np.where(better, one, slope), np.where(better, apart, off), np.minimum(loss, best)
    return slope
