"""Permutations of many rows as shifts of two random orders: statistics that are sums over rows come for all shifts of a block at once.

Row ``a[i]`` meets row ``b[(i + s) mod n]`` for the shift ``s``, with random orders ``a`` and ``b``. So each shift is a permutation of uniform law, and values of a sum under two shifts of
one block are uncorrelated but for ``-1 / (n - 1)``. Blocks have orders of their own.
"""

from __future__ import annotations

import numpy as np

#: Length of one transform; rows of one segment are what the shifts leave of it.
LENGTH = 4096
#: Deviations of a group's median place that the window holds on both sides of the middle; a median outside is found among all rows.
WIDTH = 6.0


class Shifts:
    """``count`` shifts of two random orders of ``n`` rows."""

    def __init__(self, n: int, count: int, rng: np.random.Generator):
        self.n, self.count = n, count
        self.a, self.b = (rng.permutation(np.arange(n, dtype=np.int32)) for _ in range(2))
        length = LENGTH
        while length < 2 * count:
            length *= 2
        self.length, self.held = length, length - count

    def fixed(self, x: np.ndarray) -> np.ndarray:
        """Transforms of the segments of what stays: ``x`` of each row."""
        x = x[self.a].astype(float)
        x = np.concatenate([x, np.zeros(-len(x) % self.held)]).reshape(-1, self.held)
        return np.conj(np.fft.rfft(x, self.length))

    def moved(self, x: np.ndarray) -> np.ndarray:
        """Transforms of what each segment meets of ``x`` under all shifts."""
        segments = -(-self.n // self.held)
        x = np.resize(x[self.b].astype(float), (segments - 1) * self.held + self.length)
        view = np.lib.stride_tricks.as_strided(x, (segments, self.length), (self.held * x.itemsize, x.itemsize))
        return np.fft.rfft(view, self.length)

    def sums(self, fixed: np.ndarray, moved: np.ndarray) -> np.ndarray:
        """The sum of products over all rows, for each shift."""
        return np.fft.irfft(np.einsum("ij,ij->j", fixed, moved), self.length)[: self.count]

    def drawn(self, s: int) -> np.ndarray:
        """The row that each row meets under a shift."""
        out = np.empty(self.n, np.int64)
        out[self.a] = np.roll(self.b, -s)
        return out


class Middle:
    """Brown-Forsythe statistics of permuted labels over the sorted ``y``: sums over all rows come from shifts, medians from a window around the middle."""

    def __init__(self, y: np.ndarray, shifts: Shifts, least: int):
        n = len(y)
        self.n, self.shifts = n, shifts
        half = int(min(n, WIDTH * n / (2 * np.sqrt(max(1, least))) + 2))
        self.start, end = max(0, n // 2 - half), min(n, n // 2 + half + 1)
        self.u = y - y[n // 2]
        before = np.arange(n) < self.start
        self.sums = [(f.sum(), shifts.fixed(f)) for f in (self.u, self.u**2, before.astype(float), np.where(before, self.u, 0.0))]
        self.window = self.u[self.start : end]
        at = np.empty(n, np.int32)
        at[shifts.a] = np.arange(n, dtype=np.int32)
        self.at = at[self.start : end]

    def stats(self, label: np.ndarray, levels: int) -> np.ndarray:
        """The statistic of each shift; not a number where a median lies outside the window, or there is none."""
        shifts, sizes = self.shifts, np.bincount(label, minlength=levels)
        sums = np.empty((levels, len(self.sums), shifts.count))
        for g in range(levels - 1):
            moved = shifts.moved(label == g)
            for i, (_, fixed) in enumerate(self.sums):
                sums[g, i] = shifts.sums(fixed, moved)
        sums[-1] = np.array([total for total, _ in self.sums])[:, None] - sums[:-1].sum(axis=0)
        meets = np.concatenate([label[shifts.b], label[shifts.b[: shifts.count]]]).astype(np.int8)
        out = np.full(shifts.count, np.nan)
        used = [g for g in range(levels) if sizes[g] >= 2]
        if len(used) < 2:
            return out
        n = sizes[used].astype(float)
        for s in range(shifts.count):
            labels = meets[self.at + s]
            mean, within = np.empty(len(used)), 0.0
            for i, g in enumerate(used):
                u1, u2, c, p = sums[g, :, s]
                size, c = int(sizes[g]), round(c)
                places = np.flatnonzero(labels == g)
                low, high = (size - 1) // 2 - c, size // 2 - c
                if low < 0 or high >= len(places):
                    break
                middle = (self.window[places[low]] + self.window[places[high]]) / 2
                # Distances from the median: the whole less twice what lies below it.
                far = u1 - size * middle + 2 * (middle * (low + 1 + c) - p - self.window[places[: low + 1]].sum())
                mean[i] = far / size
                within += u2 - 2 * middle * u1 + size * middle * middle - far * mean[i]
            else:
                if within > 0:
                    out[s] = (n.sum() - len(n)) / (len(n) - 1) * (n @ (mean - n @ mean / n.sum()) ** 2) / within
        return out
