"""Matching of many permuted arms at once: a row of a study has a word, whose bits are its arm in as many permutations."""

from __future__ import annotations

import numpy as np

#: Permutations of one word.
BITS = 64
#: Neighbours that a row's list holds, and those that are looked at for all rows before only the unsettled ones go on.
LISTED, FIRST = 32, 12
#: Rows whose words are worked on at once, so that they stay in a processor's cache.
ROWS = 1 << 14
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def random_subsets(n: int, m: int, count: int, rng: np.random.Generator) -> np.ndarray:
    """Words of ``n`` rows, of which bit by bit ``m`` random ones are set: the law of a permuted arm of ``m`` carriers.

    Bits are first drawn with about that chance each, then random ones are set or cleared until their number is right: given how many there are, the first draw is a uniform
    set of its size, and so is each that follows.
    """
    share = min(255, max(1, round(256 * m / n)))
    words = np.zeros(n, np.uint64)
    # From the share's last binary place on: OR with a random word for a one, AND for a zero.
    for place in range((share & -share).bit_length() - 1, 8):
        more = rng.integers(0, ONES, n, np.uint64, endpoint=True)
        words = words | more if share >> place & 1 else words & more
    words &= ONES >> np.uint64(BITS - count)
    for bit in range(count):
        flag = np.uint64(1 << bit)
        have = int(np.count_nonzero(words & flag))
        while have != m:
            # Rows in a random order, of which those count that are on the side that has too many.
            at = rng.integers(0, n, 2 * abs(have - m) + 64)
            at = at[((words[at] & flag) != 0) == (have > m)]
            at = at[np.sort(np.unique(at, return_index=True)[1])][: abs(have - m)]
            words[at] ^= flag
            have += -len(at) if have > m else len(at)
    return words


def by_line(features: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Rows in an order where neighbours are near, and in that order each row's ``count`` nearest other rows with their distances (a column for each row); none where that is not settled within lines.

    Rows that differ in one feature alone lie on a line, and their neighbours in its order are their nearest; exact where all of a list is nearer than the next line.
    """
    n = len(features)
    main = int(np.argmax([len(np.unique(f)) for f in features.T]))
    rest = np.delete(features, main, axis=1)
    order = np.lexsort([features[:, main], *rest.T])
    new = np.ones(n, bool)
    new[1:] = (rest[order[1:]] != rest[order[:-1]]).any(axis=1)
    start = np.flatnonzero(new)
    if n < 2 * count * len(start):
        return None
    lines = rest[order[start]]
    apart = np.full(len(lines), np.inf)
    for i, one in enumerate(lines if lines.shape[1] else ()):
        d = np.sqrt(((lines - one) ** 2).sum(axis=1))
        d[i] = np.inf
        apart[i] = d.min()
    end = np.append(start[1:], n)
    if (end - start).min() <= 2 * count:
        return None
    x = features[order, main]
    index, d = np.empty((count, n), np.int32), np.empty((count, n))
    line = np.cumsum(new) - 1
    for at in range(0, n, ROWS):
        rows = np.arange(at, min(n, at + ROWS))
        own, low, high = x[rows], start[line[rows]], end[line[rows]] - 1
        left, right = rows - 1, rows + 1
        for j in range(count):
            before = np.where(left >= low, own - x[np.maximum(left, 0)], np.inf)
            after = np.where(right <= high, x[np.minimum(right, n - 1)] - own, np.inf)
            turn = before <= after
            index[j, rows], d[j, rows] = np.where(turn, left, right), np.where(turn, before, after)
            left -= turn
            right += ~turn
    return None if (d[-1] + 1e-9 >= apart[line]).any() else (order, index, d)


class Packed:
    """Rows of a study with lists of their nearest rows. ``features`` tell distances, ``products`` (a row each) are summed."""

    def __init__(self, features: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray], products: np.ndarray, k: int, tie: float):
        self.order, index, d = lists
        self.n, self.k, self.tie = len(self.order), k, tie
        self.features, self.products = features[self.order], products[self.order]
        self.index = index
        self.tied = np.zeros(index.shape, np.int8)
        # Distances that follow each other within the tolerance, but reach further than it: such rows are compared with the whole other arm.
        self.odd = np.zeros(self.n, bool)
        since = d[0]
        for j in range(1, len(d)):
            self.tied[j] = -(d[j] - d[j - 1] <= tie).astype(np.int8)
            since = np.where(self.tied[j] < 0, since, d[j])
            self.odd |= d[j] - since > tie
        flat = index[:FIRST].ravel()
        self.edges = np.argsort(flat, kind="stable").astype(np.int32 if flat.size < 1 << 31 else np.int64)
        flat = flat[self.edges]
        self.begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        self.targets = flat[self.begin]

    def matched(self, one: np.ndarray, m: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of the carriers and of the others that matching keeps, of ``one``, ``m`` carriers in each of ``count`` bits."""
        used = ONES >> np.uint64(BITS - count)
        zero = ~one & used
        carriers_base = m <= self.n - m
        base, other = (one, zero) if carriers_base else (zero, one)
        taken = self._near(base, other, min(self.k, max(m, self.n - m))) & other
        return (base, taken) if carriers_base else (taken, base)

    def _near(self, base: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
        """Words of the rows that are among the ``k`` nearest of ``other`` of some row of ``base``, ties included; bits of rows that are not of ``other`` mean nothing."""
        first = min(FIRST, len(self.index))
        marks = np.empty((first, self.n), np.uint64)
        late, unsettled = [], []
        for start in range(0, self.n, ROWS):
            rows = slice(start, min(self.n, start + ROWS))
            active = np.where(self.odd[rows], np.uint64(0), base[rows])
            reached = [np.zeros(len(active), np.uint64) for _ in range(k)]
            for j in range(first):
                found = other[self.index[j, rows]]
                _step(active, found, reached, self.tied[j, rows])
                marks[j, rows] = found
            at = np.arange(rows.start, rows.stop)
            for j in range(first, len(self.index)):
                some = np.flatnonzero(active & (~reached[-1] | _word(self.tied[j, at])))
                if not len(some):
                    break
                at, active, reached = at[some], active[some], [r[some] for r in reached]
                to = self.index[j, at]
                found = other[to]
                _step(active, found, reached, self.tied[j, at])
                late.append((to, found))
            else:
                unsettled.append((at, active))
        taken = np.zeros(self.n, np.uint64)
        taken[self.targets] = np.bitwise_or.reduceat(marks.ravel()[self.edges], self.begin)
        for to, found in late:
            np.bitwise_or.at(taken, to, found)
        odd = np.flatnonzero(self.odd)
        for at, active in [*unsettled, (odd, base[odd])]:
            for row, word in zip(at[active != 0], active[active != 0].tolist(), strict=True):
                for bit in range(BITS):
                    if word >> bit & 1:
                        self._compare(row, np.uint64(1 << bit), other, k, taken)
        return taken

    def _compare(self, row: int, flag: np.uint64, other: np.ndarray, k: int, taken: np.ndarray) -> None:
        """A row whose list does not settle its nearest is compared with the whole other arm."""
        rows = np.flatnonzero(other & flag)
        d = np.sqrt(((self.features[rows] - self.features[row]) ** 2).sum(axis=1))
        taken[rows[d <= np.partition(d, k - 1)[k - 1] + self.tie]] |= flag

    def sums(self, words: np.ndarray, count: int) -> np.ndarray:
        """``(count, products)``: the products' sums over the rows of each bit."""
        out = np.zeros((BITS, self.products.shape[1]))
        for at in range(0, self.n, ROWS):
            bits = np.unpackbits(words[at : at + ROWS].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            out += bits.astype(float).T @ self.products[at : at + ROWS]
        return out[:count]

    def rows_of(self, words: np.ndarray, bit: int) -> np.ndarray:
        """The given rows that have the bit."""
        return self.order[(words & np.uint64(1 << bit)) != 0]


def _word(flag: np.ndarray) -> np.ndarray:
    """All bits for -1, none for 0."""
    return flag.astype(np.int64).view(np.uint64)


def _step(active: np.ndarray, found: np.ndarray, reached: list[np.ndarray], tied: np.ndarray) -> None:
    """Look at one more neighbour: bits that have enough end unless it is as near as the last; ``found`` keeps the bits that take it, ``reached`` those with at least 1, 2, ... neighbours."""
    active &= ~reached[-1] | _word(tied)
    found &= active
    for i in range(len(reached) - 1, 0, -1):
        reached[i] |= reached[i - 1] & found
    reached[0] |= found
