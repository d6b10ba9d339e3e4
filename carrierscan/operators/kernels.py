"""Estimators of one variant over numpy arrays. They know nothing of Spark: tasks call them per group."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import cached_property, lru_cache

import numpy as np

from carrierscan.functions import distributions as D
from carrierscan.operators import packed, shifts
from carrierscan.operators.quantiles import three_level_slopes

TIE = 1e-9


def design(v: np.ndarray, e: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Columns 1, v, E, v times E, C."""
    return np.column_stack([np.ones(len(v)), v, e, v[:, None] * e, c])


def least_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    """Minimum-norm coefficients; none with fewer rows than columns."""
    return None if len(y) < x.shape[1] else np.linalg.lstsq(x, y, rcond=None)[0]


def interaction_beta(v: np.ndarray, y: np.ndarray, e: np.ndarray, c: np.ndarray) -> float | None:
    beta = least_squares(design(v, e, c), y)
    return None if beta is None else float(beta[2 + e.shape[1]])


def scaled(features: np.ndarray) -> np.ndarray:
    """Features less their mean over the population deviation; gaps take the mean, constant features become 0."""
    mean = np.nanmean(features, axis=0)
    features = np.where(np.isnan(features), mean, features)
    sd = features.std(axis=0)
    return (features - mean) / np.where(sd > 0, sd, 1)


#: Rows of one leaf of the neighbour search, and distances that one step of a search holds at most.
LEAF, STEP = 64, 1 << 20


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def nearest_rows(features: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's ``count`` nearest rows, itself among them, by distance; and those distances. Exact: leaves are searched until none can be nearer."""
    n = len(features)
    count = min(count, n)
    leaves, todo = [], [np.arange(n)]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            leaves.append(rows)
            continue
        part = features[rows]
        order = rows[np.argsort(part[:, np.argmax(part.max(axis=0) - part.min(axis=0))], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    low, high = (np.array([f(features[rows], axis=0) for rows in leaves]) for f in (np.min, np.max))
    index, found = np.empty((n, count), np.int64), np.empty((n, count))
    for i, rows in enumerate(leaves):
        apart = np.sqrt((np.maximum(0, np.maximum(low - high[i], low[i] - high)) ** 2).sum(axis=1))
        order = np.argsort(apart, kind="stable")
        best = d = None
        at, wide = 0, 8 + 2 * count // LEAF
        while at < len(order) and (d is None or d.shape[1] < count or apart[order[at]] <= d.max() + TIE):
            more = np.concatenate([leaves[j] for j in order[at : at + wide]])
            d_more, more = distances(features[rows], features[more]), np.broadcast_to(more, (len(rows), len(more)))
            d, best = (d_more, more) if d is None else (np.concatenate([d, d_more], axis=1), np.concatenate([best, more], axis=1))
            if d.shape[1] > count:
                pick = np.argpartition(d, count - 1, axis=1)[:, :count]
                d, best = np.take_along_axis(d, pick, 1), np.take_along_axis(best, pick, 1)
            at += wide
        pick = np.argsort(d, axis=1, kind="stable")
        found[rows], index[rows] = np.take_along_axis(d, pick, 1), np.take_along_axis(best, pick, 1)
    return index, found


def neighbours(features: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists long enough to settle nearly every base row, since the other arm has at least half of the rows."""
    return nearest_rows(features.astype(float), 8 * k + 8)


def near_places(base: np.ndarray, other: np.ndarray, features: np.ndarray, k: int, near: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Which places are within some base row's k-th distance to the other arm, ties included. ``base`` and ``other`` count the arms' rows at each place.

    ``near`` may give ``nearest_rows`` of the features, which do not depend on the arms: a base place whose list cannot settle
    its k-th distance and all ties is compared with the whole other arm.
    """
    taken = np.zeros(len(features), bool)
    rest, others = np.flatnonzero(base), np.flatnonzero(other)
    k = min(k, other.sum())
    if not len(rest) or not len(others):
        return taken
    if near is not None:
        # A place with enough rows of the other arm has distance 0, and nothing else is that near but for a tie.
        own = (other[rest] >= k) & ((near[1][rest, 1] > TIE) if near[1].shape[1] > 1 else True)
        taken[rest[own]] = True
        rest = rest[~own]
        index, d = near[0][rest], near[1][rest]
        upto = np.cumsum(other[index], axis=1)
        kth = np.take_along_axis(d, np.argmax(upto >= k, axis=1)[:, None], 1)[:, 0]
        settled = (upto[:, -1] >= k) & ((kth + TIE < d[:, -1]) | (index.shape[1] == len(features)))
        taken[index[(d <= kth[:, None] + TIE) & settled[:, None]]] = True
        rest = rest[~settled]
    step = max(1, STEP // len(others))
    for at in range(0, len(rest), step):
        d = distances(features[rest[at : at + step]], features[others])
        order = np.argsort(d, axis=1)
        first = np.argmax(np.cumsum(other[others][order], axis=1) >= k, axis=1)
        kth = np.take_along_axis(d, np.take_along_axis(order, first[:, None], 1), 1)
        taken[others[(d <= kth + TIE).any(axis=0)]] = True
    return taken


def matched_rows(v: np.ndarray, features: np.ndarray, k: int, near: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The smaller arm (carriers when equal) and every row of the other within some base row's k-th distance, ties included."""
    one, zero = v == 1, v == 0
    base, other = (one, zero) if one.sum() <= zero.sum() else (zero, one)
    if not base.any() or not other.any():
        return np.zeros(0, int)
    return np.flatnonzero(base | other & near_places(base.astype(int), other.astype(int), features, k, near))


def largest_smd(arms: np.ndarray, features: np.ndarray) -> float:
    """Of both arms' counts of each row of ``features``."""
    n = arms.sum(axis=1)
    if n.min() < 2:
        return 0.0
    mean = arms @ features / n[:, None]
    sd = np.sqrt(sum(a @ (features - m) ** 2 for a, m in zip(arms, mean, strict=True)) / (n.sum() - 2))
    return float(np.where(sd > 0, np.abs(mean[0] - mean[1]) / np.where(sd > 0, sd, 1), 0).max(initial=0))


def equal_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each set of equal rows, and every row's set."""
    order = np.lexsort(x.T)
    new = np.ones(len(x), bool)
    new[1:] = (x[order[1:]] != x[order[:-1]]).any(axis=1)
    of = np.empty(len(x), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


#: Rows for each point from which on a permuted arm is drawn by point: a point's draw takes about ten times a row's.
DRAWN_BY_POINT = 10
#: Rows from which on permuted arms are words of bits, and rows of a place up to which they are: with more copies, counts of points are less work.
PACKED_FROM, PACKED_COPIES = 1 << 15, 4
#: Least eigenvalue of the scaled normal equations that are solved; others take the singular values of the design.
WELL = 1e-6


class Points:
    """Complete rows ``y, e, c`` of a study: equal rows are one point with their number, and points of equal ``e, c`` share a place.

    Arms are counts of points: matching and fits of permuted arms cost what the different rows do, however many copies each has.
    """

    def __init__(self, y: np.ndarray, e: np.ndarray, c: np.ndarray, k: int):
        features = scaled(np.column_stack([e, c]))
        first, self.of = equal_rows(np.column_stack([y, e, c]))
        self.size = np.bincount(self.of)
        self.y, self.e, self.c, self.features = y[first], e[first], c[first], features[first]
        at, self.place = equal_rows(self.features)
        self.places = self.features[at]
        self.k = k
        x = np.column_stack([self.y, self.e, self.c])
        self.middle, sd = x.mean(axis=0), x.std(axis=0)
        self.spread = np.where(sd > 0, sd, 1)
        x = np.column_stack([np.ones(len(x)), (x - self.middle) / self.spread])
        i, j = np.triu_indices(x.shape[1])
        self.products = x[:, i] * x[:, j]
        self.pair = np.empty((x.shape[1],) * 2, np.int64)
        self.pair[i, j] = self.pair[j, i] = np.arange(len(i))
        # The columns of ``design``: which of x they are, and whether times the arm.
        es, cs = 2 + np.arange(e.shape[1]), 2 + e.shape[1] + np.arange(c.shape[1])
        self.terms = np.concatenate([[0, 0], es, es, cs])
        self.armed = np.concatenate([[False, True], np.zeros(len(es), bool), np.ones(len(es), bool), np.zeros(len(cs), bool)])

    @cached_property
    def near(self) -> tuple[np.ndarray, np.ndarray]:
        return neighbours(self.places, self.k)

    @cached_property
    def packed(self) -> packed.Packed | None:
        """The rows for permutations by words, where they are many and mostly different."""
        if not max(PACKED_FROM, 1) <= len(self.of) <= PACKED_COPIES * len(self.places):
            return None
        features = self.features[self.of]
        lists = packed.by_line(features, packed.LISTED)
        return lists and packed.Packed(features, lists, self.products[self.of], self.k, TIE)

    def carriers(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights=v == 1, minlength=len(self.size))

    def permuted(self, v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Carriers of each point when the arm is permuted; where points are few, drawn by their own law (hypergeometric), which is the same."""
        if DRAWN_BY_POINT * len(self.size) > len(v):
            return self.carriers(rng.permutation(v))
        return rng.multivariate_hypergeometric(self.size, int((v == 1).sum()), method="marginals").astype(float)

    def matched(self, one: np.ndarray) -> np.ndarray:
        """How many carriers and others of each point matching keeps, of ``one`` carriers: the rows of ``matched_rows``."""
        arms = np.stack([one, self.size - one])
        n = arms.sum(axis=1)
        if not n.all():
            return np.zeros_like(arms)
        base = int(n[0] > n[1])
        held = [np.bincount(self.place, weights=a, minlength=len(self.places)) for a in arms]
        arms[1 - base] *= near_places(held[base], held[1 - base], self.places, self.k, self.near)[self.place]
        return arms

    def kept(self, v: np.ndarray) -> np.ndarray:
        """``matched`` of the arm that the rows have."""
        m = int((v == 1).sum())
        if self.packed is None or not 0 < m < len(v):
            return self.matched(self.carriers(v))
        order = self.packed.order
        words = self.packed.matched((v[order] == 1).astype(np.uint64), m, 1)
        return np.stack([np.bincount(self.of[order], weights=w.astype(float), minlength=len(self.size)) for w in words])

    def permuted_fits(self, v: np.ndarray, count: int, least: int, rng: np.random.Generator) -> list[np.ndarray | None]:
        """Coefficients after ``count`` permutations of the arm, matched and fitted; none with fewer rows than ``least`` or columns."""
        m = int((v == 1).sum())
        if self.packed is None or not 0 < m < len(v):
            arms = (self.matched(self.permuted(v, rng)) for _ in range(count))
            return [self.fit(a) if a.sum() >= least else None for a in arms]
        one, zero = self.packed.matched(packed.random_subsets(len(v), m, count, rng), m, count)
        sums = [self.packed.sums(w, count) for w in (one, zero)]
        # The first product is of ones: how many rows there are.
        enough = sums[0][:, 0] + sums[1][:, 0] >= max(least, len(self.terms))
        betas, good = self._solved(*sums)
        out: list[np.ndarray | None] = [b if e else None for b, e in zip(betas, enough, strict=True)]
        for bit in np.flatnonzero(enough & ~good):
            of = [self.of[self.packed.rows_of(w, bit)] for w in (one, zero)]
            out[bit] = self._fit_design(np.stack([np.bincount(rows, minlength=len(self.size)).astype(float) for rows in of]))
        return out

    def fit(self, arms: np.ndarray) -> np.ndarray | None:
        """Coefficients of ``design`` over so many carriers and others of each point; none with fewer rows than columns."""
        if arms.sum() < len(self.terms):
            return None
        betas, good = self._solved(*(arms @ self.products)[:, None])
        return betas[0] if good[0] else self._fit_design(arms)

    def _solved(self, one: np.ndarray, zero: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients from sums of products over carriers and over others, a row for each fit; and which are well determined."""
        one, zero = one[:, self.pair], zero[:, self.pair]
        both = np.ix_(range(len(one)), self.terms, self.terms)
        gram = np.where(self.armed[:, None] | self.armed, one[both], (one + zero)[both])
        right = np.where(self.armed, one[:, self.terms, 1], (one + zero)[:, self.terms, 1])
        size = np.sqrt(np.maximum(0, np.diagonal(gram, axis1=1, axis2=2)))
        good = (size > 0).all(axis=1)
        size = np.where(good[:, None], size, 1.0)
        gram = np.where(good[:, None, None], gram / (size[:, :, None] * size[:, None, :]), np.eye(len(self.terms)))
        good &= np.linalg.eigvalsh(gram)[:, 0] >= WELL
        gram = np.where(good[:, None, None], gram, np.eye(len(self.terms)))
        b = np.linalg.solve(gram, (right / size)[:, :, None])[:, :, 0] / size
        # From centred and scaled columns to the given ones.
        b *= self.spread[0] / np.concatenate([[1.0], self.spread[1:]])[np.maximum(0, self.terms - 1)]
        shift = b * np.concatenate([[0.0], self.middle[1:]])[np.maximum(0, self.terms - 1)]
        b[:, 0] += self.middle[0] - shift[:, ~self.armed].sum(axis=1)
        b[:, 1] -= shift[:, self.armed].sum(axis=1)
        return b, good

    def _fit_design(self, arms: np.ndarray) -> np.ndarray:
        """Minimum-norm coefficients, by the design's singular values."""
        v, rows = np.nonzero(arms)
        weight = np.sqrt(arms[v, rows])
        return np.linalg.lstsq(design(1.0 - v, self.e[rows], self.c[rows]) * weight[:, None], self.y[rows] * weight, rcond=None)[0]


@lru_cache(maxsize=1)
def _points(data: bytes, exposures: int, columns: int, k: int) -> Points:
    x = np.frombuffer(data).reshape(-1, columns)
    return Points(x[:, 0], x[:, 1 : 1 + exposures], x[:, 1 + exposures :], k)


def points_of(y: np.ndarray, e: np.ndarray, c: np.ndarray, k: int) -> Points:
    """Variants with the same complete rows share a worker's."""
    x = np.column_stack([y, e, c]).astype(float)
    return _points(x.tobytes(), e.shape[1], x.shape[1], k)


@dataclass(frozen=True)
class ScanSettings:
    """Gates and permutation counts of the interaction scan."""

    match_k: int = 3
    min_treated: int = 5
    min_sample: int = 10
    max_smd: float = 0.25
    min_obs_coef: float = 2.0
    n_perm: int = 500
    n_perm_high: int = 10_000
    check_every: int = 100
    futility_p: float = 0.5
    p_threshold: float = 0.05


#: Permutations of the heavy pass that one task does: each block has a generator of its own.
BLOCK = 500


def blocks(count: int) -> list[int]:
    """Sizes of the blocks that ``count`` replicates are dealt to."""
    return [min(BLOCK, count - at) for at in range(0, count, BLOCK)]


def permuted_betas(v: np.ndarray, points: Points, settings: ScanSettings, count: int, rng: np.random.Generator, stop_at: float | None = None, observed: float = 0.0) -> np.ndarray:
    """Coefficients after permuting the arm, matching and fitting anew, a row each; stops early where the interaction's significance is out of reach."""
    out, step = [], packed.BITS if points.packed is not None else 1
    for at in range(0, count, step):
        for i, beta in enumerate(points.permuted_fits(v, min(step, count - at), settings.min_sample, rng), at):
            if beta is not None:
                out.append(beta)
            if stop_at is not None and (i + 1) % settings.check_every == 0 and i + 1 < count and out and np.mean(np.abs(interactions(out, points)) >= abs(observed)) >= stop_at:
                return np.array(out)
    return np.array(out).reshape(len(out), len(points.terms))


def interactions(betas: np.ndarray | list[np.ndarray], points: Points) -> np.ndarray:
    """Of rows of coefficients, that of the first exposure's interaction."""
    return np.array([b[2 + points.e.shape[1]] for b in betas])


def gated(v: np.ndarray, y: np.ndarray, e: np.ndarray, c: np.ndarray, settings: ScanSettings) -> tuple[dict, tuple | None]:
    """The gates' row and, where all pass, the complete rows' arm and ``Points``. A gate that fails gives p = 1 and its name; the order of gates matters."""
    known = ~(np.isnan(v) | np.isnan(y) | np.isnan(e).any(axis=1) | np.isnan(c).any(axis=1))
    empty = {"obs_coef": None, "mean_coef": None, "sd_coef": None, "empirical_p": 1.0, "iterations": 0, "max_smd": None, "n_matched": 0}
    counts = {"n_carrier": int((v == 1).sum()), "n_noncarrier": int((v == 0).sum())}
    if min(counts.values()) < settings.min_treated:
        return empty | counts | {"gate": "too few in an arm"}, None
    v, y, e, c = v[known], y[known], e[known], c[known]
    if len(v) < settings.min_sample:
        return empty | counts | {"gate": "too few rows"}, None
    points = points_of(y, e, c, settings.match_k)
    arms = points.kept(v)
    n_matched = int(arms.sum())
    if n_matched < settings.min_sample:
        return empty | counts | {"gate": "too few matched"}, None
    smd = largest_smd(arms, points.features)
    counts |= {"max_smd": smd, "n_matched": n_matched}
    if smd > settings.max_smd:
        return empty | counts | {"gate": "not balanced"}, None
    beta = points.fit(arms)
    if beta is None:
        return empty | counts | {"gate": "no fit"}, None
    observed = float(interactions([beta], points)[0])
    if abs(observed) < settings.min_obs_coef:
        return empty | counts | {"obs_coef": observed, "gate": "small effect"}, None
    return empty | counts | {"obs_coef": observed, "gate": "tested"}, (v, points)


def light_scan(v: np.ndarray, y: np.ndarray, e: np.ndarray, c: np.ndarray, settings: ScanSettings, seed: int) -> tuple[dict, np.ndarray]:
    """One variant's gated interaction test with the light permutations alone, and their coefficients."""
    found, rows = gated(v, y, e, c, settings)
    if rows is None:
        return found, np.zeros(0)
    betas = interactions(permuted_betas(*rows, settings, settings.n_perm, np.random.default_rng(seed), settings.futility_p, found["obs_coef"]), rows[1])
    return (found | summary(found["obs_coef"], betas), betas) if len(betas) else (found | {"gate": "no permutation"}, betas)


def heavy_block(v: np.ndarray, y: np.ndarray, e: np.ndarray, c: np.ndarray, settings: ScanSettings, seed: int, block: int) -> np.ndarray:
    """Coefficients of one block of the permutations that follow the light ones."""
    rows = gated(v, y, e, c, settings)[1]
    if rows is None:
        return np.zeros(0)
    return interactions(permuted_betas(*rows, settings, blocks(settings.n_perm_high - settings.n_perm)[block], np.random.default_rng([seed, block])), rows[1])


def coefficient_table(v: np.ndarray, y: np.ndarray, e: np.ndarray, c: np.ndarray, settings: ScanSettings, seed: int) -> list[dict]:
    """One row for each coefficient of the matched model, with its permutation mean, deviation and p; none where a gate other than that on small effects stops the variant."""
    rows = gated(v, y, e, c, replace(settings, min_obs_coef=0.0))[1]
    if rows is None:
        return []
    v, points = rows
    observed = points.fit(points.kept(v))
    betas = permuted_betas(v, points, settings, settings.n_perm, np.random.default_rng(seed))
    some = len(betas) > 0
    return [
        {"obs": float(b), "perm_mean": float(betas[:, i].mean()) if some else None, "perm_sd": float(betas[:, i].std()) if some else None, "p_emp": float(np.mean(np.abs(betas[:, i]) >= abs(b))) if some else None, "iterations": len(betas)}
        for i, b in enumerate(observed)
    ]


def summary(observed: float, betas: np.ndarray) -> dict:
    return {"mean_coef": float(betas.mean()), "sd_coef": float(betas.std()), "empirical_p": float(np.mean(np.abs(betas) >= abs(observed))), "iterations": len(betas)}


def interaction_scan(v: np.ndarray, y: np.ndarray, e: np.ndarray, c: np.ndarray, settings: ScanSettings, seed: int) -> dict:
    """One variant's gated interaction test: light permutations, and the heavy ones where it stays significant."""
    found, betas = light_scan(v, y, e, c, settings, seed)
    if found["gate"] != "tested" or found["empirical_p"] > settings.p_threshold or settings.n_perm_high <= settings.n_perm:
        return found
    heavy = [heavy_block(v, y, e, c, settings, seed, i) for i in range(len(blocks(settings.n_perm_high - settings.n_perm)))]
    return found | summary(found["obs_coef"], np.concatenate([betas, *heavy]))


def resampled_medians(z: np.ndarray, reps: int, rng: np.random.Generator) -> np.ndarray:
    """Medians of ``reps`` resamples of the sorted ``z``, as many draws with replacement as values each.

    A resample's sorted places are the order statistics of uniform draws, so its middle ones are drawn by their own law (beta, and the next one given it): the same distribution
    as from whole resamples, at a cost that does not grow with the values.
    """
    n = len(z)
    k = (n + 1) // 2
    u = rng.beta(k, n + 1 - k, reps)
    low = z[np.minimum(n - 1, (u * n).astype(np.int64))]
    if n % 2:
        return low
    # Of the n - k draws above u the least: 1 - (1 - u) w, where w is the largest of as many uniforms.
    w = rng.random(reps) ** (1 / (n - k))
    return (low + z[np.minimum(n - 1, ((1 - (1 - u) * w) * n).astype(np.int64))]) / 2


def median_difference_ci(x: np.ndarray, y: np.ndarray, reps: int, alpha: float, rng: np.random.Generator) -> tuple[float, float]:
    """Percentile bootstrap interval of the difference of medians."""
    a, b = (resampled_medians(np.sort(z), reps, rng) for z in (x, y))
    low, high = np.percentile(a - b, [100 * alpha / 2, 100 * (1 - alpha / 2)])
    return float(low), float(high)


def robust_ols(x: np.ndarray, y: np.ndarray, kind: str = "HC3") -> tuple[np.ndarray, np.ndarray] | None:
    """Coefficients and heteroscedasticity-robust standard errors; none where the design is singular."""
    if len(y) <= x.shape[1] or np.linalg.matrix_rank(x) < x.shape[1]:
        return None
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    resid = y - x @ beta
    if kind == "HC3":
        weight = (resid / np.maximum(1e-12, 1 - np.einsum("ij,jk,ik->i", x, inverse, x))) ** 2
    else:
        weight = resid**2 * len(y) / (len(y) - x.shape[1])
    return beta, np.sqrt(np.diag(inverse @ (x.T * weight) @ x @ inverse))


def robust_logit(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray] | None:
    """Logistic coefficients by iteratively reweighted least squares, with HC1 standard errors; none without convergence."""
    if len(y) <= x.shape[1] or np.linalg.matrix_rank(x) < x.shape[1]:
        return None
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = p * (1 - p)
        try:
            step = np.linalg.solve((x.T * w) @ x, x.T @ (y - p))
        except np.linalg.LinAlgError:
            return None
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    else:
        return None
    bread = np.linalg.inv((x.T * w) @ x)
    meat = (x.T * (y - p) ** 2) @ x * len(y) / (len(y) - x.shape[1])
    return beta, np.sqrt(np.diag(bread @ meat @ bread))


def is_binary(y: np.ndarray) -> bool:
    return set(np.unique(np.round(y[~np.isnan(y)], 6))) <= {0.0, 1.0}


def interaction_test(v: np.ndarray, y: np.ndarray, e: np.ndarray, c: np.ndarray, least: int = 20) -> dict:
    """Robust interaction test of variant and one exposure: HC3 least squares, or HC1 logit for a 0/1 outcome; normal p-values."""
    known = ~(np.isnan(v) | np.isnan(y) | np.isnan(e) | np.isnan(c).any(axis=1))
    v, y, e, c = v[known], y[known], e[known], c[known]
    out = {"beta_i": None, "se": None, "pval": None, "n": len(v), "maf": float(min(v.mean() / 2, 1 - v.mean() / 2)) if len(v) else None}
    if len(v) < least or len(np.unique(v)) < 2:
        return out
    x = design(v, e[:, None], c)
    fit = robust_logit(x, y) if is_binary(y) else robust_ols(x, y)
    if fit is None or not fit[1][3] > 0:
        return out
    return out | {"beta_i": float(fit[0][3]), "se": float(fit[1][3]), "pval": float(D.normal_two_sided(fit[0][3] / fit[1][3]))}


def gene_exposure_correlation(v: np.ndarray, e: np.ndarray, c: np.ndarray) -> tuple[float, float] | None:
    """Coefficient of the exposure on the dosage with its robust p."""
    fit = robust_ols(np.column_stack([np.ones(len(v)), e, c]), v)
    return None if fit is None or not fit[1][1] > 0 else (float(fit[0][1]), float(D.normal_two_sided(fit[0][1] / fit[1][1])))


def breusch_pagan(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float] | None:
    """Studentised Breusch-Pagan test of a least-squares fit: LM, its p, F, its p."""
    beta = least_squares(x, y)
    if beta is None:
        return None
    squares = (y - x @ beta) ** 2
    gamma = least_squares(x, squares)
    total = ((squares - squares.mean()) ** 2).sum()
    if gamma is None or total <= 0:
        return None
    r2 = 1 - ((squares - x @ gamma) ** 2).sum() / total
    n, k = len(y), x.shape[1] - 1
    f = r2 / k / max(1e-300, (1 - r2) / (n - k - 1))
    return float(n * r2), D.chi2_sf(n * r2, k), float(f), D.f_sf(f, k, n - k - 1)


#: Rows from which on permutations of a block are shifts of two random orders.
SHIFTED_FROM = 1 << 15


def permutation_hits(vs: list[np.ndarray], y: np.ndarray, e: np.ndarray, c: np.ndarray, count: int, rng: np.random.Generator, lane: bool = True, spread: bool = True) -> list[dict]:
    """Of each variant over the same complete rows: the interaction and the Brown-Forsythe statistic, and how many of ``count`` permutations reach them.

    A permutation of the rows is drawn once for all variants. It permutes the residuals of a variant's model without the interaction (``lane``) and its dosages (``spread``).
    Rows lie by ``y, e, c`` and in their order, so that a variant's hits do not depend on which others are with it. Of many rows, permutations are shifts of two random orders (``shifts``).
    """
    if len(y) >= SHIFTED_FROM:
        return _shifted_hits(vs, y, e, c, [count], [rng], lane, spread)[0]
    order = np.lexsort(np.column_stack([c, e, y]).T)
    vs, y, e, c = [v[order] for v in vs], y[order], e[order], c[order]
    # Equal rows have equal residuals and dosages: those of points stay in a processor's cache.
    first, of = equal_rows(np.column_stack([*vs, c, e, y]))
    weight = np.sqrt(np.bincount(of))
    tests = [(LaneTest(v[first], y[first], e[first], c[first], weight, of) if lane else None, SpreadTest(v[first], y, of) if spread else None) for v in vs]
    # Large arrays are written in place: new ones would take longer than what is done with them.
    drawn, room = of.copy(), np.empty(len(of))
    for _ in range(count):
        rng.shuffle(drawn)
        for pair in tests:
            for test in pair:
                if test is not None and test.observed is not None:
                    test.hits += int(test.reached(drawn, room))
    names = (("beta_i_observed", "lane_hits"), ("levene_stat", "levene_hits"))
    return [{n: x for test, (o, h) in zip(pair, names, strict=True) if test is not None and test.observed is not None for n, x in ((o, test.observed), (h, test.hits))} for pair in tests]


def permutation_blocks(vs: list[np.ndarray], y: np.ndarray, e: np.ndarray, c: np.ndarray, counts: list[int], rngs: list[np.random.Generator], lane: bool = True, spread: bool = True) -> list[list[dict]]:
    """``permutation_hits`` of some blocks, each with a count and a generator; what blocks of many rows have in common is done once."""
    if len(y) >= SHIFTED_FROM:
        return _shifted_hits(vs, y, e, c, counts, rngs, lane, spread)
    return [permutation_hits(vs, y, e, c, count, rng, lane, spread) for count, rng in zip(counts, rngs, strict=True)]


def _shifted_hits(vs: list[np.ndarray], y: np.ndarray, e: np.ndarray, c: np.ndarray, counts: list[int], rngs: list[np.random.Generator], lane: bool, spread: bool) -> list[list[dict]]:
    """As ``permutation_blocks``, with all statistics of a block's shifts at once."""
    order = np.argsort(y, kind="stable")
    vs, y, e, c = [v[order] for v in vs], y[order], e[order], c[order]
    of, ones, room = np.arange(len(y)), np.ones(len(y)), np.empty(len(y))
    tests = [(LaneTest(v, y, e, c, ones, of) if lane else None, SpreadTest(v, y, of) if spread else None) for v in vs]
    tests = [[t if t is not None and t.observed is not None else None for t in pair] for pair in tests]
    out = []
    for count, rng in zip(counts, rngs, strict=True):
        moves, middles, rows = shifts.Shifts(len(y), count, rng), {}, []
        for one, two in tests:
            found = {}
            if one is not None:
                reached = np.abs(moves.sums(moves.fixed(one.row), moves.moved(one.resid))) >= abs(one.observed)
                found |= {"beta_i_observed": one.observed, "lane_hits": int(reached.sum())}
            if two is not None:
                sizes = np.bincount(two.label)
                # Windows of a few widths, so that variants share one.
                least = 1 << int(sizes[sizes >= 2].min()).bit_length() - 1
                if least not in middles:
                    middles[least] = shifts.Middle(y, moves, least)
                stats = middles[least].stats(two.label, two.levels)
                hits = int((stats >= two.observed).sum()) + sum(int(two.reached(moves.drawn(s), room)) for s in np.flatnonzero(np.isnan(stats)))
                found |= {"levene_stat": two.observed, "levene_hits": hits}
            rows.append(found)
        out.append(rows)
    return out


class LaneTest:
    """Interaction coefficient under permuted residuals of the model without it: a sum of products, since the coefficient of what that model fits is 0."""

    def __init__(self, v: np.ndarray, y: np.ndarray, e: np.ndarray, c: np.ndarray, weight: np.ndarray, of: np.ndarray):
        self.hits, self.observed = 0, None
        full = design(v, e[:, None], c)
        if len(of) <= full.shape[1]:
            return
        reduced = np.delete(full, 3, axis=1)
        size = weight @ np.abs(full) / weight.sum()
        whole = full / np.where(size > 0, size, 1) * weight[:, None]
        gram = whole.T @ whole
        if len(of) >= SHIFTED_FROM and np.linalg.eigvalsh(gram / np.trace(gram))[0] >= WELL:
            row = whole @ np.linalg.inv(gram)[3] / size[3]
            part = np.delete(whole, 3, axis=1)
            beta = np.linalg.solve(part.T @ part, part.T @ (y * weight)) / np.delete(size, 3)
        else:
            row = np.linalg.pinv(full * weight[:, None])[3]
            beta = np.linalg.lstsq(reduced * weight[:, None], y * weight, rcond=None)[0]
        self.observed = float(row @ (weight * y))
        self.resid = y - reduced @ beta
        self.row = (row / weight)[of]

    def reached(self, drawn: np.ndarray, room: np.ndarray) -> bool:
        return abs(self.row @ np.take(self.resid, drawn, out=room, mode="clip")) >= abs(self.observed)


#: Bits of a count of rows, and counts that one whole number holds.
BITS, HELD = 21, 3


class SpreadTest:
    """Brown-Forsythe statistic of permuted dosages (``v`` of each point), from how many rows of each dosage every value of the sorted ``y`` has."""

    def __init__(self, v: np.ndarray, y: np.ndarray, of: np.ndarray):
        if len(y) >> BITS:
            raise ValueError("more rows than counts hold")
        self.hits = 0
        levels, label = np.unique(np.round(v), return_inverse=True)
        self.levels, self.label = len(levels), label.astype(np.int32)
        # A dosage is a one in its own bits, so that one sum over the rows of a value counts several dosages.
        self.codes = [np.where(label // HELD == part, 1 << BITS * (label % HELD), 0) for part in range(-(-len(levels) // HELD))]
        self.start = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]])) if len(y) else np.zeros(0, int)
        self.y = y[self.start]
        self.observed = self.stat(of, np.empty(len(of)))

    def stat(self, drawn: np.ndarray, room: np.ndarray) -> float | None:
        sums = []
        for g in range(self.levels):
            if g % HELD == 0:
                code = np.add.reduceat(np.take(self.codes[g // HELD], drawn, out=room.view(np.int64), mode="clip"), self.start)
            counts = (code >> BITS * (g % HELD)) & ((1 << BITS) - 1)
            upto = np.cumsum(counts)
            n = upto[-1]
            if n >= 2:
                low, high = np.searchsorted(upto, [(n - 1) // 2, n // 2], side="right")
                off = np.abs(self.y - (self.y[low] + self.y[high]) / 2)
                counts = counts.astype(float)
                mean = counts @ off / n
                sums.append((n, mean, counts @ (off - mean) ** 2))
        if len(sums) < 2:
            return None
        n, mean, within = np.array(sums).T
        if within.sum() <= 0:
            return None
        return float((n.sum() - len(n)) / (len(n) - 1) * (n @ (mean - n @ mean / n.sum()) ** 2) / within.sum())

    def reached(self, drawn: np.ndarray, room: np.ndarray) -> bool:
        found = self.stat(drawn, room)
        return found is not None and found >= self.observed


def freedman_lane(v, y, e, c, count: int, rng: np.random.Generator) -> tuple[float, float, int] | None:
    """Interaction coefficient and p, by permuting the residuals of the model without the interaction."""
    found = permutation_hits([v], y, e, c, count, rng, spread=False)[0]
    return (found["beta_i_observed"], (1 + found["lane_hits"]) / (count + 1), count) if found else None


def levene_stat(groups: list[np.ndarray], middle=np.median) -> float | None:
    """Brown-Forsythe statistic over groups of at least two."""
    spread = [np.abs(g - middle(g)) for g in groups if len(g) >= 2]
    n = sum(map(len, spread))
    if len(spread) < 2:
        return None
    grand = np.concatenate(spread).mean()
    within = sum(((s - s.mean()) ** 2).sum() for s in spread)
    return None if within <= 0 else float((n - len(spread)) / (len(spread) - 1) * sum(len(s) * (s.mean() - grand) ** 2 for s in spread) / within)


def levene_permutation(v: np.ndarray, y: np.ndarray, count: int, rng: np.random.Generator) -> tuple[float, float] | None:
    found = permutation_hits([v], y, np.zeros(len(y)), np.zeros((len(y), 0)), count, rng, lane=False)[0]
    return (found["levene_stat"], (1 + found["levene_hits"]) / (count + 1)) if found else None


def quantile_fit(x: np.ndarray, y: np.ndarray, tau: float, rounds: int = 100, tolerance: float = 1e-3) -> np.ndarray | None:
    """Quantile regression by iteratively reweighted least squares."""
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    for _ in range(rounds):
        resid = y - x @ beta
        weight = np.where(resid < 0, 1 - tau, tau) / np.maximum(np.abs(resid), 1e-6)
        try:
            new = np.linalg.solve((x.T * weight) @ x, x.T @ (weight * y))
        except np.linalg.LinAlgError:
            return None
        done = np.abs(new - beta).max() < tolerance
        beta = new
        if done:
            return beta
    return None


TAUS = tuple(round(0.05 * i, 2) for i in range(1, 10))


def quantile_index(v: np.ndarray, y: np.ndarray, taus: tuple[float, ...] = TAUS, least: int = 20) -> float | None:
    """Mean over taus of the upper less the lower quantile effect of the dosage; discrete group quantiles where the dosage has two levels, an exact minimiser where it has three, reweighted least squares for more (imputed dosages)."""
    levels = np.unique(v)
    if len(v) < least or len(levels) < 2:
        return None
    if len(levels) == 2:
        low, high = (np.sort(y[v == g]) for g in levels)

        def at(s: np.ndarray, tau: float) -> float:
            return float(s[max(0, math.ceil(len(s) * tau - 1e-9) - 1)])

        gap = levels[1] - levels[0]
        effects = [(at(high, t + 0.5) - at(low, t + 0.5) - at(high, t) + at(low, t)) / gap for t in taus]
    elif len(levels) == 3:
        return float(_three_level_index(v, y, levels, np.ones((1, len(v)), np.int64), taus)[0])
    else:
        x = np.column_stack([np.ones(len(v)), v])
        effects = []
        for t in taus:
            lower, upper = quantile_fit(x, y, t), quantile_fit(x, y, t + 0.5)
            if lower is not None and upper is not None:
                effects.append(float(upper[1] - lower[1]))
    return float(np.mean(effects)) if effects else None


def _three_level_index(v: np.ndarray, y: np.ndarray, levels: np.ndarray, weights: np.ndarray, taus: tuple[float, ...]) -> np.ndarray:
    """The index of each row of ``weights``, how often it has every subject."""
    rows = [v == g for g in levels]
    slopes = three_level_slopes(levels, [y[r] for r in rows], [weights[:, r] for r in rows], np.array([*taus, *(t + 0.5 for t in taus)]))
    return (slopes[:, len(taus) :] - slopes[:, : len(taus)]).mean(axis=1)


#: Bootstrap replicates of three levels that are solved at once at most, and subjects of all of them together: about 60 bytes each.
REPLICATES, DRAWN = 100, 1 << 22


def bootstrap_indices(v: np.ndarray, y: np.ndarray, reps: int, rng: np.random.Generator) -> list[float | None]:
    """The quantile index of ``reps`` resamples of subjects. Resamples with all of three levels are solved together."""
    levels, out = np.unique(v), []
    step = max(1, min(REPLICATES, DRAWN // max(1, len(v))))
    # Sorted once: the values of all resamples then come in order.
    order = np.argsort(y, kind="stable")
    v_sorted, y_sorted = v[order], y[order]
    for at in range(0, reps, step):
        drawn = [rng.integers(0, len(v), len(v)) for _ in range(min(step, reps - at))]
        if len(levels) != 3:
            out += [quantile_index(v[rows], y[rows]) for rows in drawn]
            continue
        counts = np.array([np.bincount(rows, minlength=len(v))[order] for rows in drawn])
        whole = np.array([(counts[:, v_sorted == g].sum(axis=1) > 0) for g in levels]).all(axis=0)
        found = np.zeros(len(drawn))
        if whole.any():
            found[whole] = _three_level_index(v_sorted, y_sorted, levels, counts[whole], TAUS)
        out += [float(f) if w else quantile_index(v[rows], y[rows]) for f, w, rows in zip(found, whole, drawn, strict=True)]
    return out


def variance_scan(v: np.ndarray, y: np.ndarray, reps: int, rng: np.random.Generator, failed_as_zero: bool = False) -> dict:
    """Quantile index with a subject bootstrap's standard error. Replicates without an index are dropped, or count as 0 for parity."""
    known = ~(np.isnan(v) | np.isnan(y))
    v, y = v[known], y[known]
    out = {"n": len(v), "maf": float(v.mean() / 2) if len(v) else None, "beta_qi": None, "se": None, "z": None, "p": None}
    beta = quantile_index(v, y)
    if beta is None:
        return out
    found = [one or 0.0 for one in bootstrap_indices(v, y, reps, rng) if one is not None or failed_as_zero]
    se = float(np.std(found, ddof=1)) if len(found) > 1 else 0.0
    if not se > 0:
        return out | {"beta_qi": beta}
    return out | {"beta_qi": beta, "se": se, "z": beta / se, "p": float(D.normal_two_sided(beta / se))}
