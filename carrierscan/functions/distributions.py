"""Distribution functions in numpy: the container has no statistics library, and tasks need them vectorised."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_erfc = np.frompyfunc(math.erfc, 1, 1)
_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def normal_sf(z):
    return 0.5 * np.asarray(_erfc(np.asarray(z, float) / math.sqrt(2)), float)


def normal_two_sided(z):
    """Two-sided p-value of a standard normal statistic."""
    return np.asarray(_erfc(np.abs(np.asarray(z, float)) / math.sqrt(2)), float)


def normal_quantile(p):
    """Inverse of the normal distribution function; NaN outside (0, 1)."""
    inv = NormalDist().inv_cdf
    return np.array([inv(x) if 0 < x < 1 else math.nan for x in np.asarray(p, float).ravel()]).reshape(np.shape(p))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz recurrence."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if df > 0 and math.isfinite(t) else math.nan


def f_sf(f: float, df1: float, df2: float) -> float:
    return beta_inc(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def binomial_sf(k: int, n: int, p: float) -> float:
    """Probability of at least ``k`` successes."""
    return 1.0 if k <= 0 else 0.0 if k > n else beta_inc(k, n - k + 1, p)


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1e300
    d = 1 / b
    out = d
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2
        d = 1 / (num * d + b or 1e-300)
        c = b + num / c or 1e-300
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out * front


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


#: Values of the smaller arm up to which a rank-sum p without ties is exact.
EXACT_ARM = 8


def rank_sum_exact(u: float, n: int, m: int) -> float:
    """Two-sided exact p of a rank-sum statistic ``u`` of arms of ``n`` and ``m`` values without ties."""
    ways = [1] + [0] * (n * m)
    for i in range(1, n + 1):  # ways that a statistic arises, as coefficients of a Gaussian binomial
        top = m + i
        for s in range(n * m, top - 1, -1):
            ways[s] -= ways[s - top]
        for s in range(i, n * m + 1):
            ways[s] += ways[s - i]
    return min(1.0, 2 * sum(ways[math.ceil(max(u, n * m - u)) :]) / math.comb(n + m, n))


def mann_whitney(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """U of ``x``, two-sided p, and rank-biserial effect ``1 - 2U/(nm)``.

    Exact when the smaller side has at most eight values and nothing ties, else normal with tie and continuity corrections.
    """
    n, m = len(x), len(y)
    both = np.concatenate([x, y])
    values, inverse, counts = np.unique(both, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    u = float(ranks[:n].sum() - n * (n + 1) / 2)
    high = max(u, n * m - u)
    if min(n, m) <= EXACT_ARM and len(values) == n + m:
        p = rank_sum_exact(u, n, m)
    else:
        total = n + m
        spread = n * m / 12 * ((total + 1) - float((counts**3 - counts).sum()) / (total * (total - 1)))
        p = 1.0 if spread <= 0 else min(1.0, 2 * float(normal_sf((high - n * m / 2 - 0.5) / math.sqrt(spread))))
    return u, p, 1 - 2 * u / (n * m)


def welch(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Welch's t, two-sided p, and the difference of means in pooled standard deviations."""
    vx, vy = x.var(ddof=1) / len(x), y.var(ddof=1) / len(y)
    if vx + vy <= 0:
        return math.nan, math.nan, math.nan
    t = (x.mean() - y.mean()) / math.sqrt(vx + vy)
    df = (vx + vy) ** 2 / (vx**2 / (len(x) - 1) + vy**2 / (len(y) - 1))
    pooled = math.sqrt(((len(x) - 1) * x.var(ddof=1) + (len(y) - 1) * y.var(ddof=1)) / (len(x) + len(y) - 2))
    return float(t), t_two_sided(t, df), float((x.mean() - y.mean()) / pooled)


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a two by two table: all tables with the same margins that are not likelier."""
    row, col, n = a + b, a + c, a + b + c + d

    def log_p(k: int) -> float:
        return math.log(math.comb(row, k) * math.comb(n - row, col - k)) - math.log(math.comb(n, col))

    seen = log_p(a)
    return min(1.0, sum(math.exp(p) for k in range(max(0, col - (n - row)), min(row, col) + 1) if (p := log_p(k)) <= seen + 1e-7))


def chi2_table(table: np.ndarray) -> tuple[float, float]:
    """Chi-square statistic and p of a contingency table, with Yates' correction for two by two."""
    expected = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    off = np.abs(table - expected)
    if table.shape == (2, 2):
        off = np.maximum(0, off - np.minimum(0.5, off))
    df = (table.shape[0] - 1) * (table.shape[1] - 1)
    x = float((off**2 / expected).sum())
    return x, chi2_sf(x, df)


#: The published polynomials of the Shapiro-Wilk test, lowest power first. The outer two weights in 1/sqrt(n), then
#: mean and log deviation of the transformed statistic for 4 to 11 values (in n, with a bound) and for more (in ln n).
SHAPIRO_LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
SHAPIRO_SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SHAPIRO_FEW = ((-2.273, 0.459), (0.544, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322))
SHAPIRO_MANY = ((-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302))
#: Values from which the test is done.
SHAPIRO_LEAST = 8


def normal_scores(i, n):
    """Approximate expected normal order statistics of rank ``i`` among ``n``."""
    return normal_quantile((np.asarray(i, float) - 0.375) / (np.asarray(n, float) + 0.25))


def shapiro_wilk(n: int, score_x: float, score_score: float, low: tuple[float, float], high: tuple[float, float], squares: float) -> tuple[float, float]:
    """W and p from sums over a sample: of scores times values and of squared scores, the two lowest and two highest values, and the squares about the mean.

    NaN below ``SHAPIRO_LEAST`` values; values that are all equal give 1 and 1.
    """
    if n < SHAPIRO_LEAST:
        return math.nan, math.nan
    if not squares > 0:
        return 1.0, 1.0

    def poly(c: tuple[float, ...], x: float) -> float:
        return float(np.polynomial.polynomial.polyval(x, c))

    second, last = normal_scores([n - 1, n], n)
    a_last, a_second = (m / math.sqrt(score_score) + poly(c, 1 / math.sqrt(n)) for m, c in ((last, SHAPIRO_LAST), (second, SHAPIRO_SECOND)))
    inner = (score_score - 2 * last**2 - 2 * second**2) / (1 - 2 * a_last**2 - 2 * a_second**2)
    outer, next_outer = high[1] - low[0], high[0] - low[1]
    weighted = a_last * outer + a_second * next_outer + (score_x - last * outer - second * next_outer) / math.sqrt(inner)
    w = min(1.0, weighted**2 / squares)
    off = math.log(max(1 - w, 1e-300))
    if n <= 11:
        bound = poly(SHAPIRO_FEW[0], n)
        if off >= bound:
            return w, 0.0
        off, mean, sd = -math.log(bound - off), poly(SHAPIRO_FEW[1], n), math.exp(poly(SHAPIRO_FEW[2], n))
    else:
        mean, sd = poly(SHAPIRO_MANY[0], math.log(n)), math.exp(poly(SHAPIRO_MANY[1], math.log(n)))
    return w, float(normal_sf((off - mean) / sd))
