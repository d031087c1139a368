"""Distribution functions and small-sample tests in NumPy, for groups of bounded size."""

from __future__ import annotations

import math

import numpy as np


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """By bisection on the error function and two Newton steps."""
    lo, hi = -40.0, 40.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_sf(mid) > 1 - p else (lo, mid)
    z = (lo + hi) / 2
    for _ in range(2):
        density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        z -= ((1 - normal_sf(z)) - p) / density if density else 0.0
    return z


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 500):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + numerator * d or tiny)
            c = 1 + numerator / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def student_sf(t: float, df: float) -> float:
    """P(T > t)."""
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return tail if t > 0 else 1 - tail


# The polynomials of Royston's approximation (1995).
_A_LAST = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0)
_A_BEFORE = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0)
_MU_SMALL, _SD_SMALL, _GAMMA = (-0.0006714, 0.025054, -0.39978, 0.5440), (-0.0020322, 0.062767, -0.77857, 1.3822), (0.459, -2.273)
_MU_LARGE, _SD_LARGE = (0.0038915, -0.083751, -0.31082, -1.5861), (0.0030302, -0.082676, -0.4803)
# End of fixed values.


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W and its p-value, for 3 to 5,000 values; NaN otherwise, (1, 1) for equal values."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n < 3 or n > 5000:
        return math.nan, math.nan
    if x[-1] - x[0] < 1e-19:
        return 1.0, 1.0
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
        u, total = 1 / math.sqrt(n), float(m @ m)
        a = m / math.sqrt(total)
        last = np.polyval(_A_LAST, u) + a[-1]
        if n > 5:
            before = np.polyval(_A_BEFORE, u) + a[-2]
            scale = math.sqrt((total - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2))
            a = m / scale
            a[-2], a[1] = before, -before
        else:
            a = m / math.sqrt((total - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[-1], a[0] = last, -last
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w == 1.0:
        return w, 1.0
    y = math.log(1 - w)
    if n <= 11:
        limit = np.polyval(_GAMMA, n)
        if y >= limit:
            return w, 1e-99
        y, mu, sd = -math.log(limit - y), np.polyval(_MU_SMALL, n), math.exp(np.polyval(_SD_SMALL, n))
    else:
        k = math.log(n)
        mu, sd = np.polyval(_MU_LARGE, k), math.exp(np.polyval(_SD_LARGE, k))
    return w, normal_sf((y - mu) / sd)


def paired_t(d: np.ndarray) -> tuple[float, float]:
    """t of the differences and P(T > t)."""
    n = len(d)
    sd = float(np.std(d, ddof=1))
    t = float(np.mean(d)) / (sd / math.sqrt(n)) if sd else math.copysign(math.inf, float(np.mean(d)))
    return t, student_sf(t, n - 1)


def signed_rank(d: np.ndarray) -> tuple[float, float]:
    """Sum of the ranks of positive differences and the chance of so much or more; zeros are left out.

    Exact up to 50 differences without zeros or ties, and up to 13 with them; otherwise normal with the correction for ties.
    """
    whole = len(d)
    d = np.asarray(d, float)
    d = d[d != 0]
    n = len(d)
    if not n:
        return math.nan, math.nan
    size = np.abs(d)
    values, back, count = np.unique(size, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[back]
    w = float(rank[d > 0].sum())
    if whole <= 13 or n <= 50 and n == whole and len(values) == n:
        ways = np.zeros(n * (n + 1) + 1)  # by twice the sum: ranks of ties are halves
        ways[0] = 1
        for k in np.round(2 * rank).astype(int).tolist():
            ways[k:] += ways[:-k].copy()
        return w, float(ways[int(round(2 * w)) :].sum() / 2.0**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - float((count**3 - count).sum()) / 48
    return w, normal_sf((w - n * (n + 1) / 4) / math.sqrt(var)) if var > 0 else math.nan
