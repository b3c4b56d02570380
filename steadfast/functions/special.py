"""Special functions in numpy: incomplete beta, highest-density interval of a beta, normal and Student-t."""

from __future__ import annotations

import math

import numpy as np


def log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def _fraction(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """The continued fraction of I_x(a, b) by Lentz's method, for x < (a + 1) / (a + b + 2)."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 20_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h *= step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return h


def betainc(a: float, b: float, x) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b), elementwise in x."""
    x = np.clip(np.asarray(x, float), 0, 1)
    out = np.where(x >= 1, 1.0, 0.0)
    inside = (x > 0) & (x < 1)
    if inside.any():
        y = x[inside]
        front = np.exp(a * np.log(y) + b * np.log1p(-y) - log_beta(a, b))
        low = y < (a + 1) / (a + b + 2)
        value = np.empty_like(y)
        if low.any():
            value[low] = front[low] * _fraction(a, b, y[low]) / a
        if not low.all():
            value[~low] = 1 - front[~low] * _fraction(b, a, 1 - y[~low]) / b
        out[inside] = value
    return out


def beta_hdi(a: float, b: float, width: float) -> tuple[float, float]:
    """The interval of a given width that holds most of Beta(a, b)."""
    eps = 1e-9
    if a < 1 + eps and b < 1 + eps or abs(a - b) < eps:
        return 0.5 - width / 2, 0.5 + width / 2
    if a < 1 + eps:
        return 0.0, width
    if b < 1 + eps:
        return 1 - width, 1.0
    mode = (a - 1) / (a + b - 2)
    lo, hi = max(0.0, mode - width), min(mode, 1 - width)

    def density(x: float) -> float:
        return -math.inf if x <= 0 or x >= 1 else (a - 1) * math.log(x) + (b - 1) * math.log1p(-x)

    def rise(x: float) -> float:
        return density(x) - density(x + width)

    f_lo, f_hi = rise(lo), rise(hi)
    if f_lo * f_hi > 0:
        left = (lo + hi) / 2
        return left, left + width
    while hi - lo > eps:
        mid = (lo + hi) / 2
        if rise(mid) * f_lo <= 0 and not (rise(mid) < 0 and f_lo < 0):
            hi = mid
        else:
            lo, f_lo = mid, rise(mid)
    left = (lo + hi) / 2
    return left, left + width


# Abramowitz and Stegun 7.1.26.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429, 0.3275911)
# Acklam's rational approximation of the normal quantile.
ACKLAM_A = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239)
ACKLAM_B = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1)
ACKLAM_C = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
ACKLAM_D = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416)


def erf(x: float) -> float:
    t = 1 / (1 + ERF[5] * abs(x))
    poly = t * (ERF[0] + t * (ERF[1] + t * (ERF[2] + t * (ERF[3] + t * ERF[4]))))
    return math.copysign(1 - poly * math.exp(-x * x), x)


def normal_cdf(x: float) -> float:
    return 0.0 if x < -8 else 1.0 if x > 8 else 0.5 * (1 + erf(x / math.sqrt(2)))


def normal_ppf(p: float) -> float:
    if not 0 < p < 1:
        return -math.inf if p == 0 else math.inf if p == 1 else math.nan
    if p < 0.02425 or p > 1 - 0.02425:
        q = math.sqrt(-2 * math.log(min(p, 1 - p)))
        top, bottom = 0.0, 0.0
        for c in ACKLAM_C:
            top = top * q + c
        for d in ACKLAM_D:
            bottom = bottom * q + d
        value = top / (bottom * q + 1)
        return value if p < 0.5 else -value
    q = p - 0.5
    r, top, bottom = q * q, 0.0, 0.0
    for a in ACKLAM_A:
        top = top * r + a
    for b in ACKLAM_B:
        bottom = bottom * r + b
    return top * q / (bottom * r + 1)


def t_cdf(x: float, df: float) -> float:
    inner = float(betainc(0.5, df / 2, np.array([x * x / (df + x * x)]))[0])  # between -x and x
    return 0.5 + math.copysign(inner, x) / 2 if x else 0.5


def t_ppf(p: float, df: float) -> float:
    """Student-t quantile by bisection."""
    if not 0 < p < 1 or df <= 0:
        return math.nan
    lo, hi = -1.0, 1.0
    while t_cdf(lo, df) > p:
        lo *= 2
    while t_cdf(hi, df) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2
