"""Column expressions: normal distribution, conversions and classes of effect sizes, interval helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from steadfast.functions.special import ACKLAM_A, ACKLAM_B, ACKLAM_C, ACKLAM_D, ERF

INF = float("inf")


def _d(x) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF[5] * F.abs(x))
    poly = t * (ERF[0] + t * (ERF[1] + t * (ERF[2] + t * (ERF[3] + t * ERF[4]))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(x: Column) -> Column:
    return F.when(x < -8, 0.0).when(x > 8, 1.0).otherwise(0.5 * (1 + erf(x / (2.0**0.5))))


def _horner(values, x: Column, last: float | None = None) -> Column:
    out = _d(values[0])
    for v in (*values[1:], *(() if last is None else (last,))):
        out = out * x + v
    return out


def normal_ppf(p: Column) -> Column:
    q = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _horner(ACKLAM_C, q) / _horner(ACKLAM_D, q, 1.0)
    c = p - 0.5
    middle = _horner(ACKLAM_A, c * c) * c / _horner(ACKLAM_B, c * c, 1.0)
    inner = F.when((p < 0.02425) | (p > 1 - 0.02425), F.when(p < 0.5, tail).otherwise(-tail)).otherwise(middle)
    return F.when(p == 0, -INF).when(p == 1, INF).when((p > 0) & (p < 1), inner)


# Where small, medium and large begin, by kind of effect size.
THRESHOLDS = {"difference": (0.2, 0.5, 0.8), "correlation": (0.1, 0.3, 0.5), "dominance": (0.147, 0.33, 0.474), "variance": (0.01, 0.06, 0.14), "probability": (0.06, 0.14, 0.21)}
TYPICAL_RANGE = {"difference": (-3.0, 3.0), "correlation": (-1.0, 1.0), "dominance": (-1.0, 1.0), "variance": (0.0, 1.0), "probability": (0.0, 1.0)}


def interpret(value: Column, kind: str) -> Column:
    """Negligible, Small, Medium or Large."""
    small, medium, large = THRESHOLDS[kind]
    size = F.abs(value - 0.5) if kind == "probability" else F.abs(value)
    return F.when(size < small, "Negligible").when(size < medium, "Small").when(size < large, "Medium").when(size >= large, "Large")


def is_practically_significant(value: Column, kind: str) -> Column:
    return interpret(value, kind).isin("Medium", "Large")


def typical_range(kind: str) -> tuple[float, float]:
    """Where values of a kind of effect size usually are."""
    return TYPICAL_RANGE[kind]


def in_typical_range(value: Column, kind: str) -> Column:
    return value.between(*TYPICAL_RANGE[kind])


def favors_second(value: Column) -> Column:
    return value > 0


def cles_from_delta(delta: Column) -> Column:
    return (delta + 1) / 2


def delta_from_cles(cles: Column) -> Column:
    return 2 * cles - 1


def d_from_eta(eta: Column) -> Column:
    return F.when(eta >= 1, INF).when(eta <= 0, 0.0).otherwise(2 * F.sqrt(eta / (1 - eta)))


def eta_from_d(d: Column) -> Column:
    return d * d / (d * d + 4)


def interval_width(lower: Column, upper: Column) -> Column:
    return upper - lower


def interval_margin(lower: Column, upper: Column) -> Column:
    return (upper - lower) / 2


def interval_contains(lower: Column, upper: Column, x: Column) -> Column:
    return x.between(lower, upper)


def intervals_overlap(lower1: Column, upper1: Column, lower2: Column, upper2: Column) -> Column:
    return (lower1 <= upper2) & (lower2 <= upper1)
