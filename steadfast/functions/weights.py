"""Weights of order statistics: Harrell-Davis, its trimmed forms, and linear interpolation."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from steadfast.errors import InvalidProbability, InvalidWidth
from steadfast.functions.special import beta_hdi, betainc

#: Smaller weights are dropped before the rest is made to sum to 1.
LEAST = 1e-12
#: From this a and b on, Harrell-Davis weights are integrals of the density, which is smooth within a rank there; below, differences of betainc.
SMOOTH = 50.0
_NODES, _SHARES = np.polynomial.legendre.leggauss(12)


@dataclass(frozen=True)
class Method:
    """How order statistics are weighted.

    kind: hd, thd_sqrt, thd_linear, thd_constant (with width), thd (with width, a function of n), simple, or custom (with a function of n and p).
    """

    kind: str = "hd"
    width: float | Callable[[int], float] | None = None
    custom: Callable[[int, float], np.ndarray] | None = None

    def __post_init__(self):
        if self.kind not in ("hd", "thd_sqrt", "thd_linear", "thd_constant", "thd", "simple", "custom"):
            raise InvalidWidth(f"unknown quantile method {self.kind!r}")
        if self.kind == "thd":
            if not callable(self.width):
                raise InvalidWidth("thd needs a width that is a function of n")
        elif (self.kind == "thd_constant") != (self.width is not None) or self.width is not None and not 0 < self.width <= 1:
            raise InvalidWidth("thd_constant needs a width in (0, 1], other methods none")

    def width_for(self, n: int) -> float | None:
        if self.kind == "thd":
            width = float(self.width(n))
            if not 0 < width:
                raise InvalidWidth(f"the width for {n} values is {width}")
            return min(1.0, width)
        return {"thd_sqrt": min(1.0, 1 / math.sqrt(n)), "thd_linear": min(1.0, 1 / n), "thd_constant": self.width}.get(self.kind)

    def weights(self, n: int, p: float) -> tuple[int, np.ndarray]:
        """(rank of the first weight, from 1; weights that sum to 1)."""
        return _weights(self, n, p)


HD, THD_SQRT, THD_LINEAR, SIMPLE = Method("hd"), Method("thd_sqrt"), Method("thd_linear"), Method("simple")


def thd_function(width: Callable[[int], float]) -> Method:
    """Trimmed weights whose width is a function of the number of values; more than 1 counts as 1."""
    return Method("thd", width)


def thd_constant(width: float) -> Method:
    return Method("thd_constant", width)


def check_probability(p: float) -> float:
    if not 0 <= p <= 1:
        raise InvalidProbability(f"{p} is not in [0, 1]")
    return float(p)


@functools.lru_cache(maxsize=4096)
def _weights(method: Method, n: int, p: float) -> tuple[int, np.ndarray]:
    check_probability(p)
    if n <= 0:
        return 1, np.zeros(0)
    if n == 1 or p == 0:
        return 1, np.ones(1)
    if p == 1:
        return n, np.ones(1)
    if method.kind == "custom":
        return 1, np.asarray(method.custom(n, p), float)
    if method.kind == "simple":
        at = p * (n - 1)
        k = min(int(at), n - 2)
        return k + 1, np.array([1 - (at - k), at - k])
    a, b = (n + 1) * p, (n + 1) * (1 - p)
    width = method.width_for(n)
    if width is None or width >= 1 - 1e-9:
        first, edges = _hd_band(n, p)
        w = _smooth(n, a, b, edges) if min(a, b) >= SMOOTH else np.diff(betainc(a, b, edges / n))
    else:
        left, right = beta_hdi(a, b, width)
        first, last = max(0, math.floor(left * n)), min(math.ceil(right * n), n)
        edges = np.arange(first, last + 1)
        low, high = betainc(a, b, np.array([left, right]))
        x = edges / n
        f = np.where(x <= left, 0.0, np.where(x >= right, 1.0, (betainc(a, b, x) - low) / (high - low)))
        w = np.diff(f)
    keep = np.flatnonzero(w > LEAST)
    w = w[keep[0] : keep[-1] + 1]
    w = np.where(w > LEAST, w, 0.0)
    return int(first + keep[0] + 1), w / w.sum()


def _hd_band(n: int, p: float) -> tuple[int, np.ndarray]:
    """Ranks that can have a weight above LEAST: ten standard deviations of the beta around its mean, all for small n."""
    reach = 10 * math.sqrt(p * (1 - p) / (n + 2)) + 60 / (n + 2)
    first, last = max(0, math.floor((p - reach) * n)), min(n, math.ceil((p + reach) * n))
    return first, np.arange(first, last + 1)


def _smooth(n: int, a: float, b: float, edges: np.ndarray) -> np.ndarray:
    """Integrals of the density of Beta(a, b) between edges / n, summing to 1: Gauss-Legendre sums of its ratio to that at the mode.

    betainc takes terms in the root of n for every edge: minutes for the hundred quantiles of a million values.
    """
    mode = (a - 1) / (a + b - 2)
    off = (edges[:-1, None] + (_NODES + 1) / 2) / n - mode
    w = np.exp((a - 1) * np.log1p(off / mode) + (b - 1) * np.log1p(-off / (1 - mode))) @ _SHARES
    return w / w.sum()
