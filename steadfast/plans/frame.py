"""One object with all operators for a DataFrame, weight caches, Column forms, and the extension registry."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadfast.errors import InvalidParameter, TypeMismatch
from steadfast.functions.weights import HD, Method, check_probability
from steadfast.operators import changepoint, compare, confidence, effect, histogram, modality, quantiles, shape, spread, stability
from steadfast.operators.samples import check_column
from steadfast.plans.events import EVENTS, MATCHES, SEGMENT_CLASSES, STABILITY, Context, Events, Metrics, Pairing, TimeRange, ignore, logging_handler

class QuantileCache:
    """Weights of one method (and, if given, for columns of one type), kept by (n, p), with counts of what was there and what was made.

    most: how many to keep; those not used for longest go first. None keeps all, 0 none. It holds bands of weights on the
    driver, some 20 sqrt(n) numbers each; the weights of very many sizes are made by executors and not kept.
    """

    def __init__(self, method: Method = HD, dtype: str | None = None, most: int | None = 4096):
        self.method, self.dtype, self.most = method, dtype, most
        self.hits = self.misses = 0
        self._kept: OrderedDict = OrderedDict()

    def weights(self, n: int, p: float) -> tuple[int, np.ndarray]:
        key = int(n), float(p)
        if key in self._kept:
            self.hits += 1
            self._kept.move_to_end(key)
            return self._kept[key]
        self.misses += 1
        made = self.method.weights(*key)
        self._kept[key] = made
        while self.most is not None and len(self._kept) > self.most:
            self._kept.popitem(last=False)
        return made

    def __len__(self) -> int:
        return len(self._kept)

    @property
    def hit_rate(self) -> float:
        return self.hits / max(1, self.hits + self.misses)

    def clear(self) -> None:
        self._kept.clear()
        self.hits = self.misses = 0


class Robust:
    """Operators over a DataFrame, optionally by groups: Robust(df, ["g"]).quantiles("x", [0.5])."""

    def __init__(self, df: DataFrame, groups: Sequence[str] = ()):
        for g in groups:
            check_column(df, g, numeric=False)
        self.df, self.groups = df, list(groups)

    def quantiles(self, columns, ps: Sequence[float], method: Method = HD, **options) -> DataFrame:
        return quantiles.quantiles(self.df, columns, ps, method, self.groups, **options)

    def _fits(self, columns, method: Method, cache: QuantileCache) -> None:
        if cache.method != method:
            raise InvalidParameter(f"the cache is for {cache.method}, not {method}")
        for c in [columns] if isinstance(columns, str) else columns:
            check_column(self.df, c)
            kind = self.df.schema[c].dataType.simpleString()
            if cache.dtype not in (None, kind):
                raise TypeMismatch(f"the cache is for {cache.dtype}, column {c!r} is {kind}")

    def quantiles_cached(self, columns, ps: Sequence[float], method: Method, cache: QuantileCache) -> DataFrame:
        """quantiles() with the cache's weights, which keeps the new ones."""
        self._fits(columns, method, cache)
        return self.quantiles(columns, ps, method, cache=cache)

    def spread(self, columns, kind: str, **options) -> DataFrame:
        return spread.spread(self.df, columns, kind, self.groups, **options)

    def spread_cached(self, columns, kind: str, cache: QuantileCache) -> DataFrame:
        """Spread with the cache's method and weights for the quantiles inside; standard deviations have none."""
        self._fits(columns, cache.method, cache)
        return self.spread(columns, kind, **({} if kind.endswith("std") else {"method": cache.method, "cache": cache}))

    def confidence(self, columns, level: float = 0.95, method: str = "maritz_jarrett", p: float = 0.5, *, resamples: int = 1000, kind: str | Callable = "percentile", seed: int = 42) -> DataFrame:
        """{column}_lower and {column}_upper: maritz_jarrett, asymptotic, student, or bootstrap (of the p-quantile, with resamples and a kind of interval)."""
        out = None
        for c in [columns] if isinstance(columns, str) else columns:
            if method == "maritz_jarrett":
                found = confidence.maritz_jarrett(self.df, c, p, self.groups, level=level)
            elif method in ("asymptotic", "student"):
                found = confidence.asymptotic(self.df, c, self.groups, level=level, student=method == "student")
            elif method == "bootstrap":
                found = confidence.one_sample_bootstrap(self.df, c, self.groups, confidence.quantile_statistic(check_probability(p)), method=kind, level=level, resamples=resamples, seed=seed)
            else:
                raise InvalidParameter(f"unknown interval {method!r}")
            found = found.select(*self.groups, F.col("lower").alias(f"{c}_lower"), F.col("upper").alias(f"{c}_upper"))
            out = found if out is None else quantiles.join_groups(out, found, self.groups)
        return out

    def bootstrap(self, group: str, column: str, pair: tuple, **options) -> DataFrame:
        return confidence.bootstrap(self.df, group, column, pair, **options)

    def changepoints(self, column: str, order: Sequence[str], method: str = "cusum", **options) -> DataFrame:
        found = {"cusum": changepoint.cusum, "ewma": changepoint.ewma, "slopes": changepoint.slopes, "polynomial_slopes": changepoint.polynomial_slopes, "adaptive_slopes": changepoint.adaptive_slopes}
        if method not in found:
            raise InvalidParameter(f"unknown changepoint method {method!r}")
        return found[method](self.df, column, order, self.groups, **options)

    def stability(self, column: str, order: Sequence[str], window: int | None = None, **options) -> DataFrame:
        if window is None:
            return stability.composite(self.df, column, order, self.groups, **options)
        return stability.track(stability.windows(self.df, column, order, self.groups, window=window, **options), self.groups, options.get("parameters", stability.DEFAULT))

    def modality(self, column: str, sensitivity: float = modality.SENSITIVITY, **options) -> DataFrame:
        return modality.lowland_modes(self.df, column, self.groups, sensitivity=sensitivity, **options)

    def effect_size(self, group: str, column: str, kind: str, **options) -> DataFrame:
        return effect.effect_size(self.df, group, column, kind, **options)

    def compare(self, group: str, column: str, ps: Sequence[float] = (0.5,), method: Method = HD) -> DataFrame:
        return compare.quantile_comparison(self.df, group, column, ps, method)

    def histogram(self, column: str, kind: str = "fixed", bins: int = 10, **options) -> DataFrame:
        if kind in ("fixed", "quantile"):
            return (histogram.fixed_width if kind == "fixed" else histogram.quantile_bins)(self.df, column, bins, self.groups, **options)
        found = {"scott": histogram.scott, "freedman_diaconis": histogram.freedman_diaconis, "adaptive": histogram.adaptive_qrde}
        if kind not in found:
            raise InvalidParameter(f"unknown histogram {kind!r}")
        return found[kind](self.df, column, self.groups, **options)

    def skewness(self, column: str) -> DataFrame:
        return shape.bowley_skewness(self.df, column, self.groups)

    def kurtosis(self, column: str) -> DataFrame:
        return shape.moors_kurtosis(self.df, column, self.groups)


# ------------------------------------------------------------------ columns


def _column(f: Callable[[np.ndarray], float]) -> Callable[[Column | str], Column]:
    """A grouped aggregate of a column as a Column: for groups that fit a worker. The DataFrame operators have no such limit."""

    @F.pandas_udf("double")
    def aggregate(x: pd.Series) -> float:
        v = np.sort(x.dropna().to_numpy(float))
        return float(f(v)) if len(v) else None

    return lambda c: aggregate(F.col(c) if isinstance(c, str) else c)


def _weighted(v: np.ndarray, p: float, method: Method) -> float:
    first, w = method.weights(len(v), p)
    return float((v[first - 1 : first - 1 + len(w)] * w).sum())


def robust_quantile(column, p: float, method: Method = HD) -> Column:
    check_probability(p)
    return _column(lambda v: _weighted(v, p, method))(column)


def robust_mad(column, method: Method = HD) -> Column:
    return _column(lambda v: _weighted(np.sort(np.abs(v - _weighted(v, 0.5, method))), 0.5, method))(column)


def robust_iqr(column, method: Method = HD) -> Column:
    return _column(lambda v: _weighted(v, 0.75, method) - _weighted(v, 0.25, method))(column)


def custom_statistic(f: Callable[[np.ndarray], float]) -> Callable[[Column | str], Column]:
    """Own location or spread: f of a sorted array, as a Column function."""
    return _column(f)

__all__ = ["EVENTS", "MATCHES", "SEGMENT_CLASSES", "STABILITY", "Context", "Events", "Metrics", "Pairing", "QuantileCache", "Robust", "TimeRange", "custom_statistic", "ignore", "logging_handler", "robust_iqr", "robust_mad", "robust_quantile"]
