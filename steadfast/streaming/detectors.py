"""Online detectors as stateful streaming operators: one small state for each key.

Rows of a key are taken in the order of (order columns) within a micro-batch; what comes in a later batch comes later.
A row whose control column is true resets its key's state. Watermarks, if the stream has them, bound nothing here: the
state of a key is a few numbers, kept until it is reset or, with expire_ms, until the key has had no row for so many
milliseconds; a row that comes later starts anew.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from steadfast.functions.weights import HD, THD_SQRT, Method
from steadfast.operators.spread import STABILITY_FACTOR
from steadfast.operators.stability import DEFAULT, Parameters


def _median(x: np.ndarray, method: Method) -> float:
    first, w = method.weights(len(x), 0.5)
    return float((np.sort(x)[first - 1 : first - 1 + len(w)] * w).sum())


class OnlineEwma:
    """After a warm-up fixes reference and threshold, the average starts at the reference; add() tells whether a point is an alarm."""

    def __init__(self, lam: float = 0.2, multiplier: float = 3.0, warmup: int = 20, method: Method = HD, state: tuple | None = None):
        self.lam, self.multiplier, self.warmup, self.method = lam, multiplier, warmup, method
        self.n, self.average, self.reference, self.limit, self.first = state or (0, 0.0, 0.0, 0.0, [])
        self.first = list(self.first)

    def state(self) -> tuple:
        return self.n, self.average, self.reference, self.limit, self.first

    def add(self, x: float) -> bool:
        self.n += 1
        if self.n <= self.warmup:
            self.first.append(x)
            if self.n == self.warmup:
                v = np.array(self.first)
                self.reference = self.average = _median(v, self.method)
                self.limit = self.multiplier * _median(np.abs(v - self.reference), self.method)
                self.first = []
            return False
        self.average = self.lam * x + (1 - self.lam) * self.average
        return abs(self.average - self.reference) > self.limit


class OnlineStability:
    """Mean, variance and slope of all history; stable after enough stable points in a row."""

    def __init__(self, parameters: Parameters = DEFAULT, state: tuple | None = None):
        self.p = parameters
        self.n, self.mean, self.m2, self.sxy, self.run = state or (0, 0.0, 0.0, 0.0, 0)

    def state(self) -> tuple:
        return self.n, self.mean, self.m2, self.sxy, self.run

    def add(self, x: float) -> tuple[float, float, bool, str]:
        """cv, trend, whether the history is stable, and the status."""
        p = self.p
        self.n += 1
        n = self.n
        delta = x - self.mean
        # co-moment of index and value: the index's mean is (n - 1) / 2 from 0
        self.sxy += delta * (n - 1) / 2 if n > 1 else 0.0
        self.mean += delta / n
        self.m2 += delta * (x - self.mean)
        sd = (self.m2 / (n - 1)) ** 0.5 if n > 1 else 0.0
        strict = sd / abs(self.mean) if abs(self.mean) > 1e-10 else float("inf")
        cv = strict if abs(self.mean) > 1e-10 else 0.0 if sd < 1e-10 else float("inf")
        trend = abs(self.sxy / (n * (n * n - 1) / 12)) if n > 1 else 0.0
        good = n >= p.min_samples and cv <= p.max_cv and trend <= p.max_trend
        self.run = self.run + 1 if good else 0
        if good:
            status = "Stable" if self.run >= p.min_stable_windows else "Transitioning"
        else:
            status = "Unstable" if trend > p.max_trend or strict > p.max_cv else "Unknown"
        return cv, trend, good, status


class OnlineTracker:
    """Verdicts of the last `window` values, after each one, and how many in a row are stable.

    zero_cv: the cv of a window whose median and spread are both 0; with inf it isn't stable.
    """

    def __init__(self, window: int = 50, parameters: Parameters = DEFAULT, method: Method = THD_SQRT, state: tuple | None = None, zero_cv: float = 0.0):
        self.window, self.p, self.method, self.zero_cv = window, parameters, method, zero_cv
        self.run, values = state or (0, [])
        self.values = deque(values, window)

    def state(self) -> tuple:
        return self.run, list(self.values)

    def add(self, x: float) -> tuple[bool, int, str]:
        """Whether the window is stable, the run, and the status; Unknown until there is a whole window."""
        self.values.append(x)
        if len(self.values) < self.window:
            return False, 0, "Unknown"
        p, v = self.p, np.array(self.values)
        center = _median(v, self.method)
        spread = STABILITY_FACTOR * _median(np.abs(v - center), self.method)
        cv = spread / abs(center) if abs(center) > 1e-10 else self.zero_cv if spread < 1e-10 else float("inf")
        t = np.arange(self.window) - (self.window - 1) / 2
        trend = abs(float(t @ v) / float(t @ t)) if self.window > 1 else 0.0
        good = self.window >= p.min_samples and cv <= p.max_cv and trend <= p.max_trend
        self.run = self.run + 1 if good else 0
        if good:
            return True, self.run, "Stable" if self.run >= p.min_stable_windows else "Transitioning"
        return False, 0, "Unknown" if self.window < p.min_samples else "Unstable"


def _stream(df: DataFrame, key: str, column: str, order: Sequence[str], reset: str | None, make, row, fields: str, state: str, expire_ms: int | None) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    orders = ", ".join(f"`{o}` {df.schema[o].dataType.simpleString()}" for o in order)
    out = f"`{key}` {kind}, {orders}, x double, {fields}"

    def step(k, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        names = [key, *order, "x", *(f.split()[0] for f in fields.split(", "))]
        if group.hasTimedOut:
            group.remove()
            return
        pdf = pd.concat(list(parts)).sort_values(list(order))
        detector = make(group.get if group.exists else None)
        rows = []
        for r in pdf.itertuples(index=False):
            got = r._asdict()
            if reset is not None and got[reset]:
                detector = make(None)
                continue
            x = got[column]
            if x is None or x != x:
                continue
            rows.append((k[0], *(got[o] for o in order), float(x), *row(detector, float(x))))
        group.update(detector.state())
        if expire_ms is not None:
            group.setTimeoutDuration(expire_ms)
        yield pd.DataFrame(rows, columns=names)

    return df.groupBy(key).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout if expire_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def stream_ewma(df: DataFrame, key: str, column: str, order: Sequence[str], *, lam: float = 0.2, multiplier: float = 3.0, warmup: int = 20, reset: str | None = None, method: Method = HD, expire_ms: int | None = None) -> DataFrame:
    """key, order columns, x, ewma, is_alarm for each row of a stream."""
    make = lambda s: OnlineEwma(lam, multiplier, warmup, method, s)
    row = lambda d, x: ((a := d.add(x)), d.average)[::-1]
    return _stream(df, key, column, order, reset, make, row, "ewma double, is_alarm boolean", "n long, average double, reference double, threshold double, first array<double>", expire_ms)


def stream_stability(df: DataFrame, key: str, column: str, order: Sequence[str], *, parameters: Parameters = DEFAULT, reset: str | None = None, expire_ms: int | None = None) -> DataFrame:
    """key, order columns, x, cv, trend, is_stable, status for each row of a stream."""
    make = lambda s: OnlineStability(parameters, s)
    return _stream(df, key, column, order, reset, make, lambda d, x: d.add(x), "cv double, trend double, is_stable boolean, status string", "n long, mean double, m2 double, sxy double, run long", expire_ms)


def stream_tracker(df: DataFrame, key: str, column: str, order: Sequence[str], *, window: int = 50, parameters: Parameters = DEFAULT, reset: str | None = None, method: Method = THD_SQRT, expire_ms: int | None = None, zero_cv: float = 0.0) -> DataFrame:
    """key, order columns, x, is_stable, run, status for each row of a stream: of the window that ends with it; zero_cv as in OnlineTracker."""
    make = lambda s: OnlineTracker(window, parameters, method, s, zero_cv)
    return _stream(df, key, column, order, reset, make, lambda d, x: d.add(x), "is_stable boolean, run long, status string", "run long, values array<double>", expire_ms)
