"""Hilbert transform of series: analytic signal, envelope, instantaneous phase and frequency.

A series is transformed as a whole, in one task by numpy's FFT, since every output depends on every input.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadfast.errors import InvalidInput


def _half(n: int, compat: bool) -> int:
    """Bins below this one, without 0, are positive frequencies. compat treats the last positive bin of odd lengths as negative."""
    return n // 2 if n % 2 == 0 or compat else (n + 1) // 2


def hilbert(x: np.ndarray, compat: bool = False) -> np.ndarray:
    n = len(x)
    if not n:
        raise InvalidInput("a signal needs a value at least")
    k = np.arange(n)
    sign = np.where(k == 0, 0, np.where(k < _half(n, compat), 1, -1))
    if n % 2 == 0:
        sign[n // 2] = 0
    return np.fft.ifft(np.fft.fft(x) * (-1j * sign)).real


def analytic(x: np.ndarray, compat: bool = False) -> np.ndarray:
    n = len(x)
    if not n:
        raise InvalidInput("a signal needs a value at least")
    k = np.arange(n)
    weight = np.where(k == 0, 1.0, np.where(k < _half(n, compat), 2.0, 0.0))
    if n % 2 == 0:
        weight[n // 2] = 1.0
    return np.fft.ifft(np.fft.fft(x) * weight)


def instantaneous_frequency(z: np.ndarray, rate: float = 1.0) -> np.ndarray:
    phase = np.unwrap(np.angle(z))
    if len(phase) < 2:
        return np.zeros(len(phase))
    return np.r_[phase[1] - phase[0], (phase[2:] - phase[:-2]) / 2, phase[-1] - phase[-2]] * rate / (2 * np.pi)


def hilbert_signal(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str] = (), *, rate: float = 1.0, compat: bool = False, center: bool = False) -> DataFrame:
    """groups, idx, x, hilbert, re, im, envelope, phase, frequency (in units of `rate`) of every point of each series."""
    from steadfast.operators.changepoint import series

    s = series(df, column, order, groups).withColumn("_all", F.lit(1))
    fields = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in groups)
    schema = f"{fields}{', ' if groups else ''}idx long, x double, hilbert double, re double, im double, envelope double, phase double, frequency double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        x = pdf["x"].to_numpy()
        y = x - x.mean() if center else x
        z = analytic(y, compat)
        out = pdf[[*groups, "idx", "x"]].copy()
        return out.assign(hilbert=hilbert(y, compat), re=z.real, im=z.imag, envelope=np.abs(z), phase=np.angle(z), frequency=instantaneous_frequency(z, rate))

    return s.groupBy(*(groups or ["_all"])).applyInPandas(one, schema)
