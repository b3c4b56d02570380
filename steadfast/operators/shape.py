"""Shape: skewness and kurtosis from quantiles, from pairs, and from moments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadfast.functions.weights import HD, Method
from steadfast.operators.quantiles import wide
from steadfast.operators.samples import sample

EPS = 2.220446049250313e-16


def bowley_skewness(df: DataFrame, column: str, groups: Sequence[str] = (), method: Method = HD) -> DataFrame:
    """(q3 + q1 - 2 q2) / (q3 - q1); 0 if the range is 0."""
    q = wide(sample(df, column, groups), groups, [0.25, 0.5, 0.75], method)
    width = F.col("q2") - F.col("q0")
    return q.select(*groups, F.when(F.abs(width) < EPS, 0.0).otherwise((F.col("q2") + F.col("q0") - 2 * F.col("q1")) / width).alias(f"{column}_skewness"))


def moors_kurtosis(df: DataFrame, column: str, groups: Sequence[str] = (), method: Method = HD) -> DataFrame:
    """((o7 - o5) + (o3 - o1)) / (o6 - o2) of octiles; 3 if the denominator is 0."""
    o = wide(sample(df, column, groups), groups, [k / 8 for k in range(1, 8)], method, [f"o{k}" for k in range(1, 8)])
    width = F.col("o6") - F.col("o2")
    value = ((F.col("o7") - F.col("o5")) + (F.col("o3") - F.col("o1"))) / width
    return o.select(*groups, F.when(F.abs(width) < EPS, 3.0).otherwise(value).alias(f"{column}_kurtosis"))


def crow_siddiqui_kurtosis(df: DataFrame, column: str, groups: Sequence[str] = (), method: Method = HD) -> DataFrame:
    """(q.975 - q.025) / (q.75 - q.25) - 2.91; null below 4 values, 0 if the range is 0."""
    q = wide(sample(df, column, groups), groups, [0.025, 0.25, 0.75, 0.975], method)
    width = F.col("q2") - F.col("q1")
    value = F.when(F.abs(width) < EPS, 0.0).otherwise((F.col("q3") - F.col("q0")) / width - 2.91)
    return q.select(*groups, F.when(F.col("n") >= 4, value).alias(f"{column}_kurtosis"))


def medcouple(df: DataFrame, column: str, groups: Sequence[str] = (), method: Method = HD) -> DataFrame:
    """Harrell-Davis median of ((xj - m) - (m - xi)) / (xj - xi) over all xi < m < xj, m being the median; 0 if a side is empty.

    The pairs of one group are as many as the square of its size; they are made in blocks and only a group's values and
    the kernel's counts by value are held, so memory follows a group's pairs: it is meant for groups of up to some thousand values.
    """
    s = sample(df, column, groups)
    out = f"{column}_medcouple"
    fields = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in groups)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf["x"].to_numpy())
        first, w = method.weights(len(x), 0.5)
        m = float((x[first - 1 : first - 1 + len(w)] * w).sum())
        left, right = x[x < m], x[x > m]
        value = None
        if len(x) >= 3:
            value = 0.0
            if len(left) and len(right):
                h = np.sort(np.concatenate([((right - m) - (m - a)) / (right - a) for a in left]))
                first, w = method.weights(len(h), 0.5)
                value = float((h[first - 1 : first - 1 + len(w)] * w).sum())
        return pd.DataFrame({**{g: [pdf[g].iloc[0]] for g in groups}, out: pd.array([value], "Float64")})

    if groups:
        return s.groupBy(*groups).applyInPandas(one, f"{fields}, {out} double")

    def whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(parts))
        if len(every):
            yield one(every)

    return s.coalesce(1).mapInPandas(whole, f"{out} double")


def moments(df: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """Population skewness (null below 3 values) and excess kurtosis (below 4); 0 where the variance is 0."""
    s = sample(df, column, groups)
    var = F.var_pop("x")
    return s.groupBy(*groups).agg(
        F.when(F.count("*") >= 3, F.when(var < EPS, 0.0).otherwise(F.skewness("x"))).alias(f"{column}_skewness"),
        F.when(F.count("*") >= 4, F.when(var < EPS, 0.0).otherwise(F.kurtosis("x"))).alias(f"{column}_kurtosis"),
    )


def summary(df: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """n, sum, sum of squares, mean (0 if empty), variance and deviation (0 below 2 values), min, max of a column."""
    s = sample(df, column, groups)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return s.groupBy(*groups).agg(
        F.count("*").alias("n"), zero(F.sum("x")).alias("total"), zero(F.sum(F.col("x") * F.col("x"))).alias("sum_of_squares"), zero(F.avg("x")).alias("mean"),
        zero(F.var_samp("x")).alias("variance"), zero(F.stddev_samp("x")).alias("std_dev"), F.min("x").alias("min"), F.max("x").alias("max"),
        (zero(F.stddev_samp("x")) / F.sqrt(F.count("*"))).alias("standard_error"), F.when(F.avg("x") != 0, F.stddev_pop("x") / F.abs(F.avg("x"))).alias("cv"),
    )


def extremes(df: DataFrame, column: str, index: str, groups: Sequence[str] = ()) -> DataFrame:
    """Index of the smallest and of the largest value; the lowest index of equal ones."""
    s = sample(df, column, groups, order=[index])
    return s.groupBy(*groups).agg(F.min_by(index, F.struct("x", index)).alias("argmin"), F.max_by(index, F.struct(F.col("x"), (-F.col(index)))).alias("argmax"))


def dot_product(df: DataFrame, a: str, b: str, groups: Sequence[str] = ()) -> DataFrame:
    both = sample(df, a, groups, order=[b])
    return both.groupBy(*groups).agg(F.sum(F.col("x") * F.col(b).cast("double")).alias("dot_product"))
