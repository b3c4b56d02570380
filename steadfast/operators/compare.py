"""Comparisons of the samples of two groups: shifts and ratios, of one statistic or of quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadfast.errors import InvalidParameter
from steadfast.functions.weights import HD, Method, check_probability
from steadfast.operators.quantiles import estimate
from steadfast.operators.samples import sample

EPS = 2.220446049250313e-16


def pairs(stats: DataFrame, group: str, *, both_orders: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """group1, group2 and the statistics of both, with 1 and 2 after their names, for every two groups; a row for each group is few rows."""
    names = [c for c in stats.columns if c not in (group, *by)]
    a = stats.select(F.col(group).alias("group1"), *by, *(F.col(c).alias(f"{c}1") for c in names))
    b = stats.select(F.col(group).alias("group2"), *(F.col(c).alias(f"_{c}") for c in by), *(F.col(c).alias(f"{c}2") for c in names))
    on = F.col("group1") != F.col("group2") if both_orders else F.col("group1") < F.col("group2")
    for c in by:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return a.join(b, on).drop(*(f"_{c}" for c in by))


def difference(a: Column, b: Column) -> Column:
    return a - b


def ratio(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) >= EPS, a / b)


def log_ratio(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.log(a) - F.log(b))


def probability_range(start: float, end: float, step: float) -> list[float]:
    if step <= 0 or start > end:
        raise InvalidParameter("a range needs start <= end and a positive step")
    out, k = [], 0
    while start + k * step <= end + 1e-12:
        out.append(check_probability(min(start + k * step, 1.0)))
        k += 1
    return out


def quantile_comparison(df: DataFrame, group: str, column: str, ps: Sequence[float] = (0.5,), method: Method = HD) -> DataFrame:
    """group1, group2, p and value1, value2, shift (value1 - value2), ratio, log_ratio (null where undefined) for every two groups."""
    q = estimate(sample(df, column, [group]), [group], [check_probability(p) for p in ps], method).select(group, "p", F.col("q").alias("value"))
    both = pairs(q, group, by=["p"])
    a, b = F.col("value1"), F.col("value2")
    return both.select("group1", "group2", "p", "value1", "value2", difference(a, b).alias("shift"), ratio(a, b).alias("ratio"), log_ratio(a, b).alias("log_ratio"))
