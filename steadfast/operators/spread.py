"""Spread: absolute deviations from the median, interquartile range, trimmed and winsorized deviations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadfast.errors import InvalidParameter
from steadfast.functions.weights import HD, Method
from steadfast.operators.quantiles import estimate, measure, one_row, plain_median, weight_table, wide
from steadfast.operators.samples import join_groups, ranked, sample, sizes

#: Factors that make MAD and IQR estimate a normal's standard deviation, and 1.4826 as stability uses it.
MAD_FACTOR, IQR_FACTOR, STABILITY_FACTOR = 1.482602, 0.7413, 1.4826
#: Probabilities of the standard and the optimal quantile absolute deviation.
P_STANDARD, P_OPTIMAL = 0.682689492137086, 0.861678977787423
#: K_n of the standard deviation, n = 0 to 99.
K_STANDARD = (
    0.0, 1.7724, 1.3506, 1.3762, 1.1881, 1.1773, 1.1289, 1.1248, 1.0920, 1.0943,
    1.0764, 1.0738, 1.0630, 1.0637, 1.0533, 1.0537, 1.0482, 1.0468, 1.0419, 1.0429,
    1.0377, 1.0376, 1.0351, 1.0343, 1.0314, 1.0320, 1.0292, 1.0290, 1.0272, 1.0271,
    1.0251, 1.0253, 1.0238, 1.0235, 1.0223, 1.0224, 1.0210, 1.0210, 1.0201, 1.0199,
    1.0189, 1.0192, 1.0180, 1.0180, 1.0174, 1.0172, 1.0165, 1.0166, 1.0158, 1.0158,
    1.0152, 1.0152, 1.0146, 1.0146, 1.0141, 1.0140, 1.0135, 1.0137, 1.0130, 1.0131,
    1.0127, 1.0126, 1.0123, 1.0124, 1.0118, 1.0119, 1.0115, 1.0115, 1.0111, 1.0112,
    1.0108, 1.0108, 1.0106, 1.0106, 1.0102, 1.0103, 1.0100, 1.0100, 1.0097, 1.0097,
    1.0095, 1.0095, 1.0093, 1.0092, 1.0090, 1.0091, 1.0089, 1.0088, 1.0086, 1.0086,
    1.0084, 1.0084, 1.0082, 1.0082, 1.0081, 1.0081, 1.0079, 1.0079, 1.0078, 1.0077,
)
#: K_n of the optimal deviation, n = 0 to 99.
K_OPTIMAL = (
    0.0, 1.7729, 0.9788, 0.9205, 0.8194, 0.8110, 0.7792, 0.7828, 0.7600, 0.7535,
    0.7388, 0.7365, 0.7282, 0.7284, 0.7241, 0.7234, 0.7170, 0.7155, 0.7113, 0.7110,
    0.7083, 0.7088, 0.7068, 0.7056, 0.7030, 0.7024, 0.7006, 0.7006, 0.6995, 0.6998,
    0.6979, 0.6974, 0.6960, 0.6958, 0.6949, 0.6949, 0.6944, 0.6940, 0.6929, 0.6927,
    0.6918, 0.6918, 0.6913, 0.6914, 0.6907, 0.6904, 0.6897, 0.6896, 0.6891, 0.6892,
    0.6888, 0.6887, 0.6882, 0.6880, 0.6875, 0.6875, 0.6871, 0.6872, 0.6870, 0.6868,
    0.6863, 0.6862, 0.6859, 0.6859, 0.6857, 0.6858, 0.6854, 0.6853, 0.6850, 0.6849,
    0.6847, 0.6847, 0.6846, 0.6845, 0.6842, 0.6841, 0.6839, 0.6839, 0.6837, 0.6838,
    0.6836, 0.6834, 0.6833, 0.6832, 0.6831, 0.6830, 0.6829, 0.6830, 0.6827, 0.6827,
    0.6825, 0.6825, 0.6823, 0.6823, 0.6823, 0.6822, 0.6820, 0.6820, 0.6819, 0.6819,
)


@dataclass(frozen=True)
class Properties:
    name: str
    is_robust: bool
    breakdown_point: float
    gaussian_efficiency: float


PROPERTIES = {
    "mad": Properties("MAD", True, 0.5, 0.3675),
    "standard_qad": Properties("Standard QAD", True, 1 - P_STANDARD, 0.5406),
    "optimal_qad": Properties("Optimal QAD", True, 1 - P_OPTIMAL, 0.6522),
    "iqr": Properties("IQR", True, 0.25, 0.37),
    "std": Properties("Standard deviation", False, 0.0, 1.0),
}


def _table(values: Sequence[float], n: Column, beyond: Column) -> Column:
    return F.when(n < len(values), F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))).otherwise(beyond)


def k_standard(n: Column) -> Column:
    return _table(K_STANDARD, n, 1.0 + 0.762 / n + 0.967 / (n * n))


def k_optimal(n: Column) -> Column:
    return _table(K_OPTIMAL, n, 0.6747309 * (1.0 + 1.047 / n + 1.193 / (n * n)))


def deviation_quantile(s: DataFrame, groups: Sequence[str], p: float, method: Method = HD, cache=None) -> DataFrame:
    """groups, n, center, value: the p-quantile of absolute deviations from the median, for a sample (groups, x)."""
    measured, weights = measure(s, groups), cache.weights if cache is not None else None
    table = weight_table(s.sparkSession, measured, [0.5], method, weights)
    center = estimate(s, groups, [0.5], method, measured, table=table).select(*groups, F.col("q").alias("center"))
    away = join_groups(s, center, groups).select(*groups, F.abs(F.col("x") - F.col("center")).alias("x"))
    return join_groups(estimate(away, groups, [p], method, measured, weights, table if p == 0.5 else None).select(*groups, "n", F.col("q").alias("value")), center, groups)


def _result(df: DataFrame, groups: Sequence[str], value: Column, name: str) -> DataFrame:
    out = df.select(*groups, value.alias(name))
    return out if groups else one_row(out, [name])


def mad(df: DataFrame, column: str, groups: Sequence[str] = (), *, factor: float = 1.0, method: Method = HD, name: str | None = None, nan_policy: str = "raise", cache=None) -> DataFrame:
    """Median absolute deviation from the median, times a factor (MAD_FACTOR standardises)."""
    return qad(df, column, 0.5, groups, factor=factor, method=method, name=name or f"{column}_mad", nan_policy=nan_policy, cache=cache)


def qad(df: DataFrame, column: str, p: float, groups: Sequence[str] = (), *, factor: float = 1.0, method: Method = HD, name: str | None = None, nan_policy: str = "raise", cache=None) -> DataFrame:
    """factor times the p-quantile of absolute deviations from the median."""
    if not 0 <= p <= 1 or factor <= 0:
        raise InvalidParameter("qad needs p in [0, 1] and a positive factor")
    found = deviation_quantile(sample(df, column, groups, nan_policy=nan_policy), groups, p, method, cache)
    return _result(found, groups, F.col("value") * factor, name or f"{column}_qad")


def standard_qad(df: DataFrame, column: str, groups: Sequence[str] = (), *, method: Method = HD, name: str | None = None, nan_policy: str = "raise", cache=None) -> DataFrame:
    found = deviation_quantile(sample(df, column, groups, nan_policy=nan_policy), groups, P_STANDARD, method, cache)
    return _result(found, groups, F.col("value") * k_standard(F.col("n")), name or f"{column}_sqad")


def optimal_qad(df: DataFrame, column: str, groups: Sequence[str] = (), *, method: Method = HD, name: str | None = None, nan_policy: str = "raise", cache=None) -> DataFrame:
    found = deviation_quantile(sample(df, column, groups, nan_policy=nan_policy), groups, P_OPTIMAL, method, cache)
    return _result(found, groups, F.col("value") * k_optimal(F.col("n")), name or f"{column}_oqad")


def iqr(df: DataFrame, column: str, groups: Sequence[str] = (), *, factor: float = 1.0, method: Method = HD, name: str | None = None, nan_policy: str = "raise", cache=None) -> DataFrame:
    """Interquartile range times a factor (IQR_FACTOR standardises); null for fewer than 4 values."""
    found = wide(sample(df, column, groups, nan_policy=nan_policy), groups, [0.25, 0.75], method, weights=cache.weights if cache is not None else None)
    return _result(found, groups, F.when(F.col("n") >= 4, (F.col("q1") - F.col("q0")) * factor), name or f"{column}_iqr")


def _share(share: float) -> float:
    if not 0 <= share < 0.5:
        raise InvalidParameter("the share at each end must be in [0, 0.5)")
    return share


def trimmed_std(df: DataFrame, column: str, groups: Sequence[str] = (), *, share: float = 0.1, name: str | None = None, nan_policy: str = "raise") -> DataFrame:
    """Sample standard deviation without floor(n * share) values at each end; null below 3 values, or if under 2 are left."""
    s = sample(df, column, groups, nan_policy=nan_policy)
    r = join_groups(ranked(s, groups), sizes(s, groups), groups)
    cut = F.floor(F.col("n") * _share(share))
    kept = r.filter((F.col("rank") > cut) & (F.col("rank") <= F.col("n") - cut)).groupBy(*groups).agg(F.stddev_samp("x").alias("sd"), F.max("n").alias("n"), F.count("*").alias("left"))
    return _result(kept, groups, F.when((F.col("n") >= 3) & (F.col("left") >= 2), F.col("sd")), name or f"{column}_trimmed_std")


def winsorized_std(df: DataFrame, column: str, groups: Sequence[str] = (), *, share: float = 0.1, name: str | None = None, nan_policy: str = "raise") -> DataFrame:
    """Sample standard deviation with floor(n * share) values at each end set to the nearest that is left."""
    s = sample(df, column, groups, nan_policy=nan_policy)
    r = join_groups(ranked(s, groups), sizes(s, groups), groups).withColumn("cut", F.floor(F.col("n") * _share(share)))
    ends = r.groupBy(*groups).agg(F.max(F.when(F.col("rank") == F.col("cut") + 1, F.col("x"))).alias("lo"), F.max(F.when(F.col("rank") == F.col("n") - F.col("cut"), F.col("x"))).alias("hi"))
    held = join_groups(s, ends, groups).groupBy(*groups).agg(F.stddev_samp(F.least(F.greatest("x", "lo"), F.col("hi"))).alias("sd"), F.count("*").alias("n"))
    return _result(held, groups, F.when(F.col("n") >= 3, F.col("sd")), name or f"{column}_winsorized_std")


def standardize(df: DataFrame, column: str, groups: Sequence[str] = (), *, method: Method = HD, factor: float = MAD_FACTOR, name: str | None = None) -> DataFrame:
    """df with (value - median) / (factor * MAD) of its group; null where the scale is 0."""
    found = deviation_quantile(sample(df, column, groups), groups, 0.5, method).select(*groups, "center", (F.col("value") * factor).alias("_scale"))
    z = F.when(F.col("_scale") != 0, (F.col(column).cast("double") - F.col("center")) / F.col("_scale"))
    return join_groups(df, found, groups, "left").withColumn(name or f"{column}_z", z).drop("center", "_scale")


def plain_deviations(df: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """groups and deviation: each value's absolute distance from the plain sample median of its group."""
    s = sample(df, column, groups)
    return join_groups(s, plain_median(s, groups, "_center"), groups).withColumn("deviation", F.abs(F.col("x") - F.col("_center"))).drop("x", "_center")


METHODS = {
    "mad": mad, "smad": lambda *a, **k: mad(*a, factor=MAD_FACTOR, **k), "sqad": standard_qad, "oqad": optimal_qad, "qad": lambda df, c, groups=(), p=0.9, **k: qad(df, c, p, groups, **k),
    "iqr": iqr, "siqr": lambda *a, **k: iqr(*a, factor=IQR_FACTOR, **k), "trimmed_std": trimmed_std, "winsorized_std": winsorized_std,
}


def spread(df: DataFrame, columns: str | Sequence[str], kind: str, groups: Sequence[str] = (), **options) -> DataFrame:
    """One row for each group with a column {column}_{kind} for each column."""
    if kind not in METHODS:
        raise InvalidParameter(f"unknown spread {kind!r}; known are {', '.join(METHODS)}")
    out = None
    for c in [columns] if isinstance(columns, str) else columns:
        found = METHODS[kind](df, c, groups, name=f"{c}_{kind}", **options)
        out = found if out is None else join_groups(out, found, groups)
    return out
