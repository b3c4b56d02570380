"""Effect sizes of every two groups of a column. Groups are aggregated first; only their few rows are paired."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadfast.errors import InvalidParameter
from steadfast.functions.expressions import interpret
from steadfast.functions.special import normal_ppf
from steadfast.functions.weights import HD, Method
from steadfast.operators.compare import pairs
from steadfast.operators.quantiles import estimate
from steadfast.operators.samples import join_groups, sample
from steadfast.operators.spread import deviation_quantile


def location_scale(df: DataFrame, group: str, column: str, *, robust: bool = False, factor: float = 1.0, method: Method = HD) -> DataFrame:
    """group, n, location, scale: mean and standard deviation, or median and factor * MAD."""
    s = sample(df, column, [group])
    if robust:
        found = deviation_quantile(s, [group], 0.5, method)
        return found.select(group, "n", F.col("center").alias("location"), (F.col("value") * factor).alias("scale"))
    return s.groupBy(group).agg(F.count("*").alias("n"), F.avg("x").alias("location"), F.stddev_samp("x").alias("scale"))


def _n(c: str) -> Column:
    return F.col(c).cast("double")


def _pooled() -> Column:
    n1, n2 = _n("n1"), _n("n2")
    v = ((n1 - 1) * F.pow("scale1", F.lit(2.0)) + (n2 - 1) * F.pow("scale2", F.lit(2.0))) / (n1 + n2 - 2)
    return F.when((F.col("scale1") > 0) & (F.col("scale2") > 0), F.sqrt(v))


def _out(both: DataFrame, value: Column, kind: str, *more: Column) -> DataFrame:
    with_value = both.withColumn("magnitude", value)
    return with_value.select("group1", "group2", "n1", "n2", "magnitude", interpret(F.col("magnitude"), kind).alias("interpretation"), *more)


def cohen_d(df: DataFrame, group: str, column: str, *, welch: bool = False, robust: bool = False, method: Method = HD) -> DataFrame:
    """(location1 - location2) / pooled scale, or with welch over the standard error; null if a scale is not positive."""
    both = pairs(location_scale(df, group, column, robust=robust, method=method), group)
    if welch:
        error = F.sqrt(F.pow("scale1", F.lit(2.0)) / _n("n1") + F.pow("scale2", F.lit(2.0)) / _n("n2"))
        scale = F.when((F.col("scale1") > 0) & (F.col("scale2") > 0), error)
    else:
        scale = _pooled()
    return _out(both, (F.col("location1") - F.col("location2")) / scale, "difference")


def hedges_g(df: DataFrame, group: str, column: str, *, robust: bool = False, method: Method = HD) -> DataFrame:
    """Cohen's d with the correction for small samples."""
    both = pairs(location_scale(df, group, column, robust=robust, method=method), group)
    total = _n("n1") + _n("n2")
    j = 1 - 3 / F.when(total <= 9, 4 * (total - 2) - 1).otherwise(4 * total - 9)
    return _out(both, (F.col("location1") - F.col("location2")) / _pooled() * j, "difference")


def glass_delta(df: DataFrame, group: str, column: str, *, robust: bool = False, method: Method = HD) -> DataFrame:
    """(location2 - location1) / scale1: the first group is the control."""
    both = pairs(location_scale(df, group, column, robust=robust, method=method), group)
    return _out(both, F.when(F.col("scale1") > 0, (F.col("location2") - F.col("location1")) / F.col("scale1")), "difference")


def wins(df: DataFrame, group: str, column: str) -> DataFrame:
    """group1, group2, n1, n2, and how many pairs of values have the second, the first, or neither larger, for every two groups.

    Counts by value and group come first. A value's count in one group meets how many values of the other are below it
    by a running sum over the distinct values: no pairs of values are made.
    """
    s = sample(df, column, [group])
    counts = s.groupBy(group, "x").agg(F.count("*").alias("c"))
    totals = counts.groupBy(group).agg(F.sum("c").alias("n"))
    names = totals.select(F.col(group).alias("other"), F.col("n").alias("m"))
    # each value of a group is looked at against each other group; the groups are few, the values stay where they are
    events = counts.select(F.col(group).alias("g"), "x", "c")
    tagged = events.join(F.broadcast(names), F.col("g") < F.col("other")).select(F.col("g").alias("group1"), F.col("other").alias("group2"), "x", F.col("c").alias("c1"), F.lit(0).alias("c2"))
    tagged = tagged.unionByName(events.join(F.broadcast(names), F.col("other") < F.col("g")).select(F.col("other").alias("group1"), F.col("g").alias("group2"), "x", F.lit(0).alias("c1"), F.col("c").alias("c2")))
    byvalue = tagged.groupBy("group1", "group2", "x").agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2"))
    below = Window.partitionBy("group1", "group2").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    walked = byvalue.withColumn("b1", F.coalesce(F.sum("c1").over(below), F.lit(0))).withColumn("b2", F.coalesce(F.sum("c2").over(below), F.lit(0)))
    d = lambda c: F.col(c).cast("double")
    return walked.groupBy("group1", "group2").agg(
        F.sum("c1").alias("n1"), F.sum("c2").alias("n2"), F.sum(d("c2") * d("b1")).alias("more"), F.sum(d("c1") * d("b2")).alias("less"), F.sum(d("c1") * d("c2")).alias("same")
    )


def cliff_delta(df: DataFrame, group: str, column: str, *, level: float = 0.95) -> DataFrame:
    """(pairs with the second larger - pairs with the first larger) / all pairs, with its interval."""
    both = wins(df, group, column)
    n1, n2 = _n("n1"), _n("n2")
    half = normal_ppf((1 + level) / 2) * F.sqrt((n1 + n2 + 1) / (3 * n1 * n2))
    value = (F.col("more") - F.col("less")) / (n1 * n2)
    return _out(both, value, "dominance", F.greatest(F.lit(-1.0), F.col("magnitude") - half).alias("lower"), F.least(F.lit(1.0), F.col("magnitude") + half).alias("upper"))


def cles(df: DataFrame, group: str, column: str, *, ties: bool = True, level: float = 0.95) -> DataFrame:
    """Probability that a value of the second group is larger, equal ones counting half, or not at all."""
    both = wins(df, group, column)
    n1, n2 = _n("n1"), _n("n2")
    half = normal_ppf((1 + level) / 2) * F.sqrt((n1 + n2 + 1) / (12 * n1 * n2))
    value = (F.col("more") + (F.col("same") / 2 if ties else 0)) / (n1 * n2)
    return _out(both, value, "probability", F.greatest(F.lit(0.0), F.col("magnitude") - half).alias("lower"), F.least(F.lit(1.0), F.col("magnitude") + half).alias("upper"))


def _sums(df: DataFrame, group: str, column: str) -> DataFrame:
    s = sample(df, column, [group])
    stats = s.groupBy(group).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("v"))
    both = pairs(stats, group)
    n1, n2 = _n("n1"), _n("n2")
    grand = (n1 * F.col("mean1") + n2 * F.col("mean2")) / (n1 + n2)
    between = n1 * F.pow(F.col("mean1") - grand, F.lit(2.0)) + n2 * F.pow(F.col("mean2") - grand, F.lit(2.0))
    return both.withColumn("ssb", between).withColumn("ssw", n1 * F.col("v1") + n2 * F.col("v2"))


def point_biserial(df: DataFrame, group: str, column: str) -> DataFrame:
    """Correlation of the values with 0 for the first group and 1 for the second; null where nothing varies."""
    both = _sums(df, group, column)
    total = F.col("ssb") + F.col("ssw")
    return _out(both, F.when(total > 0, F.signum(F.col("mean2") - F.col("mean1")) * F.sqrt(F.col("ssb") / total)), "correlation")


def eta_squared(df: DataFrame, group: str, column: str) -> DataFrame:
    both = _sums(df, group, column)
    total = F.col("ssb") + F.col("ssw")
    return _out(both, F.when(total > 0, F.col("ssb") / total), "variance")


def omega_squared(df: DataFrame, group: str, column: str) -> DataFrame:
    both = _sums(df, group, column)
    within = F.col("ssw") / (_n("n1") + _n("n2") - 2)
    value = F.greatest(F.lit(0.0), (F.col("ssb") - within) / (F.col("ssb") + F.col("ssw") + within))
    return _out(both, F.when((F.col("n1") + F.col("n2") >= 4) & (F.col("ssb") + F.col("ssw") > 0), value), "variance")


METHODS = {"cohen_d": cohen_d, "hedges_g": hedges_g, "glass_delta": glass_delta, "cliff_delta": cliff_delta, "cles": cles, "point_biserial": point_biserial, "eta_squared": eta_squared, "omega_squared": omega_squared}


def effect_size(df: DataFrame, group: str, column: str, kind: str, **options) -> DataFrame:
    """group1, group2, n1, n2, magnitude, interpretation (and an interval, if the kind has one) for every two groups."""
    if kind not in METHODS:
        raise InvalidParameter(f"unknown effect size {kind!r}; known are {', '.join(METHODS)}")
    return METHODS[kind](df, group, column, **options)


__all__: Sequence[str] = [*METHODS, "effect_size", "location_scale", "wins", "estimate", "join_groups"]
