"""Samples: what every operator starts from.

A sample is the values of a numeric column, for each group of the group columns, as (groups, x). Nulls are dropped; NaN
follows a policy: raise (the query fails on one), drop, or propagate (NaN counts as the largest value).

Ranks at scale: a window over a whole group sorts it in one task. Above WINDOW_ROWS rows in some group, groups are cut
at approximate quantiles into slices that different tasks sort, and counts of the slices before give the offset; slices
that are still too large are cut again. Equal values fall in one slice, so ranks are exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steadfast.errors import InvalidColumn, InvalidParameter, TypeMismatch

#: Rows of the largest group up to which a plain window ranks, and rows of a slice beyond that.
WINDOW_ROWS, SLICE_ROWS = 5_000_000, 1_000_000
#: Slices that one level cuts a group into at most: so many values go beside each row, and a search looks at twice their root.
MOST_SLICES = 1000


def check_column(df: DataFrame, name: str, numeric: bool = True) -> None:
    if name not in df.columns:
        raise InvalidColumn(f"no column {name!r}")
    kind = df.schema[name].dataType
    if numeric and not isinstance(kind, T.NumericType):
        raise TypeMismatch(f"column {name!r} is {kind.simpleString()}, not a number")


def sample(df: DataFrame, column: str, groups: Sequence[str] = (), *, order: Sequence[str] = (), nan_policy: str = "raise") -> DataFrame:
    """groups, order columns and x as double."""
    check_column(df, column)
    for g in (*groups, *order):
        check_column(df, g, numeric=False)
    if nan_policy not in ("raise", "drop", "propagate"):
        raise InvalidParameter(f"unknown nan_policy {nan_policy!r}")
    kind, x = df.schema[column].dataType, F.col(column).cast("double")
    keep = F.col(column).isNotNull()
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        if nan_policy == "drop":
            keep &= ~F.isnan(column)
        elif nan_policy == "raise":
            x = F.when(F.isnan(column), F.raise_error(F.lit(f"NaN in column {column}")).cast("double")).otherwise(x)
    return df.filter(keep).select(*groups, *(o for o in order if o not in groups), x.alias("x"))


def sizes(s: DataFrame, groups: Sequence[str]) -> DataFrame:
    return s.groupBy(*groups).agg(F.count("*").alias("n"))


def counted(s: DataFrame, groups: Sequence[str]) -> DataFrame:
    """groups, x, c: each value of a group once, and how often it is there."""
    return s.groupBy(*groups, "x").agg(F.count("*").alias("c"))


def ranked(s: DataFrame, groups: Sequence[str], most: int | None = None, _level: int = 0, *, times: str | None = None) -> DataFrame:
    """s with rank, from 1 within its group. most: rows of the largest group, if known; else they are counted.

    times: a column that says how often a row counts; its rank is that of its last copy then.
    """
    if most is None:
        most = sizes(s, groups).agg(F.max("n")).first()[0] or 0
    if most <= WINDOW_ROWS:
        by = Window.partitionBy(*groups).orderBy("x")
        return s.withColumn("rank", F.sum(times).over(by.rowsBetween(Window.unboundedPreceding, 0)) if times else F.row_number().over(by))
    part, slices = f"_slice{_level}", min(MOST_SLICES, max(2, most // SLICE_ROWS))
    cuts = s.groupBy(*groups).agg(F.percentile_approx("x", [k / slices for k in range(1, slices)], 100 * slices).alias("_cuts"))
    stride = max(1, math.isqrt(slices))
    cuts = cuts.withColumn("_rough", F.transform(F.sequence(F.lit(1), F.size("_cuts"), F.lit(stride)), lambda i: F.element_at("_cuts", i)))
    under = lambda a: F.size(F.filter(a, lambda c: c < F.col("x")))
    # how many cuts are below a value: first among every stride-th of them, then within one stride
    jump = F.greatest(F.lit(0), under("_rough") - 1) * stride
    placed = join_groups(s, cuts, groups).select(*s.columns, (jump + under(F.slice("_cuts", jump + 1, F.lit(stride)))).alias(part))
    counts = placed.groupBy(*groups, part).agg(F.count("*").alias("_c"), (F.sum(times) if times else F.count("*")).alias("_n"))
    largest = counts.agg(F.max("_c")).first()[0]
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c", "_n")
    # slices that are still too large are cut again, as long as that makes them smaller: equal values stay together
    within = ranked(placed, [*groups, part], largest if largest < most else min(largest, WINDOW_ROWS), _level + 1, times=times)
    return join_groups(within, before, [*groups, part]).select(*s.columns, (F.col("rank") + F.col("_before")).alias("rank"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def join_groups(a: DataFrame, b: DataFrame, groups: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins on the groups, nulls being equal, with the groups' columns once; without groups, single rows side by side."""
    if not groups:
        return a.crossJoin(F.broadcast(b))  # b is one row
    renamed = b.withColumnsRenamed({g: f"_{g}" for g in groups})
    return a.join(renamed, _all([a[g].eqNullSafe(renamed[f"_{g}"]) for g in groups]), how).drop(*(f"_{g}" for g in groups))
