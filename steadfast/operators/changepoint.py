"""Changepoints of series. A series is the values of a column in the order of other columns, for each group.

Recursions are written as window functions: CUSUM by the Lindley identity, EWMA by running sums of scaled blocks, slopes as
fixed filters over the last rows. Series are independent; one series is walked in one task, as its order demands.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadfast.errors import InvalidParameter
from steadfast.functions.weights import HD, Method
from steadfast.operators.quantiles import estimate, plain_median
from steadfast.operators.samples import join_groups, sample
from steadfast.operators.spread import deviation_quantile


def series(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """groups, idx from 0, x."""
    s = sample(df, column, groups, order=order)
    return s.select(*groups, (F.row_number().over(Window.partitionBy(*groups).orderBy(*order)) - 1).cast("long").alias("idx"), "x")


def _walk(groups: Sequence[str]) -> Window:
    return Window.partitionBy(*groups).orderBy("idx")


def _upto(groups: Sequence[str]) -> Window:
    return _walk(groups).rowsBetween(Window.unboundedPreceding, 0)


def thin(alarms: DataFrame, groups: Sequence[str], tolerance: int, lists: str | None = None) -> DataFrame:
    """Drops an alarm within `tolerance` indices of the last one kept, in the order of idx (and before it, of the column `lists`).

    An alarm that is surely further away than that from whatever was kept begins a chain, and chains don't influence each
    other: one whose indices are in a row keeps every (tolerance + 1)th, the others, which are short, are folded.
    """
    order = [lists, "idx"] if lists else ["idx"]
    by = Window.partitionBy(*groups).orderBy(*order)
    fields = [c for c in alarms.columns if c not in groups]
    step = F.abs(F.col("idx") - F.lag("idx").over(by))
    # the last one kept may be up to `tolerance` before the last alarm, which matters where idx goes back
    far = step > F.when(F.lag(lists).over(by) == F.col(lists), tolerance).otherwise(2 * tolerance) if lists else step > tolerance
    chained = alarms.withColumn("_step", step).withColumn("_first", F.coalesce(far, F.lit(True)))
    chained = chained.withColumn("_chain", F.sum(F.col("_first").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy(*groups, "_chain")
    even = F.max(F.when(~F.col("_first") & (F.col("_step") != 1), 1).otherwise(0)).over(chain) == 0
    if lists:
        even = even & (F.min(lists).over(chain) == F.max(lists).over(chain))
    chained = chained.withColumn("_even", even).withColumn("_place", F.row_number().over(chain.orderBy(*order)) - 1)
    row = F.struct(*order, *(c for c in fields if c not in order))
    folded = chained.filter("not _even").groupBy(*groups, "_chain").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    empty = F.filter("_rows", lambda r: F.lit(False))
    kept = F.aggregate("_rows", empty, lambda a, r: F.when((F.size(a) > 0) & (F.abs(r["idx"] - F.element_at(a, -1)["idx"]) <= tolerance), a).otherwise(F.concat(a, F.array(r))))
    folded = folded.select(*groups, F.explode(kept).alias("_r")).select(*groups, *(F.col(f"_r.{c}").alias(c) for c in fields))
    return chained.filter(F.col("_even") & (F.col("_place") % (tolerance + 1) == 0)).select(*groups, *fields).unionByName(folded)


def _positive(value: float, name: str) -> float:
    if value <= 0:
        raise InvalidParameter(f"{name} must be positive")
    return value


def cusum_statistics(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str] = (), *, target: float | None = None, drift: float = 0.5) -> DataFrame:
    """groups, idx, x, up, down: the sums of what exceeds the reference by drift, never below 0. Reference: target, or the series' median."""
    s = series(df, column, order, groups)
    if target is not None:
        s = s.withColumn("_ref", F.lit(float(target)))
    else:
        s = join_groups(s, plain_median(sample(df, column, groups), groups, "_ref"), groups)
    over = _upto(groups)
    for name, step in (("up", F.col("x") - F.col("_ref") - drift), ("down", F.col("_ref") - F.col("x") - drift)):
        s = s.withColumn("_s", F.sum(step).over(over))
        s = s.withColumn(name, F.col("_s") - F.least(F.lit(0.0), F.min("_s").over(over))).drop("_s")
    return s.drop("_ref")


def _alarms(stats: DataFrame, groups: Sequence[str], hit: Column, confidence: Column, kind: str) -> DataFrame:
    return stats.filter(hit).select(*groups, "idx", confidence.alias("confidence"), F.lit(kind).alias("change_type"))


def cusum(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str] = (), *, target: float | None = None, threshold: float = 4.0, drift: float = 0.5) -> DataFrame:
    """groups, idx, confidence, change_type of alarms, thinned by 1; series of fewer than 5 points have none."""
    _positive(threshold, "threshold")
    stats = cusum_statistics(df, column, order, groups, target=target, drift=drift).withColumn("_n", F.count("*").over(Window.partitionBy(*groups))).filter("_n >= 5")
    most = F.greatest("up", "down")
    return thin(_alarms(stats, groups, most > threshold, F.least(F.lit(1.0), most / (2 * threshold)), "MeanShift"), groups, 1)


def cusum_batch(df: DataFrame, column: str, order: Sequence[str], references: Sequence[float], groups: Sequence[str] = (), *, drift: float = 0.5) -> DataFrame:
    """cusum_statistics for several references, told apart by a column reference."""
    out = None
    for r in references:
        one = cusum_statistics(df, column, order, groups, target=r, drift=drift).withColumn("reference", F.lit(float(r)))
        out = one if out is None else out.unionByName(one)
    return out


def _dot(window: Window, coefficients: Sequence[float]) -> Column:
    """Sum of coefficients, oldest row first, times the window's values; shorter windows use the last coefficients."""
    c = F.array(*[F.lit(float(v)) for v in coefficients])
    values = F.collect_list("x").over(window)
    n = F.size(values)
    return F.aggregate(F.zip_with(values, F.slice(c, F.lit(len(coefficients)) - n + 1, n), lambda x, k: x * k), F.lit(0.0), lambda a, v: a + v)


def ewma_statistics(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str] = (), *, lam: float = 0.2, warmup: int = 20, target: float | None = None, method: Method = HD) -> DataFrame:
    """groups, idx, x, ewma, deviation, reference, spread: the average over all points from the reference on.

    Reference: target, or the median of the first `warmup` points; spread: their raw MAD. Rows are cut into blocks so long that
    (1 - lam) ** length is under 1e-200. Within a block the average is one running sum of values scaled up by their
    age, scaled down again; of all before, only what the block before ended with is more than 1e-200 of the sum.
    """
    lam = min(max(lam, 0.001), 1.0)
    s = series(df, column, order, groups)
    first = s.filter(F.col("idx") < warmup).select(*groups, "x")
    center = deviation_quantile(first, groups, 0.5, method).select(*groups, (F.lit(float(target)) if target is not None else F.col("center")).alias("reference"), F.col("value").alias("spread"))
    keep = 1 - lam
    length = 1 if lam == 1 else math.ceil(-200 * math.log(10) / math.log(keep))
    at = (F.col("idx") % length).cast("double")
    s = s.withColumn("_block", F.floor(F.col("idx") / length))
    block = Window.partitionBy(*groups, "_block").orderBy("idx")
    upto = block.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_sum", F.sum(lam * F.col("x") * F.pow(F.lit(keep), -at)).over(upto) * F.pow(F.lit(keep), at) if lam < 1 else F.col("x"))
    before = Window.partitionBy(*groups).orderBy("_block", "idx").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_carry", F.last(F.when(at == length - 1, F.col("_sum")), ignorenulls=True).over(before))
    s = join_groups(s, center, groups)
    value = F.col("_sum") + F.pow(F.lit(keep), at + 1) * F.coalesce("_carry", "reference")
    return s.withColumn("ewma", value).withColumn("deviation", F.abs(F.col("x") - F.col("ewma"))).drop("_sum", "_carry", "_block")


def ewma(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str] = (), *, lam: float = 0.2, multiplier: float = 3.0, warmup: int = 20, target: float | None = None, method: Method = HD) -> DataFrame:
    """Alarms where the average is off by more than multiplier * spread, after the warm-up, thinned by 3; series of fewer than 30 points have none."""
    stats = ewma_statistics(df, column, order, groups, lam=lam, warmup=warmup, target=target, method=method)
    stats = stats.withColumn("_n", F.count("*").over(Window.partitionBy(*groups))).filter("_n >= 30")
    off, limit = F.abs(F.col("ewma") - F.col("reference")), multiplier * F.col("spread")
    return thin(_alarms(stats, groups, (F.col("idx") >= warmup) & (off > limit), F.least(F.lit(1.0), off / (2 * limit)), "Drift"), groups, 3)


def window_slopes(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str] = (), *, window: int = 10) -> DataFrame:
    """groups, i, slope: the least-squares slope of every full window, i being its first index."""
    s = series(df, column, order, groups)
    over = _walk(groups).rowsBetween(1 - window, 0)
    return s.withColumn("slope", F.regr_slope("x", F.col("idx").cast("double")).over(over)).filter(F.col("idx") >= window - 1).select(*groups, (F.col("idx") - window + 1).alias("i"), "slope")


def slope_filter(window: int, degree: int = 1, normalized: bool = True) -> list[float]:
    """Coefficients that give a window's fitted linear term, oldest value first: a row of the design's pseudo-inverse."""
    t = np.arange(window, dtype=float)
    if normalized:
        t = 2 * t / (window - 1) - 1
    design = np.vander(t, degree + 1, increasing=True)
    q, r = np.linalg.qr(design)
    row = np.linalg.solve(r, q.T)[1]
    return list(row * ((window - 1) / 2 if normalized else 1.0))


def polynomial_window_slopes(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str] = (), *, window: int = 25, degree: int = 1, normalized: bool = True) -> DataFrame:
    """groups, i, slope by a polynomial fit of every full window; a fixed filter, since all windows have one design."""
    if degree < 1 or window <= degree:
        raise InvalidParameter("the window must be longer than the degree, which is 1 at least")
    s = series(df, column, order, groups)
    over = _walk(groups).rowsBetween(1 - window, 0)
    s = s.withColumn("slope", _dot(over, slope_filter(window, degree, normalized))).filter(F.col("idx") >= window - 1)
    return s.select(*groups, (F.col("idx") - window + 1).alias("i"), "slope")


def _spread_of(s: DataFrame, groups: Sequence[str], name: str, method: Method) -> DataFrame:
    return deviation_quantile(s, groups, 0.5, method).select(*groups, F.col("value").alias(name))


def _jumps(slopes: DataFrame, groups: Sequence[str], multiplier: float, shift: int, kind: str, least: float, method: Method) -> DataFrame:
    """Alarms from (groups, i, x): x above multiplier times its spread."""
    limit = _spread_of(slopes.select(*groups, "x"), groups, "_spread", method)
    found = join_groups(slopes, limit, groups).withColumn("_limit", multiplier * F.col("_spread"))
    confidence = F.least(F.lit(1.0), F.col("x") / (2 * F.col("_limit")))
    return found.filter((F.col("x") > F.col("_limit")) & (confidence >= least)).select(*groups, (F.col("i") + shift).alias("idx"), confidence.alias("confidence"), F.lit(kind).alias("change_type"))


def _differences(slopes: DataFrame, groups: Sequence[str]) -> DataFrame:
    by = Window.partitionBy(*groups).orderBy("i")
    return slopes.withColumn("x", F.abs(F.lead("slope").over(by) - F.col("slope"))).filter("x is not null").select(*groups, "i", "x")


def slopes(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str] = (), *, window: int = 10, multiplier: float = 3.0, min_confidence: float = 0.5, method: Method = HD) -> DataFrame:
    """Alarms where the slopes of neighbouring windows differ much, thinned by 2; series shorter than two windows have none."""
    found = window_slopes(df, column, order, groups, window=window)
    found = found.withColumn("_n", F.count("*").over(Window.partitionBy(*groups))).filter(F.col("_n") >= window + 1).drop("_n")
    return thin(_jumps(_differences(found, groups), groups, multiplier, window, "TrendChange", min_confidence, method), groups, 2)


def polynomial_slopes(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str] = (), *, window: int = 25, degree: int = 1, multiplier: float = 3.0, steady_multiplier: float = 2.0, steady_windows: int = 3, min_confidence: float = 0.5, normalized: bool = True, method: Method = HD, _thin: bool = True) -> DataFrame:
    """Trend changes as in slopes(), and steady states: the third and later of windows in a row with a small slope.

    Thinned by 2 with all trend changes before all steady states, as one list in that order.
    """
    found = polynomial_window_slopes(df, column, order, groups, window=window, degree=degree, normalized=normalized)
    trend = _jumps(_differences(found, groups), groups, multiplier, window, "TrendChange", min_confidence, method)
    limit = _spread_of(found.select(*groups, F.abs("slope").alias("x")), groups, "_spread", method)
    walked = join_groups(found, limit, groups).withColumn("_limit", steady_multiplier * F.col("_spread"))
    by = Window.partitionBy(*groups).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    moving = F.max(F.when(F.abs("slope") >= F.col("_limit"), F.col("i"))).over(by)
    run = F.col("i") - F.coalesce(moving, F.lit(-1))
    steady = walked.withColumn("_run", run).filter(F.col("_run") >= steady_windows)
    steady = steady.select(*groups, (F.col("i") + window).alias("idx"), F.least(F.lit(1.0), F.col("_limit") / (F.abs("slope") + 1e-10)).alias("confidence"), F.lit("SteadyState").alias("change_type"))
    both = trend.withColumn("_list", F.lit(0)).unionByName(steady.withColumn("_list", F.lit(1)))
    return thin(both, groups, 2, "_list").drop("_list") if _thin else both


def adaptive_slopes(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str] = (), *, window: int = 25, acceleration_multiplier: float = 2.5, min_confidence: float = 0.5, method: Method = HD, **options) -> DataFrame:
    """polynomial_slopes, and changes of acceleration: second differences of the slopes that are large. Thinned by 3, those after the rest."""
    base = polynomial_slopes(df, column, order, groups, window=window, min_confidence=min_confidence, method=method, **options)
    found = polynomial_window_slopes(df, column, order, groups, window=window, degree=options.get("degree", 1), normalized=options.get("normalized", True))
    by = Window.partitionBy(*groups).orderBy("i")
    second = F.abs(F.lead("slope", 2).over(by) - 2 * F.lead("slope", 1).over(by) + F.col("slope"))
    accel = _jumps(found.withColumn("x", second).filter("x is not null").select(*groups, "i", "x"), groups, acceleration_multiplier, window + 2, "AccelerationChange", min_confidence, method)
    both = base.withColumn("_list", F.lit(0)).unionByName(accel.withColumn("_list", F.lit(1)))
    return thin(both, groups, 3, "_list").drop("_list")


def rolling(df: DataFrame, column: str, order: Sequence[str], statistics: dict[str, Column], groups: Sequence[str] = (), *, window: int) -> DataFrame:
    """groups, i and any aggregates of x over every full window."""
    s = series(df, column, order, groups)
    over = _walk(groups).rowsBetween(1 - window, 0)
    return s.select(*groups, "idx", *(c.over(over).alias(n) for n, c in statistics.items())).filter(F.col("idx") >= window - 1).withColumn("i", F.col("idx") - window + 1).drop("idx")


def confident(alarms: DataFrame, least: float) -> DataFrame:
    return alarms.filter(F.col("confidence") >= least)


def most_confident(alarms: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """The alarm of the highest confidence of each group, the latest of equal ones."""
    return alarms.groupBy(*groups).agg(F.max(F.struct("confidence", "idx", "change_type")).alias("_a")).select(*groups, "_a.idx", "_a.confidence", "_a.change_type")


__all__ = ["estimate", "adaptive_slopes", "confident", "cusum", "cusum_batch", "cusum_statistics", "ewma", "ewma_statistics", "most_confident", "polynomial_slopes", "rolling", "series", "slopes", "thin"]
