"""Histograms with fixed, rule-based and quantile bins, and distances between the histograms of two groups.

A histogram is rows (groups, bin, left, right, count, density), every bin included. Values are counted with map-side
combine; bins, a few hundred for each group, are made from aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadfast.errors import InvalidParameter
from steadfast.functions.weights import HD, Method
from steadfast.operators.quantiles import estimate_counted, measure
from steadfast.operators.samples import _all, counted, join_groups, ranked, sample, sizes

EDGE = 1e-10


def _fixed(s: DataFrame, groups: Sequence[str], stats: DataFrame) -> DataFrame:
    """For stats (groups, n, lo, hi, k): k equal bins from lo to hi, the last one closed; one bin from the least to the largest value, without a density, if they are equal."""
    flat = F.col("hi") - F.col("lo") < EDGE
    stats = stats.withColumn("k", F.when(flat, 1).otherwise(F.greatest(F.lit(1), F.col("k"))).cast("int")).withColumn("width", F.when(~flat, (F.col("hi") - F.col("lo")) / F.col("k")))
    lo, w = F.col("lo"), F.col("width")
    guess = F.floor((F.col("x") - lo) / w)
    # the edges themselves decide, not the division
    guess = F.when(F.col("x") < lo + guess * w, guess - 1).when(F.col("x") >= lo + (guess + 1) * w, guess + 1).otherwise(guess)
    placed = join_groups(s, stats, groups).select(*groups, F.greatest(F.lit(0), F.least(F.coalesce(guess, F.lit(0)), F.col("k") - 1)).cast("int").alias("bin"))
    counts = placed.groupBy(*groups, "bin").agg(F.count("*").alias("count"))
    bins = stats.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    left = F.when(flat, lo).otherwise(lo + F.col("bin") * w)
    bins = bins.select(*groups, "bin", left.alias("left"), F.when((F.col("bin") == F.col("k") - 1) & ~flat, F.col("hi")).when(flat, F.col("hi")).otherwise(lo + (F.col("bin") + 1) * w).alias("right"), "n", "width")
    found = join_groups(bins, counts, [*groups, "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return found.select(*groups, "bin", "left", "right", "count", (F.col("count") / (F.col("n") * F.col("width"))).alias("density"))


def _stats(s: DataFrame, groups: Sequence[str], *more: Column) -> DataFrame:
    return s.groupBy(*groups).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), *more).filter("n > 0")


def fixed_width(df: DataFrame, column: str, bins: int, groups: Sequence[str] = ()) -> DataFrame:
    s = sample(df, column, groups)
    return _fixed(s, groups, _stats(s, groups).withColumn("k", F.lit(max(1, int(bins)))))


def _bins_for(width: Column) -> Column:
    reach = F.col("hi") - F.col("lo")
    return F.when((width > 0) & (reach >= EDGE), F.ceil(reach / width)).otherwise(1)


def scott(df: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """Bins of width 3.5 population deviations times n^(-1/3)."""
    s = sample(df, column, groups)
    stats = _stats(s, groups, F.stddev_pop("x").alias("sd"))
    return _fixed(s, groups, stats.withColumn("k", _bins_for(3.5 * F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-1 / 3)))))


def freedman_diaconis(df: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """Bins of width 2 IQR times n^(-1/3); the quartiles are the values at n / 4 and 3 n / 4 in order, rounded down."""
    s = sample(df, column, groups)
    r = join_groups(ranked(s, groups), sizes(s, groups), groups)
    at = lambda share: F.max(F.when(F.col("rank") == F.floor(F.col("n") * share / 4) + 1, F.col("x")))
    iqr = r.groupBy(*groups).agg((at(3) - at(1)).alias("iqr"))
    stats = join_groups(_stats(s, groups), iqr, groups)
    return _fixed(s, groups, stats.withColumn("k", _bins_for(2 * F.col("iqr") * F.pow(F.col("n").cast("double"), F.lit(-1 / 3)))))


def uniform_steps(k: int) -> list[float]:
    return [i / k for i in range(k + 1)]


def exponential_steps(k: int) -> list[float]:
    """Steps that are finer at both ends."""
    h = k // 2
    first = [0.5 * (1 - math.exp(-5 * i / h)) for i in range(1, h + 1)] if h else []
    whole = [0.0, *first]
    return [*whole, *(1 - whole[h - i] for i in range(1, h)), 1.0]


def with_edges(s: DataFrame, groups: Sequence[str], ps: Sequence[float], method: Method, n_of: DataFrame | None = None) -> DataFrame:
    """Bins between the quantiles at ps, equal edges once; values counted anew, the last bin closed.

    n_of: groups and n of the groups that are wanted; else all are.
    """
    n_of = n_of if n_of is not None else sizes(s, groups)
    values = counted(s, groups)
    edges = estimate_counted(join_groups(values, n_of, groups), groups, sorted(set(ps)), measure(s, groups, n_of), method)
    edges = edges.groupBy(*groups, "n").agg(F.sort_array(F.collect_list("q")).alias("e"))
    kept = F.aggregate("e", F.array().cast("array<double>"), lambda a, x: F.when((F.size(a) > 0) & (x - F.element_at(a, -1) < EDGE), a).otherwise(F.concat(a, F.array(x))))
    edges = edges.withColumn("e", kept).withColumn("e", F.when(F.size("e") == 1, F.array(F.col("e")[0], F.col("e")[0] + 1)).otherwise(F.col("e")))
    edges = edges.hint("rebalance")  # an exchange with the same columns for counts and bins is made once, and so are the quantiles below it
    k = F.size("e") - 1
    # how many edges are not above a value: first among every stride-th of them, then within one stride
    stride = max(1, math.isqrt(len(ps)))
    rough = edges.withColumn("rough", F.transform(F.sequence(F.lit(1), F.size("e"), F.lit(stride)), lambda i: F.element_at("e", i)))
    jump = F.greatest(F.lit(0), F.size(F.filter("rough", lambda x: x <= F.col("x"))) - 1) * stride
    below = jump + F.size(F.filter(F.slice("e", jump + 1, F.lit(stride)), lambda x: x <= F.col("x"))) - 1
    counts = join_groups(values, rough, groups)
    counts = counts.select(*groups, "n", F.greatest(F.lit(0), F.least(below, k - 1)).alias("bin"), "c").groupBy(*groups, "n", "bin").agg(F.sum("c").alias("count"))
    bins = edges.select(*groups, "n", F.posexplode(F.transform(F.sequence(F.lit(1), k), lambda i: F.struct(F.element_at("e", i).alias("left"), F.element_at("e", i + 1).alias("right")))).alias("bin", "b"))
    found = join_groups(bins.select(*groups, "n", "bin", "b.left", "b.right"), counts, [*groups, "n", "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return found.select(*groups, "bin", "left", "right", "count", (F.col("count") / (F.col("n") * (F.col("right") - F.col("left")))).alias("density"))


def quantile_bins(df: DataFrame, column: str, bins: int, groups: Sequence[str] = (), method: Method = HD) -> DataFrame:
    """Bins that hold about equally many values. Groups with fewer values than bins get as many bins of one width as values."""
    if bins < 1:
        raise InvalidParameter("a histogram needs a bin at least")
    s = sample(df, column, groups)
    n = sizes(s, groups)
    if n.filter(F.col("n").between(1, bins - 1)).limit(1).count() == 0:
        return with_edges(s, groups, uniform_steps(bins), method)
    full = join_groups(s, n, groups)
    small = full.filter(F.col("n") < bins).drop("n")
    large = full.filter(F.col("n") >= bins).drop("n")
    return with_edges(large, groups, uniform_steps(bins), method).unionByName(_fixed(small, groups, _stats(small, groups).withColumn("k", F.col("n"))))


def qrde(df: DataFrame, column: str, steps: Sequence[float] | Callable[[int], Sequence[float]], groups: Sequence[str] = (), *, bins: int = 100, method: Method = HD) -> DataFrame:
    """Quantile-respectful density: bins between the quantiles at any steps from 0 to 1, or at those a function of `bins` gives."""
    return with_edges(sample(df, column, groups), groups, steps(bins) if callable(steps) else steps, method)


def adaptive_qrde(df: DataFrame, column: str, groups: Sequence[str] = (), method: Method = HD) -> DataFrame:
    """As many bins as the root of the largest group's size, rounded up."""
    most = sizes(sample(df, column, groups), groups).agg(F.max("n")).first()[0] or 1
    return qrde(df, column, uniform_steps(math.ceil(math.sqrt(most))), groups, method=method)


def accessors(hist: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """groups, bins, total, lower, upper, and the largest and smallest density and largest count."""
    return hist.groupBy(*groups).agg(
        F.count("*").alias("bins"), F.sum("count").alias("total"), F.min("left").alias("lower"), F.max("right").alias("upper"), F.max("density").alias("max_density"), F.min("density").alias("min_density"), F.max("count").alias("max_count")
    )


def bin_values(hist: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """hist with center, width, frequency (the share of the group's values) and normalized (the density over the group's highest)."""
    whole = hist.groupBy(*groups).agg(F.sum("count").alias("_total"), F.max("density").alias("_most"))
    out = join_groups(hist, whole, groups)
    out = out.withColumn("center", (F.col("left") + F.col("right")) / 2).withColumn("width", F.col("right") - F.col("left"))
    out = out.withColumn("frequency", F.when(F.col("_total") > 0, F.col("count") / F.col("_total"))).withColumn("normalized", F.when(F.col("_most") > 0, F.col("density") / F.col("_most")))
    return out.drop("_total", "_most")


def find_bin(hist: DataFrame, values: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """values with the bin that holds them: left <= value < right, the last bin closed; null outside."""
    edges = hist.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("left", "right", "bin"))).alias("_bins"))
    last = F.element_at("_bins", -1)
    inside = F.filter("_bins", lambda b: (F.col(column) >= b["left"]) & ((F.col(column) < b["right"]) | ((b["bin"] == last["bin"]) & (F.col(column) == b["right"]))))
    return join_groups(values, edges, groups, "left").withColumn("bin", F.try_element_at(inside, F.lit(1))["bin"]).drop("_bins")


# ------------------------------------------------------------------ distances


def _pairs(hist: DataFrame, group: str) -> DataFrame:
    """(group1, group2, edge, next, last, side bins) frames of merged edges for every two groups; all are tables of bins."""
    names = hist.select(F.col(group).alias("g")).distinct()
    both = names.alias("a").join(names.alias("b"), F.col("a.g") < F.col("b.g")).select(F.col("a.g").alias("group1"), F.col("b.g").alias("group2"))
    ends = hist.select(F.col(group).alias("g"), F.explode(F.array("left", "right")).alias("edge"))
    edges = both.join(ends, (F.col("g") == F.col("group1")) | (F.col("g") == F.col("group2"))).select("group1", "group2", "edge").distinct()
    by = Window.partitionBy("group1", "group2").orderBy("edge")
    return edges.withColumn("next", F.lead("edge").over(by)).filter("next is not null")


def _with_bins(edges: DataFrame, hist: DataFrame, group: str) -> DataFrame:
    sides = hist.groupBy(F.col(group).alias("g")).agg(F.sort_array(F.collect_list(F.struct("left", "right", "count"))).alias("bins"), F.sum("count").cast("double").alias("total"))
    for k in ("1", "2"):
        side = sides.withColumnsRenamed({"g": f"g{k}", "bins": f"bins{k}", "total": f"total{k}"})
        edges = edges.join(side, F.col(f"group{k}") == F.col(f"g{k}"))
    return edges


def _mass(k: str) -> Column:
    centre = (F.col("edge") + F.col("next")) / 2
    holds = F.filter(f"bins{k}", lambda b: (b["left"] <= centre) & (centre < b["right"]))
    return F.coalesce(F.try_element_at(holds, F.lit(1))["count"] / F.col(f"total{k}"), F.lit(0.0))


def _cdf(k: str) -> Column:
    share = lambda b: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("edge") - b["left"]) / (b["right"] - b["left"])))
    return F.aggregate(f"bins{k}", F.lit(0.0), lambda a, b: a + b["count"] * share(b)) / F.col(f"total{k}")


def distances(hist: DataFrame, group: str) -> DataFrame:
    """group1, group2, and wasserstein, kl, chi_squared, intersection, bhattacharyya of every two groups' histograms.

    On the merged edges each stretch gets the whole mass of the bin that holds its centre, made to sum to 1; the
    Wasserstein distance sums the difference of the interpolated distribution functions at the left ends.
    """
    parts = _with_bins(_pairs(hist, group), hist, group)
    parts = parts.select("group1", "group2", ((F.col("next") - F.col("edge")) * F.abs(_cdf("1") - _cdf("2"))).alias("area"), _mass("1").alias("m1"), _mass("2").alias("m2"))
    sums = parts.groupBy("group1", "group2").agg(F.sum("m1").alias("s1"), F.sum("m2").alias("s2"), F.sum("area").alias("wasserstein"), F.collect_list(F.struct("m1", "m2")).alias("m"))
    p, q = (lambda x: x["m1"] / F.col("s1")), (lambda x: x["m2"] / F.col("s2"))
    total = lambda f: F.aggregate("m", F.lit(0.0), lambda a, x: a + f(x))
    eps = 1e-10
    bc = total(lambda x: F.sqrt(p(x) * q(x)))
    return sums.select(
        "group1", "group2", "wasserstein",
        total(lambda x: F.when(p(x) > eps, p(x) * F.log(p(x) / F.greatest(q(x), F.lit(eps)))).otherwise(0.0)).alias("kl"),
        (0.5 * total(lambda x: F.when(p(x) + q(x) > 0, (p(x) - q(x)) * (p(x) - q(x)) / (p(x) + q(x))).otherwise(0.0))).alias("chi_squared"),
        total(lambda x: F.least(p(x), q(x))).alias("intersection"),
        F.when(bc >= 1, 0.0).when(bc == 0, float("inf")).otherwise(F.greatest(F.lit(0.0), -F.log(bc))).alias("bhattacharyya"),
    )


__all__ = ["_all", "accessors", "adaptive_qrde", "distances", "exponential_steps", "find_bin", "fixed_width", "freedman_diaconis", "qrde", "quantile_bins", "scott", "uniform_steps"]
