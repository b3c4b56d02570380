"""Confidence intervals: Maritz-Jarrett, asymptotic, and bootstrap.

Bootstrap resamples are drawn by position: replicate b takes, as its i-th value, the one at a hash of (seed, b, i)
modulo n. The hash is 64-bit integer arithmetic, so any engine draws the same resamples. Replicates are blocks of an
Arrow function over numbers of replicates, each with the whole sample of its group: a bootstrap is for samples that
fit a worker, MAX_SAMPLE values, which is checked.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadfast.errors import InvalidConfidenceLevel, InvalidInput, InvalidParameter
from steadfast.functions.expressions import normal_cdf
from steadfast.functions.expressions import normal_ppf as ppf_column
from steadfast.functions.special import normal_ppf, t_ppf
from steadfast.functions.weights import HD, Method, check_probability
from steadfast.operators.compare import pairs
from steadfast.operators.quantiles import estimate
from steadfast.operators.samples import sample

#: Confidence levels by name, and resamples for quick, usual and final results.
LEVELS = {"90": 0.9, "95": 0.95, "99": 0.99}
FAST, STANDARD, PRECISE = 10_000, 20_000, 30_000
MAX_SAMPLE, BLOCK_CELLS = 2_000_000, 4_000_000


def _level(level: float) -> float:
    if not 0 < level < 1:
        raise InvalidConfidenceLevel(f"{level} is not in (0, 1)")
    return level


def _z(level: float) -> float:
    return normal_ppf((1 + _level(level)) / 2)


def _interval(half: Column, name: str = "estimate") -> list[Column]:
    return [F.col(name), (F.col(name) - half).alias("lower"), (F.col(name) + half).alias("upper")]


def maritz_jarrett(df: DataFrame, column: str, p: float = 0.5, groups: Sequence[str] = (), *, level: float = 0.95, compat: bool = False) -> DataFrame:
    """groups, n, estimate, lower, upper: Harrell-Davis quantile +- z sqrt((m2 - m1^2) / n); with compat, sqrt(p (1 - p) / n), whatever the data's scale."""
    q = estimate(sample(df, column, groups), groups, [check_probability(p)], HD).withColumn("estimate", F.col("q"))
    n = F.col("n").cast("double")
    variance = F.lit(p * (1 - p)) if compat else F.when(F.col("m2") - F.col("q") * F.col("q") > 0, F.col("m2") - F.col("q") * F.col("q"))
    return q.select(*groups, "n", *_interval(_z(level) * F.sqrt(variance / n)))


def maritz_jarrett_two_sample(df: DataFrame, group: str, column: str, p: float = 0.5, *, level: float = 0.95) -> DataFrame:
    """Interval of the shift of a quantile (first less second) for every two groups, the variances added."""
    q = estimate(sample(df, column, [group]), [group], [check_probability(p)], HD)
    v = (F.col("m2") - F.col("q") * F.col("q")) / F.col("n").cast("double")
    both = pairs(q.select(group, "n", "q", v.alias("v")), group).withColumn("estimate", F.col("q1") - F.col("q2"))
    return both.select("group1", "group2", "n1", "n2", *_interval(_z(level) * F.sqrt(F.col("v1") + F.col("v2"))))


def asymptotic(df: DataFrame, column: str, groups: Sequence[str] = (), *, level: float = 0.95, student: bool = False) -> DataFrame:
    """groups, n, estimate, lower, upper: mean +- critical value times standard error; null where that is not positive.

    Student critical values are made for the distinct sizes of groups, a small table.
    """
    s = sample(df, column, groups).groupBy(*groups).agg(F.count("*").alias("n"), F.avg("x").alias("estimate"), F.stddev_samp("x").alias("sd"))
    error = F.when(F.col("sd") > 0, F.col("sd") / F.sqrt(F.col("n").cast("double")))
    if not student:
        return s.select(*groups, "n", *_interval(_z(level) * error))
    q = (1 + _level(level)) / 2

    def critical(batches):
        for pdf in batches:
            yield pd.DataFrame({"size": pdf["n"], "critical": [t_ppf(q, n - 1) if n > 1 else np.nan for n in pdf["n"]]})

    table = s.select("n").distinct().mapInPandas(critical, "size long, critical double")
    return s.join(table, F.col("n") == F.col("size")).select(*groups, "n", *_interval(F.col("critical") * error))


# ------------------------------------------------------------------ bootstrap

MIX = 2_147_483_647  # a prime; draws are numbers modulo it, from integers below 2**62


def draw(seed: int, b, i, n: int):
    """Position of the i-th value of replicate b among n, for numpy integers (or any integers)."""
    x = (b * 1_000_003 + i * 7_919 + seed * 104_729 + 12_345) % MIX
    x = (x * 48_271 + 11) % MIX
    x = ((x ^ (x >> 13)) * 69_621) % MIX
    x = ((x ^ (x >> 11)) * 39_373) % MIX
    return x % n


Statistic = Callable[[np.ndarray], np.ndarray]


def mean_statistic(rows: np.ndarray) -> np.ndarray:
    """A statistic takes sorted resamples, one a row, and gives a number, or a row of numbers, for each."""
    return rows.mean(1)


def quantile_statistic(ps: Sequence[float] | float, method: Method = HD) -> Statistic:
    several = not isinstance(ps, (int, float))

    def of(rows: np.ndarray) -> np.ndarray:
        out = []
        for p in ps if several else [ps]:
            first, w = method.weights(rows.shape[1], float(p))
            out.append(rows[:, first - 1 : first - 1 + len(w)] @ w)
        return np.stack(out, 1) if several else out[0]

    return of


def _replicates(values: np.ndarray, statistic: Statistic, seed: int, bs: np.ndarray) -> np.ndarray:
    n = len(values)
    step = max(1, BLOCK_CELLS // max(n, 1))
    out = []
    for k in range(0, len(bs), step):
        at = draw(seed, bs[k : k + step, None].astype(np.int64), np.arange(n, dtype=np.int64)[None], n)
        out.append(np.asarray(statistic(np.sort(values[at], 1)), float).reshape(len(at), -1))
    return np.concatenate(out)


def shift(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a - b


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b != 0, a / b, np.nan)


def log_ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((a > 0) & (b > 0), np.log(a) - np.log(b), np.nan)


def replicates(df: DataFrame, group: str, column: str, groups: tuple, statistic: Statistic, *, compare: Callable = shift, resamples: int = 5000, seed: int = 42, blocks: int | None = None) -> DataFrame:
    """b, k, value and original: the k-th compared number of replicate b, and that of the samples themselves.

    Both samples are sorted, collected to the driver if they have at most MAX_SAMPLE values, and sent once to workers
    that do blocks of replicates; more values are refused (InvalidInput). A failed replicate is NaN.
    """
    spark = df.sparkSession
    a, b = ([r[0] for r in sample(df.filter(F.col(group) == F.lit(g)), column).limit(MAX_SAMPLE + 1).collect()] for g in groups)
    if max(len(a), len(b)) > MAX_SAMPLE or not a or not b:
        raise InvalidInput(f"a bootstrap needs 1 to {MAX_SAMPLE} values in both samples")
    a, b = np.sort(np.array(a)), np.sort(np.array(b))
    original = np.asarray(compare(*(np.asarray(statistic(x[None]), float).reshape(1, -1) for x in (a, b))), float)[0]
    shipped = spark.sparkContext.broadcast((a, b))

    def run(batches):
        x, y = shipped.value
        for pdf in batches:
            bs = pdf["id"].to_numpy()
            value = compare(_replicates(x, statistic, seed, bs), _replicates(y, statistic, seed + 1, bs))
            k = value.shape[1]
            yield pd.DataFrame({"b": np.repeat(bs, k), "k": np.tile(np.arange(k), len(bs)), "value": value.ravel(), "original": np.tile(original, len(bs))})

    parts = blocks or max(1, min(resamples // 100, spark.sparkContext.defaultParallelism))
    return spark.range(0, resamples, 1, parts).mapInPandas(run, "b long, k long, value double, original double")


def _own_interval(reps: DataFrame, groups: Sequence[str], method: Callable[[np.ndarray, float, float], tuple[float, float]], level: float) -> DataFrame:
    fields = ", ".join(f"`{g}` {reps.schema[g].dataType.simpleString()}" for g in groups)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        theta = float(pdf["original"].iloc[0])
        lo, hi = method(np.sort(pdf["value"].to_numpy()), theta, level)
        return pd.DataFrame({**{g: [pdf[g].iloc[0]] for g in groups}, "estimate": [theta], "lower": [float(lo)], "upper": [float(hi)]})

    good = reps.filter(~F.isnan("value")).withColumn("_all", F.lit(1))
    return good.groupBy(*(groups or ["_all"])).applyInPandas(one, f"{fields}{', ' if groups else ''}estimate double, lower double, upper double")


def interval(reps: DataFrame, groups: Sequence[str], method: str | Callable = "percentile", *, level: float = 0.95) -> DataFrame:
    """groups, estimate, lower, upper from replicates (groups, value, original): percentile, basic, bca or student. NaN replicates are left out.

    method may also be a function of (sorted replicates, estimate, level) that gives (lower, upper).
    """
    if callable(method):
        return _own_interval(reps, groups, method, _level(level))
    if method not in ("percentile", "basic", "bca", "student"):
        raise InvalidParameter(f"unknown bootstrap interval {method!r}")
    alpha = 1 - _level(level)
    # replicates of one statistic: thousands of numbers
    good = reps.filter(~F.isnan("value")).groupBy(*groups).agg(F.sort_array(F.collect_list("value")).alias("v"), F.first("original").alias("estimate"))
    b, v, theta = F.size("v").cast("double"), F.col("v"), F.col("estimate")

    def at(share: Column) -> Column:
        return F.element_at(v, (F.least(F.floor(share * b), F.size("v") - 1) + 1).cast("int"))

    lo_share, hi_share = F.lit(alpha / 2), F.lit(1 - alpha / 2)
    if method == "bca":
        below = F.size(F.filter(v, lambda x: x < theta)).cast("double") / b
        z0 = F.when((below > 0) & (below < 1), ppf_column(below)).otherwise(0.0)
        lo, hi = at(normal_cdf(2 * z0 + normal_ppf(alpha / 2))), at(normal_cdf(2 * z0 + normal_ppf(1 - alpha / 2)))
    else:
        lo, hi = at(lo_share), at(hi_share)
    if method in ("basic", "student"):  # the studentised interval is the same: its standard error cancels
        lo, hi = 2 * theta - hi, 2 * theta - lo
    return good.select(*groups, "estimate", lo.alias("lower"), hi.alias("upper"))


def bootstrap(df: DataFrame, group: str, column: str, groups: tuple, statistic: Statistic | None = None, *, compare: Callable = shift, method: str = "percentile", level: float = 0.95, resamples: int = 5000, seed: int = 42) -> DataFrame:
    """estimate, lower, upper of a comparison of two groups; the statistic is the Harrell-Davis median if none is given."""
    reps = replicates(df, group, column, groups, statistic or quantile_statistic(0.5), compare=compare, resamples=resamples, seed=seed)
    return interval(reps.filter("k = 0"), [], method, level=level)


def one_sample_bootstrap(df: DataFrame, column: str, groups: Sequence[str] = (), statistic: Statistic | None = None, *, method: str | Callable = "percentile", level: float = 0.95, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """groups, estimate, lower, upper of a statistic (the Harrell-Davis median if none is given) of each group, by resamples of its own.

    A group's resamples are drawn in one task, in blocks; it is for groups that fit a worker. Empty groups have no row.
    """
    statistic = statistic or quantile_statistic(0.5)
    fields = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in groups)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf["x"].to_numpy())
        value = _replicates(x, statistic, seed, np.arange(resamples))[:, 0]
        original = float(np.asarray(statistic(x[None]), float).ravel()[0])
        return pd.DataFrame({**{g: [pdf[g].iloc[0]] * resamples for g in groups}, "value": value, "original": original})

    s = sample(df, column, groups).withColumn("_all", F.lit(1))
    reps = s.groupBy(*(groups or ["_all"])).applyInPandas(one, f"{fields}{', ' if groups else ''}value double, original double")
    return interval(reps, groups, method, level=level)


def for_quantile(found: DataFrame, p: float) -> DataFrame:
    """Of a quantile bootstrap's rows, those of one quantile."""
    return found.filter(F.abs(F.col("p") - F.lit(float(p))) < 1e-10)


def median_interval(found: DataFrame) -> DataFrame:
    return for_quantile(found, 0.5)


def quartile_intervals(found: DataFrame) -> DataFrame:
    """The rows of the quartiles there are."""
    wanted = F.least(*(F.abs(F.col("p") - F.lit(q)) for q in (0.25, 0.5, 0.75)))
    return found.filter(wanted < 1e-10)


def bootstrap_summary(found: DataFrame) -> DataFrame:
    """p, estimate, lower, upper and width, by p."""
    return found.select("p", "estimate", "lower", "upper", (F.col("upper") - F.col("lower")).alias("width")).orderBy("p")


def quantile_bootstrap(df: DataFrame, group: str, column: str, groups: tuple, ps: Sequence[float], *, compare: Callable = shift, quantile_method: Method = HD, method: str = "percentile", level: float = 0.95, resamples: int = FAST, seed: int = 42) -> DataFrame:
    """p, estimate, lower, upper of the shift (or ratio) of each quantile."""
    ps = [check_probability(p) for p in ps]
    if any(not 0 < p < 1 for p in ps):
        raise InvalidParameter("bootstrap quantiles must be in (0, 1)")
    reps = replicates(df, group, column, groups, quantile_statistic(ps, quantile_method), compare=compare, resamples=resamples, seed=seed)
    table = F.element_at(F.array(*map(F.lit, ps)), (F.col("k") + 1).cast("int"))
    return interval(reps, ["k"], method, level=level).select(table.alias("p"), "estimate", "lower", "upper")


def resamples_for(n1: int, n2: int) -> int:
    """More resamples for small samples."""
    n = min(n1, n2)
    return PRECISE if n < 50 else STANDARD if n < 200 else FAST


def auto_bootstrap(df: DataFrame, group: str, column: str, groups: tuple, *, level: float = 0.95, seed: int = 42) -> DataFrame:
    counts = {r[0]: r[1] for r in df.filter(F.col(group).isin(*groups)).groupBy(group).agg(F.count(column)).collect()}
    return bootstrap(df, group, column, groups, level=level, resamples=resamples_for(*(counts.get(g, 0) for g in groups)), seed=seed)


def median_shift(df: DataFrame, group: str, column: str, groups: tuple, *, level: float = 0.95, seed: int = 42) -> DataFrame:
    return bootstrap(df, group, column, groups, level=level, resamples=FAST, seed=seed)
