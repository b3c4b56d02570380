"""Stability of series: tests, verdicts, windows, runs of stable windows, and the expanding-window form of the online detector."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadfast.functions.expressions import erf
from steadfast.functions.weights import THD_SQRT, Method
from steadfast.operators.changepoint import series
from steadfast.operators.quantiles import plain_median
from steadfast.operators.samples import join_groups
from steadfast.operators.signal import analytic
from steadfast.operators.spread import STABILITY_FACTOR, deviation_quantile


#: Bits of the ranks that one pass of mann_kendall takes.
DIGIT = 3


@dataclass(frozen=True)
class Parameters:
    min_samples: int = 50
    max_cv: float = 0.25
    max_trend: float = 0.01
    oscillation_threshold: float = 0.1
    phase_coherence_threshold: float = 0.3
    min_stable_windows: int = 5
    significance: float = 0.05


DEFAULT = Parameters()
STRICT = Parameters(100, 0.1, 0.005, 0.05, 0.2, 10, 0.01)
RELAXED = Parameters(30, 0.3, 0.02, 0.2, 0.4, 3, 0.1)


def mann_kendall(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """groups, n, s, z, p (2 (1 - erf(|z| / sqrt 2)), from 0 to 2) and p_two_sided, half of that.

    S counts, of all pairs of points, those that rise less those that fall. It is added up over the digits, of DIGIT bits, of
    the values' ranks: pairs that first differ in a digit are in one block of the ranks' higher digits, and there running counts
    along the series tell how many lower and higher digits came before each one. So the work is n log n, in window functions.
    """
    s = series(df, column, order, groups)
    r = s.withColumn("_r", F.dense_rank().over(Window.partitionBy(*groups).orderBy("x")))
    counts = r.groupBy(*groups).agg(F.count("*").alias("n"), F.max("_r").alias("_most"))
    digits = max(1, -(-int(counts.agg(F.max("_most")).first()[0] or 1).bit_length() // DIGIT))
    each = r.select(*groups, "idx", F.col("_r"), F.explode(F.sequence(F.lit(0), F.lit(digits - 1))).alias("_place"))
    each = each.select(*groups, "idx", "_place", F.expr(f"shiftright(_r, {DIGIT} * (_place + 1))").alias("_block"), F.expr(f"shiftright(_r, {DIGIT} * _place) & {2**DIGIT - 1}").alias("_digit"))
    before = Window.partitionBy(*groups, "_place", "_block").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    step = F.lit(0)
    for d in range(2**DIGIT):
        seen = F.coalesce(F.sum(F.when(F.col("_digit") == d, 1).otherwise(0)).over(before), F.lit(0))
        step = step + F.when(F.col("_digit") > d, seen).when(F.col("_digit") < d, -seen).otherwise(0)
    total = each.withColumn("_step", step).groupBy(*groups).agg(F.sum("_step").alias("s"))
    found = join_groups(counts.drop("_most"), total, groups)
    n, sd = F.col("n").cast("double"), F.col("s").cast("double")
    var = n * (n - 1) * (2 * n + 5) / 18
    z = F.when(F.col("s") > 0, (sd - 1) / F.sqrt(var)).when(F.col("s") < 0, (sd + 1) / F.sqrt(var)).otherwise(0.0)
    found = found.withColumn("z", z).withColumn("p", 2 * (1 - erf(F.abs("z") / math.sqrt(2))))
    return found.select(*groups, "n", "s", "z", "p", (F.col("p") / 2).alias("p_two_sided"))


def levene_score(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str] = (), *, parts: int = 3) -> DataFrame:
    """groups, n, f, levene_score: F of the deviations from the medians of consecutive parts, and 1 - F / (F + df_within / df_between); 1 below 2 values a part."""
    s = series(df, column, order, groups).withColumn("_n", F.count("*").over(Window.partitionBy(*groups)))
    s = s.withColumn("_part", F.least(F.floor(F.col("idx") / F.floor(F.col("_n") / parts)), F.lit(parts - 1)))
    parts_of = [*groups, "_part"]
    s = join_groups(s, plain_median(s, parts_of, "_center"), parts_of).withColumn("_d", F.abs(F.col("x") - F.col("_center")))
    by_part = s.groupBy(*groups, "_part").agg(F.count("*").cast("double").alias("c"), F.avg("_d").alias("m"), F.var_pop("_d").alias("v"))
    total = by_part.groupBy(*groups).agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("m")) / F.sum("c")).alias("grand"), F.sum(F.col("c") * F.col("v")).alias("ssw"), F.collect_list(F.struct("c", "m")).alias("_parts"))
    ssb = F.aggregate("_parts", F.lit(0.0), lambda a, x: a + x["c"] * (x["m"] - F.col("grand")) * (x["m"] - F.col("grand")))
    dfb, dfw = float(parts - 1), F.col("n") - parts
    found = total.withColumn("f", F.when(F.col("ssw") > 0, (ssb / dfb) / (F.col("ssw") / dfw)))
    score = F.when(F.col("n") < 2 * parts, 1.0).otherwise(1 - F.col("f") / (F.col("f") + dfw / dfb))
    return found.select(*groups, F.col("n").cast("long").alias("n"), "f", score.alias("levene_score"))


def ols_trend(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """groups, n, slope and r2 on the index; 0 where undefined."""
    s = series(df, column, order, groups)
    i = F.col("idx").cast("double")
    return s.groupBy(*groups).agg(F.count("*").alias("n"), F.coalesce(F.regr_slope("x", i), F.lit(0.0)).alias("slope"), F.coalesce(F.regr_r2("x", i), F.lit(0.0)).alias("r2"))


def robust_cv(s: DataFrame, groups: Sequence[str], method: Method = THD_SQRT) -> DataFrame:
    """groups, median, spread (1.4826 * raw MAD), cv for a sample (groups, x); cv 0 if both are 0, infinite if only the median is."""
    found = deviation_quantile(s, groups, 0.5, method).select(*groups, F.col("center").alias("median"), (F.col("value") * STABILITY_FACTOR).alias("spread"))
    return found.withColumn("cv", _cv(F.col("spread"), F.col("median")))


def _cv(spread: Column, center: Column) -> Column:
    return F.when(F.abs(center) > 1e-10, spread / F.abs(center)).when(spread < 1e-10, 0.0).otherwise(float("inf"))


def stationarity_score(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str] = (), *, method: Method = THD_SQRT) -> DataFrame:
    """groups, stationarity: 1 less the mean robust cv of the means and of the variances of all windows of a quarter's length; 0 if that is below 10.

    Window sums are differences of running sums of the centred values, so that the length can differ by group.
    """
    s = series(df, column, order, groups)
    whole = Window.partitionBy(*groups)
    s = s.withColumn("_w", F.floor(F.count("*").over(whole) / 4).cast("long")).withColumn("_y", F.col("x") - F.avg("x").over(whole))
    upto = whole.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_s", F.sum("_y").over(upto)).withColumn("_q", F.sum(F.col("_y") * F.col("_y")).over(upto))
    mean_of = s.groupBy(*groups).agg(F.avg("x").alias("_mean"), F.max("_w").alias("_win"))
    ends = s.filter((F.col("_w") >= 10) & (F.col("idx") >= F.col("_w") - 1)).select(*groups, F.col("idx").alias("_i"), "_w", F.col("_s").alias("_s1"), F.col("_q").alias("_q1"))
    starts = s.select(*groups, (F.col("idx") + F.col("_w")).alias("_i"), F.col("_s").alias("_s0"), F.col("_q").alias("_q0"))
    both = join_groups(ends, starts, [*groups, "_i"], "left")
    w = F.col("_w").cast("double")
    m = (F.col("_s1") - F.coalesce("_s0", F.lit(0.0))) / w
    v = F.greatest(F.lit(0.0), (F.col("_q1") - F.coalesce("_q0", F.lit(0.0))) / w - m * m)
    stats = join_groups(both.select(*groups, m.alias("_m"), v.alias("_v")), mean_of, groups).select(*groups, (F.col("_m") + F.col("_mean")).alias("_m"), "_v")
    a = robust_cv(stats.select(*groups, F.col("_m").alias("x")), groups, method).select(*groups, F.col("cv").alias("_cm"))
    b = robust_cv(stats.select(*groups, F.col("_v").alias("x")), groups, method).select(*groups, F.col("cv").alias("_cv"))
    found = join_groups(mean_of, join_groups(a, b, groups), groups, "left") if groups else mean_of.join(a.crossJoin(b), F.lit(True), "left")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (F.col("_cm") + F.col("_cv")) / 2))
    return found.select(*groups, F.when(F.col("_win") < 10, 0.0).otherwise(score).alias("stationarity"))


def statistical_verdict(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str] = (), parameters: Parameters = DEFAULT, *, method: Method = THD_SQRT) -> DataFrame:
    """groups, n, status, reason, severity, confidence, median, spread, cv, slope, r2, mk_p, levene_score, stationarity.

    Of four signs (cv, trend, variance, stationarity) none makes Stable, three or four Unstable; else Unknown.
    """
    s = series(df, column, order, groups).select(*groups, "x")
    found = ols_trend(df, column, order, groups)
    for part in (robust_cv(s, groups, method), mann_kendall(df, column, order, groups).select(*groups, F.col("p").alias("mk_p")), levene_score(df, column, order, groups).select(*groups, "levene_score"), stationarity_score(df, column, order, groups, method=method)):
        found = join_groups(found, part, groups)
    p = parameters
    cv, mk, lev, score = F.col("cv"), F.col("mk_p"), F.col("levene_score"), F.col("stationarity")
    signs = [cv > p.max_cv, mk < 0.05, lev < 0.05, score < 0.7]
    count = sum((F.when(x, 1).otherwise(0) for x in signs[1:]), F.when(signs[0], 1).otherwise(0))
    found = found.withColumn("_count", count)
    unstable = F.col("_count") >= 3
    confidence = F.when(F.col("_count") == 0, 0.95 - cv / p.max_cv * 0.2).when(unstable, 0.9 + F.least(mk, lev, score) * 0.1).otherwise(0.5 + (2 - F.col("_count")) * 0.2)
    status = F.when(F.col("n") < p.min_samples, "InsufficientData").when(F.col("_count") == 0, "Stable").when(unstable, "Unstable").otherwise("Unknown")
    reason = F.when(unstable, F.when(signs[0], "HighVariability").when(signs[1], "Trend").when(signs[2], "VarianceChange").otherwise("NonStationary"))
    severity = F.when(unstable, F.when(signs[0], cv / p.max_cv).when(signs[1], F.abs("slope") / p.max_trend).when(signs[2], 1 - lev).otherwise(1 - score))
    return found.select(*groups, "n", status.alias("status"), reason.alias("reason"), severity.alias("severity"), confidence.alias("confidence"), "median", "spread", "cv", "slope", "r2", "mk_p", "levene_score", "stationarity")


# ------------------------------------------------------------------ windows


def _verdict(n: Column, cv: Column, trend: Column, p: Parameters, good: Column) -> list[Column]:
    status = F.when(n < p.min_samples, "Unknown").when(good, "Stable").otherwise("Unstable")
    bad = (n >= p.min_samples) & ~good
    reason = F.when(bad, F.when(trend > p.max_trend, "Trend").when((cv > p.max_cv) | (cv == float("inf")), "VarianceChange").otherwise("NonStationary"))
    severity = F.when(bad, F.when(trend > p.max_trend, F.least(F.lit(1.0), trend / p.max_trend)).when(cv > p.max_cv, F.least(F.lit(1.0), cv / p.max_cv)).otherwise(0.5))
    return [good.alias("is_stable"), status.alias("status"), reason.alias("reason"), severity.alias("severity")]


def windows(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str] = (), *, window: int = 50, step: int = 1, parameters: Parameters = DEFAULT, method: Method = THD_SQRT) -> DataFrame:
    """groups, i, mean, median, spread, cv, trend, is_stable, status, reason, severity of the windows that begin at 0, step, 2 step and so on.

    Rows are collected by blocks of step first, so that values are gathered for the windows asked for only. A window's values are
    sorted as an array; the median and MAD are weighted sums with the fixed weights of the window's length.
    """
    s = series(df, column, order, groups)
    first, w = method.weights(window, 0.5)
    dot = lambda a, weights: F.aggregate(F.zip_with(a, F.array(*[F.lit(float(v)) for v in weights]), lambda x, k: x * k), F.lit(0.0), lambda t, v: t + v)
    middle = lambda a: dot(F.slice(F.sort_array(a), first, len(w)), w)
    blocks = s.groupBy(*groups, F.floor(F.col("idx") / step).alias("_b")).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "x"))), lambda r: r["x"]).alias("_x"))
    over = Window.partitionBy(*groups).orderBy("_b").rowsBetween(0, -(-window // step) - 1)
    s = blocks.select(*groups, (F.col("_b") * step).alias("i"), F.slice(F.flatten(F.collect_list("_x").over(over)), 1, window).alias("_v")).filter(F.size("_v") == window)
    apart = [k - (window - 1) / 2 for k in range(window)]
    square = sum(k * k for k in apart)
    s = s.withColumn("mean", F.aggregate("_v", F.lit(0.0), lambda t, v: t + v) / window).withColumn("_slope", dot(F.col("_v"), [k / square for k in apart]) if square else F.lit(0.0))
    s = s.withColumn("median", middle(F.col("_v")))
    s = s.withColumn("spread", STABILITY_FACTOR * middle(F.transform("_v", lambda x: F.abs(x - F.col("median")))))
    s = s.withColumn("cv", _cv(F.col("spread"), F.col("median"))).withColumn("trend", F.abs("_slope"))
    good = (F.lit(window) >= parameters.min_samples) & (F.col("cv") <= parameters.max_cv) & (F.col("trend") <= parameters.max_trend)
    return s.select(*groups, "i", "mean", "median", "spread", "cv", "trend", *_verdict(F.lit(window), F.col("cv"), F.col("trend"), parameters, good))


def track(found: DataFrame, groups: Sequence[str] = (), parameters: Parameters = DEFAULT) -> DataFrame:
    """windows() with run (stable windows in a row), tracker_status, progress, samples_remaining and stable_at, the number (from 1) of the window that reached stability."""
    by = Window.partitionBy(*groups).orderBy("i")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    k = parameters.min_stable_windows
    t = found.withColumn("_no", F.row_number().over(by))
    t = t.withColumn("_broken", F.coalesce(F.max(F.when(~F.col("is_stable"), F.col("_no"))).over(upto), F.lit(0))).withColumn("run", F.col("_no") - F.col("_broken"))
    status = F.when(F.col("run") >= k, "Stable").when(F.col("run") > 0, "Transitioning").otherwise(F.col("status"))
    part = F.when((F.col("run") > 0) & (F.col("run") < k), F.col("run") / F.lit(float(k)))
    remaining = F.when((F.col("run") > 0) & (F.col("run") < k), (k - F.col("run")) * parameters.min_samples)
    return t.withColumn("tracker_status", status).withColumn("progress", part).withColumn("samples_remaining", remaining).withColumn("stable_at", F.when(F.col("run") >= k, F.col("_broken") + k)).drop("_no", "_broken")


def progression(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str] = (), *, window: int, step: int, parameters: Parameters = DEFAULT) -> DataFrame:
    return windows(df, column, order, groups, window=window, step=step, parameters=parameters)


def stability_index(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str] = (), *, window: int = 50, parameters: Parameters = DEFAULT) -> DataFrame:
    """groups and the first index whose window is stable; groups without one have no row."""
    return windows(df, column, order, groups, window=window, parameters=parameters).filter("is_stable").groupBy(*groups).agg(F.min("i").alias("stable_from"))


def online(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str] = (), parameters: Parameters = DEFAULT) -> DataFrame:
    """groups, idx, mean, std_dev, cv, trend, is_stable, run, status after each point: all history counts, as in the streaming detector."""
    s = series(df, column, order, groups)
    by = Window.partitionBy(*groups).orderBy("idx")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    s = s.select(*groups, "idx", F.avg("x").over(upto).alias("mean"), F.coalesce(F.stddev_samp("x").over(upto), F.lit(0.0)).alias("std_dev"), F.abs(F.coalesce(F.regr_slope("x", F.col("idx").cast("double")).over(upto), F.lit(0.0))).alias("trend"))
    p = parameters
    s = s.withColumn("cv", _cv(F.col("std_dev"), F.col("mean")))
    s = s.withColumn("is_stable", (F.col("idx") + 1 >= p.min_samples) & (F.col("cv") <= p.max_cv) & (F.col("trend") <= p.max_trend))
    s = s.withColumn("run", F.col("idx") - F.coalesce(F.max(F.when(~F.col("is_stable"), F.col("idx"))).over(upto), F.lit(-1)))
    strict_cv = F.when(F.abs("mean") > 1e-10, F.col("cv")).otherwise(float("inf"))
    status = F.when(F.col("run") >= p.min_stable_windows, "Stable").when(F.col("run") > 0, "Transitioning").when(F.col("trend") > p.max_trend, "Unstable").when(strict_cv > p.max_cv, "Unstable").otherwise("Unknown")
    return s.withColumn("status", status)


# ------------------------------------------------------------------ oscillation


def _cv_of(x: np.ndarray) -> float:
    return float(x.std() / abs(x.mean())) if len(x) and abs(x.mean()) >= 1e-10 else 0.0


def oscillation(x: np.ndarray, p: Parameters = DEFAULT, compat: bool = False) -> dict:
    """Oscillation metrics and verdict of one series."""
    z = analytic(x - x.mean(), compat)
    amplitude, phase = np.abs(z), np.angle(z)
    step = np.diff(phase)
    coherence = float(abs(np.exp(1j * step).mean())) if len(step) else 0.0
    turned = np.where(step > np.pi, step - 2 * np.pi, np.where(step < -np.pi, step + 2 * np.pi, step))
    whole = np.r_[phase[0], phase[0] + np.cumsum(turned)]
    frequency = np.r_[turned[:1], (whole[2:] - whole[:-2]) / 2, turned[-1:]] if len(whole) > 1 else np.zeros(0)
    ordered = np.sort(frequency)[len(frequency) // 20 : len(frequency) * 19 // 20]
    amplitude_stability = max(0.0, 1 - _cv_of(amplitude) / p.oscillation_threshold)
    frequency_stability = max(0.0, 1 - _cv_of(ordered)) if len(ordered) else 0.0
    power = float(amplitude.var())
    dominant = power > p.oscillation_threshold**2
    cv = _cv_of(x)
    if coherence > p.phase_coherence_threshold or dominant:
        status, reason, severity, confidence = "Unstable", "Oscillations", min(1.0, coherence / p.phase_coherence_threshold), 1 - coherence
    elif cv > p.max_cv:
        status, reason, severity, confidence = "Unstable", "VarianceChange", min(1.0, cv / p.max_cv), 1 - cv / p.max_cv
    else:
        score = amplitude_stability if coherence < 0.1 else (amplitude_stability + 1 - coherence / p.phase_coherence_threshold + frequency_stability) / 3
        status, reason, severity, confidence = ("Stable", None, None, score) if score > 0.7 else ("Unstable", "NonStationary", 1 - score, score)
    return {"phase_coherence": coherence, "amplitude_stability": amplitude_stability, "frequency_stability": frequency_stability, "dominant_power": power if dominant else None, "cv": cv, "status": status, "reason": reason, "severity": severity, "confidence": confidence}


def hilbert_verdict(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str] = (), parameters: Parameters = DEFAULT, *, compat: bool = False) -> DataFrame:
    """groups, n and oscillation() of each series; a series is transformed as a whole in one task. Short series have the status InsufficientData."""
    s = series(df, column, order, groups).withColumn("_all", F.lit(1))
    fields = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in groups)
    schema = f"{fields}{', ' if groups else ''}n long, phase_coherence double, amplitude_stability double, frequency_stability double, dominant_power double, cv double, status string, reason string, severity double, confidence double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("idx")["x"].to_numpy()
        got = oscillation(x, parameters, compat) if len(x) >= parameters.min_samples else {"status": "InsufficientData"}
        row = {**{g: pdf[g].iloc[0] for g in groups}, "n": len(x), **got}
        names = [*groups, "n", "phase_coherence", "amplitude_stability", "frequency_stability", "dominant_power", "cv", "status", "reason", "severity", "confidence"]
        return pd.DataFrame([[row.get(k) for k in names]], columns=names)

    return s.groupBy(*(groups or ["_all"])).applyInPandas(one, schema)


def composite(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str] = (), parameters: Parameters = DEFAULT) -> DataFrame:
    """groups, hilbert_status, statistical_status, status, reason, severity, confidence, agreement: the vote of both verdicts."""
    names = ["status", "reason", "severity", "confidence"]
    a = hilbert_verdict(df, column, order, groups, parameters).select(*groups, *(F.col(c).alias(f"a_{c}") for c in names))
    b = statistical_verdict(df, column, order, groups, parameters).select(*groups, *(F.col(c).alias(f"b_{c}") for c in names))
    both = join_groups(a, b, groups)
    valid = lambda k: F.when(F.col(f"{k}_status") != "InsufficientData", 1).otherwise(0)
    is_ = lambda k, s: F.when(F.col(f"{k}_status") == s, 1).otherwise(0)
    total, stable, unstable = valid("a") + valid("b"), is_("a", "Stable") + is_("b", "Stable"), is_("a", "Unstable") + is_("b", "Unstable")
    both = both.withColumn("_t", total).withColumn("_s", stable).withColumn("_u", unstable)
    agreement = F.when(F.col("_t") > 0, F.greatest("_s", "_u") / F.col("_t").cast("double")).otherwise(0.0)
    known = lambda k: F.when(F.col(f"{k}_status") != "InsufficientData", F.col(f"{k}_confidence"))
    mean_all = (F.coalesce(known("a"), F.lit(0.0)) + F.coalesce(known("b"), F.lit(0.0))) / F.col("_t")
    un = lambda k, c: F.when(F.col(f"{k}_status") == "Unstable", F.col(f"{k}_{c}"))
    mean_un = (F.coalesce(un("a", "confidence"), F.lit(0.0)) + F.coalesce(un("b", "confidence"), F.lit(0.0))) / F.col("_u")
    key = F.when(F.col("_u") == F.col("_t"), F.lit("severity")).otherwise(F.lit("confidence"))
    weight = lambda k: F.when(key == "severity", un(k, "severity")).otherwise(un(k, "confidence"))
    first = weight("b").isNull() | (weight("a") > weight("b"))
    pick = lambda c: F.when(F.col("_u") > 0, F.when(first & weight("a").isNotNull(), un("a", c)).otherwise(un("b", c)))
    status = F.when(F.col("_t") == 0, "Unknown").when(F.col("_s") == F.col("_t"), "Stable").when(F.col("_u") > 0, "Unstable").otherwise("Unknown")
    confidence = F.when(F.col("_t") == 0, 0.0).when((F.col("_s") == F.col("_t")) | (F.col("_u") == F.col("_t")), mean_all).when(F.col("_u") > 0, mean_un * agreement).otherwise(agreement * 0.5)
    return both.select(*groups, F.col("a_status").alias("hilbert_status"), F.col("b_status").alias("statistical_status"), status.alias("status"), pick("reason").alias("reason"), pick("severity").alias("severity"), confidence.alias("confidence"), agreement.alias("agreement"))
