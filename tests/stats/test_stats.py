"""Statistics against golden values, plain numpy forms, invariances, and plans."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from steadfast import errors
from steadfast.functions import special
from steadfast.functions.weights import HD, SIMPLE, THD_LINEAR, THD_SQRT, Method, thd_constant, thd_function
from steadfast.operators import changepoint, compare, confidence, effect, histogram, modality, quantiles, samples, shape, signal, spread, stability
from steadfast.plans import frame


def plain(x, p, method=HD):
    x = np.sort(np.asarray(x, float))
    first, w = method.weights(len(x), p)
    return float((x[first - 1 : first - 1 + len(w)] * w).sum())


def column(spark, values, group=None):
    return spark.createDataFrame([(group or "a", i, float(v)) for i, v in enumerate(values)], "g string, t long, x double")


def two(spark, a, b):
    return column(spark, a, "a").unionByName(column(spark, b, "b"))


def value(df):
    return df.first()[-1]


# ---------------------------------------------------------------- numbers


def test_golden_quantiles():
    ten, five = range(1, 11), range(1, 6)
    assert [plain(ten, p) for p in (0.25, 0.5, 0.75)] == pytest.approx([2.998686946607, 5.5, 8.001313053393])
    assert [plain(five, p) for p in (0.25, 0.5, 0.75)] == pytest.approx([1.769924414314, 3, 4.230075585686])
    assert [plain(ten, 0.25, m) for m in (THD_SQRT, THD_LINEAR, thd_constant(0.5))] == pytest.approx([2.705764982052, 2.475267049998, 2.916406483755])
    assert plain([42], 0.3) == 42 and plain(ten, 0) == 1 and plain(ten, 1) == 10


@pytest.mark.parametrize("n", [2, 5, 50, 1000, 20_000])
@pytest.mark.parametrize("p", [0.001, 0.123, 0.5, 0.999])
def test_weights_sum_to_one_and_mirror(n, p):
    for m in (HD, THD_SQRT, THD_LINEAR, thd_constant(0.3), SIMPLE):
        first, w = m.weights(n, p)
        back, v = m.weights(n, 1 - p)
        assert w.sum() == pytest.approx(1) and 1 <= first and first + len(w) - 1 <= n
        # the interval of trimmed weights is found to 1e-9 of its place
        tolerance = 1e-5 if "thd" in m.kind else 1e-9
        assert back + len(v) - 1 == pytest.approx(n + 1 - first, abs=1) and np.arange(first, first + len(w)) @ w == pytest.approx(n + 1 - np.arange(back, back + len(v)) @ v, abs=tolerance * n)


def test_special_functions():
    assert special.betainc(2, 3, 0.4) == pytest.approx(0.5248) and special.betainc(0.5, 0.5, [0, 0.5, 1]).tolist() == pytest.approx([0, 0.5, 1])
    assert special.normal_cdf(1.96) == pytest.approx(0.9750021, abs=1e-6) and special.normal_ppf(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert special.t_ppf(0.975, 10) == pytest.approx(2.228138852, abs=1e-8) and special.t_ppf(0.5, 3) == pytest.approx(0, abs=1e-9)
    left, right = special.beta_hdi(4, 8, 0.3)
    assert right - left == pytest.approx(0.3) and 3 * math.log(left / right) == pytest.approx(7 * math.log((1 - right) / (1 - left)), abs=1e-6)


# ---------------------------------------------------------------- operators


def test_golden_spread_and_shape(spark):
    nine = column(spark, range(1, 10))
    assert value(spread.mad(column(spark, range(1, 6)), "x")) == pytest.approx(1.25952)
    assert value(spread.mad(column(spark, range(1, 6)), "x", factor=spread.MAD_FACTOR)) == pytest.approx(1.867366871)
    assert value(spread.mad(column(spark, [1, 2, 3, 4, 5, 100]), "x")) == pytest.approx(5.545709246)
    assert value(spread.iqr(nine, "x")) == pytest.approx(4.502831183433)
    assert value(spread.standard_qad(nine, "x")) == pytest.approx(3.367689602769) and value(spread.optimal_qad(nine, "x")) == pytest.approx(2.860289121258)
    ten = column(spark, range(1, 11))
    assert value(spread.trimmed_std(ten, "x")) == pytest.approx(2.449489742783) and value(spread.winsorized_std(ten, "x")) == pytest.approx(2.718251071717)
    assert value(shape.bowley_skewness(column(spark, [1, 2, 3, 4, 5, 10, 15, 20]), "x")) == pytest.approx(0.387830621239)
    assert value(shape.medcouple(column(spark, [1, 2, 3, 4, 5, 10]), "x")) == pytest.approx(0.040584240370)
    assert value(shape.moors_kurtosis(nine, "x")) == pytest.approx(0.979751706246) and value(shape.crow_siddiqui_kurtosis(ten, "x")) == pytest.approx(-1.143957452008)


def test_golden_intervals(spark):
    ten = column(spark, range(1, 11))
    for compat, half in ((False, 0.912301508802), (True, 0.309897516152)):
        r = confidence.maritz_jarrett(ten, "x", compat=compat).first()
        assert (r["upper"] - r["lower"]) / 2 == pytest.approx(half)
    reps = spark.createDataFrame([(float(i), 5.5) for i in range(1, 11)], "value double, original double")
    assert confidence.interval(reps, [], level=0.9).first()[1:] == (1.0, 10.0)
    small = spark.createDataFrame([(4.0, 5.0), (5.0, 5.0), (6.0, 5.0), (float("nan"), 5.0)], "value double, original double")
    assert confidence.interval(small, [], "basic").first()[1:] == (4.0, 6.0)
    many = spark.createDataFrame([(5 + 0.1 * k, 5.0) for k in range(-50, 51)], "value double, original double")
    r = confidence.interval(many, [], "bca").first()
    assert abs((r["upper"] - 5) - (5 - r["lower"])) < 0.5
    r = confidence.asymptotic(ten, "x", student=True).first()
    assert (r["upper"] - r["lower"]) / 2 == pytest.approx(2.262157163 * np.std(range(1, 11), ddof=1) / math.sqrt(10))


def test_golden_effects(spark):
    far, shift = two(spark, range(1, 6), range(6, 11)), two(spark, range(1, 6), range(3, 8))
    get = lambda df, kind, **o: effect.effect_size(df, "g", "x", kind, **o).first()["magnitude"]
    assert get(shift, "cohen_d") == pytest.approx(-1.264911064) and get(shift, "hedges_g") == pytest.approx(-1.142500316) and get(shift, "cohen_d", welch=True) == pytest.approx(-2)
    assert get(shift, "glass_delta") == pytest.approx(1.264911064) and get(shift, "cohen_d", robust=True) == pytest.approx(-1.587906504) and get(shift, "cliff_delta") == pytest.approx(0.64)
    assert get(far, "point_biserial") == pytest.approx(0.870388280) and get(far, "eta_squared") == pytest.approx(0.757575758) and get(far, "omega_squared") == pytest.approx(0.705882353)
    ties = two(spark, [1, 2, 3], [2, 3, 4])
    assert get(ties, "cliff_delta") == pytest.approx(5 / 9) and get(ties, "cles") == pytest.approx(7 / 9) and get(ties, "cles", ties=False) == pytest.approx(6 / 9)
    assert get(two(spark, [1, 1], [1, 1]), "cohen_d") is None and effect.effect_size(far, "g", "x", "cohen_d").first()["interpretation"] == "Large"
    q = compare.quantile_comparison(shift, "g", "x", [0.5]).first()
    assert q["shift"] == pytest.approx(-2) and q["ratio"] == pytest.approx(0.6) and q["log_ratio"] == pytest.approx(math.log(0.6))


def test_histograms_and_distances(spark):
    same = two(spark, range(1, 6), range(1, 6))
    d = histogram.distances(histogram.fixed_width(same, "x", 4, ["g"]), "g").first()
    assert d[2:] == pytest.approx((0, 0, 0, 1, 0))
    apart = histogram.distances(histogram.fixed_width(two(spark, range(1, 4), range(4, 7)), "x", 3, ["g"]), "g").first()
    assert apart["intersection"] < 1 and apart["wasserstein"] > 0 and apart["chi_squared"] > 0 and apart["bhattacharyya"] > 0
    h = histogram.fixed_width(column(spark, [0, 1, 1, 2, 10]), "x", 5).orderBy("bin").collect()
    assert [r["count"] for r in h] == [3, 1, 0, 0, 1] and sum(r["density"] * (r["right"] - r["left"]) for r in h) == pytest.approx(1)
    assert histogram.fixed_width(column(spark, [3, 3, 3]), "x", 5).count() == 1
    assert histogram.quantile_bins(column(spark, range(3)), "x", 10).count() == 3
    assert histogram.exponential_steps(8) == pytest.approx(sorted(histogram.exponential_steps(8))) and histogram.exponential_steps(8)[4] == pytest.approx(0.5, abs=0.01)
    found = histogram.find_bin(histogram.fixed_width(column(spark, range(11)), "x", 5), column(spark, [0, 2, 10, 11]), "x").orderBy("x").collect()
    assert [r["bin"] for r in found] == [0, 1, 4, None]


def test_modes(spark):
    r = np.random.default_rng(42)
    bimodal = np.r_[r.normal(-3, 0.8, 3000), r.normal(3, 0.8, 3000)]
    found = modality.lowland_modes(column(spark, bimodal), "x").orderBy("mode").collect()
    assert len(found) == 2 and abs(found[0]["location"] + 3) < 1 and abs(found[1]["location"] - 3) < 1 and found[0]["right_bound"] == found[1]["left_bound"]
    assert modality.lowland_modes(column(spark, r.normal(0, 1, 5000)), "x").count() == 1 and modality.lowland_modes(column(spark, [1, 1]), "x").count() == 0
    assert modality.assign_modes(column(spark, [-3, 3]), "x", modality.lowland_modes(column(spark, bimodal), "x")).select("mode").distinct().count() == 2


def fold_cusum(x, ref, threshold, drift):
    up = down = 0.0
    alarms = []
    for i, v in enumerate(x):
        up, down = max(0, up + v - ref - drift), max(0, down - (v - ref) - drift)
        if (up > threshold or down > threshold) and not (alarms and i - alarms[-1] <= 1):
            alarms.append(i)
    return alarms


def test_changepoints(spark):
    step = [0] * 25 + [3] * 25
    got = changepoint.cusum(column(spark, step), "x", ["t"], target=0).orderBy("idx")
    assert [r["idx"] for r in got.collect()] == list(range(26, 50, 2)) == fold_cusum(step, 0, 4, 0.5)
    x = np.random.default_rng(1).normal(0, 1, 300)
    assert [r["idx"] for r in changepoint.cusum(column(spark, x), "x", ["t"], ["g"]).orderBy("idx").collect()] == fold_cusum(x, float(np.median(x)), 4, 0.5)
    s = changepoint.ewma_statistics(column(spark, x), "x", ["t"]).orderBy("idx").collect()
    e = s[0]["reference"]
    for r in s:
        e = 0.2 * r["x"] + 0.8 * e
        assert r["ewma"] == pytest.approx(e, abs=1e-12)
    ramp = [0.0] * 50 + [0.1 * i for i in range(50)]
    noisy = np.array(ramp) + np.random.default_rng(2).normal(0, 0.01, 100)
    assert {r["change_type"] for r in changepoint.ewma(column(spark, noisy), "x", ["t"]).collect()} == {"Drift"}
    slopes = changepoint.polynomial_window_slopes(column(spark, x), "x", ["t"], window=25, degree=2).orderBy("i").collect()
    t = 2 * np.arange(25) / 24 - 1
    assert [r["slope"] for r in slopes[:5]] == pytest.approx([np.polyfit(t, x[i : i + 25], 2)[1] * 12 for i in range(5)])
    assert changepoint.polynomial_slopes(column(spark, noisy), "x", ["t"]).count() > 0 and changepoint.adaptive_slopes(column(spark, noisy), "x", ["t"]).count() > 0
    with pytest.raises(errors.InvalidParameter):
        changepoint.cusum(column(spark, x), "x", ["t"], threshold=0)


def test_thinning_is_a_fold(spark):
    r = np.random.default_rng(3)
    idx = sorted(set(r.integers(0, 400, 150).tolist()))
    alarms = spark.createDataFrame([("a", i, 0.5) for i in idx], "g string, idx long, confidence double")
    for tolerance in (1, 2, 3):
        kept = []
        for i in idx:
            if not kept or i - kept[-1] > tolerance:
                kept.append(i)
        assert [x["idx"] for x in changepoint.thin(alarms, ["g"], tolerance).orderBy("idx").collect()] == kept
    for runs in ([(0, range(50)), (1, [49, 51, 53, *range(60, 90)])], [(0, [5, 8, 20]), (1, [21, 22, 30])], [(0, [10, 12]), (1, [13, 14])]):
        rows = [("a", n, i) for n, run in runs for i in run]
        for tolerance in (1, 2, 3):
            kept = []
            for _, n, i in rows:
                if not kept or abs(i - kept[-1][1]) > tolerance:
                    kept.append((n, i))
            got = changepoint.thin(spark.createDataFrame(rows, "g string, l int, idx long"), ["g"], tolerance, "l").orderBy("l", "idx").collect()
            assert [(x["l"], x["idx"]) for x in got] == kept


def test_stability(spark):
    flat = stability.mann_kendall(column(spark, [1, 2, 1.5, 2.5, 1, 2]), "x", ["t"]).first()
    rise = stability.mann_kendall(column(spark, range(1, 7)), "x", ["t"]).first()
    assert (flat["s"], rise["s"]) == (3, 15) and flat["p"] == pytest.approx(1.414228463, abs=1e-6) and rise["p"] == pytest.approx(0.017069841, abs=1e-6) and flat["p_two_sided"] == pytest.approx(0.707114231, abs=1e-6)
    r = np.random.default_rng(4)
    noise = r.normal(0, 1, 300)
    s = stability.mann_kendall(column(spark, np.round(noise, 1)), "x", ["t"]).first()["s"]
    y = np.round(noise, 1)
    assert s == sum(np.sign(y[j] - y[i]) for i in range(300) for j in range(i + 1, 300))
    calm, wild = column(spark, 100 + r.normal(0, 1, 400)), column(spark, np.exp(np.arange(400) / 60) + r.normal(0, 0.1, 400))
    assert stability.statistical_verdict(calm, "x", ["t"]).first()["status"] == "Stable"
    assert stability.statistical_verdict(wild, "x", ["t"]).first()["status"] == "Unstable"
    w = stability.windows(calm, "x", ["t"], window=60, step=20).orderBy("i").first()
    x = np.array([v["x"] for v in calm.orderBy("t").collect()])[:60]
    med = plain(x, 0.5, THD_SQRT)
    assert w["median"] == pytest.approx(med) and w["spread"] == pytest.approx(1.4826 * plain(abs(x - med), 0.5, THD_SQRT)) and w["trend"] == pytest.approx(abs(np.polyfit(range(60), x, 1)[0]))
    tracked = stability.track(stability.windows(calm, "x", ["t"], window=60, parameters=stability.Parameters(max_trend=0.05)), (), stability.Parameters(max_trend=0.05)).orderBy("i").collect()
    run = 0
    for t in tracked:
        run = run + 1 if t["is_stable"] else 0
        assert t["run"] == run and (t["tracker_status"] == "Stable") == (run >= 5)
    sine = column(spark, np.sin(np.arange(300) * 0.3))
    assert stability.hilbert_verdict(sine, "x", ["t"]).first()["reason"] == "Oscillations" and stability.composite(wild, "x", ["t"]).first()["status"] == "Unstable"
    assert stability.stability_index(calm, "x", ["t"], parameters=stability.RELAXED).count() == 1


def test_hilbert(spark):
    i = np.arange(256)
    x = np.cos(2 * np.pi * 5 * i / 256)
    got = signal.hilbert_signal(column(spark, x), "x", ["t"], rate=256.0).orderBy("idx").toPandas()
    assert np.allclose(got["hilbert"], np.sin(2 * np.pi * 5 * i / 256)) and np.allclose(got["envelope"], 1) and np.allclose(got["frequency"], 5)
    odd = np.cos(2 * np.pi * 2 * np.arange(5) / 5)
    assert np.allclose(np.abs(signal.analytic(odd, compat=True)), 0) and np.allclose(np.abs(signal.analytic(odd)), 1)
    with pytest.raises(errors.InvalidInput):
        signal.hilbert(np.zeros(0))


def test_bootstrap_is_the_plain_one(spark):
    r = np.random.default_rng(5)
    a, b = r.normal(100, 15, 40), r.normal(105, 15, 30)
    df = two(spark, a, b)
    reps = confidence.replicates(df, "g", "x", ("a", "b"), confidence.quantile_statistic(0.5), resamples=50, seed=7).orderBy("b").toPandas()
    a, b = np.sort(a), np.sort(b)
    for k in (0, 1, 49):
        pick = lambda v, seed: v[[confidence.draw(seed, k, i, len(v)) for i in range(len(v))]]  # noqa: B023, E731
        assert reps["value"][k] == pytest.approx(plain(pick(a, 7), 0.5) - plain(pick(b, 8), 0.5))
    ci = confidence.bootstrap(df, "g", "x", ("a", "b"), confidence.mean_statistic, resamples=2000).first()
    assert ci["lower"] < a.mean() - b.mean() < ci["upper"] and ci["estimate"] == pytest.approx(a.mean() - b.mean())
    assert confidence.resamples_for(30, 500) == 30_000 and confidence.resamples_for(100, 100) == 20_000
    with pytest.raises(errors.InvalidInput):
        confidence.bootstrap(df, "g", "x", ("a", "missing"))


# ---------------------------------------------------------------- contracts


def test_accessors_of_results(spark):
    df = two(spark, range(1, 40), range(5, 60))
    found = confidence.quantile_bootstrap(df, "g", "x", ("a", "b"), [0.25, 0.5, 0.9], resamples=100)
    assert [r["p"] for r in confidence.median_interval(found).collect()] == [0.5] and confidence.quartile_intervals(found).count() == 2
    assert [r["width"] == r["upper"] - r["lower"] for r in confidence.bootstrap_summary(found).collect()] == [True] * 3
    own = confidence.bootstrap(df, "g", "x", ("a", "b"), confidence.mean_statistic, resamples=100, method=lambda v, theta, level: (theta - level, theta + level)).first()
    assert own["upper"] - own["lower"] == pytest.approx(1.9) and own["estimate"] == pytest.approx(-12)
    bins = histogram.bin_values(histogram.fixed_width(df, "x", 4, ["g"]), ["g"]).filter("g = 'a'").orderBy("bin").collect()
    assert sum(b["frequency"] for b in bins) == pytest.approx(1) and max(b["normalized"] for b in bins) == 1 and bins[0]["center"] == pytest.approx(1 + 38 / 8)
    root, same = quantiles.quantiles(df, "x", [0.3], THD_SQRT, ["g"]), quantiles.quantiles(df, "x", [0.3], thd_function(lambda n: n**-0.5), ["g"])
    assert [tuple(r) for r in root.orderBy("g").collect()] == [tuple(r) for r in same.orderBy("g").collect()]
    modes = spark.createDataFrame([("a", 0, 2.0, 0.0, 4.0, 0.1), ("a", 1, 6.0, 4.0, 8.0, 0.2)], "g string, mode int, location double, left_bound double, right_bound double, height double")
    hit = modality.find_mode(modes, 4.0, ["g"]).first()
    assert (hit["mode"], hit["width"], hit["relative_position"]) == (0, 4.0, 1.0) and modality.find_mode(modes, 9.0, ["g"]).count() == 0
    placed = modality.assign_modes(spark.createDataFrame([("a", 5.0), ("a", 9.0)], "g string, x double"), "x", modes, ["g"], position=True).orderBy("x").collect()
    assert [(r["mode"], r["relative_position"]) for r in placed] == [(1, 0.25), (None, None)]


def test_nulls_nan_empty_and_types(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", None), (None, 5.0)], "g string, x double")
    got = {r["g"]: r["x_q0.50"] for r in quantiles.quantiles(df, "x", [0.5], groups=["g"]).collect()}
    assert got == {"a": pytest.approx(2), None: pytest.approx(5)}
    none = spark.createDataFrame([], "x double, s string, n int")
    assert math.isnan(quantiles.quantiles(none, "x", [0.5]).first()[0]) and math.isnan(value(spread.mad(none, "x"))) and math.isnan(value(spread.spread(none, "n", "iqr")))
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    assert value(quantiles.quantiles(nan, "x", [0.5], nan_policy="drop")) == pytest.approx(2)
    assert math.isnan(value(quantiles.quantiles(nan, "x", [1.0], nan_policy="propagate")))
    with pytest.raises(Exception, match="NaN in column"):
        quantiles.quantiles(nan, "x", [0.5]).collect()
    for bad, kind in ((lambda: quantiles.quantiles(none, "y", [0.5]), errors.InvalidColumn), (lambda: quantiles.quantiles(none, "s", [0.5]), errors.TypeMismatch), (lambda: quantiles.quantiles(none, "x", [1.5]), errors.InvalidProbability), (lambda: Method("thd_constant"), errors.InvalidWidth), (lambda: confidence.asymptotic(none, "x", level=1.0), errors.InvalidConfidenceLevel)):
        with pytest.raises(kind):
            bad()
    ints = spark.createDataFrame([(1,), (2,), (3,)], "x short")
    assert value(quantiles.quantiles(ints, "x", [0.5])) == pytest.approx(2)


def test_ranks_in_slices_are_exact(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = [("a", float(v)) for v in np.round(r.exponential(1, 3000), 1)] + [("b", 1.0)] * 500 + [(None, float(v)) for v in range(100)]
    df = spark.createDataFrame(rows, "g string, x double")
    monkeypatch.setattr(samples, "WINDOW_ROWS", 100)
    monkeypatch.setattr(samples, "SLICE_ROWS", 300)
    for groups in ([], ["g"]):
        got = samples.ranked(df.select("g", "x"), groups).toPandas()
        for _, part in got.groupby(groups, dropna=False) if groups else [(0, got)]:
            part = part.sort_values("rank")
            assert part["rank"].tolist() == list(range(1, len(part) + 1)) and part["x"].is_monotonic_increasing
    got = {r["g"]: r["q"] for r in quantiles.estimate(df, ["g"], [0.5]).collect()}
    assert got["a"] == pytest.approx(plain([v for g, v in rows if g == "a"], 0.5)) and got["b"] == pytest.approx(1)


def test_ranks_in_slices_of_slices(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = [("a", float(v)) for v in r.normal(0, 1, 4000)] + [("a", 0.5)] * 900 + [("b", float(v)) for v in range(50)]
    df = spark.createDataFrame(rows, "g string, x double")
    for name, n in (("WINDOW_ROWS", 200), ("SLICE_ROWS", 100), ("MOST_SLICES", 5)):
        monkeypatch.setattr(samples, name, n)
    got = samples.ranked(df, ["g"]).toPandas()
    assert len(got) == len(rows) and list(got.columns) == ["g", "x", "rank"]
    for _, part in got.groupby("g"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, len(part) + 1)) and part["x"].is_monotonic_increasing


def test_ewma_is_the_recursion(spark):
    r = np.random.default_rng(9)
    x = r.normal(50, 5, 6000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "t int, x double")
    for lam in (0.001, 0.2, 0.97, 1.0):
        got = changepoint.ewma_statistics(df, "x", ["t"], lam=lam, target=40.0).orderBy("idx").toPandas()["ewma"]
        want, average = [], 40.0
        for v in x:
            average = lam * v + (1 - lam) * average
            want.append(average)
        assert got.tolist() == pytest.approx(want, rel=1e-12), lam


def test_windows_of_any_step_are_those_of_step_one(spark):
    r = np.random.default_rng(10)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(r.normal(9, 1, 137))], "t int, x double")
    every = {w["i"]: w for w in stability.windows(df, "x", ["t"], window=20).collect()}
    assert sorted(every) == list(range(118))
    for step in (3, 7, 20, 33):
        some = {w["i"]: w for w in stability.windows(df, "x", ["t"], window=20, step=step).collect()}
        assert sorted(some) == list(range(0, 118, step))
        assert all(w["median"] == pytest.approx(every[i]["median"]) and w["trend"] == pytest.approx(every[i]["trend"]) and w["is_stable"] == every[i]["is_stable"] for i, w in some.items())


def test_mann_kendall_counts_pairs(spark):
    r = np.random.default_rng(12)
    rows = [(g, i, float(v)) for g, n in (("a", 300), ("b", 65), ("c", 1)) for i, v in enumerate(r.integers(0, 40, n))]
    got = {x["g"]: x["s"] for x in stability.mann_kendall(spark.createDataFrame(rows, "g string, t int, x double"), "x", ["t"], ["g"]).collect()}
    for g in "abc":
        v = np.array([x for h, _, x in rows if h == g])
        assert got[g] == int(np.sign(v[None, :] - v[:, None])[np.triu_indices(len(v), 1)].sum())


def test_plans_stay_in_the_jvm(spark):
    df = column(spark, range(100))
    for plan in (quantiles.quantiles(df, "x", [0.5], groups=["g"]), spread.mad(df, "x", ["g"]), effect.effect_size(df, "g", "x", "cliff_delta"), changepoint.cusum(df, "x", ["t"], ["g"]), changepoint.ewma(df, "x", ["t"], ["g"]), stability.statistical_verdict(df, "x", ["t"], ["g"])):
        text = plan._jdf.queryExecution().toString()
        assert "Python" not in text and "Pandas" not in text and "ArrowEval" not in text


def test_one_object(spark):
    df = two(spark, range(1, 40), range(5, 60))
    r = frame.Robust(df, ["g"])
    cache = frame.QuantileCache(HD)
    assert r.quantiles_cached("x", [0.5], HD, cache).count() == 2 and cache.misses == 2
    r.spread_cached("x", "mad", cache)
    assert cache.hits == 2
    with pytest.raises(errors.InvalidParameter):
        r.quantiles_cached("x", [0.5], THD_SQRT, cache)
    with pytest.raises(errors.TypeMismatch):
        r.quantiles_cached("x", [0.5], HD, frame.QuantileCache(HD, "float"))
    small = frame.QuantileCache(HD, most=1)
    r.quantiles_cached("x", [0.25, 0.5], HD, small)
    assert len(small) == 1 and small.misses == 4 and small.hit_rate == 0
    boot = r.confidence("x", method="bootstrap", resamples=300).orderBy("g").first()
    assert boot["x_lower"] < 20 < boot["x_upper"]
    wide = r.confidence("x", method="bootstrap", resamples=50, kind=lambda v, theta, level: (v[0], v[-1])).orderBy("g").first()
    assert wide["x_lower"] < 20 < wide["x_upper"]
    assert r.confidence("x").columns == ["g", "x_lower", "x_upper"] and r.changepoints("x", ["t"]).columns == ["g", "idx", "confidence", "change_type"]
    assert r.histogram("x", "scott").count() > 2 and r.modality("x").count() >= 2 and frame.Robust(df).effect_size("g", "x", "cles").count() == 1
    got = df.groupBy("g").agg(frame.robust_quantile("x", 0.5).alias("q"), frame.robust_mad("x").alias("m"), frame.robust_iqr("x").alias("i")).orderBy("g").first()
    assert got["q"] == pytest.approx(20) and got["m"] == pytest.approx(plain(abs(np.arange(1, 40) - 20.0), 0.5)) and got["i"] > 0
    events, seen = frame.Events(), []
    events.register(lambda n, d: seen.append(n))
    with events.stage(df, "count"):
        df.count()
    assert seen == ["StageStarted", "StageEnded"] and events.seconds["count"] > 0


def test_events_and_contexts(spark):
    df = column(spark, range(10))
    events, metrics, errors_seen = frame.Events(), frame.Metrics(), []
    events.register(metrics), events.register(lambda n, d: errors_seen.append(d["stage"]), ["PipelineError"]), events.register(frame.ignore)
    with events.run():
        observed, done = events.observe(df, "load", rows=F.count("*"), most=F.max("x"))
        with events.stage(df, "load"):
            observed.write.format("noop").mode("overwrite").save()
        assert done() == {"rows": 10, "most": 9.0}
    with pytest.raises(ZeroDivisionError), events.run(), events.stage(df, "break"):
        1 / 0
    assert errors_seen == ["break"] and metrics.sums["DataProcessed", "rows"] == 10 and metrics.counts["PipelineStarted"] == 2 and metrics.counts["PipelineCompleted"] == 1
    a, b = events.context.sides()
    assert a.parent == b.parent == events.context.trace and a.trace != b.trace and (a.metadata["comparison_side"], b.metadata["comparison_side"]) == ("A", "B")
    assert set(events.counts) - {"StageStarted", "StageEnded"} <= set(frame.EVENTS) and len(frame.EVENTS) == 21
    one, two_ = frame.TimeRange(0, 10), frame.TimeRange(5, 9)
    assert frame.Pairing.of(one, one).match == "Exact" and frame.Pairing.of(one, two_).confidence == 0.4 and frame.Pairing.of(one, frame.TimeRange(10, 12), True).match == "Sequential" and len(two_) == 4


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-1e3, 1e3), min_size=2, max_size=40), st.floats(0.01, 0.99), st.floats(0.1, 10), st.floats(-100, 100))
def test_quantiles_move_with_their_data(x, p, scale, shift):
    for m in (HD, THD_SQRT, SIMPLE):
        assert plain([scale * v + shift for v in x], p, m) == pytest.approx(scale * plain(x, p, m) + shift, abs=1e-6)
        assert min(x) - 1e-9 <= plain(x, p, m) <= max(x) + 1e-9


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=15), st.lists(st.integers(-5, 5), min_size=1, max_size=15))
def test_delta_turns_its_sign_with_the_groups(spark_session, a, b):
    d = effect.effect_size(two(spark_session, a, b), "g", "x", "cliff_delta").first()["magnitude"]
    e = effect.effect_size(two(spark_session, b, a), "g", "x", "cliff_delta").first()["magnitude"]
    want = sum((y > x) - (y < x) for x in a for y in b) / (len(a) * len(b))
    assert d == pytest.approx(want) and e == pytest.approx(-want)


@pytest.fixture(scope="session")
def spark_session(spark):
    return spark


# ---------------------------------------------------------------- streams


def run_stream(spark, tmp_path, f, rows, schema, batches):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    n = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * n : (k + 1) * n], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = f(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(out)
    q.awaitTermination(120)
    return spark.read.parquet(out)


def test_streamed_detectors(spark, tmp_path):
    from steadfast.streaming import detectors

    r = np.random.default_rng(8)
    x = [float(v) for v in np.r_[100 + r.normal(0, 1, 90), 120 + r.normal(0, 1, 30)]]
    rows = [("a", i, v, False) for i, v in enumerate(x)]
    schema = "g string, t long, x double, reset boolean"
    p = stability.Parameters(min_samples=30, max_trend=0.2)
    got = run_stream(spark, tmp_path / "s", lambda s: detectors.stream_stability(s, "g", "x", ["t"], parameters=p, reset="reset"), rows, schema, 4).orderBy("t").collect()
    want = stability.online(column(spark, x), "x", ["t"], (), p).orderBy("idx").collect()
    assert [g["status"] for g in got[2:]] == [w["status"] for w in want[2:]] and got[50]["cv"] == pytest.approx(want[50]["cv"]) and got[50]["trend"] == pytest.approx(want[50]["trend"])
    alarms = run_stream(spark, tmp_path / "e", lambda s: detectors.stream_ewma(s, "g", "x", ["t"], reset="reset"), rows, schema, 3).orderBy("t").collect()
    d = detectors.OnlineEwma()
    assert [a["is_alarm"] for a in alarms] == [d.add(v) for v in x] and any(a["is_alarm"] for a in alarms[90:]) and not F is None


@pytest.mark.parametrize("name", ["quantile_shift_bootstrap", "quantile_ratio_bootstrap"])
def test_quantile_bootstraps_run_the_default_resamples(spark, monkeypatch, name):
    from steadfast.plans import queries

    asked = []
    monkeypatch.setattr(confidence, "replicates", lambda *a, resamples, **k: asked.append(resamples) or spark.createDataFrame([], "b long, k long, value double, original double"))
    queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked == [confidence.FAST]
