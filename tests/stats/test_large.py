"""What only shows on large groups."""

import datetime
import time

import duckdb
import numpy as np

from steadfast.functions.special import betainc
from steadfast.functions.weights import HD, _weights


def test_weights_of_a_million_values_take_no_minutes():
    _weights.cache_clear()
    began = time.monotonic()
    found = [HD.weights(1_200_000, k / 101) for k in range(1, 101)]
    assert time.monotonic() - began < 60  # differences of betainc: 583 s
    for k, (first, w) in enumerate(found, 1):
        ranks = np.arange(first, first + len(w))
        assert abs(w.sum() - 1) < 1e-12
        assert abs((ranks * w).sum() - 0.5 - 1_200_000 * k / 101) < 0.5  # the beta's mean is p
        assert abs(w @ (ranks - (ranks * w).sum()) ** 2 / (1_200_000 * (k / 101) * (1 - k / 101)) - 1) < 1e-4


def test_weights_by_the_density_are_differences_of_betainc():
    for n, p in ((150, 0.4), (1000, 0.06), (5000, 0.99), (5000, 0.0101), (20_000, 0.5)):
        first, w = HD.weights(n, p)
        plain = np.diff(betainc((n + 1) * p, (n + 1) * (1 - p), np.arange(first - 1, first + len(w)) / n))
        assert np.abs(plain - w).max() < 1e-10


def test_modes_of_large_groups(spark):
    """Two groups of 300,000 values, two hills and one: a hundred quantiles of each."""
    from pyspark.sql import functions as F

    from steadfast.operators.modality import assign_modes, lowland_modes

    _weights.cache_clear()
    u = (F.col("id") % 150_000 + 0.5) / 150_000
    hill = F.log(u / (1 - u))
    df = spark.range(600_000).select((F.col("id") % 2).alias("g"), F.col("id"), hill.alias("x")).withColumn("x", F.col("x") + F.when((F.col("g") == 0) & (F.col("id") >= 300_000), 40.0).otherwise(0.0))
    began = time.monotonic()
    modes = lowland_modes(df, "x", ["g"]).collect()
    assert sorted((r["g"], r["mode"]) for r in modes) == [(0, 0), (0, 1), (1, 0)]
    placed = assign_modes(df, "x", spark.createDataFrame(modes), ["g"]).groupBy("g", "mode").count().collect()
    assert sum(r["count"] for r in placed) == 600_000
    assert time.monotonic() - began < 90


def test_modes_rank_each_value_once(spark):
    """A million rows of 500 values: ranks come from the values' counts, not from the rows."""
    from pyspark.sql import functions as F

    from steadfast.operators.modality import lowland_modes

    df = spark.range(1_000_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 500).cast("double").alias("x"))
    for groups in (["g"], []):
        found = lowland_modes(df, "x", groups)
        text = found._jdf.queryExecution().optimizedPlan().toString()
        assert "row_number" not in text and "Window [sum(c" in text
        assert [(r["mode"], r["left_bound"], r["right_bound"]) for r in found.collect()] == ([(0, 0.0, 498.0), (0, 1.0, 499.0)] if groups else [(0, 0.0, 499.0)])


def test_quantiles_of_counted_values_are_those_of_their_rows(spark, monkeypatch):
    from steadfast.functions.weights import SIMPLE, THD_SQRT
    from steadfast.operators import quantiles, samples

    r = np.random.default_rng(5)
    x = {"a": np.r_[np.full(5000, 7.0), r.normal(0, 50, 3000).round(1)], "b": r.normal(0, 1, 4000), "a null": r.integers(0, 3, 2500).astype(float), "one": np.array([4.0])}
    rows = [(None if g == "a null" else g, float(v)) for g, values in x.items() for v in values]
    df = spark.createDataFrame(rows, "a string, x double")
    ps = [0.0, *(k / 101 for k in range(1, 101)), 1.0]
    for limit, driver, broadcast in ((samples.WINDOW_ROWS, quantiles.DRIVER_ROWS, quantiles.BROADCAST_WEIGHTS), (700, 0, quantiles.BROADCAST_WEIGHTS), (700, 0, 0)):
        monkeypatch.setattr(samples, "WINDOW_ROWS", limit)
        monkeypatch.setattr(samples, "SLICE_ROWS", 300)
        monkeypatch.setattr(quantiles, "DRIVER_ROWS", driver)
        monkeypatch.setattr(quantiles, "BROADCAST_WEIGHTS", broadcast)
        for method in (HD, THD_SQRT, SIMPLE) if driver else (HD,):
            measured = quantiles.measure(df, ["a"])
            counts = samples.join_groups(samples.counted(df, ["a"]), measured.sizes, ["a"])
            got = {(row["a"], row["p"]): row["q"] for row in quantiles.estimate_counted(counts, ["a"], ps, measured, method).collect()}
            assert len(got) == len(x) * len(ps)
            for g, values in x.items():
                order = np.sort(values)
                for p in ps:
                    first, w = method.weights(len(values), p)
                    assert abs(got[None if g == "a null" else g, p] - w @ order[first - 1 : first - 1 + len(w)]) < 1e-9


def test_stream_tracker_on_windows_of_zeros_is_as_its_sql(spark, tmp_path):
    from steadfast.plans import queries

    begin = datetime.datetime(2024, 1, 1)
    values = [float(k % 7 + 1) for k in range(30)] + [0.0] * 70 + [float(k % 5 + 1) for k in range(60)]
    rows = [(k, begin + datetime.timedelta(seconds=k), 1, "a", v, "") for k, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(map(tuple, queries.QUERIES["stream_tracker"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(con.sql(queries.SQL["stream_tracker"]).fetchall())
