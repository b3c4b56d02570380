"""Quantiles as weighted sums of order statistics: Harrell-Davis, trimmed Harrell-Davis, and linear interpolation.

The weights depend on (method, n, p) only. They are a dimension table (n, p, rank, w) that meets the ranked sample in
an equi-join, so any number of ps costs one ranking of the data, and the sums are ordinary aggregates in the JVM.

For many ps, estimate_counted ranks each value once with its count, and a row of its table has the weights of many ranks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from steadfast.errors import InvalidParameter
from steadfast.functions.weights import HD, SIMPLE, Method, check_probability
from steadfast.operators import samples
from steadfast.operators.samples import _all, join_groups, ranked, sample, sizes

#: Distinct group sizes whose weights the driver makes, and rows of the table it makes; beyond, executors make them.
DRIVER_SIZES, DRIVER_ROWS = 2_000, 2_000_000
#: Ranks whose weights a row of cell_table holds, tasks that make it beyond the driver's bounds, and weights up to which it is broadcast.
CELL, CELL_TASKS, BROADCAST_WEIGHTS = 1024, 24, 30_000_000

PERCENTILES = tuple(k / 100 for k in range(1, 100))
DECILES = tuple(k / 10 for k in range(1, 10))
QUARTILES = (0.25, 0.5, 0.75)


def _rows(weights: Callable[[int, float], tuple[int, np.ndarray]], ns: Sequence[int], ps: Sequence[float]) -> pd.DataFrame:
    parts = []
    for n in ns:
        for p in ps:
            first, w = weights(int(n), float(p))
            parts.append(pd.DataFrame({"n": int(n), "p": float(p), "rank": np.arange(first, first + len(w)), "w": w}))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"n": [], "p": [], "rank": [], "w": []}).astype({"n": "int64", "p": "float64", "rank": "int64", "w": "float64"})


@dataclass
class Measured:
    """Group sizes of a sample: as a DataFrame (groups, n), the largest, and the distinct ones if they are few."""

    sizes: DataFrame
    most: int
    known: list[int] | None


def measure(s: DataFrame, groups: Sequence[str], n_of: DataFrame | None = None) -> Measured:
    """n_of: groups and n, if they are not to be counted in s."""
    n_of = n_of if n_of is not None else sizes(s, groups)
    known = sorted(r[0] for r in n_of.select("n").distinct().limit(DRIVER_SIZES + 1).collect())
    if len(known) <= DRIVER_SIZES:
        return Measured(n_of, known[-1] if known else 0, known)
    return Measured(n_of, n_of.agg(F.max("n")).first()[0], None)


def _most_weights(known: Sequence[int], ps: Sequence[float]) -> int:
    """A band of weights is some 20 standard deviations of a rank wide at most."""
    return sum(min(n, 20 * int(max(n, 1) ** 0.5) + 120) for n in known) * len(ps)


def weight_table(spark: SparkSession, measured: Measured, ps: Sequence[float], method: Method = HD, weights: Callable[[int, float], tuple[int, np.ndarray]] | None = None) -> DataFrame:
    """(n, p, rank, w) for the sizes of groups. Broadcast only if the driver made it within its bounds, from `weights` if given."""
    ps = [check_probability(p) for p in ps]
    known = measured.known
    if known is not None and _most_weights(known, ps) <= DRIVER_ROWS:
        return F.broadcast(spark.createDataFrame(_rows(weights or method.weights, known, ps), "n long, p double, rank long, w double"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column(0).to_pylist():
                for p in ps:
                    yield pa.RecordBatch.from_pandas(_rows(method.weights, [n], [p]), preserve_index=False)

    return measured.sizes.select("n").distinct().mapInArrow(make, "n long, p double, rank long, w double")


def estimate(s: DataFrame, groups: Sequence[str], ps: Sequence[float], method: Method = HD, measured: Measured | None = None, weights: Callable[[int, float], tuple[int, np.ndarray]] | None = None, table: DataFrame | None = None) -> DataFrame:
    """groups, n, p, q (the quantile) and m2 (the weighted second moment) for a sample (groups, x). Groups without values have no row.

    measured: the sizes, if a sample of the same sizes was measured before; weights: where the driver gets those of (n, p);
    table: the weight_table, if there is one already.
    """
    measured = measured or measure(s, groups)
    r = ranked(s, groups, measured.most)
    if not groups:
        r = r.withColumn("n", F.lit(measured.most).cast("long"))
    elif measured.most <= samples.WINDOW_ROWS:  # one shuffle gives rank and size
        r = r.withColumn("n", F.count("*").over(Window.partitionBy(*groups)))
    else:
        r = join_groups(r, measured.sizes, groups)
    if table is None:
        table = weight_table(s.sparkSession, measured, ps, method, weights)
    weighted = r.join(table, (r["n"] == table["n"]) & (r["rank"] == table["rank"])).select(*(r[g] for g in groups), r["n"], "p", "w", "x")
    return weighted.groupBy(*groups, "n", "p").agg(F.sum(F.col("w") * F.col("x")).alias("q"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("m2"))


def _cells(method: Method, n: int, ps: Sequence[float]) -> pa.RecordBatch:
    """(n, p, _cell, _base, _sums): the weights of the ranks after base in one cell, summed from 0 on."""
    rows = []
    for p in ps:
        first, w = method.weights(n, p)
        base, end = first - 1, first - 1 + len(w)
        for cell in range(base // CELL, (end - 1) // CELL + 1):
            a, b = max(base, cell * CELL), min(end, (cell + 1) * CELL)
            rows.append((n, p, cell, a, np.concatenate([[0.0], np.cumsum(w[a - base : b - base])])))
    kinds = {"n": pa.int64(), "p": pa.float64(), "_cell": pa.int64(), "_base": pa.int64(), "_sums": pa.list_(pa.float64())}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))


def cell_table(spark: SparkSession, measured: Measured, ps: Sequence[float], method: Method = HD) -> DataFrame:
    """The weights of weight_table, a row for each p and cell of ranks. Broadcast only if there are few."""
    ps, known = [check_probability(p) for p in ps], measured.known
    most = _most_weights(known, ps) if known is not None else math.inf
    if known and most <= DRIVER_ROWS:
        return F.broadcast(spark.createDataFrame(pa.Table.from_batches([_cells(method, n, ps) for n in known])))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield _cells(method, n, [p])

    each = measured.sizes.select("n").distinct().select("n", F.explode(F.array(*map(F.lit, ps))).alias("p")).repartition(CELL_TASKS, "n", "p")
    table = each.mapInArrow(make, "n long, p double, _cell long, _base long, _sums array<double>")
    return F.broadcast(table) if most <= BROADCAST_WEIGHTS else table.hint("merge")


def estimate_counted(counts: DataFrame, groups: Sequence[str], ps: Sequence[float], measured: Measured, method: Method = HD) -> DataFrame:
    """groups, n, p and q of counts (groups, n, x, c): each value once, with the sum of the weights of its ranks."""
    r = ranked(counts, groups, measured.most, times="c")  # at most so many rows
    r = r.withColumn("_cell", F.explode(F.sequence(F.expr(f"(rank - c) div {CELL}"), F.expr(f"(rank - 1) div {CELL}"))))
    table = cell_table(counts.sparkSession, measured, ps, method)
    met = r.join(table, (r["n"] == table["n"]) & (r["_cell"] == table["_cell"])).select(*(r[g] for g in groups), r["n"], "p", "x", "_sums", (F.col("rank") - F.col("_base")).alias("_to"), (F.col("rank") - F.col("c") - F.col("_base")).alias("_from"))
    ends = F.greatest(F.lit(0), F.col("_from")).cast("int"), F.least(F.size("_sums") - 1, F.col("_to")).cast("int")
    return met.filter(ends[0] < ends[1]).groupBy(*groups, "n", "p").agg(F.sum((F.get("_sums", ends[1]) - F.get("_sums", ends[0])) * F.col("x")).alias("q"))


def wide(s: DataFrame, groups: Sequence[str], ps: Sequence[float], method: Method = HD, names: Sequence[str] | None = None, **known) -> DataFrame:
    """groups, n and a column for each p: one row for each group."""
    names = names or [f"q{k}" for k in range(len(ps))]
    long = estimate(s, groups, list(dict.fromkeys(ps)), method, **known)
    return long.groupBy(*groups, "n").agg(*(F.max(F.when(F.col("p") == F.lit(float(p)), F.col("q"))).alias(name) for p, name in zip(ps, names, strict=True)))


def plain_median(s: DataFrame, groups: Sequence[str], name: str = "median") -> DataFrame:
    """groups and the sample median, by ranks as all quantiles: no group has to fit into a task's memory."""
    return estimate(s.select(*groups, "x"), groups, [0.5], SIMPLE).select(*groups, F.col("q").alias(name))


def one_row(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Of an ungrouped result with a row or none: one row, NaN where there was none."""
    return df.agg(*(F.coalesce(F.first(f"`{v}`"), F.lit(float("nan"))).alias(v) for v in values))


def quantiles(df: DataFrame, columns: str | Sequence[str], ps: Sequence[float], method: Method = HD, groups: Sequence[str] = (), nan_policy: str = "raise", cache=None) -> DataFrame:
    """One row for each group with a column {column}_q{p} for each column and p, p to two places.

    Nulls are dropped. Without groups an empty sample gives NaN; a group without values gives null. cache: a QuantileCache
    whose weights are taken, and which keeps those that are new.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    ps = [check_probability(p) for p in ps]
    if not columns or not ps:
        raise InvalidParameter("quantiles needs a column and a probability at least")
    names = {p: f"q{p:.2f}" if len({f"{x:.2f}" for x in ps}) == len(set(ps)) else f"q{p:g}" for p in ps}
    out = None
    for c in columns:
        x = sample(df, c, groups, nan_policy=nan_policy)
        found = wide(x, groups, ps, method, [f"{c}_{names[p]}" for p in ps], weights=cache.weights if cache is not None else None).drop("n")
        if not groups:
            found = one_row(found, [f"{c}_{names[p]}" for p in ps])
        out = found if out is None else join_groups(out, found, groups, "left" if groups else "inner")
    return out


def quantile_table(df: DataFrame, column: str, ps: Sequence[float], method: Method = HD, groups: Sequence[str] = (), nan_policy: str = "raise") -> DataFrame:
    """groups, n, p, value, second_moment: a row for each group and p."""
    return estimate(sample(df, column, groups, nan_policy=nan_policy), groups, ps, method).withColumnsRenamed({"q": "value", "m2": "second_moment"})


__all__ = ["DECILES", "PERCENTILES", "QUARTILES", "_all", "estimate", "estimate_counted", "measure", "plain_median", "quantile_table", "quantiles", "weight_table", "wide"]
