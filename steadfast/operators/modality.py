"""Modes of a distribution by lowlands between the peaks of its quantile-respectful density.

The density is made natively for every group; only its few hundred bins go to a Python function that walks the peaks.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadfast.functions.weights import HD, Method
from steadfast.operators.histogram import uniform_steps, with_edges
from steadfast.operators.samples import join_groups, sample

SENSITIVITY, PRECISION = 0.5, 1 / 101


class Terrain:
    """A histogram whose bins hold equal shares, seen as hills and valleys."""

    def __init__(self, left: np.ndarray, right: np.ndarray, height: np.ndarray):
        self.left, self.right, self.height = left, right, height
        self.centre = (left + right) / 2
        inner = height[1:-1]
        self.hills = 1 + np.flatnonzero((inner > height[:-2]) & (inner >= height[2:]))

    def valley(self, hill: int, other: int, sensitivity: float) -> int | None:
        """The lowest bin between two hills, if it is a lowland: if the valley, filled up to the lower hill, is mostly water.

        Where it is filled, from the first to the last bin that isn't above the level, the bins' shares are the ground.
        """
        between = self.height[hill : other + 1]
        level = min(between[0], between[-1])
        under = hill + np.flatnonzero(between <= level)
        filled = (self.right[under[-1]] - self.left[under[0]]) * level
        ground = (under[-1] - under[0] + 1) / len(self.height)
        dry = ground / filled if filled > 0 else 0.0
        return hill + int(between.argmin()) if dry < sensitivity else None

    def density_at(self, x: float) -> float:
        """Of the first bin that reaches x."""
        return float(self.height[min(int(np.searchsorted(self.right, x, side="left")), len(self.height) - 1)])


def find_modes(left: np.ndarray, right: np.ndarray, height: np.ndarray, sensitivity: float = SENSITIVITY) -> list[tuple[float, float, float, float]]:
    """(location, left bound, right bound, height) of each mode of a histogram whose bins hold equal shares.

    From left to right a range of hills is open, from high to low, and its first hill names it. The next hill looks back over
    those lower than itself, the last one first, and at the first that is higher. A lowland on that way ends the range: a
    mode. Without one the lower hills are its slopes, and it joins the range.
    """
    land = Terrain(left, right, height)
    if len(land.hills) < 2:
        top = int(land.hills[0]) if len(land.hills) else int(height.argmax())
        first = top if len(land.hills) else 0
        return [(float(land.centre[top]), float(left[0]), float(right[-1]), float(height[first]))]
    summits, borders = [], []
    ridge: list[int] = []
    for hill in land.hills.tolist():
        stay = bisect.bisect_right(ridge, -height[hill], key=lambda h: -height[h])  # so many are as high or higher
        view = ridge[stay:][::-1] + [h for h in ridge[:stay][-1:] if height[h] > height[hill]]
        border = next((v for h in view if (v := land.valley(h, hill, sensitivity)) is not None), None)
        if border is None:
            ridge = [*ridge[:stay], hill]
        else:
            summits.append(ridge[0])
            borders.append(float(land.centre[border]))
            ridge = [hill]
    summits.append(ridge[0])
    edges = [float(left[0]), *borders, float(right[-1])]
    return [(float(x := land.centre[m]), a, b, land.density_at(x)) for m, a, b in zip(summits, edges, edges[1:], strict=False)]


def lowland_modes(df: DataFrame, column: str, groups: Sequence[str] = (), *, sensitivity: float = SENSITIVITY, precision: float = PRECISION, method: Method = HD, steps: Callable[[int], Sequence[float]] = uniform_steps) -> DataFrame:
    """groups, mode, location, left_bound, right_bound, height: a row for each mode; groups of fewer than 2 or of equal values have none."""
    sensitivity, precision = min(max(sensitivity, 0.0), 1.0), min(max(precision, 0.001), 1.0)
    s = sample(df, column, groups)
    wide = s.groupBy(*groups).agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("reach")).filter("n >= 2 and reach >= 1e-9").drop("reach")
    hist = with_edges(s, groups, steps(round(1 / precision)), method, wide)
    fields = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in groups)
    schema = f"{fields}{', ' if groups else ''}mode int, location double, left_bound double, right_bound double, height double"
    one = hist.withColumn("_all", F.lit(1)) if not groups else hist

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        found = find_modes(pdf["left"].to_numpy(), pdf["right"].to_numpy(), pdf["density"].to_numpy(), sensitivity)
        out = pd.DataFrame(found, columns=["location", "left_bound", "right_bound", "height"])
        out.insert(0, "mode", np.arange(len(found), dtype="int32"))
        for g in reversed(groups):
            out.insert(0, g, pdf[g].iloc[0])
        return out

    return one.groupBy(*(groups or ["_all"])).applyInPandas(walk, schema)


def mode_contains(value: Column, left_bound: Column, right_bound: Column) -> Column:
    """Whether a value lies within a mode's bounds, both included."""
    return value.between(left_bound, right_bound)


def relative_position(value: Column, left_bound: Column, right_bound: Column) -> Column:
    """Where a value lies between a mode's bounds: 0 at the left one, 1 at the right one; 0.5 in a mode without width, null outside."""
    width = right_bound - left_bound
    inside = F.when(width > 0, (value - left_bound) / F.when(width > 0, width)).otherwise(F.lit(0.5))
    return F.when(mode_contains(value, left_bound, right_bound), inside)


def assign_modes(df: DataFrame, column: str, modes: DataFrame, groups: Sequence[str] = (), *, position: bool = False) -> DataFrame:
    """df with the mode whose bounds hold the value, the first of two that share a bound; null outside.

    With position, also relative_position within it.
    """
    bounds = modes.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("mode", "left_bound", "right_bound"))).alias("_modes"))
    found = F.filter("_modes", lambda m: mode_contains(F.col(column), m["left_bound"], m["right_bound"]))
    out = join_groups(df, bounds, groups, "left").withColumn("_mode", F.try_element_at(found, F.lit(1)))
    out = out.withColumn("mode", F.col("_mode.mode"))
    if position:
        out = out.withColumn("relative_position", relative_position(F.col(column).cast("double"), F.col("_mode.left_bound"), F.col("_mode.right_bound")))
    return out.drop("_modes", "_mode")


def find_mode(modes: DataFrame, value: float, groups: Sequence[str] = ()) -> DataFrame:
    """The mode that holds a value in each group, the first of two that share a bound, with its width and the value's place in it."""
    bounds = F.col("left_bound"), F.col("right_bound")
    hits = modes.filter(mode_contains(F.lit(float(value)), *bounds))
    fields = [c for c in modes.columns if c not in groups and c != "mode"]
    first = hits.groupBy(*groups).agg(F.min(F.struct("mode", *fields)).alias("_m")).filter("_m is not null")
    return first.select(*groups, "_m.*").withColumn("width", bounds[1] - bounds[0]).withColumn("relative_position", relative_position(F.lit(float(value)), *bounds))


def mode_summary(modes: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return modes.groupBy(*groups).agg(F.count("*").alias("mode_count"), (F.count("*") == 1).alias("is_unimodal"), (F.count("*") > 1).alias("is_multimodal"))
