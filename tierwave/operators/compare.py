"""Comparisons of signals and of moment series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differential(a: DataFrame, b: DataFrame, keys: Sequence[str], fold: bool = False, high: float | None = None) -> DataFrame:
    """keys, pos, value: a - b, or the fold change clip(a, 1, high) / clip(b, 1, high) - 1. Absent positions are 0."""
    both = a.select(*keys, "pos", F.col("value").alias("_a")).join(b.select(*keys, "pos", F.col("value").alias("_b")), [*keys, "pos"], "full")
    x, y = (F.coalesce(c, F.lit(0.0)) for c in ("_a", "_b"))
    if fold:
        inside = lambda c: F.greatest(F.lit(1.0), c if high is None else F.least(c, F.lit(high)))
        return both.select(*keys, "pos", (inside(x) / inside(y) - 1).alias("value"))
    return both.select(*keys, "pos", (x - y).alias("value"))


def min_max(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Each column from 0 to 1 within `by`; where it doesn't vary, 0.

    Extremes are aggregated first and joined, so that no group has to be in one task.
    """
    ends = df.groupBy(*by).agg(*(f(c).alias(f"_{n}_{c}") for c in columns for f, n in ((F.min, "min"), (F.max, "max"))))
    spread = lambda c: F.col(f"_max_{c}") - F.col(f"_min_{c}")
    scaled = {c: (F.col(c) - F.col(f"_min_{c}")) / F.when(spread(c) == 0, 1.0).otherwise(spread(c)) for c in columns}
    return df.join(ends, list(by)).select(*(scaled[c].alias(c) if c in scaled else c for c in df.columns))


def correlation(a: DataFrame, b: DataFrame, on: Sequence[str], by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each column of two series joined on `on`, within `by`."""
    right = b.select(*on, *(F.col(c).alias(f"_{c}") for c in columns))
    return a.join(right, list(on)).groupBy(*by).agg(*(F.corr(c, f"_{c}").alias(c) for c in columns))


def running_top(df: DataFrame, by: str, k: int, skip: int = 0) -> DataFrame:
    """The k rows of the largest `by` after the first `skip`."""
    return df.orderBy(F.desc(by), *(c for c in df.columns if c != by)).offset(skip).limit(k)


def by_distance(df: DataFrame, index: str, focus: int) -> DataFrame:
    """Adds how far each row is from a focal one, for ordering."""
    return df.withColumn("distance", F.abs(F.col(index) - focus))
