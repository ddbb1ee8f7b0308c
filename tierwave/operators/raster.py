"""Interval rasterisation: contributions of intervals to positions, by difference events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running_sums, with_following
from .store import kept


def coverage_runs(intervals: DataFrame, keys: Sequence[str], values: Sequence[str], block: int = 1 << 16) -> DataFrame:
    """keys, start, end, values: maximal stretches [start, end) between changes of the sums over covering intervals.

    intervals: keys, start, end (half-open), values. Each interval is two events whatever its length, made of one row, so
    that what leads to the intervals is computed once; their sums by position are written once and read again.
    """
    two = F.array(*(F.struct(F.col(at).cast("bigint").alias("pos"), F.lit(by).cast("bigint").alias("_n")) for at, by in (("start", 1), ("end", -1))))
    events = intervals.select(*keys, "start", "end", *values).where("start < end").select(*keys, *values, F.explode(two).alias("_e"))
    net = kept(events.groupBy(*keys, F.col("_e.pos").alias("pos")).agg(*(F.sum(F.col("_e._n") * F.col(v)).alias(v) for v in values), F.sum("_e._n").alias("_n")))
    levels = running_sums(net, keys, [*values, "_n"], block)
    runs = with_following(levels, keys, "end", block)
    return runs.where("_n > 0").select(*keys, F.col("pos").alias("start"), "end", *values)


def positions(runs: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row for each position of the runs."""
    return runs.select(*keys, F.explode(F.expr("sequence(start, end - 1)")).alias("pos"), *values)


def projected(start: str, end: str, tlen: str, limit: Column | None = None) -> tuple[Column, Column]:
    """Bounds of an interval stretched by a signed length: forward from its end, or back before its start."""
    forward = F.col(end) + F.col(tlen)
    low = F.when(F.col(tlen) < 0, F.greatest(F.lit(0).cast("bigint"), F.col(start) + F.col(tlen))).otherwise(F.col(start))
    high = F.when(F.col(tlen) > 0, forward if limit is None else F.least(forward, limit)).otherwise(F.col(end))
    return low, high

