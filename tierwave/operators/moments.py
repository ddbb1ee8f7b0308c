"""Window moments n, sum, min, max, m1..m4 (mean and sums of powers of differences from it), and their exact merge.

Absent positions are zeros: n is the width of the window (less at the end of a sequence), not the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("n", "sum", "min", "max", "m1", "m2", "m3", "m4")


def tile_moments(signal: DataFrame, keys: Sequence[str], window: int, lengths: DataFrame | None = None) -> DataFrame:
    """keys, tile, FIELDS of each window [tile * window, (tile + 1) * window) that has a row.

    signal: keys, pos, value. lengths: seq, len (for the width of the last window); without it every row's position is
    taken as present, and n counts rows. One shuffle, of central moments aggregated map-side.
    """
    group = [*keys, "tile"]
    tiled = signal.select(*keys, F.col("value").cast("double").alias("value"), F.floor(F.col("pos") / window).alias("tile"))
    r, m2 = F.col("_rows"), F.col("_var") * F.col("_rows")
    parts = tiled.groupBy(*group).agg(
        F.count("*").cast("double").alias("_rows"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("_mean"), F.var_pop("value").alias("_var"), F.skewness("value").alias("_skew"), F.kurtosis("value").alias("_kurt"),
    )
    parts = parts.withColumns({"_m2": m2, "_m3": F.coalesce(F.col("_skew"), F.lit(0.0)) * F.pow(m2, F.lit(1.5)) / F.sqrt(r), "_m4": F.coalesce(F.col("_kurt") + 3, F.lit(0.0)) * m2 * m2 / r})
    if lengths is None:
        parts = parts.withColumn("n", F.col("_rows"))
    else:
        width = F.least(F.lit(window).cast("bigint"), F.col("len") - F.col("tile") * window)
        parts = parts.join(lengths.select("seq", "len"), "seq").withColumn("n", width.cast("double"))
    # The absent positions are a second part, all zeros.
    absent, m1 = F.col("n") - r, F.col("sum") / F.col("n")
    d = F.col("_mean") - m1
    zero = lambda f, c: F.when(absent > 0, f(F.col(c), F.lit(0.0))).otherwise(F.col(c)).alias(c)
    tail = lambda k: r * F.pow(d, F.lit(k)) + absent * F.pow(-m1, F.lit(k))
    return parts.select(
        *group, "n", "sum", zero(F.least, "min"), zero(F.greatest, "max"), m1.alias("m1"), (F.col("_m2") + tail(2)).alias("m2"),
        (F.col("_m3") + 3 * d * F.col("_m2") + tail(3)).alias("m3"), (F.col("_m4") + 4 * d * F.col("_m3") + 6 * d * d * F.col("_m2") + tail(4)).alias("m4"),
    )


def run_moments(runs: DataFrame, keys: Sequence[str], window: int, lengths: DataFrame) -> DataFrame:
    """As tile_moments() for a signal given as runs (keys, start, end, value), weighted by their lengths in the window."""
    cut = runs.select(*keys, "start", "end", "value", F.explode(F.expr(f"sequence(start div {window}, (end - 1) div {window})")).alias("tile"))
    part = cut.select(*keys, "tile", "value", (F.least(F.col("end"), (F.col("tile") + 1) * window) - F.greatest("start", F.col("tile") * window)).alias("_w"))
    group = [*keys, "tile"]
    over = Window.partitionBy(*group)
    part = part.join(lengths.select("seq", "len"), "seq").withColumn("n", F.least(F.lit(window).cast("bigint"), F.col("len") - F.col("tile") * window))
    part = part.withColumn("m1", F.sum(F.col("value") * F.col("_w")).over(over) / F.col("n")).withColumn("_d", F.col("value") - F.col("m1"))
    out = part.groupBy(*group).agg(F.first("n").alias("n"), F.sum("_w").alias("_rows"), F.sum(F.col("value") * F.col("_w")).alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), F.first("m1").alias("m1"), *(F.sum(F.pow("_d", F.lit(k)) * F.col("_w")).alias(f"m{k}") for k in (2, 3, 4)))
    absent = F.col("n") - F.col("_rows")
    zero = lambda f, c: F.when(absent > 0, f(F.col(c), F.lit(0.0))).otherwise(F.col(c).cast("double")).alias(c)
    return out.select(*group, F.col("n").cast("double").alias("n"), F.col("sum").cast("double").alias("sum"), zero(F.least, "min"), zero(F.greatest, "max"), "m1", *((F.col(f"m{k}") + absent * F.pow(-F.col("m1"), F.lit(k))).alias(f"m{k}") for k in (2, 3, 4)))


def merge(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Moments of the union of the windows of each key: parts have keys and FIELDS. Sums only, so exact in any order.

    The mean of a key is joined back, and all sums are aggregated map-side: a key may have any number of windows.
    """
    mean = parts.groupBy(*keys).agg((F.sum(F.col("n") * F.col("m1")) / F.sum("n")).alias("_m"))
    return _merged(parts.join(mean, list(keys)), keys)


def merge_few(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """merge() for keys of few windows each: the mean and the sums use one shuffle."""
    over = Window.partitionBy(*keys)
    return _merged(parts.withColumn("_m", F.sum(F.col("n") * F.col("m1")).over(over) / F.sum("n").over(over)), keys)


def _merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    p = parts.withColumn("_d", F.col("m1") - F.col("_m"))
    n, d, m2, m3 = (F.col(c) for c in ("n", "_d", "m2", "m3"))
    return p.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), F.first("_m").alias("m1"),
        F.sum(m2 + n * d * d).alias("m2"), F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("m3"),
        F.sum(F.col("m4") + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d).alias("m4"),
    )


def merge_tiles(moments: DataFrame, keys: Sequence[str], branch: int) -> DataFrame:
    """One level up: every `branch` tiles make one, the last from what is left."""
    return merge_few(moments.withColumn("tile", F.floor(F.col("tile") / branch)), [*keys, "tile"])


def merge_overlapping(moments: DataFrame, keys: Sequence[str], span: int, step: int = 1) -> DataFrame:
    """Moments of every `span` rows that lie `step` apart, from each row on, where all are there."""
    at = F.explode(F.expr(f"filter(transform(sequence(0, {span - 1}), k -> tile - k * {step}), x -> x >= 0)"))
    copies = moments.withColumn("_start", at)
    full = F.count("*").over(Window.partitionBy(*keys, "_start"))
    copies = copies.withColumn("_full", full).where(F.col("_full") == span).drop("tile", "_full").withColumnRenamed("_start", "tile")
    return merge_few(copies, [*keys, "tile"])


def standardized(n: str = "n") -> list[Column]:
    """mean, std (sample), skew, kurt (excess); 0, 0 and -3 where they aren't defined."""
    n_, m2 = F.col(n), F.col("m2")
    varies = m2 > 0
    return [
        F.col("m1").alias("mean"), F.when(varies & (n_ > 1), F.sqrt(m2 / (n_ - 1))).otherwise(0.0).alias("std"),
        F.when(varies, F.sqrt(n_) * F.col("m3") / F.pow(m2, F.lit(1.5))).otherwise(0.0).alias("skew"),
        F.when(varies, n_ * F.col("m4") / (m2 * m2) - 3).otherwise(-3.0).alias("kurt"),
    ]


def selected_moments(which: Sequence[int]) -> Column:
    """An array of some of mean, std, skew and kurt (1 to 4), in the order asked for."""
    four = F.array(*standardized())
    return F.transform(F.array(*map(F.lit, which)), lambda k: F.element_at(four, k)) if which else F.array().cast("array<double>")


def window_range(scaled: bool = False) -> Column:
    spread = F.col("max") - F.col("min")
    return spread * F.col("n") if scaled else spread


def window_variance() -> Column:
    return F.when(F.col("n") > 1, F.col("m2") / (F.col("n") - 1)).otherwise(0.0)


def pyramid(moments: DataFrame, keys: Sequence[str], window: int, branch: int, root: int) -> DataFrame:
    """keys, window, tile, FIELDS of all levels window * branch ** k up to root, each merged from the level below it."""
    level, out = moments.withColumn("window", F.lit(window).cast("bigint")), None
    while True:
        out = level if out is None else out.unionByName(level)
        if branch < 2 or window * branch > root:
            return out
        window *= branch
        level = merge_tiles(level.drop("window"), keys, branch).withColumn("window", F.lit(window).cast("bigint"))


def clean_end(moments: DataFrame, keys: Sequence[str], window: int, lengths: DataFrame, most: int = 10) -> DataFrame:
    """Sets truncated windows at the end of each sequence to empty ones of the right width.

    From the last window back, at most `most` windows, stopping at the first good one. Only the last `most` windows of
    a sequence are ranked.
    """
    placed = moments.join(lengths.select("seq", "len"), "seq")
    last = F.floor((F.col("len") - 1) / window)
    width = F.when(F.col("tile") == last, F.col("len") - last * window).otherwise(F.lit(window)).cast("double")
    placed = placed.withColumn("_back", last - F.col("tile")).withColumn("_width", width).withColumn("_bad", (F.col("n") < width) & (last - F.col("tile") < most))
    good = placed.where((F.col("_back") < most) & ~F.col("_bad")).groupBy(*keys).agg(F.min("_back").alias("_good"))
    placed = placed.join(good, list(keys), "left")
    fix = F.col("_bad") & (F.col("_back") < F.coalesce("_good", F.lit(most)))
    empty = {"sum": 0.0, "min": 0.0, "max": 0.0, "m1": 0.0, "m2": 0.0, "m3": 0.0, "m4": 0.0}
    return placed.select(*keys, "tile", F.when(fix, F.col("_width")).otherwise(F.col("n")).alias("n"), *(F.when(fix, v).otherwise(F.col(c)).alias(c) for c, v in empty.items()))
