"""Aggregates of every frame of `window` positions, one position apart, for signals whose positions are all present.

Power sums of differences from the block's mean are kept as running sums and subtracted at the frame's ends, so a frame
costs the same whatever its width; minima and maxima combine running ones from both sides of a cut every `window`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import BLOCK, in_block, own, with_halo


def sliding_minmax(signal: DataFrame, keys: Sequence[str], window: int, block: int = BLOCK) -> DataFrame:
    """keys, pos, min, max of [pos, pos + window), for frames that are full."""
    cut = signal.withColumn("_cut", F.floor(F.col("pos") / window))
    up, down = Window.partitionBy(*keys, "_cut").orderBy("pos"), Window.partitionBy(*keys, "_cut").orderBy(F.desc("pos"))
    ends = cut.select(*keys, "pos", *(f("value").over(w).alias(n) for f, w, n in ((F.min, up, "_min_to"), (F.max, up, "_max_to"), (F.min, down, "_min_from"), (F.max, down, "_max_from"))))
    halo = with_halo(ends, after=window - 1, block=block)
    w = in_block(keys)
    out = halo.select(*keys, "pos", "_block", F.least("_min_from", F.lead("_min_to", window - 1).over(w)).alias("min"), F.greatest("_max_from", F.lead("_max_to", window - 1).over(w)).alias("max"), F.lead("pos", window - 1).over(w).alias("_last"))
    return own(out, block).where(f"_last = pos + {window - 1}").drop("_last")


def sliding_moments(signal: DataFrame, keys: Sequence[str], window: int, block: int = BLOCK) -> DataFrame:
    """keys, pos, n, sum, min, max, m1..m4 of [pos, pos + window), for frames that are full."""
    halo = with_halo(signal, after=window - 1, block=block)
    whole = Window.partitionBy(*keys, "_block")
    shifted = halo.withColumn("_c", F.avg("value").over(whole)).withColumn("_x", F.col("value") - F.col("_c"))
    w = in_block(keys)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = shifted.select(*keys, "pos", "_block", "_c", *(F.sum(F.pow("_x", F.lit(k))).over(so_far).alias(f"_p{k}") for k in (1, 2, 3, 4)))
    frame = sums.select(*keys, "pos", "_block", "_c", F.lead("pos", window - 1).over(w).alias("_last"), *((F.lead(f"_p{k}", window - 1).over(w) - F.coalesce(F.lag(f"_p{k}").over(w), F.lit(0.0))).alias(f"_s{k}") for k in (1, 2, 3, 4)))
    s1, s2, s3, s4 = (F.col(f"_s{k}") for k in (1, 2, 3, 4))
    n, m = float(window), F.col("_m")
    out = own(frame, block).where(f"_last = pos + {window - 1}").withColumn("_m", s1 / n).select(
        *keys, "pos", F.lit(n).alias("n"), (s1 + n * F.col("_c")).alias("sum"), (m + F.col("_c")).alias("m1"),
        (s2 - m * s1).alias("m2"), (s3 - 3 * m * s2 + 2 * m * m * s1).alias("m3"), (s4 - 4 * m * s3 + 6 * m * m * s2 - 3 * m * m * m * s1).alias("m4"),
    )
    return out.join(sliding_minmax(signal, keys, window, block), [*keys, "pos"])
