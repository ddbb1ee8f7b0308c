"""Histograms of a signal's values, and of steps from a value to the next, per window: tall rows of counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import bin_index
from .ordered import in_block, own, running_sums, with_following, with_halo


def tile_spectrum(signal: DataFrame, keys: Sequence[str], window: int, edges: Sequence[float]) -> DataFrame:
    """keys, tile, bin, cnt of a signal whose positions are all present."""
    binned = signal.select(*keys, F.floor(F.col("pos") / window).alias("tile"), bin_index("value", edges).alias("bin"))
    return binned.where("bin is not null").groupBy(*keys, "tile", "bin").agg(F.count("*").alias("cnt"))


def transitions(signal: DataFrame, keys: Sequence[str], edges: Sequence[float], block: int = 1 << 16) -> DataFrame:
    """keys, pos, from_bin, to_bin of each position and the next one; the last position of a sequence has none."""
    halo = with_halo(signal.select(*keys, "pos", bin_index("value", edges).alias("from_bin")), after=1, block=block)
    w = in_block(keys)
    steps = halo.select(*keys, "pos", "_block", "from_bin", F.lead("from_bin").over(w).alias("to_bin"), F.lead("pos").over(w).alias("_next"))
    return own(steps, block).where("_next = pos + 1 and from_bin is not null and to_bin is not null").drop("_next")


def tile_transitions(signal: DataFrame, keys: Sequence[str], window: int, edges: Sequence[float], within: bool = False) -> DataFrame:
    """keys, tile, from_bin, to_bin, cnt. A step belongs to the tile it starts in; within: only steps that end there."""
    steps = transitions(signal, keys, edges).withColumn("tile", F.floor(F.col("pos") / window))
    if within:
        steps = steps.where(F.floor((F.col("pos") + 1) / window) == F.col("tile"))
    return steps.groupBy(*keys, "tile", "from_bin", "to_bin").agg(F.count("*").alias("cnt"))


def merge_counts(counts: DataFrame, keys: Sequence[str], bins: Sequence[str], branch: int) -> DataFrame:
    """One level up, for histograms (bins: bin) as for transitions (bins: from_bin, to_bin)."""
    up = counts.withColumn("tile", F.floor(F.col("tile") / branch))
    return up.groupBy(*keys, "tile", *bins).agg(F.sum("cnt").alias("cnt"))


def count_pyramid(counts: DataFrame, keys: Sequence[str], bins: Sequence[str], window: int, branch: int, root: int) -> DataFrame:
    """keys, window, tile, bins, cnt of all levels window * branch ** k up to root, each summed from the level below it."""
    level, out = counts.withColumn("window", F.lit(window).cast("bigint")), None
    while True:
        out = level if out is None else out.unionByName(level)
        if branch < 2 or window * branch > root:
            return out
        window *= branch
        level = merge_counts(level, keys, bins, branch).withColumn("window", F.lit(window).cast("bigint"))


def collapse_counts(parts: DataFrame, keys: Sequence[str], bins: Sequence[str]) -> DataFrame:
    """Counts of all windows of a key together, as those of chunks."""
    return parts.groupBy(*keys, *bins).agg(F.sum("cnt").alias("cnt"))


def clean_count_ends(counts: DataFrame, keys: Sequence[str], bins: Sequence[str], window: int, lengths: DataFrame, zero_bin: int, most: int = 10, steps: int = 0) -> DataFrame:
    """Sets truncated windows at the end of each sequence to windows of zeros, all in zero_bin (steps: from it to itself).

    lengths: seq, len. From the last window back, at most `most`, stopping at the first that has all its positions, less
    `steps` in each (1 for steps inside windows). Windows without any count are among them. A row a key and window is
    looked at, and only of the last `most`.
    """
    sequences = counts.select(*keys).distinct().join(lengths.select("seq", "len"), "seq")
    last = F.floor((F.col("len") - 1) / window)
    tail = sequences.select(*keys, "len", F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), last - most + 1), last)).alias("tile"))
    width = F.least(F.lit(window).cast("bigint"), F.col("len") - F.col("tile") * window) - steps
    sums = counts.groupBy(*keys, "tile").agg(F.sum("cnt").alias("_n"))
    judged = tail.join(sums, [*keys, "tile"], "left").select(*keys, "tile", width.alias("_width"), (F.coalesce("_n", F.lit(0)) >= width).alias("_good"))
    good = judged.where("_good").groupBy(*keys).agg(F.max("tile").alias("_last"))
    bad = judged.join(good, list(keys), "left").where("tile > coalesce(_last, -1)").select(*keys, "tile", "_width")
    whole = counts.join(bad.drop("_width"), [*keys, "tile"], "left_anti")
    zeros = bad.where("_width > 0").select(*keys, "tile", *(F.lit(zero_bin).alias(b) for b in bins), F.col("_width").alias("cnt"))
    return whole.select(*keys, "tile", *bins, "cnt").unionByName(zeros)


def dense_spectrum(counts: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """keys, tile, counts: an array of `size` numbers, zeros among them."""
    held = counts.groupBy(*keys, "tile").agg(F.map_from_entries(F.collect_list(F.struct("bin", "cnt"))).alias("_m"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.coalesce(F.try_element_at("_m", j), F.lit(0)).cast("double"))
    return held.select(*keys, "tile", cells.alias("counts"))


def dense_transitions(counts: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """keys, tile, counts: `size` arrays of `size` numbers; rows are the bins that steps go to, columns those they come from."""
    cell = (F.col("to_bin") * size + F.col("from_bin")).cast("int")
    flat = dense_spectrum(counts.withColumn("bin", cell), keys, size * size)
    return flat.withColumn("counts", reshape(F.col("counts"), size))


def tall_spectrum(dense: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, tile, bin, cnt of what isn't zero."""
    return dense.select(*keys, "tile", F.posexplode("counts").alias("bin", "cnt")).where("cnt != 0").withColumn("cnt", F.col("cnt").cast("bigint"))


def tall_transitions(dense: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, tile, from_bin, to_bin, cnt of what isn't zero."""
    rows = dense.select(*keys, "tile", F.posexplode("counts").alias("to_bin", "_row"))
    return rows.select(*keys, "tile", "to_bin", F.posexplode("_row").alias("from_bin", "cnt")).where("cnt != 0").withColumn("cnt", F.col("cnt").cast("bigint"))


def flat_chunks(dense: DataFrame, keys: Sequence[str], tiles: int) -> DataFrame:
    """keys, chunk, first, flat: the arrays (of numbers) of `tiles` windows one after another; windows that are absent are left out."""
    held = dense.groupBy(*keys, F.floor(F.col("tile") / tiles).alias("chunk")).agg(F.min("tile").alias("first"), F.array_sort(F.collect_list(F.struct("tile", "counts"))).alias("_w"))
    return held.select(*keys, "chunk", "first", F.flatten(F.transform("_w", lambda w: w.counts)).alias("flat"))


def nth_spectrum(flat: Column, i: Column | int, size: int) -> Column:
    """The i-th array of `size` numbers of a flat one."""
    return F.slice(flat, (F.lit(i) if isinstance(i, int) else i) * size + 1, size)


def nth_matrix(flat: Column, i: Column | int, size: int) -> Column:
    """The i-th matrix of size by size numbers of a flat array, by rows."""
    return reshape(nth_spectrum(flat, i, size * size), size)


def reshape(flat: Column, size: int) -> Column:
    """A flat array in arrays of `size`."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(flat) / size).cast("int") - 1), lambda j: F.slice(flat, j * size + 1, size))


def merge_counts_overlapping(counts: DataFrame, keys: Sequence[str], bins: Sequence[str], span: int, tiles: int, step: int = 1) -> DataFrame:
    """Counts of every `span` rows `step` apart, from each of `tiles` rows on, where all are there."""
    at = F.explode(F.expr(f"filter(transform(sequence(0, {span - 1}), k -> tile - k * {step}), x -> x >= 0 and x + {(span - 1) * step} < {tiles})"))
    return counts.withColumn("tile", at).groupBy(*keys, "tile", *bins).agg(F.sum("cnt").alias("cnt"))


def sliding_counts(rows: DataFrame, keys: Sequence[str], bins: Sequence[str], window: int, length: int) -> DataFrame:
    """keys, pos, bins, cnt of each frame [pos, pos + window) inside [0, length), where cnt is over 0.

    rows: keys, pos, bins. Each row enters one frame and leaves another (two events); running sums of the events give
    the counts at the changes, and each change holds up to the next one.
    """
    enter = rows.select(*keys, *bins, F.greatest(F.col("pos") - (window - 1), F.lit(0)).alias("pos"), F.lit(1).cast("bigint").alias("cnt"))
    leave = rows.select(*keys, *bins, (F.col("pos") + 1).alias("pos"), F.lit(-1).cast("bigint").alias("cnt"))
    net = enter.unionByName(leave).groupBy(*keys, *bins, "pos").agg(F.sum("cnt").alias("cnt")).where("cnt != 0")
    level = running_sums(net, [*keys, *bins], ["cnt"])
    held = with_following(level, [*keys, *bins], "_to").withColumn("_to", F.least(F.coalesce("_to", F.lit(length)), F.lit(length - window + 1))).where("cnt > 0 and pos < _to")
    return held.select(*keys, *bins, F.explode(F.expr("sequence(pos, _to - 1)")).alias("pos"), "cnt")
