"""Levels of detail: which level of a pyramid answers a range best, and the range's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flank(start: Column, end: Column, share: float, length: Column) -> tuple[Column, Column]:
    """A range widened by a share of its width to both sides, inside [0, length]."""
    by = F.greatest(F.lit(0).cast("bigint"), F.bround((end - start) * share).cast("bigint"))
    return F.greatest(F.lit(0).cast("bigint"), start - by), F.least(end + by, length)


def choose_window(ranges: DataFrame, levels: DataFrame, tiles: int) -> DataFrame:
    """ranges (range_id, seq, start, end) with the window whose number of tiles is closest to `tiles`.

    levels: seq, window (a few rows for each sequence, joined on it). A level of more than twice the tiles isn't used;
    where all have more, the coarsest is.
    """
    n = (F.col("end") - F.col("start")) / F.col("window")
    fits = F.when(n <= 2 * tiles, 0).otherwise(1)
    rank = F.struct(fits.alias("a"), F.when(fits == 0, F.abs(n - tiles)).otherwise(n).alias("b"), F.col("window").alias("c"))
    best = ranges.join(levels, "seq").groupBy(*ranges.columns).agg(F.min_by("window", rank).alias("window"))
    return best


def slice_range(moments: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of moments (seq, window, tile, ...) inside the chosen ranges (range_id, seq, start, end, window)."""
    low, high = F.floor(F.col("start") / F.col("window")), F.ceil(F.col("end") / F.col("window"))
    return moments.join(chosen, ["seq", "window"]).where((F.col("tile") >= low) & (F.col("tile") < high)).drop("start", "end")


def parse_range(text: Column) -> list[Column]:
    """seq, start, end of `seq:start-end`; of another text the seq alone."""
    pattern = r"^([^:]+):(\d+)-(\d+)$"
    has = text.rlike(pattern)
    number = lambda k: F.when(has, F.regexp_extract(text, pattern, k).cast("bigint"))
    return [F.when(has, F.regexp_extract(text, pattern, 1)).otherwise(text).alias("seq"), number(2).alias("start"), number(3).alias("end")]


def lookup(names: DataFrame, genes: DataFrame) -> DataFrame:
    """Coordinates of gene names; of a gene with several places the first (ord 0)."""
    return names.join(genes.where("ord = 0"), "gene")


def search(genes: DataFrame, stub: str) -> DataFrame:
    """Genes whose name holds the stub, in any case."""
    return genes.where(F.upper("gene").contains(stub.upper()))


def _rounded(x: Column) -> Column:
    """To the nearest whole number, halves up."""
    return F.floor(x + 0.5)


def pan(start: Column, end: Column, window: Column, tiles: Column, length: Column, right: bool) -> tuple[Column, Column]:
    """A range moved by a tenth of its windows; one that would leave the sequence stays where it is."""
    by = window * _rounded(tiles * 0.1) * (1 if right else -1)
    inside = (end + by <= length) if right else (start + by >= 0)
    return F.when(inside, start + by).otherwise(start), F.when(inside, end + by).otherwise(end)


def zoom(start: Column, end: Column, into: bool) -> tuple[Column, Column]:
    """A range of 0.8 or 1.2 times the width around its centre; one that would begin before 0 stays as it is."""
    half = _rounded((end - start) / 2)
    by = _rounded(half * (0.8 if into else 1.2))
    low, high = start + half - by, start + half + by
    return F.when(low >= 0, low).otherwise(start), F.when(low >= 0, high).otherwise(end)
