"""Ordered computations along a position axis without putting a whole sequence in one task.

Positions are cut into blocks. A frame that reaches over a block's edge sees the rows it needs because they are sent to
the neighbouring block as well (a halo); a running sum adds the totals of the blocks before, a table of one row a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 1 << 16


def with_halo(df: DataFrame, before: int = 0, after: int = 0, block: int = BLOCK, pos: str = "pos") -> DataFrame:
    """Adds _block; rows that a neighbour's frame of `before` rows back or `after` rows ahead sees are repeated there."""
    to = F.sequence(F.floor((F.col(pos) - after) / block), F.floor((F.col(pos) + before) / block))
    return df.withColumn("_block", F.explode(to))


def own(df: DataFrame, block: int = BLOCK, pos: str = "pos") -> DataFrame:
    """Drops the halo again."""
    return df.where(F.floor(F.col(pos) / block) == F.col("_block")).drop("_block")


def in_block(keys: Sequence[str], pos: str = "pos") -> WindowSpec:
    return Window.partitionBy(*keys, "_block").orderBy(pos)


def with_following(df: DataFrame, keys: Sequence[str], name: str, block: int = BLOCK, pos: str = "pos") -> DataFrame:
    """df with `name`, the next position within keys (null at the end); pos is unique within keys.

    The one after a block's last position is the first of a later block that has any: a table of one row a block.
    """
    df = df.withColumn("_block", F.floor(F.col(pos) / block))
    firsts = df.groupBy(*keys, "_block").agg(F.min(pos).alias("_first"))
    later = firsts.select(*keys, "_block", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_block")).alias("_later"))
    ahead = F.coalesce(F.lead(pos).over(in_block(keys, pos)), F.col("_later"))
    return df.join(later, [*keys, "_block"]).withColumn(name, ahead).drop("_block", "_later")


def running_sums(df: DataFrame, keys: Sequence[str], columns: Sequence[str], block: int = BLOCK, pos: str = "pos") -> DataFrame:
    """df with each of `columns` replaced by its running sum over pos within keys; pos is unique within keys."""
    df = df.withColumn("_block", F.floor(F.col(pos) / block))
    totals = df.groupBy(*keys, "_block").agg(*(F.sum(c).alias(f"_t_{c}") for c in columns))
    over = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_block", *(F.coalesce(F.sum(f"_t_{c}").over(over), F.lit(0)).alias(f"_b_{c}") for c in columns))
    here = in_block(keys, pos).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(before, [*keys, "_block"])
    return out.select(*(c for c in df.columns if c not in columns and c != "_block"), *((F.sum(c).over(here) + F.col(f"_b_{c}")).alias(c) for c in columns))
