"""Bins over sorted edges, half-open: bin j holds [edges[j], edges[j + 1]); values outside have none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the upper edge of the overflow bin.
OVERFLOW = 4294967295.0


def default_edges(max_depth: int, bins: int = 10) -> list[float]:
    """`bins` equal bins from 0 to max_depth, and one for what is over it."""
    step = max_depth // bins
    return [float(k * step) for k in range(bins + 1)] + [OVERFLOW]


def bin_index(value: Column | str, edges: Sequence[float]) -> Column:
    """Number of the value's bin, null outside. A chain of comparisons, which stays in generated code."""
    value = F.col(value) if isinstance(value, str) else value
    out = F.when((value < edges[0]) | (value >= edges[-1]) | value.isNull(), F.lit(None).cast("int"))
    for j, edge in enumerate(edges[1:]):
        out = out.when(value < edge, F.lit(j))
    return out


def parse_edges(spec: str | None) -> list[float]:
    """Edges of `0,5,10,...`: distinct whole numbers in order. Without a specification 25 equal bins from 0 to 1."""
    if spec is None:
        return [k / 25 for k in range(26)]
    return [float(x) for x in sorted({int(x) for x in spec.split(",")})]
