"""Window moments and histograms of an event stream, with a watermark for late rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bins import bin_index
from ..operators import moments
from ..operators.store import merge_into, read_table


def stream_moments(events: DataFrame, every: str, late: str, by: Sequence[str] = (), slide: str | None = None, center: float = 0.0) -> DataFrame:
    """start, by, n, sum, min, max, m1..m4 of each time window; events: ts, value.

    State is power sums of value - center, which merge by addition; a center near the mean keeps them exact.
    """
    x = F.col("value") - center
    window = F.window("ts", every, slide) if slide else F.window("ts", every)
    sums = events.withWatermark("ts", late).groupBy(window, *by).agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), *(F.sum(F.pow(x, F.lit(k))).alias(f"_s{k}") for k in (1, 2, 3, 4)))
    n, (s1, s2, s3, s4) = F.col("n"), (F.col(f"_s{k}") for k in (1, 2, 3, 4))
    m = s1 / n
    return sums.select(F.col("window.start").alias("start"), *by, "n", "sum", "min", "max", (m + center).alias("m1"), (s2 - m * s1).alias("m2"), (s3 - 3 * m * s2 + 2 * m * m * s1).alias("m3"), (s4 - 4 * m * s3 + 6 * m * m * s2 - 3 * m * m * m * s1).alias("m4"))


def stream_spectrum(events: DataFrame, every: str, late: str, edges: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """start, by, bin, cnt of each time window."""
    binned = events.withWatermark("ts", late).withColumn("bin", bin_index("value", edges)).where("bin is not null")
    return binned.groupBy(F.window("ts", every), *by, "bin").agg(F.count("*").alias("cnt")).select(F.col("window.start").alias("start"), *by, "bin", "cnt")


def upsert(path: str, partitions: Sequence[str], keys: Sequence[str]):
    """For foreachBatch: a batch's rows replace those of equal keys (partitions among them); all others stay."""

    def write(batch: DataFrame, _: int) -> None:
        merge_into(batch, path, partitions, keys)

    return write


def moments_sink(path: str, every: str, by: Sequence[str] = ()):
    """For foreachBatch on a stream of ts, value, by: what a batch adds to its windows is kept, however late it comes.

    Each batch writes the moments of its own rows in each window, under its number; merged_moments() adds them up by the
    closed form. A batch that is repeated after a restart replaces what it wrote before, so no row counts twice, and no
    watermark drops any. compact() joins what old batches wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        placed = batch.select(F.window("ts", every)["start"].alias("start"), *by, F.col("value"), F.lit(0).cast("bigint").alias("pos"))
        parts = moments.tile_moments(placed, ["start", *by], 1).drop("tile")
        parts = parts.withColumns({"day": F.date_format("start", "yyyy-MM-dd"), "batch": F.lit(number).cast("bigint")})
        merge_into(parts, path, ["day"], ["day", "start", *by, "batch"], ["start"])

    return write


def merged_moments(spark: SparkSession, path: str, by: Sequence[str] = ()) -> DataFrame:
    """start, by, n, sum, min, max, m1..m4 of all that moments_sink() has written."""
    return moments.merge_few(read_table(spark, path, ["day"]), ["start", *by])


def compact(spark: SparkSession, path: str, by: Sequence[str], before: int, to: str) -> None:
    """Writes a table like path's to `to`, in which what batches under `before` wrote is one row a window, of batch -1.

    Batches under `before` must be committed in the stream's checkpoint: they can't come again.
    """
    parts, keys = read_table(spark, path, ["day"]), ["day", "start", *by]
    old = moments.merge_few(parts.where(F.col("batch") < before), keys).withColumn("batch", F.lit(-1).cast("bigint"))
    merge_into(old.unionByName(parts.where(F.col("batch") >= before).select(*old.columns)), to, ["day"], [*keys, "batch"], ["start"])
