"""Signals, reads, sequences and genes derived from plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("sm", "rg", "seq", "track")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_signal(spark: SparkSession, folder: str) -> DataFrame:
    """sm, rg, seq, track, pos, value: the value of each event, at its number."""
    label = [F.lit(x).alias(c) for c, x in zip(KEYS, ("s", "all", "events", "value"), strict=True)]
    return table(spark, folder, "events").select(*label, F.col("event_id").alias("pos"), "value")


def event_type_signals(spark: SparkSession, folder: str) -> DataFrame:
    """One sparse track for each type of event: positions of other types are absent."""
    return table(spark, folder, "events").select(F.lit("s").alias("sm"), F.lit("all").alias("rg"), F.lit("events").alias("seq"), F.col("event_type").alias("track"), F.col("event_id").alias("pos"), "value")


def event_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").agg((F.max("event_id") + 1).alias("len")).select(F.lit("events").alias("seq"), "len")


def reads(spark: SparkSession, folder: str) -> DataFrame:
    """Reads from line items: one for each, at its ship date."""
    bit = lambda c, b: F.when(c, b).otherwise(0)
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("bigint")
    flag = (
        bit(F.round(F.col("l_discount") * 100) <= 5, 0x2) + bit(F.col("l_partkey") % 37 == 0, 0x8) + bit(F.col("l_partkey") % 2 == 1, 0x10) + bit(F.col("l_suppkey") % 2 == 1, 0x20)
        + bit(F.col("l_linenumber") == 6, 0x100) + bit(F.col("l_partkey") % 101 == 0, 0x200) + bit(F.col("l_linenumber") == 7, 0x400)
    )
    seq = F.concat("l_returnflag", "l_linestatus")
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey") % 4).alias("sm"), F.concat(F.lit("rg"), F.col("l_linenumber")).alias("rg"), seq.alias("seq"), days.alias("pos"),
        (days + F.col("l_quantity").cast("int")).alias("ref_end"), F.col("l_quantity").cast("int").alias("rlen"), flag.cast("int").alias("flag"),
        (7 * F.round(F.col("l_tax") * 100).cast("int")).alias("mapq"), (F.col("l_orderkey") % 401 - 200).cast("bigint").alias("tlen"),
        F.when(F.col("l_orderkey") % 10 == 0, F.lit("other")).otherwise(seq).alias("mate_seq"),
    )


def lengths(reads_: DataFrame) -> DataFrame:
    return reads_.groupBy("seq").agg(F.max("ref_end").alias("len"))


def genes(spark: SparkSession, folder: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in ("AF", "AO", "NF", "NO", "RF", "RO")))
    start = F.col("p_partkey") % 2400
    return table(spark, folder, "part").select(F.concat_ws("#", "p_name", "p_partkey").alias("gene"), F.lit(0).alias("ord"), F.get(names, (F.col("p_partkey") % 6).cast("int")).alias("seq"), start.alias("start"), (start + F.col("p_size")).alias("end"))


def sides(reads_: DataFrame) -> DataFrame:
    """Inclusive intervals of two sides, by the second letter of the sequence's name, on one line of positions."""
    side = F.when(F.col("seq").endswith("O"), "a").otherwise("b")
    return reads_.select(F.lit("all").alias("seq"), side.alias("side"), F.col("pos").alias("start"), (F.col("ref_end") - 1).alias("end"))
