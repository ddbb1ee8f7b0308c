"""Random draws with replacement, by weights: each draw is a look-up in running counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _number(text: Column) -> Column:
    """60 bits of a text, alike in every engine that has MD5."""
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(15)), 16, 10).cast("bigint")


def pick(df: DataFrame, count: int, seed: int, by: Sequence[str], weight: str | None = None, rows: int = 1000) -> DataFrame:
    """draw (from 0), and a row of df for each of `count` draws; a row may be drawn several times.

    by: columns that tell rows apart. weight: whole numbers, null and under 1 for rows that aren't drawn; without it all
    rows weigh the same. Rows stand in the order of a hash of `by`, each over as many of the numbers from 0 on as it weighs,
    and a draw is the row over its number: the same rows for a seed, whatever the partitions. Running weights add the
    totals of 4,096 parts of the hashes; look-ups meet in blocks of numbers that some `rows` rows share. Without rows
    of weight there are no draws.
    """
    told = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in by))
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    placed = df.withColumns({"_h": F.md5(told), "_w": w}).where("_w > 0").withColumn("_part", F.substr("_h", F.lit(1), F.lit(3)))
    totals = placed.groupBy("_part").agg(F.sum("_w").alias("_t"), F.count("*").alias("_n"))  # at most 4,096 rows
    before = totals.select("_part", F.coalesce(F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    here = Window.partitionBy("_part").orderBy("_h", *by).rowsBetween(Window.unboundedPreceding, 0)
    ranged = placed.join(F.broadcast(before), "_part").withColumn("_to", F.sum("_w").over(here) + F.col("_b")).withColumn("_from", F.col("_to") - F.col("_w"))
    total, n = totals.agg(F.sum("_t"), F.sum("_n")).first()
    if not total:
        return df.sparkSession.createDataFrame([], f"draw long, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}")
    block = max(1, total * rows // n)
    shared = ranged.withColumn("_block", F.explode(F.expr(f"sequence(_from div {block}, (_to - 1) div {block})")))
    draws = df.sparkSession.range(count).select(F.col("id").alias("draw"), (_number(F.concat_ws("/", F.lit(str(seed)), "id")) % total).alias("_u")).withColumn("_at", F.expr(f"_u div {block}"))
    return draws.join(shared, (F.col("_at") == F.col("_block")) & (F.col("_u") >= F.col("_from")) & (F.col("_u") < F.col("_to"))).select("draw", *(F.col(c) for c in df.columns))
