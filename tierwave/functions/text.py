"""Sequence and log text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the time format of status logs.
LOG_TIME = "yyyy/MM/dd'['HH:mm:ss']'"


def edit_distance(a: Column | str, b: Column | str) -> Column:
    """Levenshtein distance (unit weights)."""
    return F.levenshtein(a, b)


def weighted_edit_distance(match: float = 0, insert: float = 1, delete: float = 1, substitute: float = 1):
    """Pandas UDF of two strings: the least total weight of edits that turn the first into the second."""
    import pandas as pd

    def one(a: str | None, b: str | None) -> float | None:
        if a is None or b is None:
            return None
        row = [j * insert for j in range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i * delete
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + delete, row[j - 1] + insert, last + (match if x == y else substitute))
        return float(row[-1])

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")


def read_group_line(rg: Column, sm: Column, library: Column, platform: Column) -> Column:
    return F.format_string("@RG\\tID:%s\\tSM:%s\\tLB:%s\\tPL:%s", rg, sm, library, platform)


def merged_sample_name(sm: str = "sm") -> Column:
    """Aggregate: the sorted distinct names, joined by a hyphen."""
    return F.array_join(F.array_sort(F.collect_set(sm)), "-")


def parse_log(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """stage, status, at of lines `stage=<int>\\tstatus=<-1|0|1>\\tdatetime=<time>`."""
    get = lambda name, what: F.regexp_extract(column, rf"(?:^|\t){name}=({what})(?:\t|$)", 1)
    return lines.select(*keep, get("stage", r"\d+").cast("int").alias("stage"), get("status", r"-?\d").cast("int").alias("status"), F.to_timestamp(get("datetime", r"[^\t]+"), LOG_TIME).alias("at"))


def last_good_stage(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return log.groupBy(*by).agg(F.max(F.when(F.col("status") == 1, F.col("stage"))).alias("stage"))


