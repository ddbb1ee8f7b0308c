"""Overlaps by bins of several widths and by running counts, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tierwave.operators import intervals, tracks

KIND = "seq string, start long, end long, name int"


def made(n, seed, longest):
    r = random.Random(seed)
    out = [(r.choice("ab"), s := r.randint(0, 100_000), s + r.choice([0, 1, 7, 64, r.randint(1, longest)]), k) for k in range(n)]
    return [*out, ("a", 0, 250_000_000, n), ("b", 63, 65, n + 1), ("a", 511, 513, n + 2), ("c", 5, 9, n + 3)]


def overlap(a, b):
    return a[0] == b[0] and a[1] < b[2] and b[1] < a[2] and a[1] < a[2] and b[1] < b[2]


@pytest.mark.parametrize("base", [1, 64, 5000])
def test_pairs(spark, base):
    left, right = made(150, 1, 3000), made(150, 2, 60_000)
    got = intervals.overlap_join(spark.createDataFrame(left, KIND), spark.createDataFrame(right, KIND), "seq", base)
    assert got.columns == ["seq", "start", "end", "name", "r_seq", "r_start", "r_end", "r_name"]
    assert sorted(map(tuple, got.collect())) == sorted((*a, *b) for a in left for b in right if overlap(a, b))


def test_a_long_interval_is_one_row(spark):
    one = intervals._binned(spark.createDataFrame([("a", 0, 250_000_000, 1), ("a", 5, 6, 2)], KIND), 64)
    assert [(r.name, r._k, r._b) for r in one.orderBy("name").collect()] == [(1, 8, 0), (2, 0, 0)]


@pytest.mark.parametrize("block", [1 << 16, 1000])
def test_counts_without_pairs(spark, block):
    left, right = made(200, 3, 5000), made(100, 4, 20_000)
    got = intervals.overlap_counts(spark.createDataFrame(left, KIND), spark.createDataFrame(right, KIND).withColumn("more", F.lit(1)), "seq", block)
    over = lambda b: [a for a in left if overlap(a, b)]
    assert sorted(map(tuple, got.collect())) == sorted((*b, 1, len(over(b)), sum(min(a[2], b[2]) - max(a[1], b[1]) for a in over(b))) for b in right if b[1] < b[2])


def test_empty(spark):
    none = spark.createDataFrame([], KIND)
    some = spark.createDataFrame([("a", 1, 5, 0)], KIND)
    assert intervals.overlap_join(none, some, "seq", 64).count() == 0 and intervals.overlap_join(none, none, "seq", 64).count() == 0
    assert [tuple(r)[-2:] for r in intervals.overlap_counts(none, some, "seq").collect()] == [(0, 0)]


def test_pairs_of_crowded_bins_are_dealt_out(spark):
    """What straddles a bound of coarse bins meets its neighbours only, not all of its sequence; no key holds most rows."""
    rows = [("a", 6 * k % 2400, 6 * k % 2400 + 1 + k % 50, k) for k in range(2000)]
    df = spark.createDataFrame([*rows, ("a", 0, 2500, 2000)], KIND)
    bins = intervals._covering(df, 8, 3)
    assert bins.groupBy("name").count().agg(F.max("count")).first()[0] <= 2 * (intervals.FAN - 1) * 3
    assert bins.groupBy("_j", "_c").count().agg(F.max("count")).first()[0] < 100
    pairs = intervals.overlap_join(df, df, "seq", 64).select("name", "r_name").collect()
    every = [*rows, ("a", 0, 2500, 2000)]
    assert len(pairs) == len(set(pairs)) == sum(overlap(x, y) for x in every for y in every)


def test_no_key_has_all_pairs_of_a_crowded_place(spark):
    """Many intervals over one place meet in slices: each pair once, and under no key more than some 50 of either side."""
    left = spark.createDataFrame([("a", 64, 72, k) for k in range(600)] + [("a", 3, 5, 600)], KIND)
    right = spark.createDataFrame([("a", 65, 67, k) for k in range(900)] + [("b", 3, 5, 900)], KIND)
    binned = lambda df: df.withColumns({"_j": F.lit(0), "_c": F.expr("start div 8")})
    a, b = intervals._sliced(binned(left), binned(right), "seq", 50)
    at = ["seq", "_j", "_c", "_s", "_t"]
    assert all(df.groupBy(*at).count().agg(F.max("count")).first()[0] < 100 for df in (a, b))
    assert (a.count(), b.count()) == (600 * 18 + 1, 900 * 12 + 1)
    assert a.join(b, at).count() == 600 * 900
    pairs = intervals.overlap_join(left, right, "seq", 64, 50).select("name", "r_name").collect()
    assert len(pairs) == len(set(pairs)) == 600 * 900


def test_bases_are_read_once(spark):
    """Both events of a read come from one row, whatever was needed to make it."""
    made = spark.sparkContext.accumulator(0)

    def bases(n):
        made.add(1)
        return "gC" * n + "A" * n

    zero = F.lit(0).cast("bigint")
    rows = spark.range(50).select(F.lit("c").alias("seq"), F.lit("c").alias("mate_seq"), F.col("id").alias("pos"), F.lit(6).alias("rlen"), (F.col("id") + 6).alias("ref_end"), F.lit(0).alias("flag"), F.lit(30).alias("mapq"), zero.alias("tlen"), F.udf(bases, "string")((F.col("id") % 3).cast("int")).alias("bases"))
    got = tracks.interval_tracks(rows, ["seq"], ["gc", "total"], has_bases=True).collect()
    assert made.value == 50
    assert sum((x["end"] - x["start"]) * x["total"] for x in got) == 300
    assert abs(sum((x["end"] - x["start"]) * x["gc"] for x in got) - 6 * 33 * 2 / 3) < 1e-6


def test_gc_of_many_reads_is_exact(spark):
    """A share without an end in binary, summed over many reads: before, each read's was off by a third of 2**-40."""
    zero, n = F.lit(0).cast("bigint"), 300_000
    rows = spark.range(n).select(F.lit("c").alias("seq"), F.lit("c").alias("mate_seq"), zero.alias("pos"), F.lit(3).alias("rlen"), F.lit(3).alias("ref_end"), F.lit(0).alias("flag"), F.lit(30).alias("mapq"), zero.alias("tlen"), F.lit("gAA").alias("bases"))
    (got,) = tracks.interval_tracks(rows, ["seq"], ["gc", "total"], has_bases=True).collect()
    assert got["total"] == n
    assert abs(got["gc"] - n / 3) < 1e-9
