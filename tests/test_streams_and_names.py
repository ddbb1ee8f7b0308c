"""Windows that merge what a stream brings late, draws with replacement, and names in SQL."""

import pytest
from pyspark.sql import functions as F

from tierwave.functions import sql_names
from tierwave.operators import draws, moments
from tierwave.streaming import windows

SCHEMA = "ts timestamp, kind string, value double"


def events(spark, seed, n=400):
    k = F.col("id") * 7919 % 100_003 + seed
    return spark.range(n).select(F.timestamp_seconds(1_700_000_000 + k % 20_000).alias("ts"), F.when(k % 3 > 0, F.concat(F.lit("k"), k % 3)).alias("kind"), (k % 97 / 7 + 1).alias("value"))


def rows(df):
    return sorted(((r.start, r.kind, r.n, r.min, r.max, *(round(r[c], 5) for c in ("sum", "m1", "m2", "m3", "m4"))) for r in df.collect()), key=repr)


def test_late_rows_a_stop_and_a_repeated_batch(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    parts = [events(spark, s) for s in (1, 2, 3, 4)]

    def run(sink):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()

    sink, calls = windows.moments_sink(out, "1 hour", ["kind"]), []
    for p in parts[:2]:
        p.coalesce(1).write.mode("append").parquet(source)
    run(sink)

    def stops(batch, number):
        sink(batch, number)
        calls.append(number)
        raise RuntimeError("lost after the write, before the checkpoint")

    parts[2].coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="lost"):
        run(stops)
    parts[3].coalesce(1).write.mode("append").parquet(source)
    run(sink)  # the batch that was written comes again
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    placed = every.select(F.window("ts", "1 hour")["start"].alias("start"), "kind", "value", F.lit(0).cast("bigint").alias("pos"))
    want = rows(moments.tile_moments(placed, ["start", "kind"], 1).drop("tile"))
    assert calls and rows(windows.merged_moments(spark, out, ["kind"])) == want
    windows.compact(spark, out, ["kind"], 2, out + "-2")
    assert rows(windows.merged_moments(spark, out + "-2", ["kind"])) == want
    assert spark.read.parquet(out + "-2").count() < spark.read.parquet(out).count()


def test_draws(spark):
    df = spark.createDataFrame([(f"r{k}", w, k) for k, w in enumerate([5, 0, None, 1, 3, 1000, 1])], "name string, w long, more int")
    one = sorted(map(tuple, draws.pick(df, 5000, 3, ["name"], "w").collect()))
    assert [r[0] for r in one] == list(range(5000))  # each draw once
    assert one == sorted(map(tuple, draws.pick(df.repartition(7), 5000, 3, ["name"], "w", rows=1).collect()))
    assert one != sorted(map(tuple, draws.pick(df, 5000, 4, ["name"], "w").collect()))
    times = {n: sum(r[1] == n for r in one) for n in ("r0", "r1", "r2", "r5")}
    assert times["r1"] == times["r2"] == 0 and abs(times["r5"] / 5000 - 1000 / 1010) < 0.01 and 5 < times["r0"] < 50
    even = [r.name for r in draws.pick(df, 7000, 1, ["name"]).collect()]
    assert all(850 < even.count(f"r{k}") < 1150 for k in range(7))
    assert draws.pick(df.where("w = 0"), 9, 1, ["name"], "w").count() == 0


def test_names_in_sql(spark):
    assert len(sql_names.register(spark)) == len(sql_names.FUNCTIONS) == len(sql_names.register(spark))
    got = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert got("SELECT pos FROM rasterize(3, 6)") == [(3,), (4,), (5,)] and got("SELECT * FROM rasterize(3, 3)") == []
    assert got("SELECT * FROM tiles_of(95, 210, 100)") == [(0, 5), (1, 100), (2, 10)]
    cigar = "array(named_struct('op', 4, 'len', 5), named_struct('op', 0, 'len', 10), named_struct('op', 1, 'len', 3), named_struct('op', 2, 'len', 4))"
    assert got(f"SELECT * FROM cigar_segments(100, {cigar})") == [(0, 4, 100, 105), (1, 0, 105, 115), (2, 1, 115, 115), (3, 2, 115, 119)]
    assert got("SELECT bin_of(0D, array(0D, 1D, 5D)), bin_of(1D, array(0D, 1D, 5D)), bin_of(5D, array(0D, 1D, 5D)), bin_of(-1D, array(0D, 1D, 5D))") == [(0, 1, None, None)]
    some = [2.0, 7.0, 1.0, 1.0, 9.5, 3.25]
    part = lambda x: f"named_struct('n', 1D, 'sum', {x}D, 'min', {x}D, 'max', {x}D, 'm1', {x}D, 'm2', 0D, 'm3', 0D, 'm4', 0D)"
    merged = spark.sql(f"SELECT merge_moments(array({', '.join(map(part, some))})) AS p").select("p.*").first()
    m = sum(some) / len(some)
    assert [round(merged[f"m{k}"], 9) for k in (1, 2, 3, 4)] == [round(x, 9) for x in (m, *(sum((x - m) ** k for x in some) for k in (2, 3, 4)))]
    assert (merged.n, merged.min, merged.max, merged.sum) == (6, 1.0, 9.5, sum(some))
