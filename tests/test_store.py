"""The store's keys, what a stopped write leaves, and its catalog without its rows."""

import pytest
from pyspark.sql import functions as F

from tierwave.operators import store
from tierwave.streaming.windows import upsert

KINDS = "sm string, rg string, seq string, track string, window long, tile long, sum double"


def rows(spark, samples, tiles, add=0.0):
    return spark.createDataFrame([(sm, rg, seq, "a b%+=/é", 100, t, t + add) for sm in samples for rg in (None, "1") for seq in ("7", "X") for t in tiles], KINDS)


def found(df):
    return sorted(((r.sm, r.rg, r.seq, r.track, r.tile, r.sum) for r in df.collect()), key=repr)


ODD = (None, "", "0012", "007", "~0", "~", "~~", "__HIVE_DEFAULT_PARTITION__x")


def test_odd_keys_are_kept(spark, tmp_path):
    path = str(tmp_path / "store")
    store.write(rows(spark, ODD, range(3)), path, "moments")
    store.write(rows(spark, ODD, range(2, 6), 10.0), path, "moments")
    want = rows(spark, ODD, range(2)).unionByName(rows(spark, ODD, range(2, 6), 10.0))
    assert found(store.read(spark, path)) == found(want)
    assert found(store.read(spark, path, sm=[None, "007"], rg=None, seq="7")) == found(want.where("(sm is null or sm = '007') and seq = '7'"))
    assert found(store.read(spark, path, sm="")) == found(want.where("sm = ''"))
    assert found(store.read(spark, path, rg=[None])) == found(want.where("rg is null"))
    listed = store.stored_catalog(spark, path)
    assert sorted(map(repr, (tuple(r[c] for c in store.LEVELS) for r in listed.collect()))) == sorted(map(repr, map(tuple, store.catalog(store.read_table(spark, path)).collect())))
    assert "LocalTableScan" in (plan := listed._jdf.queryExecution().toString()) or "Scan ExistingRDD" in plan
    assert "Scan parquet" not in plan and "FileScan" not in plan


def test_upsert_of_a_stream_keeps_null_keys(spark, tmp_path):
    path, write = str(tmp_path / "t"), upsert(str(tmp_path / "t"), ["kind"], ["kind", "k"])
    frame = lambda x: spark.createDataFrame(x, "kind string, k long, v long")
    write(frame([(None, 1, 1), ("", 1, 2), ("a", None, 3), ("01", 1, 9)]), 0)
    write(frame([(None, 2, 4), ("", 1, 5), ("a", None, 6)]), 1)
    got = sorted(((r.kind, r.k, r.v) for r in store.read_table(spark, path, ["kind"]).collect()), key=repr)
    assert got == sorted([(None, 1, 1), (None, 2, 4), ("", 1, 5), ("a", None, 6), ("01", 1, 9)], key=repr)


def test_equal_keys_in_one_write(spark, tmp_path):
    path = str(tmp_path / "store")
    for _ in range(2):
        store.write(rows(spark, ["a"], [1]).unionByName(rows(spark, ["a"], [1], 5.0)), path, "moments")
    assert {r.sum for r in store.read(spark, path).collect()} == {6.0}


@pytest.mark.parametrize("when", ["before", "between"])
def test_stopped_write_is_finished_or_undone(spark, tmp_path, monkeypatch, when):
    path = str(tmp_path / "store")
    store.write(rows(spark, ["a", None], range(4)), path, "moments")
    before = found(store.read(spark, path))

    def stop(staged, to, *_):
        if when == "between":  # the old partitions are gone, the new ones aren't there yet
            store._delete(spark, f"{to}/feature=moments/sm=~0")
        raise RuntimeError("lost driver")

    with monkeypatch.context() as m:
        m.setattr(store, "_replace", stop)
        with pytest.raises(RuntimeError):
            store.write(rows(spark, [None], [2, 3, 4], 7.0), path, "moments")
    if when == "before":
        assert found(store.read(spark, path)) == before
    store.write(rows(spark, ["b"], [0]), path, "moments")
    want = rows(spark, ["a"], range(4)).unionByName(rows(spark, [None], [0, 1])).unionByName(rows(spark, [None], [2, 3, 4], 7.0)).unionByName(rows(spark, ["b"], [0]))
    assert found(store.read(spark, path)) == found(want)
    assert store.recover(spark, path, store.PARTITIONS) == 0


def test_half_staged_write_is_dropped(spark, tmp_path):
    path = str(tmp_path / "store")
    store.write(rows(spark, ["a"], [0]), path, "moments")
    (tmp_path / "store" / "_staged-x").mkdir()
    assert store.recover(spark, path, store.PARTITIONS) == 0
    assert found(store.read(spark, path)) == found(rows(spark, ["a"], [0]))
    assert not (tmp_path / "store" / "_staged-x").exists()


def test_attributes(spark):
    lengths = spark.createDataFrame([("7", 250)], "seq string, len long")
    base = rows(spark, ["a"], range(3)).withColumn("feature", F.lit("moments"))
    counts = base.where("tile < 2").withColumn("feature", F.lit("spectrum"))
    got = store.attributes(base.unionByName(counts), lengths, 10, [0, 0.5, 1], 8000).where("rg is null").orderBy("seq", "feature").collect()
    assert [(r.seq, r.feature, r.len, r.tiles, r.tile, r.bins, r.bin_count, r.max_depth, r.total_sum, r.window_root) for r in got] == [
        ("7", "moments", 250, 3, True, None, None, 8000, 3.0, 100), ("7", "spectrum", 250, 2, False, [0.0, 0.5, 1.0], 2, 8000, 1.0, 100),
        ("X", "moments", None, 3, None, None, None, 8000, 3.0, 100), ("X", "spectrum", None, 2, None, [0.0, 0.5, 1.0], 2, 8000, 1.0, 100),
    ]
