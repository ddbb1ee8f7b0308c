"""Counts as tall rows and as arrays, all levels, ends; default filters and wavelets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierwave.functions.bins import parse_edges
from tierwave.operators import filters, lod, moments, spectrum, tracks


def test_dense_and_back(spark):
    tall = spark.createDataFrame([("a", 0, 0, 3), ("a", 0, 2, 1), ("a", 5, 1, 4), ("b", 1, 2, 2)], "seq string, tile long, bin int, cnt long")
    dense = spectrum.dense_spectrum(tall, ["seq"], 3)
    assert {(r.seq, r.tile): r.counts for r in dense.collect()} == {("a", 0): [3, 0, 1], ("a", 5): [0, 4, 0], ("b", 1): [0, 0, 2]}
    assert sorted(map(tuple, spectrum.tall_spectrum(dense, ["seq"]).collect())) == sorted(map(tuple, tall.collect()))
    steps = spark.createDataFrame([("a", 0, 0, 1, 3), ("a", 0, 1, 1, 1), ("b", 2, 1, 0, 9)], "seq string, tile long, from_bin int, to_bin int, cnt long")
    square = spectrum.dense_transitions(steps, ["seq"], 2)
    assert {(r.seq, r.tile): r.counts for r in square.collect()} == {("a", 0): [[0, 0], [3, 1]], ("b", 2): [[0, 9], [0, 0]]}
    assert sorted((r.seq, r.tile, r.from_bin, r.to_bin, r.cnt) for r in spectrum.tall_transitions(square, ["seq"]).collect()) == sorted(map(tuple, steps.collect()))
    flat = spectrum.flat_chunks(dense, ["seq"], 4)
    assert {(r.seq, r.chunk): (r.first, r.flat) for r in flat.collect()} == {("a", 0): (0, [3, 0, 1]), ("a", 1): (5, [0, 4, 0]), ("b", 0): (1, [0, 0, 2])}
    one = spark.range(1).select(F.array(*map(F.lit, range(12))).alias("f")).select(spectrum.nth_spectrum(F.col("f"), 1, 4).alias("s"), spectrum.nth_matrix(F.col("f"), 2, 2).alias("m"), spectrum.reshape(F.col("f"), 6).alias("r")).first()
    assert (one.s, one.m, one.r) == ([4, 5, 6, 7], [[8, 9], [10, 11]], [list(range(6)), list(range(6, 12))])


def test_ends_of_counts(spark):
    lengths = spark.createDataFrame([("a", 35), ("b", 30), ("c", 12)], "seq string, len long")
    rows = [("a", 0, 1, 10), ("a", 1, 1, 10), ("a", 2, 2, 4)] + [("b", t, 1, 10) for t in range(3)] + [("c", 0, 0, 2), ("c", 0, 1, 5)]
    got = spectrum.clean_count_ends(spark.createDataFrame(rows, "seq string, tile long, bin int, cnt long"), ["seq"], ["bin"], 10, lengths, 0)
    assert sorted(map(tuple, got.collect())) == sorted([("a", 0, 1, 10), ("a", 1, 1, 10), ("a", 2, 0, 10), ("a", 3, 0, 5), *rows[3:6], ("c", 0, 0, 10), ("c", 1, 0, 2)])


def test_filters_of_tracks():
    assert list(filters.filters_for(["total", "tlen_dis_rd", "right_smap_diff"])) == ["tlen_dis_rd", "right_smap_diff"]
    assert filters.filters_for(["total"]) == {}
    assert filters.filters_for(["total"], "total:db4,0.5,1E9,1e2,0.25;other:poly,1,5,0,1")["total"] == {"type": "db4", "value": 0.5, "width": 1_000_000_000, "over": 100, "mix": 0.25}


@pytest.mark.parametrize("name", ["haar", "db1", "db2", "db4", "db7", "db20"])
def test_wavelets_are_orthogonal_and_give_the_signal_back(name):
    h = filters.scaling_filter(name)
    assert np.isclose(h.sum(), np.sqrt(2)) and np.isclose((h * h).sum(), 1)
    for k in range(2, len(h), 2):
        assert abs((h[k:] * h[:-k]).sum()) < 1e-7
    y = np.random.default_rng(1).random(333) * 9
    for n in (len(h), 100, 333):
        low, detail = filters._split(y[:n], h)
        assert len(low) == (n + len(h) - 1) // 2
        assert np.allclose(filters._join(low, detail, h)[:n], y[:n], atol=1e-6)
    assert np.allclose(filters.wavelet_denoise(y, 1.0, name), y, atol=1e-5)
    assert not np.allclose(filters.wavelet_denoise(y, 0.5, name), y, atol=1e-3)


def test_db4_is_the_published_filter():
    #: The scaling filter of four vanishing moments.
    known = [0.2303778133, 0.7148465706, 0.6308807679, -0.0279837694, -0.1870348117, 0.0308413818, 0.0328830117, -0.0105974018]
    assert np.allclose(filters.scaling_filter("db4"), known, atol=1e-9)


def test_edges_selection_and_moves(spark):
    assert parse_edges("5,1,5,30") == [1.0, 5.0, 30.0]
    assert len(parse_edges(None)) == 26 and parse_edges(None)[-1] == 1.0 and parse_edges(None)[1] == 0.04
    row = spark.createDataFrame([(4.0, 2.0, 3.0, 0.0, 4.0)], "n double, m1 double, m2 double, m3 double, m4 double")
    assert row.select(moments.selected_moments([2, 1]).alias("m")).first().m == [1.0, 2.0]
    assert row.select(moments.selected_moments([]).alias("m")).first().m == []
    at = spark.createDataFrame([(100, 300), (0, 200), (850, 1050)], "s long, e long")
    show = lambda f: [tuple(r) for r in at.select(*f).collect()]
    s, e = F.col("s"), F.col("e")
    assert show(lod.pan(s, e, F.lit(10), F.lit(20), F.lit(1060), True)) == [(120, 320), (20, 220), (850, 1050)]
    assert show(lod.pan(s, e, F.lit(10), F.lit(20), F.lit(1060), False)) == [(80, 280), (0, 200), (830, 1030)]
    assert show(lod.zoom(s, e, True)) == [(120, 280), (20, 180), (870, 1030)]
    assert show(lod.zoom(s, e, False)) == [(80, 320), (0, 200), (830, 1070)]


def test_projected_tracks_end_with_the_sequence(spark):
    reads = spark.createDataFrame([("c1", 10, 10, 20, 0x2, 60, 500, "c1"), ("c2", 10, 10, 20, 0x2, 60, 500, "c2")], "seq string, pos long, rlen int, ref_end long, flag int, mapq int, tlen long, mate_seq string")
    lengths = spark.createDataFrame([("c1", 100)], "seq string, len long")
    assert sorted((r.seq, r.start, r.end) for r in tracks.projected_tracks(reads, ["seq"], lengths).collect()) == [("c1", 10, 100), ("c2", 10, 520)]


@pytest.mark.parametrize(("value", "mix"), [(0.5, 1.0), (0.0, 0.25), (0.9, 1.0)])
def test_wide_fits_equal_those_in_one_task(spark, value, mix):
    r = np.random.default_rng(3)
    rows = []
    for seq, n in (("a", 700), ("b", 350), (None, 90)):
        y = np.where(r.random(n) < 0.2, 0, r.gamma(2, 3, n) + np.sin(np.arange(n) / 40) * 4 + 4)
        y[:7] = y[-5:] = 0
        rows += [(seq, k, float(v)) for k, v in enumerate(y)]
    rows += [("zero", k, 0.0) for k in range(50)] + [("few", k, float(k < 5)) for k in range(50)] + [("minus", k, -1.0) for k in range(30)] + [("flat", k, 2.0) for k in range(40)]
    df = spark.createDataFrame(rows, "seq string, pos long, value double").repartition(5)
    for width in (300, 10_000):
        got = {(x.seq, x.pos): x.value for x in filters.detrend_wide(df, ["seq"], value, width, mix).collect()}
        want = {}
        for seq in {x[0] for x in rows}:
            y = np.array([x[2] for x in rows if x[0] == seq])
            for s in range(0, len(y), width):
                want |= {(seq, s + k): v for k, v in enumerate(filters.poly_detrend(y[s : s + width], value, mix))}
        assert got.keys() == want.keys() and len(got) == len(rows)
        assert max(abs(got[k] - want[k]) for k in got) < 1e-6
    one = filters.filter_signal(df, ["seq"], "poly", value, 1_000_000_000, 0, mix)
    assert "Pandas" not in one._jdf.queryExecution().optimizedPlan().toString().replace("MapInPandas", "") and one.count() == len(rows)
