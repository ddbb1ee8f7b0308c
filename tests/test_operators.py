import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierwave.functions import text
from tierwave.functions.bins import bin_index, default_edges
from tierwave.sources.fasta import sliced
from tierwave.operators import compare, filters, intervals, lod, moments, ordered, raster, sliding, spectrum, store, tracks
from tierwave.sources import alignments
from tierwave.streaming import windows


def signal(spark, values, seq="s"):
    return spark.createDataFrame([("a", "all", seq, "t", i, float(v)) for i, v in enumerate(values)], "sm string, rg string, seq string, track string, pos long, value double")


KEYS = ("sm", "rg", "seq", "track")


def exact(x, n=None):
    x = np.array(x, float)
    n = n or len(x)
    m = x.sum() / n
    d = np.concatenate([x - m, np.full(n - len(x), -m)])
    low, high = (min(x.min(), 0), max(x.max(), 0)) if n > len(x) else (x.min(), x.max())
    return [n, x.sum(), low, high, m, (d**2).sum(), (d**3).sum(), (d**4).sum()]


def close(row, want):
    return all(math.isclose(row[f], w, rel_tol=1e-9, abs_tol=1e-6 * max(1, abs(want[5]) ** 2)) for f, w in zip(moments.FIELDS, want, strict=True))


@pytest.mark.parametrize("n", [9, 10, 11, 99, 100, 101, 250])
def test_tiles_pyramid_and_direct_agree(spark, n):
    rng = random.Random(n)
    v = [rng.choice([0, 0, -3.5, 7, 1000 * rng.random()]) for _ in range(n)]
    length = spark.createDataFrame([("s", n)], "seq string, len long")
    base = moments.tile_moments(signal(spark, v), KEYS, 10, length)
    for r in moments.pyramid(base, KEYS, 10, 10, n).collect():
        w = r["window"]
        assert close(r, exact(v[r.tile * w : (r.tile + 1) * w]))
    (whole,) = moments.merge(base, ["seq"]).collect()
    assert close(whole, exact(v))
    for r in moments.merge_overlapping(base, KEYS, 3).collect():
        assert close(r, exact(v[r.tile * 10 : r.tile * 10 + 30]))


def test_sparse_signal_has_zeros(spark):
    rows = signal(spark, [5, 6, 7, 8]).where("pos in (1, 3)")
    length = spark.createDataFrame([("s", 4)], "seq string, len long")
    (r,) = moments.tile_moments(rows, KEYS, 10, length).collect()
    assert close(r, exact([6, 8], 4))
    runs = spark.createDataFrame([("s", 1, 3, 2.0), ("s", 12, 25, 3.0)], "seq string, start long, end long, value double")
    length = spark.createDataFrame([("s", 27)], "seq string, len long")
    for r in moments.run_moments(runs, ["seq"], 10, length).collect():
        dense = [2.0 if 1 <= p < 3 else 3.0 if 12 <= p < 25 else 0.0 for p in range(27)]
        assert close(r, exact(dense[r.tile * 10 : r.tile * 10 + 10]))


def test_standardized_edges(spark):
    rows = moments.tile_moments(signal(spark, [4, 4, 4, 1]), KEYS, 3).orderBy("tile").select(*moments.standardized()).collect()
    assert [tuple(r) for r in rows] == [(4, 0, 0, -3), (1, 0, 0, -3)]


@pytest.mark.parametrize("block", [7, 64, 1 << 16])
def test_sliding_over_blocks(spark, block):
    rng = random.Random(3)
    v = [rng.choice([0, 5, 100 * rng.random()]) for _ in range(150)]
    got = sliding.sliding_moments(signal(spark, v), KEYS, 8, block).collect()
    assert sorted(r.pos for r in got) == list(range(143))
    assert all(close(r, exact(v[r.pos : r.pos + 8])) for r in got)


def test_spectrum_and_transitions(spark):
    rng = random.Random(8)
    v = [rng.choice([-1, 0, 0.5, 1, 1.5, 2, 9]) for _ in range(95)]
    edges = [0, 1, 2, 5]
    place = lambda x: next((j for j in range(3) if edges[j] <= x < edges[j + 1]), None)
    b = [place(x) for x in v]
    got = {(r.tile, r.bin): r.cnt for r in spectrum.tile_spectrum(signal(spark, v), KEYS, 10, edges).collect()}
    want = {}
    for i, x in enumerate(b):
        if x is not None:
            want[i // 10, x] = want.get((i // 10, x), 0) + 1
    assert got == want
    for within in (False, True):
        want = {}
        for i in range(94):
            if b[i] is not None and b[i + 1] is not None and not (within and i % 10 == 9):
                k = (i // 10, b[i], b[i + 1])
                want[k] = want.get(k, 0) + 1
        got = {(r.tile, r.from_bin, r.to_bin): r.cnt for r in spectrum.tile_transitions(signal(spark, v), KEYS, 10, edges, within).collect()}
        assert got == want
    rows = signal(spark, v).select(*KEYS, "pos", bin_index("value", edges).alias("bin")).where("bin is not null")
    got = {(r.pos, r.bin): r.cnt for r in spectrum.sliding_counts(rows, KEYS, ["bin"], 10, 95).collect()}
    want = {(i, j): b[i : i + 10].count(j) for i in range(86) for j in range(3) if b[i : i + 10].count(j)}
    assert got == want


@pytest.mark.parametrize("block", [5, 1 << 16])
def test_coverage_and_running_sums(spark, block):
    rng = random.Random(6)
    reads = [(rng.randrange(80), rng.randrange(0, 12)) for _ in range(60)]
    df = spark.createDataFrame([("s", a, a + n, 1) for a, n in reads], "seq string, start long, end long, n long")
    want = {p: sum(a <= p < a + n for a, n in reads) for p in range(100)}
    runs = raster.coverage_runs(df, ["seq"], ["n"], block)
    got = {r.pos: r.n for r in raster.positions(runs, ["seq"], ["n"]).collect()}
    assert got == {p: c for p, c in want.items() if c}
    sums = ordered.running_sums(signal(spark, range(40)), KEYS, ["value"], block).collect()
    assert {r.pos: r.value for r in sums} == {i: i * (i + 1) / 2 for i in range(40)}


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_interval_sets(spark, block):
    rng = random.Random(9)
    cases = [([(0, 3), (5, 9)], [(4, 4)]), ([(0, 3)], [(0, 3)]), ([(0, 9)], [(2, 4)]), ([(2, 4)], [(0, 9)]), ([(0, 5)], [(3, 8)]), ([(3, 8)], [(0, 5)]), ([], [(1, 2), (3, 4)]), ([(1, 1)], [(9, 9)])]
    for _ in range(6):
        cases.append(tuple([(s, s + rng.randrange(6)) for s in (rng.randrange(50) for _ in range(8))] for _ in range(2)))
    rows = [(str(k), side, a, b) for k, sides in enumerate(cases) for side, some in zip("ab", sides, strict=True) for a, b in some]
    df = spark.createDataFrame(rows, "seq string, side string, start long, end long")
    for name, of in (("intersection", set.__and__), ("union", set.__or__), ("only_a", set.__sub__), ("only_b", lambda x, y: y - x)):
        got = {}
        for r in intervals.combine(df, ["seq"], name, block).collect():
            got.setdefault(r.seq, []).append((r.start, r.end))
        for k, (a, b) in enumerate(cases):
            points = of(*({x for s, e in some for x in range(s, e + 1)} for some in (a, b)))
            want = []
            for x in sorted(points):
                if want and want[-1][1] == x - 1:
                    want[-1] = (want[-1][0], x)
                else:
                    want.append((x, x))
            assert sorted(got.get(str(k), [])) == want


def test_overlap_join_has_each_pair_once(spark):
    rng = random.Random(2)
    a, b = ([(i, rng.choice("xy"), s, s + rng.randrange(40)) for i, s in enumerate(rng.choices(range(200), k=40))] for _ in range(2))
    df = [spark.createDataFrame(x, "id long, seq string, start long, end long") for x in (a, b)]
    got = sorted((r.id, r.r_id) for r in intervals.overlap_join(*df, "seq", 16).collect())
    assert got == sorted((i, j) for i, s, x, y in a for j, t, u, v in b if s == t and max(x, u) < min(y, v) and x < y and u < v)


SAM = """@HD\tVN:1.6
@SQ\tSN:c1\tLN:1000
@SQ\tSN:c2\tLN:2000
@RG\tID:g1\tSM:one
@RG\tID:g2\tSM:one
r1\t3\tc1\t101\t60\t100M\t=\t301\t300\t{b}\t*\tRG:Z:g1
r2\t1\tc1\t101\t60\t20S80M\tc2\t1\t0\t{b}\t*\tRG:Z:g2
r3\t1\tc1\t101\t60\t80M20S\t=\t1\t0\t{b}\t*
r4\t1024\tc1\t101\t60\t100M\t=\t1\t0\t{b}\t*
r5\t512\tc1\t101\t60\t100M\t=\t1\t0\t{b}\t*
r6\t0\tc1\t101\t60\t10S90M\t=\t1\t0\t{b}\t*
r7\t0\tc1\t101\t60\t40M5I55M\t=\t1\t0\t{b}\t*
r8\t0\tc1\t101\t60\t40M50D60M\t=\t1\t0\t{b}\t*
r9\t0\tc1\t101\t60\t50M200N50M\t=\t1\t0\t{b}\t*
r10\t0\tc1\t101\t60\t50=1X49=\t=\t1\t0\t{b}\t*
r11\t4\t*\t0\t0\t*\t*\t0\t0\t{b}\t*
""".format(b="AC" * 50)  # fmt: skip


def test_alignment_text(spark, tmp_path):
    (tmp_path / "x.sam").write_text(SAM)
    lines = alignments.sam_lines(spark, str(tmp_path / "x.sam"))
    assert [tuple(r) for r in alignments.sequence_dictionary(lines).collect()] == [("c2", 2000), ("c1", 1000)]
    groups = alignments.read_groups(lines)
    assert [tuple(r) for r in alignments.groups_of_samples(groups).collect()] == [("one", ["g1", "g2"])]
    reads = alignments.sam_reads(lines, groups)
    assert reads.count() == 11 and tracks.admitted(reads).count() == 8 and reads.where("rg is null").count() == 9
    got = sorted((r.track, r.start, r.end) for r in tracks.cigar_segments(reads, ["seq"]).collect())
    assert got == sorted([
        ("clipped", 100, 120), ("left_clipped", 100, 120), ("clipped", 180, 200), ("right_clipped", 180, 200), ("insertion", 139, 140), ("deletion", 140, 190), ("big_del", 140, 190),
        ("splice", 150, 350), ("substitution", 150, 151),
    ])
    runs = tracks.interval_tracks(reads, ["seq"], ["total", "proper_pair"])
    assert {(r.start, r.end, r.total, r.proper_pair) for r in runs.collect()} == {(100, 200, 8, 1)}
    (tmp_path / "r.fa").write_text(">c1 first\n" + "N" * 100 + "\n" + "AC" * 25 + "\n" + "CC" * 25 + "\nAC\n>c2\nAA\n")
    fasta = alignments.fasta(spark, str(tmp_path / "r.fa"))
    assert {(r.seq, len(r.bases)) for r in fasta.collect()} == {("c1", 202), ("c2", 2)}
    one = reads.where("tlen = 300")
    assert sorted(r.pos for r in tracks.exact_substitutions(one, sliced(fasta, 16), ["seq"], 16).collect()) == list(range(150, 200, 2))


def test_tables_of_cohorts(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("s1\tpop\tr1;l;ILLUMINA;3.5,r2;l;ILLUMINA;1\n")
    assert {tuple(r) for r in alignments.cohort(spark, str(tmp_path / "c.tsv")).collect()} == {("s1", "pop", "r1", "l", "ILLUMINA", 3.5), ("s1", "pop", "r2", "l", "ILLUMINA", 1.0)}
    head = [f"c{i}" for i in range(15)]
    (tmp_path / "x.bas").write_text("\t".join(head) + "\n" + "\t".join(["a", "b", "c", "S", "P", "L", "R", "x", "6000000000", *"abcde", "40"]) + "\n")
    (r,) = alignments.run_statistics(spark, str(tmp_path / "x.bas")).collect()
    assert r["sample"] == "S" and r["rgs"][0].coverage == 2.0 and r["rgs"][0].mapq == "40"
    (tmp_path / "g.json").write_text('{"g": [["c1", 5, 9], ["c2", 1, 2]], "h": [["c1", 0, 1]]}')
    genes = alignments.genes_json(spark, str(tmp_path / "g.json"))
    names = spark.createDataFrame([("g",), ("none",)], "gene string")
    assert [tuple(r) for r in lod.lookup(names, genes).collect()] == [("g", 0, "c1", 5, 9)]
    fq = alignments.to_fastq(spark.createDataFrame([("g", "n", "AC", "II")], "rg string, name string, bases string, qual string")).collect()
    assert fq[0].value == "@n\nAC\n+\nII"


def test_store_round_trip(spark, tmp_path):
    rng = random.Random(1)
    v = [rng.random() for _ in range(100)]
    length = spark.createDataFrame([("s", 100)], "seq string, len long")
    levels = moments.pyramid(moments.tile_moments(signal(spark, v), KEYS, 10, length), KEYS, 10, 10, 100)
    path = str(tmp_path / "store")
    store.write(levels, path, "moments")
    store.write(levels.where("window = 100"), path, "moments")
    assert store.read(spark, path, sm="all", seq=["s"], window=10, start=25, end=60).select("tile").distinct().count() == 4
    assert store.read(spark, path).count() == 11
    # Another sample, and tiles of a stored slice: nothing else changes.
    more = levels.where("tile in (3, 4)").withColumn("sum", F.lit(-1.0))
    store.write(levels.withColumn("sm", F.lit("b")), path, "moments")
    store.write(more.where("window = 10").unionByName(levels.where("window = 10").limit(1).withColumn("tile", F.lit(77).cast("bigint"))), path, "moments")
    got = store.read(spark, path)
    assert got.count() == 23 and got.where("sm = 'b'").count() == 11 and sorted(r.tile for r in got.where("sum = -1").collect()) == [3, 4] and got.where("tile = 77").count() == 1
    assert sorted(r.tile for r in store.read(spark, path, sm="b", window=10, start=30, end=50).collect()) == [3, 4]
    described = store.attributes(got.withColumn("feature", F.lit("moments")), length, 10)
    store.write_attributes(described.where("sm = 'a'"), path + "-catalog")
    store.write_attributes(described, path + "-catalog")
    every = store.catalogs(spark, {"x": path + "-catalog", "y": path + "-catalog"})
    assert every.count() == 8 and every.select("window_root", "len", "window_branch").distinct().collect() == [(100, 100, 10)]
    assert sorted(map(tuple, store.store_of(every).collect())) == [("a", "x"), ("b", "x")]
    cat = store.catalog(store.read_table(spark, path))
    (w,) = store.windows_by_sequence(cat).collect()
    assert w["windows"] == [10, 100] and w.uniform
    assert store.base_window(cat).first()["window"] == 10
    assert store.rename_sample(levels, "z").select("sm").distinct().first()[0] == "z"
    assert store.to_json(levels).where("json like '{\"sm\":\"a\"%'").count() == 11


def test_level_of_detail(spark):
    levels = spark.createDataFrame([("s", w) for w in (100, 1000, 10000)], "seq string, window long")
    ranges = spark.createDataFrame([(1, "s", 0, 1000), (2, "s", 0, 9000), (3, "s", 0, 10**7)], "range_id long, seq string, start long, end long")
    assert {r.range_id: r["window"] for r in lod.choose_window(ranges, levels, 10).collect()} == {1: 100, 2: 1000, 3: 10000}
    got = spark.createDataFrame([("c:5-9",), ("name",)], "t string").select(*lod.parse_range(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("c", 5, 9), ("name", None, None)]


def test_compare(spark):
    a, b = signal(spark, [1, 2, 3, 0]), signal(spark, [0, 5, 3]).where("pos < 3")
    assert sorted((r.pos, r.value) for r in compare.differential(a, b, KEYS).collect()) == [(0, 1), (1, -3), (2, 0), (3, 0)]
    assert sorted((r.pos, round(r.value, 3)) for r in compare.differential(a, b, KEYS, True, 2.0).collect()) == [(0, 0), (1, 0), (2, 0), (3, 0)]
    scaled = compare.min_max(signal(spark, [2, 4, 3]), ["seq"], ["value"]).collect()
    assert sorted(r.value for r in scaled) == [0, 0.5, 1]
    assert [r.value for r in compare.min_max(signal(spark, [7]), ["seq"], ["value"]).collect()] == [0]


def test_filters(spark):
    rng = np.random.default_rng(5)
    y = np.concatenate([np.zeros(10), 50 + np.arange(200) * 0.3 + rng.normal(0, 5, 200), np.zeros(14)])
    flat = filters.poly_detrend(y, 0.5)
    assert np.all(flat[:10] == 0) and math.isclose(flat[10:210].max(), y[10:210].max()) and abs(np.polyfit(np.arange(200), flat[10:210], 1)[0]) < abs(np.polyfit(np.arange(200), y[10:210], 1)[0])
    assert np.allclose(filters.haar_denoise(y, 1.0), y) and np.abs(np.diff(filters.haar_denoise(y, 0.0))).sum() < np.abs(np.diff(y)).sum()
    got = filters.filter_signal(signal(spark, y), KEYS, "haar", 1.0, 64, 16).collect()
    assert len(got) == len(y) and all(math.isclose(r.value, y[r.pos], abs_tol=1e-9) for r in got)
    assert filters.parse_spec("t:poly,0.5,100,10,0.1;") == {"t": {"type": "poly", "value": 0.5, "width": 100, "over": 10, "mix": 0.1}}
    with pytest.raises(ValueError):
        filters.parse_spec("t:poly,1")


def test_texts(spark):
    df = spark.createDataFrame([("AC", "CA"), ("", "abc"), ("same", "same"), (None, "x")], "a string, b string")
    got = df.select(text.edit_distance("a", "b").alias("u"), text.weighted_edit_distance(0, 1, 1, 1)("a", "b").alias("w"), text.weighted_edit_distance(0, 2, 3, 1)("a", "b").alias("x")).collect()
    assert [r.u for r in got] == [2, 3, 0, None] and [r.x for r in got][:3] == [2.0, 6.0, 0.0]
    assert [None if r.w is None or r.w != r.w else r.w for r in got] == [2.0, 3.0, 0.0, None]
    log = spark.createDataFrame([("stage=2\tstatus=1\tdatetime=2020/01/02[03:04:05]",), ("stage=3\tstatus=-1\tdatetime=2020/01/02[03:04:06]",)], "value string")
    parsed = text.parse_log(log)
    assert parsed.first().at == datetime(2020, 1, 2, 3, 4, 5) and text.last_good_stage(parsed).first().stage == 2
    assert default_edges(500)[:3] == [0, 50, 100] and len(default_edges(500)) == 12


def test_streams(spark, tmp_path):
    schema = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("value", T.DoubleType())])
    rows = [(datetime(2024, 1, 1, h, m), float(h * 60 + m)) for h in range(3) for m in range(0, 60, 7)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df in (("m", windows.stream_moments(source(), "1 hour", "10 minutes", center=60.0)), ("h", windows.stream_spectrum(source(), "1 hour", "10 minutes", [0.0, 60.0, 1000.0]))):
        q = df.writeStream.outputMode("complete").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    for r in spark.table("m").collect():
        assert close(r, exact([v for t, v in rows if t.hour == r.start.hour]))
    assert {(r.start.hour, r.bin): r.cnt for r in spark.table("h").collect()} == {(0, 0): 9, (1, 1): 9, (2, 1): 9}


def test_upsert_keeps_what_it_does_not_replace(spark, tmp_path):
    write = windows.upsert(str(tmp_path / "t"), ["day"], ["day", "k"])
    make = lambda rows: spark.createDataFrame(rows, "day int, k int, v int")
    for i, rows in enumerate(([(1, 1, 1), (1, 2, 1)], [(1, 2, 2), (2, 1, 2)], [(2, 3, 3)])):
        write(make(rows), i)
    assert sorted((r.day, r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 3, 3)]


def reads_of_one_day(spark, folder, n):
    """A table of line items: n reads of sample s0 and one of s1 at the same place."""
    item = spark.range(n + 1).selectExpr("id as l_orderkey", "1L as l_partkey", f"if(id < {n}, 4L, 1L) as l_suppkey", "1 as l_linenumber", "5.0D as l_quantity", "0.01D as l_discount", "0.08D as l_tax", "'N' as l_returnflag", "'O' as l_linestatus", "timestamp'1996-01-01' as l_shipdate")
    item.write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_fold_of_deep_coverage_is_not_cut(spark, tmp_path):
    from tierwave.jobs.queries import QUERIES

    got = QUERIES["diff_fold"](spark, reads_of_one_day(spark, tmp_path, 12_000)).collect()
    assert {r.value for r in got} == {11_999.0} and len(got) == 5


def test_groups_and_lengths_are_sent_not_shuffled(spark):
    lines = spark.createDataFrame([(f"r{k}\t0\tc1\t5\t9\t3M\t=\t5\t0\tAAA\t*\tRG:Z:g{k % 2}",) for k in range(9)] + [("x\t0\tc1\t5\t9\t3M\t=\t5\t0\tAAA\t*",)], "value string")
    groups = spark.createDataFrame([("g0", "a"), ("g1", "b")], "rg string, sm string")
    found = alignments.sam_reads(lines, groups)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.name, r.sm) for r in found.collect()) == [*((f"r{k}", "ab"[k % 2]) for k in range(9)), ("x", None)]


def test_intervals_are_made_once_for_both_events(spark):
    seen = spark.sparkContext.accumulator(0)

    def mark(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([("c", k, k + 3, 1) for k in range(50)], "seq string, start long, end long, n long").mapInArrow(mark, "seq string, start long, end long, n long")
    assert raster.coverage_runs(df, ["seq"], ["n"], 16).count() == 52
    assert seen.value == 50


def test_aligned_spans_are_neither_shuffled_nor_sorted(spark, monkeypatch):
    """Against a plain walk, with batches cut between reads; keys may be null."""
    rng, rows = random.Random(3), []
    for k in range(60):
        cigar = [(rng.choice([0, 0, 1, 2, 3, 4, 7, 8]), rng.randint(1, 6)) for _ in range(rng.randint(0, 9))]
        size = sum(n for op, n in cigar if op in (0, 1, 4, 7, 8))
        rows.append((rng.choice(["c1", None]), k, k + 9, 0, cigar, "".join(rng.choice("acgt") for _ in range(size))))
    monkeypatch.setattr(tracks, "WALK_OPS", 7)
    df = spark.createDataFrame(rows, "seq string, pos long, ref_end long, flag int, cigar array<struct<op:int,len:int>>, bases string").repartition(1)
    want = []
    for seq, at, _, _, cigar, bases in rows:
        read = 0
        for op, n in cigar:
            if op in (0, 7, 8):
                want.append((seq, at, bases[read : read + n].upper()))
            at, read = at + n * (op in (0, 2, 3, 7, 8)), read + n * (op in (0, 1, 4, 7, 8))
    found = tracks.aligned_spans(df, ["seq"])
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
