"""BAM: rows equal those of the same alignments as text, splits, regions by the index, whole files and broken guesses."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierwave.sources import alignments, bam, bgzf

SEQS = [("c1", 900_000), ("c2", 300_000), ("c3", 70)]
HEAD = bam.header_text(SEQS, [("g1", "s1"), ("g2", "s2")])


def lines(n, seed=1):
    """SAM lines: mapped, unmapped, with and without bases, qualities, groups and mates, one very long."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        seq, length = r.choice(SEQS)
        q = r.choice([0, 1, 30, 51]) if k else 150_000
        ops = [f"{r.randint(1, 9)}S", f"{q}M", f"{r.randint(1, 90)}{r.choice('DNI')}", "4="] if q else []
        size = sum(int(o[:-1]) for o in ops if o[-1] in "MSI=")
        bases = "".join(r.choices("ACGTN", k=size)) if ops and r.random() < 0.9 or not k else "*"
        qual = "".join(chr(33 + r.randint(0, 60)) for _ in bases) if bases != "*" and r.random() < 0.9 else "*"
        mate = r.choice(["=", "*", "c1", "c2"])
        where = (seq, r.randint(1, length)) if ops else ("*", 0)
        tags = r.choice(["", "\tRG:Z:g1", "\tNM:i:3\tRG:Z:g2\tXB:B:c,1,-2", "\tXX:Z:RGZnot\tRG:Z:g1"])
        out.append(f"r{k}\t{r.choice([0, 16, 99, 147, 1024])}\t{where[0]}\t{where[1]}\t{r.randint(0, 60)}\t{''.join(ops) or '*'}\t{mate}\t{0 if mate == '*' else r.randint(1, 70)}\t{r.randint(-500, 500)}\t{bases}\t{qual}{tags}")
    return out


COLUMNS = ["name", "flag", "seq", "pos", "mapq", "cigar", "mate_seq", "mate_pos", "tlen", "bases", "qual", "rg", "ref_end", "rlen"]


def shown(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*COLUMNS).collect())))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """The alignments as text, and as a folder of files with small blocks."""
    folder = tmp_path_factory.mktemp("bam")
    (folder / "x.sam").write_text(HEAD + "\n".join(lines(3000)) + "\n")
    sam = alignments.sam_reads(alignments.sam_lines(spark, str(folder / "x.sam"))).drop("sm")
    bam.write_bam(sam, str(folder / "x.bam"), HEAD, 3)
    return sam, str(folder / "x.bam")


def test_rows_equal_those_of_text(spark, made):
    sam, path = made
    assert len(bgzf.list_files(path, ".bam")) == 3
    assert shown(bam.bam(spark, path)) == shown(sam)
    assert [r.seq for r in alignments.sequence_dictionary(bam.header_lines(spark, path)).collect()] == ["c1", "c2", "c3"]


def one_file(path, k=0):
    return bgzf.list_files(path, ".bam")[k]


@pytest.mark.parametrize("split", [3_000, 20_000, 1 << 30])
@pytest.mark.parametrize("indexed", [True, False])
def test_splits_give_every_record_once(spark, made, tmp_path, split, indexed):
    _, path = made
    for k, f in enumerate(bgzf.list_files(path, ".bam")):
        (tmp_path / f"{k}.bam").write_bytes(open(f, "rb").read())
        if indexed:
            (tmp_path / f"{k}.bam.bai").write_bytes(open(f + ".bai", "rb").read())
    got = bam.bam(spark, str(tmp_path), split)
    assert split > 1 << 20 or len(bam.BamReader(str(tmp_path), split).partitions()) > 3
    assert shown(got) == shown(made[0])


@pytest.mark.parametrize("where", ["seq = 'c2' and pos < 60000 and ref_end > 50000", "seq = 'c1' and pos >= 880000", "seq in ('c3', 'c2') and pos <= 10", "seq = '*'", "seq = 'none'", "pos < 1000 and ref_end >= 900"])
def test_region_filters(spark, made, where):
    sam, path = made
    assert shown(bam.bam(spark, path, 4_000).where(where)) == shown(sam.where(where))


def test_region_opens_only_its_blocks(spark, made, tmp_path):
    """Everything outside the chunks that the index names is destroyed; the region still reads."""
    sam, path = made
    where = "seq = 'c1' and pos < 420000 and ref_end > 400000"
    source = next(f for f in bgzf.list_files(path, ".bam") if "c1" in {s for s in [x for x in bam.header(f).names]} and bam.chunks_of(bam.index(f)[0], 400_000, 420_000))
    reader = bam.BamReader(source, bam.SPLIT)
    reader.seqs, reader.low, reader.high = {"c1"}, 400_000, 420_000
    splits = reader.partitions()
    raw = open(source, "rb").read()
    keep = bytearray(len(raw))
    for a, z in [(0, bam.header(source).first >> 16), *((s.start >> 16, (s.end >> 16) + bgzf.block_length(raw, s.end >> 16)) for s in splits)]:
        keep[a:z] = raw[a:z]
    assert 0 < sum(map(bool, keep)) < len(raw) * 0.9
    (tmp_path / "y.bam").write_bytes(keep)
    (tmp_path / "y.bam.bai").write_bytes(open(source + ".bai", "rb").read())
    want = bam.bam(spark, source).where(where)
    assert shown(bam.bam(spark, str(tmp_path / "y.bam")).where(where)) == shown(want)
    assert want.count() > 0


def test_wrong_guess_is_an_error(spark, made, monkeypatch):
    f = one_file(made[1])
    head = bam.header(f)
    second = bgzf.first_record(f, 40_000, np.array(head.lengths))
    with pytest.raises(ValueError, match="record"):
        list(bam.records(f, head.first, second + 1, head, checked=True))


def test_long_cigar_and_empty_table(spark, tmp_path):
    cigar = [{"op": 0, "len": 1}, {"op": 2, "len": 1}] * 40_000
    row = {"name": "long", "flag": 0, "seq": "c1", "pos": 5, "mapq": 9, "cigar": cigar, "mate_seq": "*", "mate_pos": -1, "tlen": 0, "bases": "A" * 40_000, "qual": "*", "rg": None}
    raw = bam.encode(row, {"c1": 0})
    size = struct.unpack_from("<i", raw)[0]
    got = bam.decode(np.frombuffer(raw[4:], np.uint8), np.array([0]), np.array([size]), bam.Header("", ["c1"], [900_000], 0)).to_pylist()[0]
    assert got["cigar"] == cigar and got["ref_end"] == 80_005 and got["bases"] == row["bases"] and got["qual"] == "*"
    empty = spark.createDataFrame([], bam.READ)
    bam.write_bam(empty, str(tmp_path / "e.bam"), HEAD, 1)
    assert bam.bam(spark, str(tmp_path / "e.bam")).count() == 0


def test_tracks_from_bam(spark, made):
    from tierwave.operators import tracks

    sam, path = made
    keys, got = ["seq"], [tracks.interval_tracks(x.withColumn("mate_seq", F.col("mate_seq")), ["seq"], ["total", "mapq"]).orderBy("seq", "start").collect() for x in (sam, bam.bam(spark, path))]
    assert got[0] == got[1] and keys


def test_bases_are_packed_without_a_step_a_base():
    import time

    row = {"seq": "c", "mate_seq": "*", "cigar": None, "rg": None, "qual": "!~" * 500_000, "name": "r", "pos": 5, "mate_pos": None, "tlen": 0, "flag": 0, "mapq": 0, "bases": "=acmgrsvtwyhkdbn?xé" * 52_631 + "ACG" * 3 + "GT"}
    row["bases"] = row["bases"][:999_999] + "T"
    start = time.thread_time()
    record = bam.encode(row, {"c": 0})
    assert time.thread_time() - start < 0.1
    at = 4 + 32 + 2
    packed = np.frombuffer(record[at : at + 500_000], np.uint8)
    want = [bam.LETTERS.find(c) if c in bam.LETTERS else 15 for c in row["bases"].upper()[:2000]]
    assert np.stack([packed >> 4, packed & 15], 1).ravel()[:2000].tolist() == want
    assert record[at + 500_000 : at + 500_004] == bytes([0, 93, 0, 93])
    assert bam.encode(row | {"bases": "ACG", "qual": "*"}, {"c": 0})[at : at + 5] == bytes([0x12, 0x40, 255, 255, 255])


def test_columns_make_the_records_that_rows_make(spark, made):
    """A batch's records equal those made one by one; also of letters outside ASCII, long CIGARs, nulls, and qualities of another length."""
    import pyarrow as pa

    rows = [r.asDict(recursive=True) for r in made[0].limit(500).collect()]
    none = dict.fromkeys(rows[0])
    plain = none | {"name": "p", "seq": "c2", "pos": 7, "mate_seq": "=", "bases": "acgtn", "qual": "!#~AB", "rg": ""}
    long = [{"op": 0, "len": 1}, {"op": 2, "len": 1}] * 40_000
    rows += [none, plain, plain | {"bases": "aéT", "qual": "*"}, plain | {"bases": "ACG", "qual": "\u00a1AB"}, plain | {"cigar": long}, plain | {"qual": ""}, plain | {"name": "", "mate_seq": "c1", "rg": "é"}, plain | {"seq": "other", "mapq": 255, "flag": 65535}]
    names, kinds = [s for s, _ in SEQS], spark.createDataFrame([], bam.READ).toArrow().schema
    for part in (rows, rows[::-1], rows[:1], []):
        batch = pa.RecordBatch.from_pylist(part, kinds)
        raw, sizes, ref, start, end = bam.encode_batch(batch, names)
        want = [bam.encode(r, {n: k for k, n in enumerate(names)}) for r in part]
        assert raw == b"".join(want) and sizes.tolist() == [len(w) for w in want]
        covers = [sum(c["len"] for c in r["cigar"] or () if c["op"] in bam.MOVES) for r in part]
        assert [(k, a, z) for k, a, z in zip(ref.tolist(), start.tolist(), end.tolist()) if k >= 0] == [(names.index(r["seq"]), r["pos"], r["pos"] + max(c, 1)) for r, c in zip(part, covers) if r["seq"] in names and r["pos"] is not None and r["pos"] >= 0]
    with pytest.raises(ValueError, match="qualities"):
        bam.encode_batch(pa.RecordBatch.from_pylist([plain, plain | {"qual": "! AB~"}], kinds), names)


def test_groups_among_other_tags():
    """The group's tag first, later, missing, empty, or with its letters in another tag."""
    tags = [b"RGZg1\0", b"NMC\5RGZg2\0", b"", b"XXZRGZ\0", b"RGZ\0NMC\0", b"XBBc\2\0\0\0RGRGZg3\0", b"RGZ\xc3\xa9\0XAAq"]
    raw, at, ends = b"", [], []
    for tag in tags:
        at.append(len(raw := raw + b"\0Q\0RGZ"))
        ends.append(len(raw := raw + tag))
    got = bam._groups(np.frombuffer(raw + b"\0", np.uint8), np.array(at), np.array(ends))
    assert got.to_pylist() == ["g1", "g2", None, None, "", "g3", "é"]


def test_the_index_is_that_of_each_record(made):
    """Chunks and windows as they follow from each record's own place, over several batches."""
    for f in bgzf.list_files(made[1], ".bam"):
        head, found = bam.header(f), bam.index(f)
        blocks, at, seen = bgzf.Blocks(f, head.first >> 16), head.first & 0xFFFF, []
        while blocks.has(at, 4):
            (size,) = struct.unpack("<i", blocks.get(at, 4))
            assert blocks.has(at + 4, size)
            seen.append((blocks.virtual(at), bam.decode(np.frombuffer(blocks.get(at + 4, size), np.uint8), np.array([0]), np.array([size]), head).to_pylist()[0]))
            at += 4 + size
        after = [v for v, _ in seen[1:]] + [blocks.size - len(bgzf.END) << 16]
        bins, windows = [{} for _ in SEQS], [{} for _ in SEQS]
        for (v, r), z in zip(seen, after, strict=True):
            if r["seq"] == "*" or r["pos"] < 0:
                continue
            k, end = head.names.index(r["seq"]), max(r["ref_end"] or 0, r["pos"] + 1)
            chunks = bins[k].setdefault(bam.bin_of(r["pos"], end), [])
            if chunks and chunks[-1][1] == v:
                chunks[-1] = chunks[-1][0], z
            else:
                chunks.append((v, z))
            for w in range(r["pos"] // bam.WINDOW, (end - 1) // bam.WINDOW + 1):
                windows[k].setdefault(w, v)
        assert seen and [b for b, _ in found] == bins
        assert [{w: v for w, v in enumerate(ws) if w in ours} for (_, ws), ours in zip(found, windows)] == windows


def test_only_places_are_made_for_the_ranges(spark, tmp_path):
    """Bases are made once a read: the ranges' bounds need sequences and positions only."""
    made = spark.sparkContext.accumulator(0)

    def bases(n):
        made.add(1)
        return "A" * n

    rows = spark.range(60).select(F.col("id").cast("string").alias("name"), F.lit("c1").alias("seq"), (F.col("id") % 30).alias("pos"), F.udf(bases, "string")((F.col("id") % 3 + 1).cast("int")).alias("bases"))
    bam.write_bam(rows, str(tmp_path / "r.bam"), HEAD, 5)
    assert made.value == 60
    files = bgzf.list_files(str(tmp_path / "r.bam"), ".bam")
    each = [[(r["seq"], r["pos"]) for b in bam.records(f, bam.header(f).first, None, bam.header(f)) for r in b.to_pylist()] for f in files]
    assert len(files) == 5 and sum(map(len, each)) == 60 and max(map(len, each)) <= 14
    assert [x for e in each for x in e] == sorted(x for e in each for x in e)


def test_files_have_bounded_reads(spark, made, tmp_path, monkeypatch):
    """More reads make more files than shuffle partitions, so that what a task sorts stays bounded."""
    monkeypatch.setattr(bam, "FILE", 200)
    bam.write_bam(made[0], str(tmp_path / "f.bam"), HEAD)
    files = bgzf.list_files(str(tmp_path / "f.bam"), ".bam")
    placed = [sum(b.num_rows for b in bam.records(f, bam.header(f).first, None, bam.header(f))) for f in files[:-1]]  # those without a place stay together
    assert len(files) > 8 and max(placed) <= 300
    assert shown(bam.bam(spark, str(tmp_path / "f.bam"))) == shown(made[0])


def test_tasks_decode_by_columns():
    """A record costs some microseconds to make and to read, not a hundred (a row at a time took over 25 each)."""
    import time

    import pyarrow as pa

    n = 20_000
    one = {"name": "a/read", "flag": 0, "seq": "c1", "pos": 5, "mapq": 9, "cigar": [{"op": 4, "len": 10}, {"op": 0, "len": 30}, {"op": 2, "len": 4}], "mate_seq": "=", "mate_pos": 5, "tlen": 0, "bases": "ACGT" * 10, "qual": "*", "rg": "rg1", "ref_end": 39, "rlen": 40}
    batch = pa.RecordBatch.from_pylist([one] * n)
    bam.encode_batch(batch, ["c1"])
    start = time.thread_time()
    raw, sizes, *_ = bam.encode_batch(batch, ["c1"])
    took = time.thread_time() - start
    assert took / n < 10e-6, took
    at = np.cumsum(sizes) - sizes
    start = time.thread_time()
    got = bam.decode(np.frombuffer(raw, np.uint8), at + 4, sizes - 4, bam.Header("", ["c1"], [900_000], 0))
    took = time.thread_time() - start
    assert took / n < 15e-6, took
    assert got.num_rows == n and got.slice(n - 1).to_pylist() == [one | {"mate_seq": "c1"}]
