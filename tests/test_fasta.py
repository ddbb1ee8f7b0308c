"""Slices of reference sequences, whatever the ranges of bytes they are read by."""

import random

import pytest

from tierwave.sources import alignments, fasta


def write(folder, records, seed=3, line=None):
    """A file with lines of random lengths, blank lines and both line ends; returns the sequences."""
    r = random.Random(seed)
    text = ""
    for name, bases in records:
        text += f">{name} some > words\n"
        at = 0
        while at < len(bases):
            n = line or r.randint(1, 70)
            text += bases[at : at + n] + r.choice(["\n", "\r\n", "\n\n"])
            at += n
    (folder / "r.fa").write_bytes(text.rstrip("\n").encode())
    return str(folder / "r.fa")


def made(seed=1):
    r = random.Random(seed)
    return [(f"c{k}", "".join(r.choices("ACGTacgtN", k=n))) for k, n in enumerate((1000, 1, 64, 0, 333, 64, 2000))]


def expect(records, width):
    return sorted((n, s // width, s, b[s : s + width].upper()) for n, b in records for s in range(0, len(b), width))


@pytest.mark.parametrize(("width", "split", "line"), [(64, 50, None), (64, 7, None), (10, 333, None), (128, 1 << 20, None), (50, 300, 100_000), (1000, 40, None)])
def test_slices(spark, tmp_path, width, split, line):
    records = made()
    path = write(tmp_path, records, line=line)
    got = fasta.slices(spark, path, width, split)
    assert sorted(map(tuple, got.collect())) == expect(records, width)


def test_no_row_holds_more_than_a_slice_and_only_wanted_ones_come(spark, tmp_path):
    records = made(2)
    path = write(tmp_path, records)
    wanted = spark.createDataFrame([("c0", 3), ("c6", 30), ("c6", 9999), ("zz", 1)], "seq string, slice long")
    got = fasta.slices(spark, path, 64, 100, wanted).collect()
    assert sorted(map(tuple, got)) == [x for x in expect(records, 64) if x[:2] in {("c0", 3), ("c6", 30)}]
    assert sorted(map(tuple, fasta.lengths(fasta.slices(spark, path, 64, 100)).collect())) == sorted((n, len(b)) for n, b in records if b)


def test_headers_with_marks_and_empty_file(spark, tmp_path):
    records = made(4)
    path = write(tmp_path, records)
    assert sorted((r.seq, r.bases) for r in alignments.fasta(spark, path).collect()) == sorted(records)
    (tmp_path / "e.fa").write_text("")
    assert fasta.slices(spark, str(tmp_path / "e.fa")).count() == 0
    (tmp_path / "h.fa").write_text(">only a header")
    assert fasta.slices(spark, str(tmp_path / "h.fa"), 10, 3).count() == 0
