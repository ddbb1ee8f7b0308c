"""Placement of clipped ends against a search over all words, and the tracks of planted clips."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierwave.operators import realign
from tierwave.sources.fasta import sliced

PAIR = str.maketrans("ACGT", "TGCA")


def brute(fragment, line, step, most, band):
    """(strand, start, end, score, mapq) of the best chain, or None."""
    k = realign.SEED
    while k <= len(fragment):
        places = defaultdict(list)
        for p in range(0, len(line) - k + 1, step):
            if set(line[p : p + k]) <= set("ACGT"):
                places[line[p : p + k]].append(p)
        found, least = [], None
        for strand, text in ((1, fragment), (-1, fragment[::-1].translate(PAIR))):
            hits = []
            for o in range(len(text) - k + 1):
                there = places.get(text[o : o + k], ())
                if there:
                    least = min(least or len(there), len(there))
                hits += [(p - o, o, p) for p in there if len(there) <= most]
            hits.sort()
            for i, h in enumerate(hits):
                if i == 0 or h[0] - hits[i - 1][0] > band:
                    found.append((strand, []))
                found[-1][1].append(h)
        if found:
            rows = [(len({x for _, o, _ in c for x in range(o, o + k)}), -s, min(p for *_, p in c), max(p for *_, p in c) + k, len(c)) for s, c in found]
            rows.sort(key=lambda r: (-r[0], r[1], r[2]))
            best, second = rows[0], rows[1][0] if len(rows) > 1 else 0
            quality = max(0, min(60, math.floor(40 * (1 - second / best[0]) * min(1, best[4] / 10) * math.log(best[0]))))
            return -best[1], best[2], best[3], best[0], quality
        if least is None:
            return None
        k *= 2
    return None


def genome(seed=7, n=3000):
    r = random.Random(seed)
    line = "".join(r.choices("ACGT", k=n))
    repeat = line[100:160]
    line = line[:500] + "A" * 200 + line[700:1000] + "N" * 5 + line[1005:2000] + "".join(repeat for _ in range(6)) + line[2360:]
    return line


def test_codes():
    line = genome()
    for k in (12, 24, 48, 96):
        at, code = realign.word_codes(line.encode(), k)
        assert at.tolist() == [p for p in range(len(line) - k + 1) if "N" not in line[p : p + k]]
        words = defaultdict(set)
        for p, c in zip(at.tolist(), code.tolist(), strict=True):
            words[line[p : p + k]].add(c)
        assert all(len(x) == 1 for x in words.values()) and len({c for x in words.values() for c in x}) == len(words)
    assert len(realign.word_codes(b"ACGT", 12)[0]) == 0


@pytest.mark.parametrize(("width", "most"), [(512, 64), (128, 3)])
def test_placement(spark, width, most):
    r, line = random.Random(3), genome()
    fragments = []
    for _ in range(60):
        n, p = r.randint(18, 90), r.randint(0, len(line) - 90)
        text = list(line[p : p + n])
        for _ in range(r.choice([0, 0, 1, 3])):
            text[r.randrange(n)] = r.choice("ACGT")
        if r.random() < 0.3:
            text.insert(n // 2, "G")
        text = "".join(text)
        fragments.append(text[::-1].translate(PAIR) if r.random() < 0.5 else text)
    fragments += ["A" * 40, line[95:165], line[2000:2080], "ACGT" * 8, "N" * 30, line[980:1020]]
    other = genome(9, 500)[:300]
    df = spark.createDataFrame([("c1", f) for f in fragments] * 2 + [("c2", fragments[0])], "seq string, bases string")
    slices = sliced(spark.createDataFrame([("c1", line), ("c2", other)], "seq string, bases string"), width)
    got = {(x.seq, x.bases): (x.strand, x.start, x.end, x.score, x.mapq) for x in realign.place(df, slices, width, most=most).collect()}
    want = {("c1", f): b for f in fragments if (b := brute(f, line, realign.STEP, most, realign.BAND))}
    want |= {("c2", f): b for f in fragments[:1] if (b := brute(f, other, realign.STEP, most, realign.BAND))}
    assert got == want
    assert len(got) > 50 and sum(x[4] > 20 for x in got.values()) > 20


def test_tracks_of_planted_clips(spark):
    line, rest = genome(11, 4000), "C" * 30
    rows, want = [], defaultdict(lambda: defaultdict(int))

    def add(side, pos, target, n, flip, flag):
        piece = line[target : target + n]
        piece = piece[::-1].translate(PAIR) if flip else piece
        bases = piece + rest if side == "left" else rest + piece
        cigar = [(4, n), (0, 30)] if side == "left" else [(0, 30), (4, n)]
        rows.append(("c1", pos, pos + 30, flag, bases, cigar))
        hit = brute(piece, line, realign.STEP, realign.MOST, realign.BAND)
        at = pos + (n if side == "left" else 30)
        to = hit[2] if hit[0] < 0 else hit[1]
        if hit[4] > 20 and abs(to - at + 1) > hit[3] and not flag & 0x400:
            kind = "same" if hit[0] == (-1 if flag & 16 else 1) else "diff"
            for p in range(min(at, to), max(at, to)):
                want[p][f"{side}_smap_{kind}"] += 1
                want[p][f"smap_{kind}"] += 1

    r = random.Random(2)
    for k in range(40):
        target, n = r.choice([r.randint(2500, 3500), r.randint(900, 2000)]), r.randint(18, 60)
        add(r.choice(["left", "right"]), r.randint(1000, 2400), target, n, r.random() < 0.5, r.choice([0, 16, 16, 0x400]))
    reads = spark.createDataFrame(rows, "seq string, pos long, ref_end long, flag int, bases string, cigar array<struct<op:int,len:int>>")
    runs = realign.smap_tracks(reads, sliced(spark.createDataFrame([("c1", line)], "seq string, bases string"), 256), 256, ["seq"]).collect()
    got = defaultdict(lambda: defaultdict(int))
    for x in runs:
        for p in range(x.start, x.end):
            for t in realign.TRACKS:
                if x[t]:
                    got[p][t] = x[t]
    assert {p: dict(v) for p, v in got.items()} == {p: dict(v) for p, v in want.items()}
    assert len(want) > 500 and np.any([t in v for v in want.values() for t in realign.TRACKS])


def test_no_clips(spark):
    reads = spark.createDataFrame([("c1", 5, 35, 0, "A" * 30, [(0, 30)]), ("c1", 5, 35, 0, "*", [(4, 30), (0, 30)])], "seq string, pos long, ref_end long, flag int, bases string, cigar array<struct<op:int,len:int>>")
    slices = sliced(spark.createDataFrame([("c1", genome())], "seq string, bases string"), 256)
    assert realign.smap_tracks(reads, slices, 256, ["seq"]).count() == 0


def test_reads_are_made_once(spark):
    """What leads to bases and CIGARs is computed once a read: neither a filter nor the second use of clips repeats it."""
    line = "".join(random.Random(5).choices("ACGT", k=600))
    slices = sliced(spark.createDataFrame([("c1", line)], "seq string, bases string"), 256)
    made = spark.sparkContext.accumulator(0)

    def bases(at):
        made.add(1)
        return line[at : at + 30] + "N" * 10

    rows = spark.range(200).select(F.lit("c1").alias("seq"), (F.col("id") + 300).alias("pos"), (F.col("id") + 340).alias("ref_end"), F.lit(0).alias("flag"), F.udf(bases, "string")((F.col("id") % 100).cast("int")).alias("bases"))
    step = lambda op, n: F.struct(F.lit(op).alias("op"), F.lit(n).alias("len"))
    reads = rows.withColumn("cigar", F.array(step(4, 30), step(0, 10)))
    assert realign.smap_tracks(reads, slices, 256, ["seq"]).count() > 0
    assert made.value == 200


def test_reads_without_clips(spark):
    """Null and empty CIGARs, and reads without bases or with none told, have no clips."""
    kind = "seq string, pos long, ref_end long, flag int, bases string, cigar array<struct<op int, len int>>"
    clip = [(4, 20), (0, 10)]
    rows = [("c", 5, 9, 0, "A" * 30, None), ("c", 5, 9, 0, "A" * 30, []), ("c", 5, 9, 0, "*", clip), ("c", 5, 9, 0, None, clip), ("c", 5, None, 0, "A" * 30, clip), ("c", 5, 9, 0, "c" * 30, clip), ("c", 5, 9, 16, "ac" * 15, clip[::-1]), ("c", 5, 9, 0, "t" * 20, clip[:1])]
    got = sorted(map(tuple, realign.clipped_ends(spark.createDataFrame(rows, kind), ["seq"]).collect()))
    assert got == [("c", -1, "right", 15, "AC" * 10), ("c", 1, "left", 25, "C" * 20), ("c", 1, "left", 25, "T" * 20)]
