"""Duplicate marking against a plain search over the groups."""

import random

from pyspark.sql import functions as F

from tierwave.operators import duplicates
from tierwave.operators.tracks import DUPLICATE

KIND = "name string, flag int, seq string, pos long, ref_end long, cigar array<struct<op:int,len:int>>, qual string, rg string"


def five(r):
    ops = r[5]
    clips = 0
    for op, n in reversed(ops) if r[1] & 16 else ops:
        if op not in (4, 5):
            break
        clips += n
    return r[4] - 1 + clips if r[1] & 16 else r[3] - clips


def brute(rows):
    score = lambda r: 0 if r[6] == "*" else sum(q for c in r[6] if (q := ord(c) - 33) >= 15)
    templates = {}
    for r in rows:
        if r[4] is not None and not r[1] & 0x900:
            templates.setdefault((r[7], r[0]), []).append(r)
    ends = {t: sorted((r[2], five(r), bool(r[1] & 16)) for r in v) for t, v in templates.items()}
    best, taken = {}, {(t[0], e) for t, v in ends.items() if len(v) > 1 for e in (v[0], v[-1])}
    rank = lambda t: (-sum(map(score, templates[t])), t[1])
    place = lambda t: (t[0], ends[t][0], ends[t][-1] if len(ends[t]) > 1 else None)
    for t in templates:
        best[place(t)] = min(best.get(place(t), rank(t)), rank(t))
    lost = {t for t in templates if best[place(t)] != rank(t) or len(ends[t]) == 1 and (t[0], ends[t][0]) in taken}
    return sorted(((r[0], r[1] & ~DUPLICATE | (DUPLICATE if (r[7], r[0]) in lost and r[4] is not None and not r[1] & 0x900 else 0), *r[2:4]) for r in rows), key=repr)


def made(n, seed):
    r, rows = random.Random(seed), []
    for k in range(n):
        at, q, rg = r.randint(20, 26), chr(33 + r.choice([2, 20, 40])), r.choice(["g1", "g2", None])
        for mate in range(r.choice([1, 2, 2, 2])):
            clip, pos, flag = r.randint(0, 3), at + 10 * mate, r.choice([0, 16])
            cigar = [(0, 8), (r.choice([4, 5]), clip)] if flag else [(r.choice([4, 5]), clip), (0, 8)]
            cigar = [c for c in cigar if c[1]]
            flag |= r.choice([0, 0, 0, 0, 0x100, 0x400, 0x800])
            rows.append((f"t{k}", flag, r.choice(["c1", "c1", "c2"]), pos, pos + 8, cigar, r.choice([q * 8, q * 8, "*"]), rg))
    rows.append(("unmapped", 4, "*", -1, None, None, "*", "g1"))
    return rows


def test_against_search(spark):
    for seed in range(3):
        rows = made(150, seed)
        got = duplicates.mark(spark.createDataFrame(rows, KIND).repartition(3)).select("name", "flag", "seq", "pos").collect()
        want = brute(rows)
        assert sorted(map(tuple, got), key=repr) == want
        assert sum(bool(x[1] & DUPLICATE) for x in want) > 10


def test_hot_place_ties_and_lone_mates(spark):
    rows = [(f"t{k:03}", 0, "c1", 100, 110, [(0, 10)], "I" * 10, "g") for k in range(300)]
    got = {r.name: r.flag for r in duplicates.mark(spark.createDataFrame(rows, KIND)).collect()}
    assert [n for n, f in got.items() if not f] == ["t000"]  # equal qualities: the first name
    pair = [("p", 0, "c1", 100, 110, [(0, 10)], "#" * 10, "g"), ("p", 16, "c1", 300, 310, [(0, 10)], "#" * 10, "g")]
    got = {r.name: r.flag & DUPLICATE for r in duplicates.mark(spark.createDataFrame(rows + pair, KIND)).collect()}
    assert [n for n, f in got.items() if not f] == ["p"]  # a template stands above lone reads
    assert duplicates.mark(spark.createDataFrame([], KIND)).count() == 0


def test_templates_are_made_once_and_met_by_name(spark):
    """Nothing is joined by place, and qualities are summed once a read."""
    seen = spark.sparkContext.accumulator(0)

    def mark(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = made(100, 7)
    df = spark.createDataFrame(rows, KIND)
    found = duplicates.best(duplicates._templates(df.mapInArrow(mark, df.schema), "rg"))
    found.collect()
    assert seen.value == len(rows)
    odd = spark.createDataFrame([("*",), (None,), ("",), ("I#0/",), ("~",)], "q string").repartition(1)
    assert sorted(odd.select(duplicates.quality(F.col("q")).alias("n")).collect(), key=repr) == sorted([(0,), (None,), (0,), (40 + 15,), (93,)], key=repr)
