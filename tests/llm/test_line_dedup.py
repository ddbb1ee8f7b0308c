import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tierwave.llm.line_dedup import dedup_lines

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10):
    """Counter of (doc_id, n_lines, n_dropped, kept); null ids are one document before all others."""
    rank = lambda i: (i is not None, i or 0)
    first = {}
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    for i, lines in split:
        for line in lines:
            first[key(line)] = min(first.get(key(line), rank(i)), rank(i))
    out = []
    for i, lines in split:
        stay = [x for x in lines if len(key(x)) < least or first[key(x)] == rank(i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def run(make, rows, **more):
    found = dedup_lines(make(rows), **more).select("doc_id", "lines.n_lines", "lines.n_dropped", "lines.kept").collect()
    return sorted((tuple(r) for r in found), key=repr)


def test_cases(make, odd):
    line = "a line that many texts have"
    rows = [*odd, (50, f"{line}\nown words of this text\n{line}"), (49, f"x\n \t{line.upper()}\r\nshort\n{line} "), (48, "short\nshort"), (51, "\n".join([line] * 3000)), (52, line), (None, "own words of this text")]
    rows += [(53, "\n".join(f"numbered line {k}" for k in range(500))), (54, "\n".join(f"numbered line {k}" for k in range(0, 700, 3))), (53, "numbered line 4\nsecond row of one id")]
    assert run(make, rows) == brute(rows)


def test_hot_line_is_sliced(make):
    rows = [(i, f"the very common line of all\nline of document number {i}\nline of two documents {i // 2}") for i in range(600)]
    assert run(make, rows) == brute(rows)


def test_empty_and_names(make, spark):
    assert run(make, []) == []
    got = dedup_lines(make([(1, "one line of text")]).withColumn("lines", F.lit(7)).withColumn("keep", F.lit(8)).withColumn("_d1", F.lit(9)))
    assert got.select("lines", "keep", "_d1", "lines_.n_lines").first() == (7, 8, 9, 1)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["", "aé漢", "A very plain line", " a VERY plain line\x0b", "İstanbul line 12", "another plain line 3", "tail\r", "\x1cnot stripped line"]), max_size=80).map("\n".join), max_size=12))
def test_brute_force(make, texts):
    rows = list(enumerate(texts))
    assert run(make, rows) == brute(rows)


@pytest.mark.parametrize("name", ["op13_line_dedup"])
def test_query(spark, name):
    from tierwave.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    got = QUERIES[name](spark, folder).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute(rows)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(r.n_dropped for r in got) > 0
