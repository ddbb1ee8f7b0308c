import re
from collections import Counter

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tierwave.llm.phrases import collocations, phrase_counts

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def count(rows, most=4):
    """Counter of (lang, words), and of all words of a language as (lang, ())."""
    f = Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            words = re.findall("[^ \t]+", piece)
            for i in range(len(words)):
                f[lang or "und", ()] += 1
                for k in range(1, most + 1):
                    if i + k <= len(words):
                        f[lang or "und", tuple(words[i : i + k])] += 1
    return f


def brute(rows, least=30, top=2000):
    f = count(rows)
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in candidates.items():
        cuts = [(2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        inside = any(len(o) > len(words) and x == lang and 100 * b >= 80 * a and any(o[i : i + len(words)] == words for i in range(len(o))) for (x, o), b in candidates.items())
        if not inside:
            out.append((lang, -score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]], f[lang, ()]))
    ranked = []
    for lang in sorted({x[0] for x in out}):
        for i, x in enumerate(sorted(y for y in out if y[0] == lang)[:top]):
            ranked.append((lang, i + 1, x[3].decode(), -x[2], x[4], x[5], x[6], -x[1]))
    return ranked


def frame(spark, rows):
    return spark.createDataFrame([(lang, text, 1, "n") for lang, text in rows], "lang string, text string, n long, w1 string").repartition(3)


def run(spark, rows, **more):
    return sorted(map(tuple, collocations(frame(spark, rows), **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


ROWS = [("en", "New York City. new york city, new york, York new"), ("en", "in New\tYork  City is a park; in new york"), (None, "a a a a a b a b"), ("und", "a a a\nb"), ("fr", ""), ("fr", None), ("de", "x\x00y ß É é 漢 😀 x\x00y ß"), ("en", "the end")] * 3


@pytest.mark.parametrize("more", [{}, {"chunk_bytes": 10}, {"size": 2048}])
def test_cases(spark, more):
    assert run(spark, ROWS, least=3, **more) == brute(ROWS, 3)


def test_top_and_ties(spark):
    rows = [("en", f"pair{i} of{i} . ") for i in range(40)] * 4
    assert run(spark, rows, least=4, top=7) == brute(rows, 4, 7)


def test_counts_over_several_words_together(spark):
    rows = [("en", "a b c a b. b c a b c, a b c d")] * 5
    got = {(r.lang, tuple(r.words)): r.f for r in phrase_counts(frame(spark, rows), 5).collect()}
    assert got == {p: n for p, n in count(rows).items() if n >= 5 or not p[1]}


def test_large_counts_are_exact(spark):
    big = 5_000_000_000_000_000_000
    got = spark.range(1).select(F.expr(f"(cast(2000000 as decimal(7, 0)) * cast({big}L as decimal(19, 0))) div (cast({big}L as decimal(19, 0)) + cast({big + 7}L as decimal(19, 0)))").alias("s")).first().s
    assert got == 2_000_000 * big // (2 * big + 7)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None), ("en", "")]) == []


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["en", "de", None]), st.lists(st.sampled_from(["a", "b", "C", "\n", ".", "d\x1c", "É"]), max_size=40).map(" ".join)), max_size=15))
def test_brute_force(spark, rows):
    assert run(spark, rows, least=3, size=2048) == brute(rows, 3)


def test_query(spark):
    from tierwave.llm.queries import QUERIES
    from tierwave.llm.sql import SQL

    folder = "/root/testdata/sf0.01"
    got = sorted(map(tuple, QUERIES["op12_phrases"](spark, folder).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    want = con.sql(f"select lang, rank, phrase, a, l, r, n, score from ({SQL['op12_phrases']})").fetchall()
    assert got == sorted(want)
    assert len(got) > 100


def test_no_phrases_through_the_driver(spark):
    """Phrase tables are small on disk, compressed, but not in memory: no join by phrase may send them whole."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    try:
        plan = collocations(frame(spark, ROWS), least=3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    keys = re.findall(r"(\w+) \[lang#\d+, (?:_left|_right|phrase)#\d+", "\n".join(x for x in plan.splitlines() if "Join" in x))
    assert keys == ["SortMergeJoin"] * 3
