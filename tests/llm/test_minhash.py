import random

from pyspark.sql import functions as F

from tierwave.llm.minhash import at_or_after, edited_likeness, likeness, quantiles, with_fingerprint, with_next


def test_next_and_edited(make, odd):
    rows = [(i, t) for i, t in odd if i is not None and i != 3] + [(900 - k, f"text {k} of some") for k in range(40)]
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    after = {a[0]: b[1] or "" for a, b in zip(order, order[1:] + order[:1], strict=True)}
    for per in (3, 2_000):
        got = with_next(make(rows), ["text"], per).collect()
        assert {r.doc_id: r.next.text or "" for r in got} == after and len(got) == len(rows)
    bounds = quantiles(make([(i % 37, "") for i in range(900)]), 9, 4)
    assert bounds == sorted(set(bounds)) and 6 <= len(bounds) <= 12
    for some in ([], [4], bounds):
        got = make([(i, "") for i in range(-2, 40)]).select("doc_id", at_or_after(some, F.col("doc_id")).alias("k")).collect()
        assert all(r.k == sum(b < r.doc_id for b in some) for r in got)
    text = {i: t or "" for i, t in rows}
    for r in edited_likeness(make(rows)).collect():
        t = text[r.doc_id]
        h = len(t) // 2
        assert (r.n_chars, r.edited) == (len(t), t[: len(t) - h] + after[r.doc_id][:h])


def test_ties_nulls_and_empty(make, odd):
    got = edited_likeness(make(odd)).collect()
    assert len(got) == len(odd) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert edited_likeness(make([])).count() == 0
    (one,) = edited_likeness(make([(5, "a b c d")])).collect()
    assert one.edited == "a b a b" and one.near_next == 1


def test_likeness_near_jaccard(spark):
    rng, rows, truth = random.Random(1), [], []
    for _ in range(150):
        n, share = rng.choice([1, 4, 30, 200, 1000]), rng.random()
        a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        b = a[: int(n * share)] + [f"v{rng.randrange(10**6)}" for _ in range(n - int(n * share))]
        grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
        truth.append(len(grams(a) & grams(b)) / len(grams(a) | grams(b)))
        rows.append((len(rows), " ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    df = with_fingerprint(with_fingerprint(df, "a", "fa"), "b", "fb").select("i", likeness("fa", "fb").alias("s"), F.length("fa").alias("n"))
    off = [r.s - truth[r.i] for r in df.collect()]
    assert max(map(abs, off)) < 0.2 and abs(sum(off) / len(off)) < 0.015 and (sum(x * x for x in off) / len(off)) ** 0.5 < 0.05


def test_equal_texts_equal_fingerprints(make):
    df = with_fingerprint(make([(1, "x y z"), (2, "x y z"), (3, None), (4, ""), (5, "x  y\tz")]), "text", "f").collect()
    f = {r.doc_id: r.f for r in df}
    assert f[1] == f[2] == f[5] != f[3] == f[4] and all(len(x) == 256 for x in f.values())


def test_full_bins_meet_the_same_bins(spark):
    rng, rows, truth = random.Random(5), [], []
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for i in range(60):
        a = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(400, 900))]
        b = a[: len(a) * 8 // 10]
        rows.append((i, " ".join(a), " ".join(b)))
        truth.append(len(grams(b)) / len(grams(a)))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    for name in "ab":
        hashes = f"transform(split({name}, ' '), w -> xxhash64(w))"
        df = df.withColumn("h" + name, F.expr(hashes)).withColumn("n" + name, F.expr(f"size(array_distinct(transform(sequence(1, size(h{name}) - 4), i -> shiftrightunsigned(xxhash64(slice(h{name}, i, 5)), 57))))"))
    df = with_fingerprint(with_fingerprint(df, "a", "fa"), "b", "fb").select("i", "na", "nb", likeness("fa", "fb").alias("s"))
    got = df.collect()
    assert sum((r.na == 128) != (r.nb == 128) and min(r.na, r.nb) >= 126 for r in got) >= 5
    assert max(abs(r.s - truth[r.i]) for r in got) < 0.2


def test_columns_of_the_names_used_inside_stay(spark):
    df = spark.createDataFrame([("a b c", 1, "x", 3)], "_w string, _h int, _O string, n int")
    got = with_fingerprint(df, "_w", "f")
    assert got.columns == ["_w", "_h", "_O", "n", "f"] and tuple(got.first())[:4] == ("a b c", 1, "x", 3)
    assert got.first().f == with_fingerprint(df.select(F.col("_w").alias("t")), "t", "f").first().f


def test_next_over_many_buckets_and_null_ids(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(400) if k % 3 else None, f"t{k}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashed = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]]))
    want = {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}
    for per_bucket in (5, 40, 1000):
        assert {r.text: r.next.text for r in with_next(df, ["text"], per_bucket).collect()} == want
