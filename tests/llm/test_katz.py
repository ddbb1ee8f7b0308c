import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tierwave.llm.katz import by_remainder, chunks_of, discounts, encode, fit, probabilities, score, vocabulary
from tierwave.llm.queries import op10_lm_scoring


def tokens(text):
    return [*(text or "").encode().lower().split(), b" "]


def slow(rows, order, most=5):
    """The model by dictionaries, and a check that every history's probabilities sum to one."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    grams = [Counter() for _ in range(order)]
    for (_, t), out in zip(rows, held, strict=True):
        if not out:
            ws = [b"\n"] * (order - 1) + tokens(t)
            for k in range(order - 1, len(ws)):
                for n in range(1, order + 1):
                    grams[n - 1][tuple(ws[k - n + 1 : k + 1])] += 1
    n, v = sum(grams[0].values()), len(grams[0])
    d = [discounts([sum(c == r for c in x.values()) for r in range(1, most + 2)], most) for x in grams]
    cut = lambda k, c: (d[k - 1][c] if c <= most else 1) * c
    unknown = 1 - sum(cut(1, c) for c in grams[0].values()) / (n + 1)
    after = {}
    for x in grams[1:]:
        for g, c in x.items():
            after.setdefault(g[:-1], {})[g[-1]] = c
    weights = {}

    def denominator(h):
        total, kept = sum(after[h].values()), sum(cut(len(h) + 1, c) for c in after[h].values())
        return total if kept < total * (1 - 1e-12) else total + 1

    def p(h, w):
        if not h:
            return cut(1, grams[0][w,]) / (n + 1) if (w,) in grams[0] else unknown
        if h not in after:
            return p(h[1:], w)
        if w in after[h]:
            return cut(len(h) + 1, after[h][w]) / denominator(h)
        if h not in weights:
            kept = sum(cut(len(h) + 1, c) for c in after[h].values())
            weights[h] = (1 - kept / denominator(h)) / (1 - sum(p(h[1:], x) for x in after[h]))
        return weights[h] * p(h[1:], w)

    for h in [*list(after)[:6], *list(after)[-3:], (b"never",) * (order - 1)]:
        assert abs(sum(p(h, w) for w in [*(g[0] for g in grams[0]), b"unknown"]) - 1) < 1e-9
    out = []
    for (i, t), h in zip(rows, held, strict=True):
        ws = [b"\n"] * (order - 1) + tokens(t)
        own = ws[order - 1 :]
        prob = sum(math.log10(p(tuple(ws[k - order + 1 : k]), ws[k])) for k in range(order - 1, len(ws)))
        out.append((i, h, len(own), sum((w,) in grams[0] for w in own), n, sum(math.log10((grams[0][w,] + 1) / (n + v + 1)) for w in own), prob))
    return out


def key(r):
    return r[0] is None, r[0] or 0, *r[1:5], round(r[6], 6)


def same(got, want):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    want = sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * (1 + abs(b[5])) and abs(a[6] - b[6]) < 1e-6 * (1 + abs(b[6]))


@pytest.mark.parametrize("order, chunk, bucket", [(1, 300, 50), (2, 300, 50), (2, 10**7, 10**6), (3, 700, 100), (4, 10**7, 10**6)])
def test_against_dictionaries(make, odd, order, chunk, bucket):
    rng = random.Random(2)
    rows = odd + [(100 + i, " ".join(f"W{min(int(rng.expovariate(0.08)), 90)}" for _ in range(rng.randrange(60)))) for i in range(200)]
    got = score(make(rows), by_remainder(F.col("doc_id")), order, chunk_bytes=chunk, bucket_keys=bucket)
    same(got.collect(), slow(rows, order))


def test_tables_score_other_texts(make):
    """The tables of one corpus, asked by another that holds unknown words."""
    train, other = [(i, f"a b {'c' * (i % 3 + 1)} d e{i % 4}") for i in range(40)], [(1, "a b x d"), (2, "zz"), (3, "a b c d e1")]
    train = [(i, t) for i, t in train if zlib.crc32(str(i).encode()) % 7 != 2]
    chunks = chunks_of(make(train), F.lit(False))
    words = vocabulary(chunks, 5)
    model = fit(encode(chunks, words, 5), words, 2)
    asked = chunks_of(make(other), F.lit(True))
    got = {r.doc_id: r.score for r in probabilities(encode(asked, words, 5), model).collect()}
    # These stand for doc_ids of the other texts that are held out.
    held = [i for i in range(1000, 9000) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    want = {r[0]: r[6] for r in slow(train + [(h, t) for h, (_, t) in zip(held, other, strict=True)], 2)}
    for (i, _), h in zip(other, held, strict=True):
        assert abs(got[i] - want[h]) < 1e-9


def test_nothing_to_learn_from(make):
    got = score(make([(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert score(make([]), F.lit(False)).count() == 0


def test_query(spark):
    """The registered query over a whole small table."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    same(op10_lm_scoring(spark, "/root/testdata/sf0.001").collect(), slow(rows, 2))
