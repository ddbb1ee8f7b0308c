import math

import numpy as np
import pytest

from tierwave.llm.whitening import whiten

rng = np.random.default_rng(5)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long, v string").repartition(3)


def brute(rows, components=16):
    """Ids, n, exact deviations, whitened values (up to sign), explained."""
    good = [(i, v) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in good]
    distinct = sorted({v for _, v in x})
    n, s = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    fit = np.array(distinct, float) - np.array(s) / n
    values, vectors = np.linalg.eigh(fit.T @ fit / n)
    order = [k for k in np.argsort(-values)[:components] if values[k] > 1e-12 * values.max()]
    w = (np.array([v for _, v in x], float) - np.array(s) / n) @ vectors[:, order] / np.sqrt(values[order])
    return {"n": n, "explained": values[order] / values.sum(), "rows": [(i, sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True)), r) for (i, v), r in zip(x, w, strict=True)]}


def same(got, want):
    assert sorted(((r.vec_id, r.deviation) for r in got), key=repr) == sorted(((i, d) for i, d, _ in want["rows"]), key=repr)
    for r in got:
        assert r.n == want["n"]
        assert np.allclose(r.explained, want["explained"], rtol=1e-9)
        assert r.identity_error < 1e-9
    key = lambda r: (r[0] is None, r[0] or 0, r[1], np.round(np.abs(r[2]), 6).tolist())
    a = np.array([x[2] for x in sorted(((r.vec_id, r.deviation, np.array(r.whitened)) for r in got), key=key)])
    b = np.array([x[2] for x in sorted(want["rows"], key=key)])
    sign = np.sign((a * b).sum(0))
    assert np.allclose(a * sign, b, atol=1e-7)


def made(n, width, repeats=0):
    base = rng.normal(size=(n, width)) * np.linspace(2, 0.2, width) @ np.linalg.qr(rng.normal(size=(width, width)))[0]
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(base)]
    return rows + [(n + i, rows[0][1], 1, "x") for i in range(repeats)]


@pytest.mark.parametrize(("n", "width", "block"), [(300, 20, 32), (70, 5, 1024), (40, 30, 7)])
def test_against_plain_linear_algebra(spark, n, width, block):
    rows = made(n, width, n // 2)
    same(whiten(frame(spark, rows), block_rows=block).collect(), brute(rows))


def test_cases(spark):
    rows = made(60, 6) + [(None, made(1, 6)[0][1], None, None), (7, made(1, 6)[0][1], None, None)]
    bad = [(900, None, 1, ""), (901, [1.0] * 5 + [None], 1, ""), (902, [1.0] * 5 + [math.inf], 1, ""), (903, [math.nan] * 6, 1, ""), (904, [], 1, "")]
    want = brute(rows)
    same(whiten(frame(spark, rows + bad + [(905, [1.0, 2.0], 1, "")]), block_rows=16).collect(), want)


def test_flat_and_empty(spark):
    assert whiten(frame(spark, [])).collect() == []
    assert whiten(frame(spark, [(1, None, 1, "")])).collect() == []
    assert whiten(frame(spark, [(i, [0.5, 0.25], 1, "") for i in range(4)])).collect() == []
    flat = [(i, [*v, 3.0], n, s) for i, v, n, s in made(50, 3)]  # a dimension without variance is no component
    got = whiten(frame(spark, flat)).collect()
    assert {len(r.whitened) for r in got} == {3}
    same(got, brute(flat))


def test_deviation_beyond_64_bits(spark):
    rows = [(1, [1e9, 0.0], 1, ""), (2, [0.0, 3.0], 1, ""), (3, [2.0, 1.0], 1, "")]
    got = {r.vec_id: r.deviation for r in whiten(frame(spark, rows)).collect()}
    want = {i: d if d < 1 << 63 else None for i, d, _ in brute(rows)["rows"]}
    assert got == want and None in got.values()


def test_query(spark):
    from tierwave.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    got = QUERIES["op11_whitening"](spark, folder).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = brute(rows)
    by = {(r.vec_id, r.component): r for r in got}
    assert len(by) == len(got) == 16 * len(want["rows"])
    for i, d, _ in want["rows"]:
        assert by[i, 1].deviation == d and by[i, 16].n == want["n"]
    w = np.array([[by[i, k + 1].whitened for k in range(16)] for i, _, _ in want["rows"]])
    plain = np.array([x for _, _, x in want["rows"]])
    assert np.allclose(w * np.sign((w * plain).sum(0)), plain, atol=1e-7)
    assert np.allclose([by[0, k + 1].explained for k in range(16)], want["explained"])
