import random
from collections import Counter

from tierwave.llm.suffix_dedup import drop_repeats, remove_repeats


def slow(texts, depth):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + depth] for r in raws for i in range(len(r) - depth + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - depth + 1):
            if seen[r[i : i + depth]] > 1:
                gone[i : i + depth] = [True] * depth
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, bytes(b for b, g in zip(r, gone, strict=True) if not g)))
    return out


def texts(seed, depth):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("abcdefgh é漢") for _ in range(n))
    shared = [say(n) for n in (depth // 3, depth - 1, depth, depth + 1, 2 * depth, 5 * depth)]
    out = [None, "", "x", "ab" * 4 * depth, "z" * 3 * depth, "z" * (depth + 1), say(depth)]
    for _ in range(60):
        t = say(rng.randrange(3 * depth))
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            if rng.random() < 0.3:
                k = rng.randrange(len(s))
                s = s[:k] + "!" + s[k + 1 :]
            t += s + say(rng.randrange(depth))
        out.append(t)
    return out + out[-6:] + [shared[2], shared[3]]


def test_against_all_windows(make):
    for seed, depth, block in ((1, 20, 8), (2, 20, 16), (3, 31, 4), (4, 64, 16), (5, 200, 64)):
        rows = list(enumerate(texts(seed, depth)))
        rows += [(3, "repeat me " * 30), (3, "repeat me " * 30), (None, "no id " * 50 + str(seed)), (None, None)]
        got = remove_repeats(make(rows), depth, block).collect()
        want = slow([t for _, t in rows], depth)
        key = lambda r: (r[0] is None, r[0] or 0, r[1:])
        found = sorted(((r.doc_id, r.repeats.n_bytes, sum(x.e - x.s for x in r.repeats.removed), len(r.repeats.removed), bytes(r.repeats.kept)) for r in got), key=key)
        assert found == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=key)
        assert sum(w[1] > 0 for w in want) > 20


def test_texts_stay_valid(make):
    rows = [(1, "aé" + "漢字" * 40 + "tail"), (2, "b漢" + "漢字" * 40 + "end"), (3, None)]
    docs = make(rows)
    got = drop_repeats(docs, 20, 8)
    assert got.columns == docs.columns
    out = {r.doc_id: r.text for r in got.collect()}
    assert out[3] is None and "�" not in out[1] + out[2] and out[1].endswith("tail") and "漢字漢字" not in out[1] + out[2]
    assert drop_repeats(make([])).count() == 0
    clash = make([(1, "ab" * 30)]).withColumnsRenamed({"ids": "_key", "part": "_spans", "n": "_cut", "fp": "key"})
    (row,) = drop_repeats(clash, 20, 8).collect()
    assert (row["_key"], row["_spans"], row["_cut"], row.key, row.text) == (1, None, None, "x", "")
