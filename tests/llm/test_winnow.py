import random
import re

from tierwave.llm.winnow import drop_contaminated, judge

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return SPLIT.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(text, items):
    ws, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        n = min(13, len(iw))
        for i in range(len(iw) - n + 1 if n else 0):
            for j in range(len(ws) - n + 1):
                if ws[j : j + n] == iw[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(item)
    return len(ws), len(hit), sorted(str(x) for x in found if x is not None), bool(hit) and 20 * len(hit) >= len(ws)


def cases(odd):
    rng = random.Random(5)
    say = lambda n, v=40: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(v)) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([40, 13, 12, 14, 1, 60, 5])]
    items += [(20, "la " * 30), (21, None), (22, " ... "), (23, items[0][1].upper()), (None, items[1][1]), (24, "É 漢字 x"), (0, "zz yy xx")]
    docs = [(i, t if t is None or len(t) < 1000 else t[:4000]) for i, t in odd]
    for k in range(60):
        i, t = items[rng.randrange(7)]
        ws = t.split()
        a = rng.randrange(len(ws))
        part = " ".join(ws[a : a + rng.choice([3, 12, 13, 14, 40])])
        docs.append((100 + k, f"{say(rng.randrange(60))} {part}, {say(rng.randrange(9))}!{items[1][1] if k % 7 == 0 else ''}\n{t if k % 5 == 0 else ''}"))
    docs += [(200, "la " * 50), (201, "La-la " * 14), (202, "x É.漢字  X"), (203, "zz yy xx" + say(300)), (204, "la " * 13 + "lo")]
    return docs, items


def test_against_all_windows(spark, make, odd):
    docs, items = cases(odd)
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, key string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in judge(make(docs), bench).collect()), key=key)
    want = sorted(((i, *slow(t, items)) for i, t in docs), key=key)
    assert got == want
    assert sum(r[4] for r in want) > 10 and sum(r[2] == 0 for r in want) > 5
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in drop_contaminated(make(docs), bench).collect())
    assert kept == sorted((r[0] is None, r[0] or 0) for r in want if not r[4])


def test_clashing_columns(spark, make):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = make([(1, "x alpha beta gamma"), (2, "clean"), (2, None)]).withColumnsRenamed({"ids": "key", "part": "key_", "n": "item"})
    got = drop_contaminated(docs, bench)
    assert got.columns == docs.columns and sorted((r.doc_id, r.key, r.text or "") for r in got.collect()) == [(2, 1, ""), (2, 1, "clean")]


def test_empty(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert judge(make([]), none).count() == 0
    assert [tuple(r) for r in judge(make([(1, "a b")]), none).select("n_words", "n_hit", "contaminated").collect()] == [(2, 0, False)]


def test_repetitive_and_long_texts(spark, make):
    """A text that repeats what an item repeats: every place of one fits every place of the other."""
    bench = spark.createDataFrame([(1, "la " * 500), (2, "do re " * 300), (3, "once only " + "x y z " * 5)], "item_id long, text string")
    docs = make([(1, "la " * 160_000), (2, "do re mi " + "re do " * 40_000), (3, "word " * 30_000), (4, "la " * 12)])
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), len(r.spans)) for r in judge(docs, bench).collect()}
    assert got == {1: (160_000, 160_000, ["1"], 1), 2: (80_003, 80_000, ["2"], 1), 3: (30_000, 0, [], 0), 4: (12, 0, [], 0)}


def test_query(spark):
    import hashlib

    from tierwave.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{folder}/{t}.parquet").select(c, "text").collect()]
    docs, items = read("documents", "doc_id"), read("benchmark", "item_id")
    windows = {}
    for item, t in items:
        iw = words(t)
        n = min(13, len(iw))
        for i in range(len(iw) - n + 1 if n else 0):
            windows.setdefault(tuple(iw[i : i + n]), set()).add(item)
    want = []
    for doc, t in docs:
        ws, hit, found = words(t), set(), set()
        for n in {len(w) for w in windows}:
            for j in range(len(ws) - n + 1):
                if ids := windows.get(tuple(ws[j : j + n])):
                    hit |= set(range(j, j + n))
                    found |= ids
        listed = ",".join(sorted(str(x) for x in found))
        want.append((doc, len(ws), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)))
    got = sorted(map(tuple, QUERIES["op1_decontamination"](spark, folder).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()))
    assert got == sorted(want) and any(r[5] for r in got)
