import itertools
import random

import xxhash

from tierwave.llm.simhash import bucket_links, components, keep_one, near_duplicates, similar, simhash


def slow(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_against_pairs(make, odd):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [*odd, *((50 + k, base.replace(f"w{7 * k}", "edit") if k else base) for k in range(12)), (40, base)]
    got = near_duplicates(make(rows)).collect()
    assert len(got) == len(rows)
    prints = {t: simhash(t) % 2**64 for _, t in rows}
    assert prints == {t: slow(t) for t in prints}
    nodes = list({*prints.values()})
    comp = {x: x for x in nodes}
    for _ in nodes:
        for a, b in itertools.permutations(nodes, 2):
            if (a ^ b).bit_count() <= 3:
                comp[a] = comp[b] = min(comp[a], comp[b])
    first = {}
    for i, t in rows:
        if i is not None:
            first[comp[prints[t]]] = min(i, first.get(comp[prints[t]], i))
    want = sorted((i is None, i or 0, prints[t], first.get(comp[prints[t]])) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp % 2**64, r.component_id) for r in got) == want


def test_keep_one(make):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (3, "something else here now"), (3, "something else here now"), (None, "x"), (None, "y")]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in keep_one(make(rows)).collect()) == [(False, 1), (False, 3), (True, 0), (True, 0)]
    assert keep_one(make([])).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {*((i, 0) for i in range(201)), (1000, 1000), (1001, 1000)}


def test_bucket_links_connect_the_same(spark):
    rng = random.Random(7)
    nodes = {0, 1, 2**63}
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(40):
            x = center
            for _ in range(rng.randrange(7)):
                x ^= 1 << rng.randrange(64)
            nodes.add(x)
    nodes |= {rng.getrandbits(64) for _ in range(300)}
    nodes = sorted(nodes)
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if (a ^ b).bit_count() <= 7:
            root[find(a)] = find(b)
    want = {}
    for x in nodes:
        want.setdefault(find(x), set()).add(x)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(x),) for x in nodes], "fp long")
    found = {}
    for r in components(bucket_links(df)).collect():
        found.setdefault(r.root, set()).add(r.node % 2**64)
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_keep_one_takes_edited_copies(make):
    rng = random.Random(1)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, groups = [], {}
    for g in range(30):
        base = say(150)
        for k in range(4):
            words = list(base)
            for _ in range(min(k, 3)):
                words[rng.randrange(150)] = f"x{rng.randrange(5000)}"
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + k, " ".join(say(150))) for k in range(60)]
    kept = [r.doc_id for r in keep_one(make(rows)).collect()]
    # Three of 150 words differ at most; the fingerprints are random, so a few such copies may stay.
    assert len(kept) == len(set(kept)) <= 93 and {groups[i] for i in kept if i in groups} == set(range(30)) and len([i for i in kept if i not in groups]) == 60


def test_under_the_similarity_all_stay(make):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(rng.sample(words, 120))) for i in range(8)]
    rows += [(20, rows[0][1] + " end"), (21, rows[5][1].upper())]
    assert len({simhash(t, 0) for _, t in rows[:8]}) == 1
    assert sorted(r.doc_id for r in keep_one(make(rows)).collect()) == list(range(8))


def test_one_doc_id_on_several_texts(make):
    a, b = "one two three four five six", "another text that is nothing like it at all"
    got = sorted((r.doc_id, r.text) for r in keep_one(make([(2, a), (5, a), (5, b), (5, b), (7, b)])).collect())
    assert got == [(2, a), (5, b)]
    assert keep_one(make([])).count() == 0
    clash = keep_one(make([(1, a), (1, a), (None, a), (None, a)]).withColumnsRenamed({"ids": "_key", "part": "text_hash", "n": "node"}))
    assert clash.columns == ["doc_id", "text", "_key", "text_hash", "fp", "node"] and sorted(str(r.doc_id) for r in clash.collect()) == ["1", "None", "None"]


def test_similar_against_pairs(make):
    rng, rows = random.Random(9), []
    for _ in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(150)]
        for _ in range(12):
            text = list(base)
            for _ in range(rng.randrange(9)):
                text[rng.randrange(150)] = f"x{rng.randrange(400)}"
            rows.append((len(rows), " ".join(text)))
    grams = [{tuple(t.split()[i : i + 5]) for i in range(146)} for _, t in rows]
    prints = [simhash(t, 0) % 2**64 for _, t in rows]
    least, changed = list(range(len(rows))), True
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= 7 and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    while changed:
        changed = False
        for a, b in links:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    assert 6 < len(set(least)) < len(rows) - 6
    for chunk in (4, 1_000):
        assert {r.doc_id: r.component_id for r in similar(make(rows), chunk=chunk).collect()} == dict(enumerate(least))
