"""Each stage against a brute-force version on its own input, and the whole pipeline on planted cases."""

import random

import corpus_pipeline
import pytest
from test_packing import ids_of
from test_suffix_dedup import slow as slow_repeats
from test_winnow import slow as slow_hits

from tierwave.llm.simhash import simhash
from tierwave.llm.toxicity import fit


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    say = lambda n, k=3000: " ".join(f"{rng.choice('klmnprst')}o{rng.randrange(k)}" for _ in range(n))
    bench = [(i, say(40)) for i in range(5)]
    passage = say(60)
    rows, labels = [], []
    for i in range(160):
        text = say(rng.randrange(40, 120))
        if i % 8 == 0:
            text = " ".join(w if k % 6 else rng.choice(["vilest", "rotten", "wretch"]) for k, w in enumerate(text.split()))
        elif i % 16 == 1:
            text += " " + bench[i % 5][1]
        elif i % 16 == 2:
            text += " " + passage
        elif i % 16 == 3 and rows:
            text = rows[-rng.randrange(1, 3)][1]
        rows.append((i, text, "en", "src0", len(text)))
        labels.append((i, 1, int(i % 8 == 0)))
    rows += [(900, None, "en", "src0", 0), (901, "", "en", None, 0), (902, "tiny", None, "src1", 4), (None, "no id " + say(30), "en", "src0", 9)]
    at = tmp_path_factory.mktemp("corpus")
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "packing"]
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    def step(name, docs):
        out = stages[name](spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/after-{name}.parquet")
        return spark.read.parquet(f"{folder}/after-{name}.parquet")

    one = fit(docs, spark.read.parquet(f"{folder}/labels.parquet")).scorer()
    want = [(i, t) for i, t in rows(docs) if one(t)[1] < 0.5]
    docs = step("toxicity", docs)
    assert rows(docs) == want and all("rotten" not in (t or "") for _, t in want) and len(want) > 140

    prints = [(i, t, simhash(t, 0)) for i, t in rows(docs)]
    first = {}
    for i, _, x in prints:
        near = [j for j, _, y in prints if ((x ^ y) % 2**64).bit_count() <= 7]
        first[i] = min(j for j in near if j is not None) if any(j is not None for j in near) else None
    want = [(i, t) for i, t, _ in prints if i is None or first[i] == i]
    docs = step("near_duplicates", docs)
    assert rows(docs) == want and len(want) < len(prints)

    before = rows(docs)
    cut = slow_repeats([t for _, t in before], 200)
    docs = step("repeated_passages", docs)
    assert rows(docs) == sorted(((i, t if not c[1] else c[3].decode()) for (i, t), c in zip(before, cut, strict=True)), key=str)
    assert sum(c[1] > 0 for c in cut) > 5

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = [(i, t) for i, t in rows(docs) if not slow_hits(t, items)[3]]
    docs = step("decontamination", docs)
    assert rows(docs) == want

    pieces = stages["packing"](spark, docs, folder).collect()
    got = sorted((r.sequence_id * 1024 + r.offset, r.length) for r in pieces)
    assert [a for a, _ in got] == [sum(n for _, n in got[:k]) for k in range(len(got))]
    assert sum(n for _, n in got) == sum(len(ids_of(t)) for _, t in want)


def test_run(spark, folder):
    again = corpus_pipeline.run(spark, folder)
    assert again.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and again.count() > 50


def test_cases(spark, tmp_path):
    """Nulls, repeats, one doc_id on several texts, clashing columns and empty tables through all stages."""
    schema = "doc_id long, text string, key string, _cut string, fp long"
    rows = [(1, None, "k", None, 1), (2, "", "k", "c", 2), (3, "one small text", None, "c", 3), (3, "one small text", None, "c", 3), (3, "some other words here", "k", "c", 3), (None, None, None, None, None)]
    for name, data in (("full", rows), ("empty", [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(data, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            docs = stage(spark, docs, at)
            docs.write.parquet(f"{at}/{k}.parquet")
            docs = spark.read.parquet(f"{at}/{k}.parquet")
            assert docs.columns == ["doc_id", "text", "key", "_cut", "fp"]
        kept = sorted(((r.doc_id, r.text, r.key, r["_cut"], r.fp) for r in docs.collect()), key=str)
        assert kept == ([] if name == "empty" else sorted([rows[0], rows[2], rows[4], rows[5]], key=str))
        assert corpus_pipeline.run(spark, at).count() == len(kept)
