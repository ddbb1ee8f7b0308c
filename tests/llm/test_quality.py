import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tierwave.llm.quality import KINDS, WIDTH, features, fit, held_out, score


def test_held_out_accuracy(spark, make, odd):
    rng, rows, said = random.Random(4), [], []
    for i in range(400):
        words = [f"{rng.choice(['ka', 'lo', 'mi'])}{rng.choice(['ren', 'tas', 'vo'])}{k % 7}" for k in range(rng.randrange(10, 200))]
        bad = i % 5 == 0
        if bad:
            words = [w + rng.choice(["###", "$$"]) for w in words] if i % 2 else [words[0]] * 80
        rows.append((i, " ".join(words)))
        said.append((i, int(not bad)))
    labels = spark.createDataFrame([*said, (None, 0), (3, None), (9999, 0)], "doc_id long, quality int")
    model = fit(make(rows), labels, ~held_out(F.col("doc_id")))
    got = {r.doc_id: r.score for r in score(make(rows), model).collect()}
    test = [(i, q) for i, q in said if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(test) > 40 and np.mean([(got[i] >= 0.3) == q for i, q in test]) > 0.95
    edge = score(make(odd), model).collect()
    assert len(edge) == len(odd) and all(0 <= r.score <= 1 for r in edge)
    assert score(make([]), model).count() == 0


def test_held_out_labels_are_not_read(spark, make):
    rows = [(i, "good words here" if i % 2 else "### $$$") for i in range(60)]
    out = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    models = [fit(make(rows), spark.createDataFrame([(i, (i % 2) ^ (flip and i in out)) for i, _ in rows], "doc_id long, quality int"), ~held_out(F.col("doc_id"))) for flip in (0, 1)]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].threshold == models[1].threshold


def test_without_classes(spark, make):
    model = fit(make([(1, "a")]), spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert [r.score for r in score(make([(1, "a"), (2, None)]), model).collect()] == [1.0, 1.0]


def test_features_have_one_width():
    assert {len(features(t)) for t in (None, "", " ", "a", "\x00", "é" * 1000, "\ud800")} == {WIDTH}


def test_commonest_word_is_counted_over_all_words():
    top = 2 * len(KINDS) + 2
    lines = "\n".join(" ".join(f"w{k}" for k in range(10)) for _ in range(2_000))
    assert features(lines)[top] == 0.1
    rare = ["x" if i % 7 == 3 else f"w{i}" for i in range(14_000)]
    assert features(" ".join(rare))[top] == 1 / 7
