import random

import numpy as np

from tierwave.llm.toxicity import SeverityModel, _features, drop_toxic, fit, fit_cumulative_link, score, words_of

BAD = ["vilest", "rotten", "wretch", "blight", "foulness"]


def corpus(n=600):
    rng = random.Random(3)
    rows, said = [], []
    for i in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 120))]
        if bad := i % 4 == 0:
            for _ in range(rng.choice([2, 4, 8])):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words)))
        said.append((i, int(bad)))
    return rows, said


def test_held_out_accuracy(spark, make, odd):
    rows, said = corpus()
    labels = spark.createDataFrame([r for r in said if r[0] < 400] + [(None, 1), (5, None), (999, 1), (1, 0)], "doc_id long, toxic int")
    model = fit(make(rows), labels)
    assert list(model.thresholds) == sorted(model.thresholds) and any(w.startswith(max(model.weights, key=model.weights.get).rstrip("*")) for w in BAD)
    found = {r.doc_id: r.toxicity for r in score(make(rows), model).collect()}
    right = [found[i].rejected == bool(t) for i, t in said if i >= 400]
    assert np.mean(right) > 0.97
    count = {i: len(set(t.split()) & set(BAD)) for i, t in rows}
    mean = lambda k: np.mean([found[i].severity for i in count if count[i] == k])
    assert mean(0) < mean(2) < mean(4)
    got = score(make(odd), model).collect()
    assert len(got) == len(odd) and all(r.toxicity.severity >= 0 for r in got)
    kept = drop_toxic(make(rows), labels)
    assert kept.columns == make(rows).columns and 0 < kept.count() < len(rows)


def test_without_classes(spark, make):
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert drop_toxic(make([(1, "a"), (None, None)]), labels).count() == 2
    assert drop_toxic(make([]), labels).count() == 0
    assert fit(make([]), labels.limit(0)) == SeverityModel()


def test_one_word_splitter(make):
    """Fitting and scoring have the same words of a text, whatever its white space and letters."""
    texts = ["a\u00a0b\u3000c", "\u0130x \u1e9e (word)", None, " ", "tab\x1cfield"]
    for r in _features(make([(1, t) for t in texts]).selectExpr("doc_id doc", "text", "1 toxic", "text t")).groupBy("doc").agg({"feature": "collect_set"}).collect():
        assert {f for f in r[1] if not f.endswith("*")} == set().union(*map(words_of, texts)) - {""}


def test_gradient_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (4000, 6))
    z = x @ np.array([3.0, -2, 1, 0, 0, 0]) + rng.logistic(size=4000)
    grade = (z[:, None] > np.array([0.0, 1.5, 3])).sum(1)
    row, col = np.nonzero(x)
    w, t = fit_cumulative_link(row, col, grade, 6, 3, 1e-4, 600)
    assert np.abs(w - [3, -2, 1, 0, 0, 0]).max() < 0.35 and np.abs(t - [0, 1.5, 3]).max() < 0.35
