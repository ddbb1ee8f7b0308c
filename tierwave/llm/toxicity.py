"""Toxicity: cumulative-link ordinal regression over sparse word features.

Labels say toxic or not; severity grades come from them in two steps. Words (and word beginnings of 4 to 6 letters)
that are far more frequent in toxic than in other labelled documents are marker features. A toxic document's grade is
1 to `grades` by how many distinct marker words it has, cut at the quantiles of the toxic ones; others have grade 0.
The model P(grade > j) = sigmoid(w . x - t_j) shares w across ordered thresholds t; x counts, over a document's
distinct words, the selected features. It is fitted with an L1 penalty (proximal gradient). Scores are expected
severity; a document is rejected if P(grade > 0) reaches `reject`.

The fit uses at most `sample` labelled documents (those of least hash), so that what reaches the driver is bounded:
`features` selected features of each. Scoring covers whole texts of all documents.

Cases: null and empty texts have no features and the base score; labels of null toxic, of null or unknown doc_id are
left out; repeated labels of one document count as toxic if any is; without both classes among the labels nothing is
rejected and the severity is 0; repeated rows are scored each; a
text of any length is read word by word; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, free_name, materialize

#: Lengths of the word beginnings that are features besides whole words.
BEGINNINGS = (4, 5, 6)


@dataclass
class SeverityModel:
    """weights: of features (a word, or `beginning*`); thresholds: t_0 < t_1 < ..."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()

    def scorer(self):
        """Function from a text to (expected severity, P(grade > 0))."""
        weights, thresholds = self.weights, np.array(self.thresholds)

        class Words(dict):
            def __missing__(self, word):
                w = weights.get(word, 0.0)
                if len(word) > BEGINNINGS[0]:
                    w += sum(weights.get(word[:n] + "*", 0.0) for n in BEGINNINGS if len(word) > n)
                if len(self) < 500_000:
                    self[word] = w
                return w

        known = Words()

        def score(text):
            if not len(thresholds):
                return 0.0, 0.0
            over = 1 / (1 + np.exp(thresholds - sum(map(known.__getitem__, words_of(text)))))
            return float(over.sum()), float(over[0])

        return score


#: Characters stripped from the ends of words.
EDGES = ".,;:!?\"'()[]{}%&*#$|"


def words_of(text: str | None) -> set[str]:
    return {w.strip(EDGES) for w in (text or "").lower().split()}


def _features(docs: DataFrame) -> DataFrame:
    """doc, toxic, feature: the distinct features of each labelled document, of the words that scoring has."""
    import pandas as pd

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(words_of(t)))

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    begun = [F.transform(F.filter("words", _longer(n)), _beginning(n)) for n in BEGINNINGS]
    every = F.array_distinct(F.concat("words", *begun))
    return docs.withColumn("words", F.pandas_udf(run, "array<string>")("text")).select("doc", "toxic", F.explode(every).alias("feature")).where("feature != ''")


def _longer(n):
    return lambda w: F.char_length(w) > n


def _beginning(n):
    return lambda w: F.concat(F.substring(w, 1, n), F.lit("*"))


def labelled(documents: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc, text, toxic of at most `sample` labelled documents (of a repeated doc_id the least text)."""
    said = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # The sample is drawn from the labels, so that its few ids, and not the texts, are dealt out.
    chosen = said.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    one = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return one.groupBy(F.col("doc_id").alias("doc"), "toxic").agg(F.min("text").alias("text"))


def fit(documents: DataFrame, labels: DataFrame, grades: int = 3, sample: int = 6_000, features: int = 1_000, penalty: float = 3e-4, rounds: int = 400) -> SeverityModel:
    docs = materialize(labelled(documents, labels, sample), "toxicity-sample")
    n = {r["toxic"]: r["count"] for r in docs.groupBy("toxic").count().collect()}
    bad, good = sum(v for k, v in n.items() if k), n.get(0, 0)
    if not bad or not good:
        return SeverityModel()
    found = _features(docs)
    seen = found.groupBy("feature").agg(F.count(F.when(F.col("toxic") > 0, 1)).alias("p"), F.count(F.when(F.col("toxic") == 0, 1)).alias("q")).where("p + q >= 3")
    odds = F.log((F.col("p") + 0.5) / (bad + 1)) - F.log((F.col("q") + 0.5) / (good + 1))
    # The strongest features by their log-odds in standard errors, to either side.
    z = odds / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("q") + 0.5))
    best = seen.select("feature", odds.alias("odds"), z.alias("z")).orderBy(F.abs("z").desc(), "feature").limit(features)
    chosen = best.collect()
    number = {r["feature"]: i for i, r in enumerate(chosen)}
    marker = np.array([r["odds"] > 2 and r["z"] > 3 and not r["feature"].endswith("*") for r in chosen])
    rows = found.join(F.broadcast(best.select("feature")), "feature").groupBy("doc").agg(F.collect_set("feature").alias("f"))
    rows = docs.select("doc", "toxic").join(rows, "doc", "left").collect()
    y = np.array([r["toxic"] > 0 for r in rows])
    at = [np.array([number[f] for f in r["f"] or ()], int) for r in rows]
    hits = np.array([marker[a].sum() for a in at])
    cuts = np.quantile(hits[y], [k / grades for k in range(1, grades)])
    grade = np.where(y, 1 + (hits[:, None] > cuts[None]).sum(1), 0)
    row, col = np.repeat(np.arange(len(at)), [len(a) for a in at]), np.concatenate(at) if at else np.zeros(0, int)
    w, t = fit_cumulative_link(row, col, grade, len(chosen), int(grade.max()), penalty, rounds)
    return SeverityModel({r["feature"]: float(x) for r, x in zip(chosen, w, strict=True) if x}, tuple(map(float, t)))


def fit_cumulative_link(row, col, grade, width: int, top: int, penalty: float, rounds: int):
    """Weights and ordered thresholds t_0 < ... < t_{top-1}, by accelerated proximal gradient with an L1 penalty.

    Thresholds are t_0 and the logarithms of the gaps, so that they stay ordered.
    """
    n = len(grade)
    w, base, gaps = np.zeros(width), 0.0, np.zeros(max(top - 1, 0))
    step = 4.0 / max(1.0, np.bincount(row, minlength=n).mean())
    v, vb, vg = np.zeros(width), 0.0, np.zeros_like(gaps)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    for _ in range(rounds):
        t = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        s = np.bincount(row, weights=w[col], minlength=n)
        over = np.concatenate([np.ones((n, 1)), sig(s[:, None] - t[None, :]), np.zeros((n, 1))], 1)  # P(grade >= j)
        hi, lo = over[np.arange(n), grade], over[np.arange(n), grade + 1]
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        ds = (dhi - dlo) / p  # d log p / d s
        dt = np.zeros(top)
        np.add.at(dt, np.maximum(grade - 1, 0), np.where(grade > 0, -dhi / p, 0))
        np.add.at(dt, np.minimum(grade, top - 1), np.where(grade < top, dlo / p, 0))
        dw = np.bincount(col, weights=ds[row], minlength=width) / n
        tail = np.cumsum(dt[::-1])[::-1] / n
        v, vb, vg = 0.9 * v + step * dw, 0.9 * vb + step * tail[0], 0.9 * vg + step * tail[1:] * np.exp(gaps)
        w, base, gaps = w + v, base + vb, np.clip(gaps + vg, -6, 3)
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
    return w, base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def score(documents: DataFrame, model: SeverityModel, reject: float = 0.5, name: str = "toxicity") -> DataFrame:
    """documents with the struct `name`: severity (expected grade), p_toxic (P(grade > 0)) and rejected."""
    import pandas as pd

    bound_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most `features` words

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = shared.value.scorer()
        for part in texts:
            out = pd.DataFrame([one(t) for t in part], columns=["severity", "p_toxic"])
            yield out.assign(rejected=out.p_toxic >= reject)

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return documents.withColumn(name, F.pandas_udf(run, "severity double, p_toxic double, rejected boolean")("text"))


def drop_toxic(documents: DataFrame, labels: DataFrame, reject: float = 0.5) -> DataFrame:
    """documents less the rejected ones."""
    name = free_name(documents, "_toxicity")
    return score(documents, fit(documents, labels), reject, name).where(f"not {name}.rejected").drop(name)
