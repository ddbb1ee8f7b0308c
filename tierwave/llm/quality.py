"""Quality: Bradley-Terry scores learnt from preference pairs.

A document's features are shares and rates of its text: kinds of characters, word lengths, repetition of words and of
lines. Preference pairs put a labelled document of quality 1 before one of quality 0; logistic loss on the difference
of their features gives the weights, so that a document's strength is w . x. The strength is cut where the share of
quality 0 among the training labels says (a quantile of the training strengths, taken between the classes), and mapped
by a logistic curve that puts this cut at `cut` (0.3).

The fit uses at most `sample` labelled documents (those of least hash; held-out ones never), `pairs` pairs, on the
driver: the features of each are some 30 numbers. Scoring covers whole texts of all documents.

Cases: null and empty texts have the features of no text and are scored by them; labels of null quality, of null or
unknown doc_id are left out; of repeated labels of a document the least counts; without both classes every score is 1;
repeated rows are scored each; texts may have any length; empty tables give no rows; a column `score` is replaced, other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

KINDS = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "space": b" \t", "line": b"\n", "stop": b".,", "pipe": b"|", "mark": b"!?",
    "odd": b"#$%&*+/<=>@\\^_`{}~", "colon": b":;", "quote": b"\"'()[]-", "wide": bytes(range(128, 256)), "control": bytes([*range(9), *range(11, 32), 127]),
}
_TABLE = np.zeros((256, len(KINDS)))
for _i, _k in enumerate(KINDS.values()):
    _TABLE[list(_k), _i] = 1


def features(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return np.zeros(WIDTH)
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _TABLE / n
    words = text.split()
    k = max(len(words), 1)
    lines = text.split("\n")
    counts = Counter(words)
    distinct = len(counts) / k
    runs = sum(a == b for a, b in zip(words, words[1:])) / k  # noqa: B905
    top = max(counts.values(), default=0) / k
    # Words of two letters and more end in a letter or a sentence's marks, unless something was put behind them.
    tails = sum(1 for w in words if w[-1] in "#$%&*+/<=>@|!") / k
    capitals = sum(map(str.isupper, words)) / k
    mean = min(sum(map(len, words)) / k, 40) / 40
    repeated = 1 - len(set(lines)) / len(lines)
    size = np.log1p(k)
    extra = [distinct, runs, top, tails, capitals, mean, repeated, size / 10, 1 / (1 + k), max(map(len, words), default=0) > 60, np.sqrt(runs), np.sqrt(tails), (1 - distinct) * size / 10]
    return np.concatenate([share, np.sqrt(share), np.array(extra, float)])


WIDTH = 2 * len(KINDS) + 13


@dataclass
class StrengthModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    cut: float = 0.3

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.ones(len(x))
        raw = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw - self.threshold) + np.log(self.cut / (1 - self.cut)), -35, 35)))


def _sample(documents: DataFrame, labels: DataFrame, training: Column, sample: int):
    said = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & training).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    # A bounded sample, drawn from the labels, so that its few ids, and not the texts, are dealt out.
    few = said.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = documents.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).orderBy("doc_id")

    def run(texts: Iterator) -> Iterator:
        import pandas as pd

        for t in texts:
            yield pd.Series([features(x).tolist() for x in t])

    import pandas as pd

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    rows = chosen.select("quality", F.pandas_udf(run, "array<double>")("text").alias("x")).collect()
    return np.array([r["x"] for r in rows]).reshape(-1, WIDTH), np.array([r["quality"] for r in rows], int)


def fit(documents: DataFrame, labels: DataFrame, training: Column | None = None, sample: int = 8_000, pairs: int = 40_000, rounds: int = 300, ridge: float = 1e-3, cut: float = 0.3) -> StrengthModel:
    """training: which labels (by their columns) may be used; all by default."""
    bound_batches(documents.sparkSession)
    x, y = _sample(documents, labels, F.lit(True) if training is None else training, sample)
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
    good, bad = np.flatnonzero(y > 0), np.flatnonzero(y <= 0)
    if not len(good) or not len(bad):
        return StrengthModel(mean, scale, np.zeros(0), 0.0, 1.0, cut)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(17)
    diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w, v = np.zeros(WIDTH), np.zeros(WIDTH)
    step = 4 / np.linalg.eigvalsh(diff.T @ diff / pairs)[-1]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -35, 35)))  # chance of the wrong order
        v = 0.9 * v + 0.5 * step * (diff.T @ p / pairs - ridge * w)
        w = w + v
    raw = z @ w
    # The quantile of the strengths that the share of quality 0 names, moved to the middle of the gap beside it.
    order = np.sort(raw)
    k = len(bad)
    threshold = (order[max(k - 1, 0)] + order[min(k, len(order) - 1)]) / 2
    slope = 4 / max(np.median(raw[good]) - np.median(raw[bad]), 1e-6)
    return StrengthModel(mean, scale, w, float(threshold), float(slope), cut)


def score(documents: DataFrame, model: StrengthModel, name: str = "score") -> DataFrame:
    """documents with the column `name` (0 to 1); predicted quality is 1 from model.cut on."""
    import pandas as pd

    bound_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(shared.value.score(np.array([features(x) for x in t]).reshape(-1, WIDTH)))

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return documents.withColumn(name, F.pandas_udf(run, "double")("text"))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether the CRC-32 of doc_id as text leaves no remainder; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0
