"""Toxicity scoring by non-negative positive-unlabelled (nnPU) learning.

A linear classifier over word-presence features is trained with numpy from
*confirmed toxic* texts (P) and *unlabelled* texts (U) only.  The risk is the
class-prior-corrected estimator of Kiryo et al. (2017)

    R(f) = pi * E_P[l(f)] + max(0, E_U[l(-f)] - pi * E_P[l(-f)])

whose second term estimates the risk on the unseen negatives and is kept
non-negative, which stops the model from memorising P.  The decision value is then moved to where PU data
estimate the best F1, so that ``threshold`` is the cut.  ``pi`` is a parameter or, when labels exist, the toxic share of the labelled learnable rows.

Scale: training uses a bounded, hash-ordered sample (``max_positive`` and
``max_unlabelled`` documents, a documented parameter; each sampled text is
reduced to its word set on the executors, and only words that are frequent
enough come to the driver).  Scoring covers every row in one Arrow pass without
a shuffle; the model shipped to the executors has at most ``max_features``
words.

Defined results: a null or empty text scores ``sigmoid(bias)``; extra columns
of the input are ignored; a table without any positive example gives a model
without features whose score is ``pi`` for every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.scratch import materialize

#: Every ASCII byte that is neither a letter nor a digit separates words.
_SEPARATORS = bytes(b if (b >= 128 or chr(b).isalnum()) else 32 for b in range(256))


@dataclass(frozen=True)
class ToxicityConfig:
    #: Bounds of the training sample, in documents.
    max_positive: int = 6000
    max_unlabelled: int = 18000
    #: Words kept after selection; the size bound of the broadcast model.
    max_features: int = 4096
    #: A word must occur in so many sampled documents to become a feature.
    min_documents: int = 4
    #: Minimum two-sample z score between P and U for a feature.
    min_z: float = 4.5
    class_prior: float | None = None
    iterations: int = 600
    learning_rate: float = 0.1
    l2: float = 1e-4
    #: Slack below zero at which the negative risk is corrected.
    beta: float = 0.0
    threshold: float = 0.7


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = 0.0

    def raw(self, text: str | None) -> float:
        return self.bias + sum(map(self.weights.get, self.weights.keys() & words(text)))

    def score(self, text: str | None) -> float:
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.raw(text), -60, 60))))


def words(text: str | None) -> set[bytes]:
    """Distinct lower-cased words of a whole text."""
    return set(text.lower().encode().translate(_SEPARATORS).split()) if text else set()


def _word_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"positive": pdf["positive"], "words": [[w.decode() for w in sorted(words(t))] for t in pdf["text"]]})


@dataclass(frozen=True)
class Sample:
    """P and U over a common vocabulary: for each document the numbers of the features it has."""

    vocabulary: list[bytes]
    positive: list[list[int]]
    unlabelled: list[list[int]]
    prior: float


def training_sample(docs: DataFrame, labels: DataFrame, config: ToxicityConfig) -> Sample:
    """The bounded training sample.

    ``labels`` holds only rows that may be learned from.  U is drawn from
    ``docs`` without looking at a label.  Word counts and the choice of features
    are made by the executors; only the chosen features and, for each sampled
    document, their numbers come to the driver.
    """
    labelled = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    ids = docs.select("doc_id").where("doc_id is not null")
    positive = ids.join(labelled.where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    parts = [d.distinct().orderBy(order, "doc_id").limit(n).withColumn("positive", F.lit(v)) for d, n, v in ((positive, config.max_positive, 1), (ids, config.max_unlabelled, 0))]
    chosen = materialize(parts[0].unionByName(parts[1]), "sample-ids")
    # at most max_positive + max_unlabelled ids, so the texts needn't be shuffled
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("positive", "text")
    rows = materialize(texts.mapInPandas(_word_sets, "positive int, words array<string>"), "sample-words")
    vocabulary = select_features(rows, config)
    number = {w: i for i, w in enumerate(vocabulary)}

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"positive": pdf["positive"], "features": [[number[w] for w in ws if w in number] for ws in pdf["words"]]})

    found = rows.mapInPandas(numbered, "positive int, features array<int>").toPandas()
    prior = config.class_prior if config.class_prior is not None else float(labelled.agg(F.avg("toxic")).first()[0] or 0.0)
    groups = [found.loc[found["positive"] == v, "features"].tolist() for v in (1, 0)]
    return Sample([w.encode() for w in vocabulary], groups[0], groups[1], prior)


def select_features(rows: DataFrame, config: ToxicityConfig) -> list[str]:
    """Words whose document frequency is significantly higher or lower in P than in U, the surest first."""
    size = {r["positive"]: r["n"] for r in rows.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = max(size.get(1, 0), 1), max(size.get(0, 0), 1)
    counts = rows.select("positive", F.explode("words").alias("word")).groupBy("word").agg(F.sum("positive").alias("p"), F.count(F.lit(1)).alias("n"))
    pooled = F.col("n") / (n_p + n_u)
    spread = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * (1 / n_p + 1 / n_u))
    z = F.abs(F.col("p") / n_p - (F.col("n") - F.col("p")) / n_u) / spread
    sure = counts.where(F.col("n") >= config.min_documents).withColumn("z", z).where(F.col("z") >= config.min_z)
    return [r["word"] for r in sure.orderBy(F.desc("z"), "word").limit(config.max_features).collect()]


class _Sparse:
    """Binary document-by-feature matrix in compressed rows."""

    def __init__(self, docs: list[list[int]], width: int):
        self.rows = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        self.cols = np.fromiter((i for d in docs for i in d), dtype=np.int64)
        self.n, self.width = len(docs), width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=w[self.cols], minlength=self.n)

    def t_dot(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, weights=g[self.rows], minlength=self.width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def fit_nnpu(sample: Sample, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Minimise the non-negative PU risk with the logistic loss by Adam on the whole sample."""
    base = min(max(sample.prior, 1e-3), 1 - 1e-3)
    start = float(np.log(base / (1 - base)))
    if not sample.positive or not sample.unlabelled or not sample.vocabulary:
        return ToxicityModel({}, start)
    width = len(sample.vocabulary)
    p, u = _Sparse(sample.positive, width), _Sparse(sample.unlabelled, width)
    w = np.zeros(width + 1)
    w[-1] = start
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, config.iterations + 1):
        f_p, f_u = p.dot(w[:-1]) + w[-1], u.dot(w[:-1]) + w[-1]
        # l(z) = log(1 + exp(-z)); l'(f) = -sigmoid(-f); d/df l(-f) = sigmoid(f)
        s_p, s_u = _sigmoid(f_p), _sigmoid(f_u)
        negative_risk = np.logaddexp(0, f_u).mean() - base * np.logaddexp(0, f_p).mean()
        if negative_risk >= -config.beta:
            g_p = (base * (s_p - 1) - base * s_p) / p.n
            g_u = s_u / u.n
        else:  # step back on the part that has been over-fitted
            g_p, g_u = base * s_p / p.n, -s_u / u.n
        g = np.append(p.t_dot(g_p) + u.t_dot(g_u), g_p.sum() + g_u.sum())
        g[:-1] += config.l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= config.learning_rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    cut = best_cut(p.dot(w[:-1]) + w[-1], u.dot(w[:-1]) + w[-1], base)
    bias = float(w[-1] - cut + np.log(config.threshold / (1 - config.threshold)))
    return ToxicityModel({x: float(v) for x, v in zip(sample.vocabulary, w)}, bias)


def best_cut(f_p: np.ndarray, f_u: np.ndarray, prior: float) -> float:
    """Decision value that maximises F1 as PU data estimate it, 2 pi TPR / (PPR + pi).

    Among equally good values the middle of the widest such interval is taken.
    """
    values = np.unique(np.concatenate([f_p, f_u]))
    if len(values) < 2:
        return float(values[0]) if len(values) else 0.0
    cuts, gaps = (values[1:] + values[:-1]) / 2, np.diff(values)
    tpr = 1 - np.searchsorted(np.sort(f_p), cuts) / len(f_p)
    ppr = 1 - np.searchsorted(np.sort(f_u), cuts) / len(f_u)
    f1 = 2 * prior * tpr / (ppr + prior)
    best = np.flatnonzero(f1 >= f1.max() - 1e-3)
    return float(np.average(cuts[best], weights=gaps[best]))


def train(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    return fit_nnpu(training_sample(docs, labels, config), config)


def score_of(docs: DataFrame, model: ToxicityModel, text: str = "text") -> Column:
    """The score of a text column, computed in Arrow batches with the shipped model."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shipped.value
        for texts in batches:
            yield pd.Series([own.score(t) for t in texts], dtype="float64")

    return toxic_score(F.col(text))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = ToxicityConfig.threshold) -> DataFrame:
    """``docs`` with ``score`` (double) and ``predicted`` (int); clashing input columns are replaced."""
    scored = docs.withColumn("score", score_of(docs, model, text))
    return scored.withColumn("predicted", (F.col("score") >= F.lit(threshold)).cast("int"))


def keep(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = ToxicityConfig.threshold) -> DataFrame:
    """The documents whose score is below the threshold, with exactly their own columns."""
    return docs.where(score_of(docs, model, text) < F.lit(threshold))


def learnable(labels: DataFrame) -> DataFrame:
    """Rows whose label may be learned: crc32 of the id as text, modulo 3, is not 1."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
