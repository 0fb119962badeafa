"""Quality classifier by positive-unlabelled learning.

Trusted positives (documents marked good) and unlabelled text are all it
learns from; documents marked bad are ordinary unlabelled ones. The class
prior of the unlabelled text is estimated first: a plain positive-against-
unlabelled classifier is fitted on one half, and on the other half the
smallest ratio of the two classes' upper tails bounds the prior (the best-bin
estimate). Then the non-negative unbiased risk

    prior * E+[loss(f)] + max(0, Eu[loss(-f)] - prior * E+[loss(-f)])

is minimised; when the second part turns negative its gradient is followed
backwards (the usual correction). The model is additive over quantile bins of
document statistics.

Defined results: null and empty texts have all statistics zero and get the
score of that point; without any positive, or without any unlabelled text, the
score is 0.5 for all; repeated rows, null ids and extra columns are kept as
they are. The fit uses at most ``ROWS`` positives and ``ROWS`` unlabelled
texts; scoring reads every text whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, shielded
from .labelled import SAMPLE_BYTES, among_smallest, labelled_sample, texts_in_budget
from .textstats import NAMES, text_stats
from .wordgrams import Adam, sigmoid

ROWS = 4000
BINS = 12
STEPS, RATE = 1500, 0.1
DECAY, DECAY_ROWS = 1e-4, 2.0   # L2; at least DECAY_ROWS / rows, so that small samples are smoothed
THRESHOLD = 0.7


@dataclass
class PUModel:
    edges: list          # per statistic: increasing bin edges
    weights: np.ndarray  # one per bin, then the bias
    prior: float

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Bin number of every statistic, as columns of one index matrix."""
        out = np.empty(stats.shape, np.int64)
        base = 0
        for j, edges in enumerate(self.edges):
            out[:, j] = base + np.searchsorted(edges, stats[:, j], side="right")
            base += len(edges) + 1
        return out

    def logit(self, stats: np.ndarray) -> np.ndarray:
        return self.weights[self.features(stats)].sum(axis=1) + self.weights[-1]


def _edges(values: np.ndarray) -> np.ndarray:
    """Quantile edges; the largest values keep bins of their own, so that
    rare extremes are seen."""
    q = np.concatenate([np.linspace(0, 1, BINS + 1)[1:-1], [0.95, 0.98, 0.99]])
    return np.unique(np.quantile(values, q))


def _descend(x, index, weight_grad, steps=STEPS):
    adam = Adam(len(x), RATE)
    decay = max(DECAY, DECAY_ROWS / len(index))
    for _ in range(steps):
        z = x[index].sum(axis=1) + x[-1]
        slope = weight_grad(z)
        grad = np.bincount(index.ravel(), np.repeat(slope, index.shape[1]), len(x))
        grad[-1] = slope.sum()
        x = adam.step(x, grad + decay * np.append(x[:-1], 0.0))
    return x


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """Best-bin estimate from held-out scores: min over thresholds of the tail
    ratio, each widened by its sampling error."""
    n_p, n_u = len(positive), len(unlabelled)
    cuts = np.unique(np.quantile(positive, np.linspace(0, 0.98, 200)))
    p = (positive[None, :] >= cuts[:, None]).mean(axis=1)
    u = (unlabelled[None, :] >= cuts[:, None]).mean(axis=1)
    err = np.sqrt(np.log(4 / confidence) / 2)
    bound = (u + err / np.sqrt(n_u) + p * 0 + err / np.sqrt(n_p)) / np.maximum(p, 1e-9)
    best = int(np.argmin(bound))
    return float(np.clip(u[best] / max(p[best], 1e-9), 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> PUModel:
    """Fit on statistics (rows of ``textstats.NAMES``) of both samples."""
    if not len(positive) or not len(unlabelled):
        return PUModel([np.zeros(0)] * len(NAMES), np.zeros(len(NAMES) + 1), 0.5)
    edges = [_edges(c) for c in np.concatenate([positive, unlabelled]).T]
    size = sum(len(e) + 1 for e in edges) + 1
    model = PUModel(edges, np.zeros(size), 0.5)
    ip, iu = model.features(positive), model.features(unlabelled)

    # 1. prior: positives against unlabelled on the even rows, tails on the odd
    half = np.concatenate([ip[::2], iu[::2]])
    n_p, n_u = len(ip[::2]), len(iu[::2])
    target = np.concatenate([np.ones(n_p), np.zeros(n_u)])
    mass = np.concatenate([np.full(n_p, 0.5 / n_p), np.full(n_u, 0.5 / n_u)])
    x = _descend(np.zeros(size), half, lambda z: mass * (sigmoid(z) - target))
    held_p, held_u = (ip[1::2], iu[1::2]) if len(ip) > 1 and len(iu) > 1 else (ip, iu)
    prior = estimate_prior(x[held_p].sum(axis=1), x[held_u].sum(axis=1))

    # 2. non-negative risk, logistic loss
    index = np.concatenate([ip, iu])
    is_p = np.arange(len(index)) < len(ip)
    n_p, n_u = len(ip), len(iu)

    def slope(z):
        s = sigmoid(z)
        negative = np.logaddexp(0, z)                 # loss(-f)
        rest = negative[~is_p].mean() - prior * negative[is_p].mean()
        part = np.where(is_p, -prior * s / n_p, s / n_u)   # gradient of ``rest``
        if rest < 0:
            return -part
        return part + np.where(is_p, prior * (s - 1) / n_p, 0.0)

    model.weights = _descend(np.zeros(size), index, slope)
    model.prior = prior
    return model


def stats_matrix(texts) -> np.ndarray:
    return np.array([text_stats(t) for t in texts], float).reshape(-1, len(NAMES))


def unlabelled_sample(docs: DataFrame, rows: int, fold: Column | None = None,
                      max_bytes: int = SAMPLE_BYTES, doc_id: str = "doc_id", text: str = "text") -> list[str]:
    """At most ``rows`` texts of at most ``max_bytes`` together by a hash of id
    and text, labels unseen."""
    part = docs if fold is None else docs.where(fold)
    texts = (part.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
             .select(F.xxhash64("_id", "_t").alias("_h"), "_t"))
    near = among_smallest(texts, rows, F.col("_h"))
    first = texts.where(near).select("_h").distinct().orderBy("_h").limit(rows)     # hashes only in one task
    chosen = texts.where(near).join(F.broadcast(first), "_h").groupBy("_h").agg(F.min("_t").alias("_t"))
    got = texts_in_budget(chosen, "_t", ["_h"], max_bytes)
    return [r["_t"] for r in sorted(got, key=lambda r: (r["_h"], r["_t"]))]


def score(docs: DataFrame, model: PUModel, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Append ``score`` (probability of good text) and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        s = sigmoid(shared.value.logit(stats_matrix(texts)))
        return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

    return shielded(docs, [text], lambda d: map_texts(d, [text], run, "score double, predicted int"),
                    ("score", "predicted"))


def classify(docs: DataFrame, labels: DataFrame, train: Column | None = None, rows: int = ROWS,
             threshold: float = THRESHOLD, label: str = "quality", doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """Fit on positives and unlabelled texts whose id ``train`` admits, score
    all. Only label 1 is ever read."""
    positives = [t for t, _ in labelled_sample(docs, labels.where(F.col(label) == 1), label, rows,
                                               train, doc_id=doc_id, text=text)]
    others = unlabelled_sample(docs, rows, train, doc_id=doc_id, text=text)
    return score(docs, fit(stats_matrix(positives), stats_matrix(others)), threshold, text)
