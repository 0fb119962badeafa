"""Quality rules: fixed base rules, then gradient-boosted trees over document
statistics.

Trees are grown on histograms (quantile bins) with the logistic loss. Chosen
statistics are monotonic: a split on one is allowed only if the side with more
of it does not get the higher value (or the lower, for +1), and the midpoint
bounds all values below the split, so the whole ensemble is monotonic. The
fitted ensemble is flattened into node arrays and scored for a whole batch at
once, one level of all trees at a time.

Defined results: a null text counts as empty, all counts zero, hence failed by
the base rules; without labels of both classes the trees are empty and every
document that passes the base rules is kept; repeated rows, null ids and extra
columns are kept as they are. The fit uses at most ``ROWS`` labelled texts;
statistics and verdicts read every text whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import map_texts, shielded
from .labelled import labelled_sample
from .textstats import BASE, NAMES, text_stats
from .wordgrams import sigmoid

ROWS = 6000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
TREES, DEPTH, RATE, BINS, MIN_LEAF, RIDGE = 80, 4, 0.15, 64, 20, 1.0
THRESHOLD = 0.5
# more of these never makes a text better
MONOTONE = {"symbol_share": -1, "repeat_share": -1, "dup_line_share": -1, "upper_share": -1,
            "bang_share": -1, "bar_share": -1, "top_word_share": -1, "repeat_pair_share": -1}


@dataclass
class Trees:
    """Flat node arrays; a leaf points to itself. ``root`` has one entry a tree."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    depth: int
    start: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        if not len(self.root):
            return np.full(len(x), self.start)
        node = np.repeat(self.root[None, :], len(x), axis=0)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            below = x[row, self.feature[node]] <= self.threshold[node]
            node = np.where(below, self.left[node], self.right[node])
        return self.start + self.value[node].sum(axis=1)


class _Grower:
    def __init__(self, x: np.ndarray, signs: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
                      for c in x.T]
        self.binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1)
        self.signs = signs
        self.nodes: list[list] = []   # feature, threshold, left, right, value
        self.roots: list[int] = []

    def _leaf(self, value: float) -> int:
        i = len(self.nodes)
        self.nodes.append([0, 0.0, i, i, value * RATE])
        return i

    def grow(self, rows, grad, hess, depth, low, high) -> tuple[int, list]:
        """Node number and (rows, node) of the leaves below it."""
        g, h = grad[rows].sum(), hess[rows].sum()
        value = float(np.clip(-g / (h + RIDGE), low, high))
        best = None
        if depth and len(rows) >= 2 * MIN_LEAF:
            for j, edges in enumerate(self.edges):
                if not len(edges):
                    continue
                b = self.binned[rows, j]
                size = len(edges) + 1
                gl = np.cumsum(np.bincount(b, grad[rows], size))[:-1]
                hl = np.cumsum(np.bincount(b, hess[rows], size))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=size))[:-1]
                vl = np.clip(-gl / (hl + RIDGE), low, high)
                vr = np.clip(-(g - gl) / (h - hl + RIDGE), low, high)
                gain = -(gl * vl + 0.5 * (hl + RIDGE) * vl**2) - ((g - gl) * vr + 0.5 * (h - hl + RIDGE) * vr**2)
                ok = (nl >= MIN_LEAF) & (len(rows) - nl >= MIN_LEAF)
                if self.signs[j]:
                    ok &= (vr - vl) * self.signs[j] >= 0
                gain = np.where(ok, gain, -np.inf)
                k = int(np.argmax(gain))
                if best is None or gain[k] > best[0]:
                    best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
        base = -(g * value + 0.5 * (h + RIDGE) * value**2)
        if best is None or not np.isfinite(best[0]) or best[0] <= base + 1e-6:
            i = self._leaf(value)
            return i, [(rows, i)]
        _, j, k, vl, vr = best
        i = len(self.nodes)
        self.nodes.append([j, float(self.edges[j][k]), -1, -1, 0.0])
        mid = (vl + vr) / 2
        sides = [(low, high), (low, high)]
        if self.signs[j] > 0:
            sides = [(low, mid), (mid, high)]
        elif self.signs[j] < 0:
            sides = [(mid, high), (low, mid)]
        below = self.binned[rows, j] <= k
        left, a = self.grow(rows[below], grad, hess, depth - 1, *sides[0])
        right, b = self.grow(rows[~below], grad, hess, depth - 1, *sides[1])
        self.nodes[i][2:4] = [left, right]
        return i, a + b


def fit(x: np.ndarray, y: np.ndarray, names=NAMES, monotone: dict | None = None) -> Trees:
    """Fit on rows of statistics; ``monotone`` maps names to +1 or -1."""
    signs = np.array([(MONOTONE if monotone is None else monotone).get(n, 0) for n in names])
    share = float(np.mean(y)) if len(y) else 1.0
    empty = np.zeros(0, np.int64)
    if not 0 < share < 1:
        return Trees(empty, np.zeros(0), empty, empty, np.zeros(0), empty, 0, 30.0 if share else -30.0)
    start = float(np.log(share / (1 - share)))
    grower = _Grower(x, signs)
    z = np.full(len(y), start)
    for _ in range(TREES):
        p = sigmoid(z)
        root, leaves = grower.grow(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-9), DEPTH,
                                   -np.inf, np.inf)
        grower.roots.append(root)
        for rows, leaf in leaves:
            z[rows] += grower.nodes[leaf][4]
    f, t, left, right, v = zip(*grower.nodes, strict=True)
    return Trees(np.array(f), np.array(t), np.array(left), np.array(right), np.array(v),
                 np.array(grower.roots), DEPTH, start)


def judge(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Append the base counts, ``base_failed``, ``score`` (of the trees) and ``kept``."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(texts):
        rows = [text_stats(t) for t in texts]
        x = np.array(rows, float).reshape(-1, len(NAMES))
        base = [np.array([r[i] for r in rows], np.int64) for i in range(len(BASE))]
        n_words, repeat = base[0], base[4]
        failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
        s = sigmoid(shared.value.logit(x))
        return [*map(pa.array, base), pa.array(failed), pa.array(s), pa.array(~failed & (s >= threshold))]

    schema = ", ".join(f"{b} long" for b in BASE) + ", base_failed boolean, score double, kept boolean"
    return shielded(docs, [text], lambda d: map_texts(d, [text], run, schema),
                    (*BASE, "base_failed", "score", "kept"))


def filter_quality(docs: DataFrame, labels: DataFrame, train: Column | None = None,
                   rows: int = ROWS, threshold: float = THRESHOLD, label: str = "quality",
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fit the trees on labelled documents and judge all (nothing is dropped;
    ``kept`` holds the verdict)."""
    sample = labelled_sample(docs, labels, label, rows, train, doc_id=doc_id, text=text)
    x = np.array([text_stats(t) for t, _ in sample], float).reshape(-1, len(NAMES))
    trees = fit(x, np.array([y for _, y in sample], float))
    return judge(docs, trees, threshold, text)
