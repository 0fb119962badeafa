"""Toxicity by multiple-instance learning.

Only documents carry labels. A sentence's probability is a logistic function
of its words' hashed n-grams; a document's is the noisy-or of its sentences
(toxic if any sentence is). The model is fitted to document labels through the
noisy-or, and the fitted sentence scores then locate the offending sentences.

Defined results: a text without words (null, empty, only signs) scores 0 and
has no spans; repeated rows, null ids and extra columns are kept as they are;
without any labelled document, or with labels of one class only, the model is
the constant prior of sentences that gives that share. Fitting uses at most
``ROWS`` labelled documents (together up to ``labelled.SAMPLE_BYTES``); scoring reads
every text whole.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, shielded
from .labelled import labelled_sample
from .wordgrams import WORD, Adam, Vocabulary, WordScores, sigmoid

ROWS = 6000
DIMS = 1 << 16
LOW, HIGH = 3, 2        # stems and whole words, no inner n-grams
STEPS, RATE = 300, 0.1
DECAY = 1e-4            # L1: words that only label noise explains go to zero
THRESHOLD = 0.5
START, SMOOTH, MIN_DOCS = 1.0, 5.0, 5
POSITIVE = 2.0          # weight of a positive document, the rarer class
SENTENCE = re.compile(r"[^.!?\n\r。！？]+[.!?。！？]*")


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def scorer(self):
        return WordScores(self.weights.astype(np.float64), LOW, HIGH)


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of every sentence that has a word."""
    out = []
    for m in SENTENCE.finditer(text):
        words = WORD.findall(m.group())
        if words:
            out.append((m.start(), m.end(), words))
    return out


def _log_odds(vocabulary: Vocabulary, word: np.ndarray, doc: np.ndarray, y: np.ndarray):
    """Smoothed log odds of a slot's presence in positive documents, and the
    slots present in ``MIN_DOCS`` documents (the others stay at zero). The
    start: from zero, the noisy-or credits the first words it finds and never
    learns the others that stand beside them."""
    begin = np.concatenate([[0], np.cumsum(vocabulary.sizes, dtype=np.int64)])
    hit, seen = np.zeros(vocabulary.dims), np.zeros(vocabulary.dims)
    cuts = np.searchsorted(doc, np.arange(0, len(y) + 200, 200))   # 200 documents at a time
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        pairs = np.unique(doc[lo:hi].astype(np.int64) << 32 | word[lo:hi])
        w = pairs & 0xFFFFFFFF
        reps = vocabulary.sizes[w]
        step = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        slot = vocabulary.slots[np.repeat(begin[w], reps) + step]
        both = np.unique(np.repeat(pairs >> 32, reps) * vocabulary.dims + slot)
        slot = both % vocabulary.dims
        hit += np.bincount(slot, y[both // vocabulary.dims], vocabulary.dims)
        seen += np.bincount(slot, minlength=vocabulary.dims)
    base = y.mean()
    odds = np.log((hit + SMOOTH * base) / base) - np.log((seen - hit + SMOOTH * (1 - base)) / (1 - base))
    return np.where(seen >= MIN_DOCS, odds, 0.0), seen >= MIN_DOCS


def fit(sample: list[tuple[str, int]], dims: int = DIMS, steps: int = STEPS,
        rate: float = RATE, decay: float = DECAY) -> ToxicityModel:
    """Fit sentence weights to document labels through the noisy-or."""
    vocabulary = Vocabulary(LOW, HIGH, dims)
    bags: dict[tuple[str, int], int] = {}
    for pair in sample:                      # copies of one text count once
        bags[pair] = 1
    word, sentence_of, doc_of, y, n_sentences = array("i"), array("i"), array("i"), [], 0
    for text, label in bags:
        found = sentences(text)
        if not found:
            continue
        for _, _, words in found:
            word.extend(vocabulary.ids(words))
            sentence_of.extend([n_sentences] * len(words))
            doc_of.append(len(y))
            n_sentences += 1
        y.append(label)
    y = np.array(y, float)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return ToxicityModel(np.zeros(dims), -30.0 if share == 0 else 30.0)
    vocabulary.freeze()
    word, sentence_of, doc_of = (np.array(x, np.int32) for x in (word, sentence_of, doc_of))
    per_doc = n_sentences / len(y)
    x = np.zeros(dims + 1)
    odds, used = _log_odds(vocabulary, word, doc_of[sentence_of], y)
    x[:dims] = START * odds
    x[-1] = np.log(share / per_doc)
    adam = Adam(dims + 1, rate)
    for i in range(steps):
        adam.rate = rate * 0.5 * (1 + np.cos(np.pi * i / steps))
        scores = vocabulary.scores(x[:dims])
        z = np.bincount(sentence_of, scores[word], n_sentences) + x[-1]
        # log(1 - p_doc) = -sum softplus(z); stable on both ends
        stay = np.bincount(doc_of, -np.logaddexp(0, z), len(y))
        p = -np.expm1(stay)
        # d loss / d stay: positives -(1 - p) / p, negatives 1, times -1
        slope = np.where(y > 0, POSITIVE * np.exp(stay) / np.maximum(p, 1e-12), -1.0) / len(y)
        dz = -slope[doc_of] * sigmoid(z)
        dword = np.bincount(word, dz[sentence_of], len(scores))
        grad = np.concatenate([used * vocabulary.back(dword) + decay * np.sign(x[:dims]), [dz.sum()]])
        x = adam.step(x, grad)
    return ToxicityModel(x[:dims], float(x[-1]))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD,
          text: str = "text") -> DataFrame:
    """Append ``score`` (noisy-or), ``predicted`` and ``offending``: spans
    (start, end, score) of sentences whose own probability reaches the
    threshold, or, in a document that reaches it only jointly, its highest
    sentence. Offsets are in characters of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    memo: dict = {}

    def run(texts):
        weights, bias = shared.value
        table = memo.get("t")
        if table is None:
            table = memo["t"] = ToxicityModel(weights, bias).scorer()
        look = table.__getitem__
        scores, flags, spans = [], [], []
        for t in texts:
            found = sentences(t) if t else []
            if not found:
                scores.append(0.0)
                flags.append(0)
                spans.append([])
                continue
            z = np.fromiter((sum(map(look, w)) for _, _, w in found), float, len(found)) + bias
            p = sigmoid(z)
            s = float(-np.expm1(-np.logaddexp(0, z).sum()))
            hot = np.flatnonzero(p >= threshold)
            if s >= threshold and not len(hot):
                hot = [int(p.argmax())]
            scores.append(s)
            flags.append(int(s >= threshold))
            spans.append([{"start": found[i][0], "end": found[i][1], "score": float(p[i])} for i in hot])
        return scores, pa.array(flags, pa.int32()), pa.array(spans, span)

    schema = "score double, predicted int, offending array<struct<start:int,end:int,score:double>>"
    return shielded(docs, [text], lambda d: map_texts(d, [text], run, schema),
                    ("score", "predicted", "offending"))


def train(docs: DataFrame, labels: DataFrame, fold: Column | None = None, rows: int = ROWS,
          label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Fit on at most ``rows`` labelled documents whose id ``fold`` admits."""
    return fit(labelled_sample(docs, labels, label, rows, fold, doc_id=doc_id, text=text))


def classify(docs: DataFrame, labels: DataFrame, fold: Column | None = None,
             rows: int = ROWS, threshold: float = THRESHOLD, label: str = "toxic",
             doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fit on the labelled documents whose id ``fold`` admits, score all."""
    return score(docs, train(docs, labels, fold, rows, label, doc_id, text), threshold, text)


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD,
               text: str = "text") -> DataFrame:
    """The documents that the model does not predict toxic, all columns kept."""
    def run(d):
        return score(d, model, threshold, text).where(F.col("predicted") == 0).select(*d.columns)
    return shielded(docs, [text], run)
