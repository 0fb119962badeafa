"""Hashed character n-grams of words, and additive word scores.

A word is lower-cased, wrapped in boundary marks and cut into n-grams, its
beginnings (stems up to ``STEM`` characters) and the whole word; each is
hashed into ``dims`` slots. A word's score is the sum of its slots' weights
over the root of their number. Models built on
this are linear in the word, so scoring a text is one table look-up per word:
``WordScores`` fills the table on demand and stays within a bounded size.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable

import numpy as np

STEM = 9
WORD = re.compile(r"[^\W_]+")


def gram_ids(word: str, low: int, high: int, dims: int) -> list[int]:
    """Slots of the n-grams (``low`` to ``high`` characters) of one word."""
    w = f"<{word.lower()}>"
    n = len(w)
    crc = zlib.crc32
    out = [crc(w.encode("utf-8", "surrogatepass")) % dims]
    out += [crc(w[:i].encode("utf-8", "surrogatepass"), 99) % dims
            for i in range(high + 1, min(STEM + 1, n))]
    for size in range(low, min(high, n) + 1):
        out += [crc(w[i:i + size].encode("utf-8", "surrogatepass"), size) % dims
                for i in range(n - size + 1)]
    return out


def bulk_grams(words: list[str], low: int, high: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot, word number) of the n-grams of many words at once, with a mark
    at both ends of a word. Words must not hold a line feed. Its own hashing,
    apart from :func:`gram_ids`; numpy passes over all code points, so a new
    word costs little. The pairs come sorted by word, and every word has one."""
    text = "\n" + "\n".join(words).lower() + "\n"
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mark = np.flatnonzero(code == 10)
    n = len(code)
    owner = np.cumsum(code == 10) - 1                  # the mark before a word belongs to it
    end = mark[np.minimum(owner + 1, len(mark) - 1)]   # the mark after it
    slots, owners = [], []
    h = code + np.uint64(1)
    for size in range(2, high + 1):
        h = h[:n - size + 1] * np.uint64(0x9E3779B97F4A7C15) + code[size - 1:] + np.uint64(1)
        if size < low:
            continue
        at = np.flatnonzero(np.arange(n - size + 1) + size - 1 <= end[:n - size + 1])
        if size == low:                                # short words: the pair of marks at least
            at = np.union1d(at, mark[:-1][np.diff(mark) < size - 1])
            at = at[at + size <= n]
        x = h[at] ^ np.uint64(size)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        slots.append(((x ^ (x >> np.uint64(32))) % np.uint64(dims)).astype(np.int64))
        owners.append(owner[at])
    slot, who = np.concatenate(slots), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    keep = who[order] < len(words)
    return slot[order][keep], who[order][keep]


class WordScores(dict):
    """word -> score of the word; emptied when
    it holds ``limit`` words, so memory is bounded on any vocabulary."""

    def __init__(self, weights: np.ndarray, low: int, high: int, limit: int = 300_000):
        super().__init__()
        self.weights, self.low, self.high, self.limit = weights, low, high, limit

    def __missing__(self, word: str):
        if len(self) >= self.limit:
            self.clear()
        ids = gram_ids(word, self.low, self.high, len(self.weights))
        got = self.weights[ids].sum(axis=0) / len(ids) ** 0.5
        value = float(got) if got.ndim == 0 else got
        self[word] = value
        return value


class Vocabulary:
    """Distinct words of a training sample and their n-gram slots, kept as two
    flat arrays so that one pass over the distinct words scores them all."""

    def __init__(self, low: int, high: int, dims: int):
        self.low, self.high, self.dims = low, high, dims
        self.index: dict[str, int] = {}
        self._slots, self._sizes = array("i"), array("i")

    def ids(self, words: Iterable[str]) -> list[int]:
        out = []
        for w in words:
            i = self.index.get(w)
            if i is None:
                i = self.index[w] = len(self.index)
                slots = gram_ids(w, self.low, self.high, self.dims)
                self._slots.extend(slots)
                self._sizes.append(len(slots))
            out.append(i)
        return out

    def freeze(self) -> None:
        self.sizes = np.array(self._sizes, np.int32)
        self.slots = np.array(self._slots, np.int32)
        self.owner = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.share = 1.0 / np.sqrt(np.maximum(self.sizes, 1))
        self._slots, self._sizes = array("i"), array("i")

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Score of every distinct word."""
        return np.bincount(self.owner, weights[self.slots], len(self.share)) * self.share

    def back(self, grad: np.ndarray) -> np.ndarray:
        """Gradient with respect to the slot weights."""
        return np.bincount(self.slots, (grad * self.share)[self.owner], self.dims)


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, x: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.02 * (grad * grad - self.v)
        return x - self.rate * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.98 ** self.t)) + 1e-8)


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x)))
