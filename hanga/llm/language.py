"""Language identification of mixed text.

Script ranges narrow the candidates of every word to the languages that were
seen in its script; each candidate gets a score for the word (smoothed log
probability of its hashed n-grams, relative to the best and bounded
below); Viterbi over the words with a penalty for every switch labels the
spans. The document's language is the one that labels most letters.

Most texts are of one language, and for those the best path is shown constant
without running the recursion. Let gains count against the best constant path.
A path with m stretches in other languages has at least m switches, or m - 1
if it never uses the constant's language. So no path with a switch wins if no
stretch gains more than a penalty, and a beginning and an end together do not
either.

Defined results: null texts and texts without a letter are ``und`` with score
0 and no spans; words of a script that no learned language uses leave all
languages as candidates with equal scores; without training rows every text is
``und``; ties go to the language first in the alphabet; repeated rows, null
ids and extra columns are kept as they are. The fit uses at most about
``ROWS`` labelled texts, dealt evenly over the languages; prediction reads
every text whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, shielded, small_side
from .labelled import texts_in_budget
from .wordgrams import bulk_grams

ROWS = 4000
MIN_ROWS = 20            # of a language, however many languages there are
DIMS = 1 << 15
LOW, HIGH = 2, 5
SMOOTH = 0.5
FLOOR = 4.0              # a word counts at most so much against a language
PENALTY = 8.0            # for a switch between words
MIN_SCRIPT_SHARE = 0.02  # of a language's words, to be a candidate in a script
TABLE = 150_000          # words remembered between groups of texts
CELLS = 1_000_000        # word scores of a group of texts labelled together
WORD = re.compile(r"[^\W\d_]+")

# First code points of script ranges (Unicode blocks).
SCRIPT_RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Other"),
    (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"),
    (0x3400, "Han"), (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Other"),
    (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB13, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Other"),
    (0x20000, "Han"), (0x32000, "Other"),
]
_STARTS = [a for a, _ in SCRIPT_RANGES]


def script_of(word: str) -> str:
    """Script of the word's first letter."""
    for c in word:
        if c.isalpha():
            return SCRIPT_RANGES[bisect_right(_STARTS, ord(c)) - 1][1]
    return "Other"


@dataclass
class LanguageModel:
    languages: list[str]
    logs: np.ndarray                    # slot x language log probabilities
    scripts: dict[str, np.ndarray]      # script -> languages seen in it (mask)


class WordTable:
    """Words met so far: a row of ``scores`` each (per language, best is 0) and
    their ``letters``; new words are scored in bulk."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)), np.float32)
        self.letters = np.zeros(0, np.int32)

    def ids(self, words: list[str]) -> np.ndarray:
        """Row numbers of the words (valid until the next call)."""
        if len(self.index) > TABLE:
            self._clear()
        index = self.index
        new = [w for w in set(words) if w not in index]
        for lo in range(0, len(new), 20_000):
            self._add(new[lo:lo + 20_000])
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def _add(self, words: list[str]) -> None:
        n = len(self.index)
        self.index.update(zip(words, range(n, n + len(words)), strict=True))
        size = n + len(words)
        if size > len(self.letters):
            more = max(size, 2 * len(self.letters)) - len(self.letters)
            self.scores = np.concatenate([self.scores, np.zeros((more, self.scores.shape[1]), np.float32)])
            self.letters = np.concatenate([self.letters, np.zeros(more, np.int32)])
        # isalpha of a whole word tells its letters in one step; the rest is rare
        letters = [len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in words]
        self.letters[n:size] = letters
        scripts = [script_of(w) if k else "" for w, k in zip(words, letters, strict=True)]
        slot, owner = bulk_grams(words, LOW, HIGH, len(self.model.logs))
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        rows = np.add.reduceat(self.model.logs[slot], first, axis=0)
        rows /= np.sqrt(np.diff(np.append(first, len(owner))))[:, None]
        masks = {s: m for s in set(scripts) if (m := self.model.scripts.get(s)) is not None}
        none = np.zeros(len(self.model.languages), bool)
        mask = np.array([masks.get(s, none) for s in scripts])
        rows = np.where(mask, rows, -np.inf)
        with np.errstate(invalid="ignore"):
            rows = np.maximum(rows - rows.max(axis=1, keepdims=True), -FLOOR)
        rows[~mask.any(axis=1)] = 0.0            # no candidate: equal scores
        self.scores[n:size] = rows


def best_path(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Language number of every word (Viterbi with a switching penalty)."""
    total = scores.sum(axis=0, dtype=np.float64)
    top = int(total.argmax())
    if constant_paths(scores, np.zeros(1, np.int64), penalty)[0] == top:
        return np.full(len(scores), top)
    n, k = scores.shape
    came = np.empty((n, k), np.int16)
    here = np.arange(k)
    value = scores[0].astype(np.float64)
    for t in range(1, n):
        best = int(value.argmax())
        jump = value[best] - penalty
        switch = value < jump
        came[t] = np.where(switch, best, here)
        value = np.where(switch, jump, value) + scores[t]
    path = np.empty(n, np.int64)
    path[-1] = int(value.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path


def constant_paths(scores: np.ndarray, starts: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """For many texts at once (rows ``starts[i]`` up to the next start): the
    language of the best path if it is shown constant, else -1."""
    n, k = scores.shape
    sizes = np.diff(np.append(starts, n))
    top = np.add.reduceat(scores, starts, axis=0, dtype=np.float64).argmax(axis=1)
    text = np.repeat(np.arange(len(starts)), sizes)
    gain = np.cumsum(scores - scores[np.arange(n), top[text]][:, None], axis=0, dtype=np.float64)
    before = np.concatenate([np.zeros((1, k)), gain[:-1]])[starts]   # sums up to each text
    gain -= before[text]
    # running minimum inside each text: later texts are shifted below earlier ones
    step = (np.ptp(gain) + 1.0) * text[:, None]
    low = np.minimum(np.minimum.accumulate(gain - step, axis=0) + step, 0.0)
    stretch = np.maximum.reduceat((gain - low).max(axis=1), starts)
    opening = np.maximum(np.maximum.reduceat(gain, starts, axis=0).max(axis=1), 0.0)
    ends = gain[starts + sizes - 1]
    closing = np.maximum(ends - np.minimum(np.minimum.reduceat(gain, starts, axis=0), 0.0), 0.0).max(axis=1)
    return np.where((stretch <= penalty) & (opening + closing <= penalty), top, -1)


def fit(sample: list[tuple[str, str]], dims: int = DIMS) -> LanguageModel:
    """Fit on (text, language) pairs."""
    languages = sorted({lang for _, lang in sample})
    counts = np.full((dims, len(languages)), SMOOTH)
    seen: dict[str, np.ndarray] = {}
    for k, lang in enumerate(languages):
        words: Counter = Counter()
        for text, of in sample:
            if of == lang:
                words.update(WORD.findall(text))
        if not words:
            continue
        names, times = list(words), np.array(list(words.values()), float)
        slot, owner = bulk_grams(names, LOW, HIGH, dims)
        counts[:, k] += np.bincount(slot, times[owner], dims)
        for w, n in zip(names, times, strict=True):
            seen.setdefault(script_of(w), np.zeros(len(languages)))[k] += n
    words_of = sum(seen.values()) if seen else np.zeros(len(languages))
    scripts = {s: m for s, v in seen.items()
               if (m := v >= MIN_SCRIPT_SHARE * np.maximum(words_of, 1)).any()}
    return LanguageModel(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32), scripts)


def training_rows(docs: DataFrame, train: Column | None, rows: int = ROWS, text: str = "text",
                  lang: str = "lang") -> list[tuple[str, str]]:
    """About ``rows`` (text, language) pairs, evenly over the languages, chosen
    by a hash of the text; at least ``MIN_ROWS`` of each language if it has
    them. All texts together keep to ``labelled.SAMPLE_BYTES``; every language
    has its first text considered before any has its second."""
    part = docs if train is None else docs.where(train)
    part = (part.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
            .select(F.col(text).alias("text"), F.col(lang).alias("lang")))
    u = F.xxhash64("text", F.lit(7))
    # copies count once: a large group of them must not thin out the other texts
    sizes = part.select("lang", u.alias("u")).distinct().groupBy("lang").agg(F.count("*").alias("n"))
    kinds = sizes.count()
    most = max(MIN_ROWS, rows // max(1, kinds))
    # of a large language only texts with a small hash are ranked, four times
    # as many as needed on average
    near = (u.cast("double") / float(1 << 63) + 1) / 2 * F.col("n") <= 4.0 * most
    by = Window.partitionBy("lang").orderBy(u, "text")
    chosen = (part.join(small_side(sizes, kinds, 64), "lang").where(near).dropDuplicates(["lang", "text"])
              .withColumn("_r", F.row_number().over(by))
              .where(F.col("_r") <= most).select("_r", "lang", "text"))
    got = texts_in_budget(chosen, "text", ["_r", "lang"])
    return sorted((r["text"], r["lang"]) for r in got)


def label_spans(docs: DataFrame, model: LanguageModel, penalty: float = PENALTY,
                text: str = "text") -> DataFrame:
    """Append ``lang_pred``, ``score`` (its share of the letters) and
    ``lang_spans`` (lang, start, end in characters; neighbours differ)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    memo: dict = {}

    def spans_of(t: str, path: np.ndarray, languages: list[str]):
        new = np.flatnonzero(np.diff(path)) + 1
        starts = [m.start() for m in WORD.finditer(t)]
        cuts = [0, *(starts[i] for i in new), len(t)]
        kinds = path[np.concatenate([[0], new])]
        return [{"lang": languages[k], "start": a, "end": b} for k, a, b in zip(kinds, cuts, cuts[1:], strict=False)]

    def label(group: list[tuple[int, str, list[str]]], table: WordTable, out: list) -> None:
        """Label the texts of ``group`` (place, text, words) together."""
        languages = table.model.languages
        sizes = np.array([len(w) for _, _, w in group])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        ids = table.ids([x for _, _, w in group for x in w])
        scores, letters = table.scores[ids], table.letters[ids]
        held = np.add.reduceat(letters, starts)
        top = constant_paths(scores, starts, penalty)
        for (at, t, words), lo, n, k in zip(group, starts.tolist(), held.tolist(), top.tolist(), strict=True):
            if n == 0:
                continue
            if k >= 0:
                out[at] = (languages[k], 1.0, [{"lang": languages[k], "start": 0, "end": len(t)}])
                continue
            hi = lo + len(words)
            path = best_path(scores[lo:hi], penalty)
            share = np.bincount(path, letters[lo:hi], len(languages))
            out[at] = (languages[int(share.argmax())], float(share.max() / n),
                       spans_of(t, path, languages))

    def run(texts):
        table = memo.get("t")
        if table is None:
            table = memo["t"] = WordTable(shared.value)
        got: list = [("und", 0.0, [])] * len(texts)
        group, cells = [], 0
        for at, t in enumerate(texts):
            words = WORD.findall(t) if t and table.model.languages else []
            if words:
                group.append((at, t, words))
                cells += len(words) * len(table.model.languages)
            if group and (cells >= CELLS or at == len(texts) - 1):
                label(group, table, got)
                group, cells = [], 0
        if group:
            label(group, table, got)
        return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                pa.array([g[2] for g in got], span)]

    schema = "lang_pred string, score double, lang_spans array<struct<lang:string,start:int,end:int>>"
    return shielded(docs, [text], lambda d: map_texts(d, [text], run, schema),
                    ("lang_pred", "score", "lang_spans"))


def identify(docs: DataFrame, train: Column | None = None, rows: int = ROWS,
             penalty: float = PENALTY, text: str = "text", lang: str = "lang") -> DataFrame:
    """Fit on the documents that ``train`` admits, label all."""
    return label_spans(docs, fit(training_rows(docs, train, rows, text, lang)), penalty, text)
