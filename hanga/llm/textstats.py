"""Statistics of one text, read once.

Words are runs of characters other than blank and 09-0D; a line is what stands
between line feeds. Counts are exact over the whole text; a null text counts
as empty and has all counts zero.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("mean_word", "symbol_share", "repeat_share", "dup_line_share", "distinct_share",
          "top_word_share", "upper_share", "digit_share", "punct_share", "stop_share",
          "short_line_share", "bang_share", "log_words", "letter_share", "repeat_pair_share",
          "bar_share")
NAMES = BASE + SHARES


def _repeats(ids: np.ndarray, width: int, distinct: int) -> int:
    """Words standing in windows of ``width`` words found twice or more."""
    n = len(ids)
    if n < width:
        return 0
    key = ids[:n - width + 1].copy()
    for i in range(1, width):
        nxt = ids[i:n - width + 1 + i]
        if float(key.max() + 1) * distinct >= 2.0 ** 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * distinct + nxt
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    cover = np.zeros(n, bool)
    for i in range(width):
        cover[at + i] = True
    return int(cover.sum())


def text_stats(text: str | None) -> list[float]:
    """Values in the order of ``NAMES`` (the base counts as whole numbers)."""
    if not text:
        return [0] * len(NAMES)
    data = text.encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    n = len(words)
    spaces = int(sum(hist[c] for c in SPACE))
    chars = len(text) - spaces
    symbols = int(sum(hist[c] for c in SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    if n == 0:
        return [0, chars, symbols, dup, 0] + [0.0] * len(SHARES)
    number: dict = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    distinct = len(number)
    repeat = _repeats(ids, 3, distinct)
    pairs = _repeats(ids, 2, distinct)
    size = max(len(data), 1)
    upper, lower = hist[65:91].sum(), hist[97:123].sum()
    stops = sum(hist[c] for c in b".,;:?")
    short = sum(len(x.split()) < 3 for x in lines)
    return [n, chars, symbols, dup, repeat,
            chars / n, symbols / max(chars, 1), repeat / n, dup / max(len(lines), 1), distinct / n,
            float(np.bincount(ids).max()) / n, float(upper) / max(float(upper + lower), 1.0),
            float(hist[48:58].sum()) / size, float(stops) / size,
            float(hist[ord(".")]) / n, short / max(len(lines), 1), float(hist[ord("!")]) / n,
            float(np.log1p(n)), float(upper + lower + hist[128:].sum()) / size, pairs / n,
            float(hist[ord("|")]) / n]
