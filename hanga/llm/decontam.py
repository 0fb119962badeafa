"""Benchmark decontamination by SimHash of item-sized windows.

Texts and items are cut into lower-cased words (letters and digits). Against an
item of n words every window of n words of a document is a candidate
(of a document with fewer words the whole document, as its only window). Window
and item fingerprints (SimHash of the words) are matched through multi-index
Hamming blocks: the 64 bits are cut into ``BLOCKS`` blocks of 16, and of
fingerprints within ``radius`` bits at least one block differs in at most its
share of the radius (3 of 15 bits). A block table lists every item under all
values within a part of that share, a window asks for all values within the
rest, so every item within the radius is found; of unrelated items 4 % share
a block with a window. Candidates are then verified exactly: weighted Jaccard
similarity of their multisets of ``SHINGLE``-word shingles must reach
``MIN_SIMILARITY``. A shingle weighs the sum of its words' weights: a word of
the item its rarity in the benchmark, any other word the mean of the item's.

Windows that hold no shingle of any item of their size have similarity 0 and
are not fingerprinted (no result changes).

Scale. Documents are never shuffled: the benchmark travels to them, in blocks
of items whose size is checked, so any benchmark size works (one pass over the
documents per block; the leaks of a block are written before the next one is
sent). Memory per document is linear in its length.

Defined results: null and empty texts match nothing; items with fewer words
than a shingle are compared by their whole word sequence as one shingle; items
without a word match nothing; null item ids stay null in the result; repeated
documents and items each give their rows; extra columns are ignored by
``find_leaks`` and kept by ``drop_leaks``; empty tables give no leaks.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanga.session import broadcast_limit

from .common import map_texts, shared_table, shielded

SHINGLE = 5
MIN_SIMILARITY = 0.8
RADIUS = 15
BLOCKS = 4
BLOCK_BITS = 64 // BLOCKS
CHAR_BYTES = 64          # of an index per character of an item
ITEM_BYTES = 4096        # and per item, for the block tables
PAIRS = 1 << 20          # candidates compared at once
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class WordHashes(dict):
    """word -> 64-bit hash; emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(word_hash: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of every run of ``size`` words, from the words' hashes."""
    n = len(word_hash) - size + 1
    h = np.zeros(max(n, 0), np.uint64)
    for i in range(size):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word_hash[i:i + n]
    return h ^ (h >> np.uint64(32))


@dataclass
class Item:
    item_id: object
    words: list[str]
    shingles: Counter
    weights: dict                          # of the item's words
    other: float                           # of any other word


@dataclass
class Index:
    """Everything a task needs about one block of items."""
    radius: int
    min_similarity: float
    by_size: dict = field(default_factory=dict)
    first: np.ndarray = None               # sorted hashes of all items' shingles
    sizes_of: dict = field(default_factory=dict)  # shingle hash -> window sizes it matters for
    short: dict = field(default_factory=dict)     # few words: joined words -> items


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _flips(bits: int) -> np.ndarray:
    """All values of a block with at most ``bits`` bits set."""
    return np.array([sum(1 << i for i in c) for n in range(bits + 1)
                     for c in combinations(range(BLOCK_BITS), n)], np.uint16)


def _shares(radius: int) -> list[int]:
    """Bits that each block may differ in (-1: the block need not be asked).
    If every block differed in more, the sum would exceed ``radius``."""
    each, rest = divmod(radius, BLOCKS)
    return [each if i <= rest else each - 1 for i in range(BLOCKS)]


def _block(prints: np.ndarray, no: int) -> np.ndarray:
    return (prints >> np.uint64(no * BLOCK_BITS)).astype(np.uint16)


def block_tables(prints: np.ndarray, radius: int) -> list[tuple]:
    """(block, values, items, flips) per block: the sorted values under which
    items are listed, and what a window flips in its own value to ask."""
    out = []
    for no, share in enumerate(_shares(radius)):
        if share < 0:
            continue
        asked = share // 2
        listed = _flips(share - asked)
        values = (_block(prints, no)[:, None] ^ listed).ravel()
        order = np.argsort(values, kind="stable")
        items = np.repeat(np.arange(len(prints), dtype=np.int32), len(listed))
        out.append((no, values[order], items[order], _flips(asked)))
    return out


def near_pairs(fp: np.ndarray, prints: np.ndarray, tables: list[tuple], radius: int) -> tuple:
    """(windows, items) of all pairs of fingerprints within ``radius`` bits."""
    found = []
    for no, values, items, flips in tables:
        asked = (_block(fp, no)[:, None] ^ flips).ravel()
        lo = np.searchsorted(values, asked)
        many = np.searchsorted(values, asked, "right") - lo
        ends = np.cumsum(many)
        if not many.any():
            continue
        cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1], PAIRS), "right")).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(asked)], strict=True):
            m = many[a:b]
            w = np.repeat(np.arange(a, b), m) // len(flips)
            step = np.arange(len(w)) - np.repeat(np.cumsum(m) - m, m)
            i = items[np.repeat(lo[a:b], m) + step]
            near = np.bitwise_count(fp[w] ^ prints[i]) <= radius
            found.append(np.unique(w[near] * len(prints) + i[near]))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, int)
    return pairs // max(len(prints), 1), pairs % max(len(prints), 1)


def shingles_of(words: list[str]) -> Counter:
    if len(words) < SHINGLE:
        return Counter([tuple(words)]) if words else Counter()
    return Counter(zip(*(words[i:] for i in range(SHINGLE)), strict=False))


def similarity(a: Counter, b: Counter, weights: dict, other: float) -> float:
    """Weighted Jaccard similarity of two multisets of shingles; a word without
    a weight weighs ``other``."""
    def mass(s, n):
        return n * sum(weights.get(w, other) for w in s)
    both = sum(mass(s, min(n, b[s])) for s, n in a.items() if s in b)
    total = sum(mass(s, n) for s, n in a.items()) + sum(mass(s, n) for s, n in b.items()) - both
    return both / total if total else 0.0


def _votes(hashes: np.ndarray) -> np.ndarray:
    """Votes of words on the 64 bits; a window's SimHash is the sign of its sums."""
    return 2 * _bits(hashes).astype(np.int32) - 1


def build_index(items: list[tuple], weights: dict, radius: int = RADIUS,
                min_similarity: float = MIN_SIMILARITY) -> Index:
    index, hashes = Index(radius, min_similarity), WordHashes()
    sizes = defaultdict(set)
    groups: dict[int, list[Item]] = defaultdict(list)
    for no, (item_id, text) in enumerate(items):
        words = words_of(text)
        if not words:
            continue
        if len(words) < SHINGLE:
            index.short.setdefault(tuple(words), []).append((no, item_id))
            continue
        own = {w: weights[w] for w in words}
        groups[len(words)].append(Item(item_id, words, shingles_of(words), own, sum(own.values()) / len(own)))
        for h in np.unique(shingle_hashes(hashes.of(words))).tolist():
            sizes[h].add(len(words))
    for size, group in groups.items():
        prints = np.zeros(len(group), np.uint64)
        for i, item in enumerate(group):
            votes = _votes(hashes.of(item.words)).sum(axis=0)
            prints[i] = np.packbits(votes > 0, bitorder="little").view(np.uint64)[0]
        index.by_size[size] = (group, prints, block_tables(prints, radius))
    index.first = np.array(sorted(sizes), np.uint64)
    index.sizes_of = {h: sorted(s) for h, s in sizes.items()}
    return index


def _ranges(starts: np.ndarray, reach: int, limit: int) -> list[tuple[int, int]]:
    """Merged ranges [a, b) of window starts within ``reach`` before a hit."""
    out: list[list[int]] = []
    for s in starts.tolist():
        a, b = max(0, s - reach), min(s + 1, limit)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return [(a, b) for a, b in out]


def leaks_in(text: str | None, index: Index, table: WordHashes | None = None) -> list[tuple]:
    """(item_id, similarity, first word, words) of every leaked item, at its
    most similar window (the first of equals)."""
    words = words_of(text)
    best: dict[int, tuple] = {}
    for n in {len(k) for k in index.short}:
        for i in range(len(words) - n + 1):
            for no, item_id in index.short.get(tuple(words[i:i + n]), ()):
                best.setdefault(("short", no), (item_id, 1.0, i, n))
    if len(words) >= SHINGLE and len(index.first):
        hashes = (WordHashes() if table is None else table).of(words)
        marks = shingle_hashes(hashes)
        at = np.minimum(np.searchsorted(index.first, marks), len(index.first) - 1)
        hits = np.flatnonzero(index.first[at] == marks)
        by_size = defaultdict(list)
        for h in hits.tolist():
            for size in index.sizes_of[int(marks[h])]:
                by_size[size].append(h)
        for size, starts in by_size.items():
            width = min(size, len(words))
            for a, b in _ranges(np.array(starts), width - SHINGLE, len(words) - width + 1):
                for lo in range(a, b, 4096):
                    hi = min(b, lo + 4096)
                    _match(words, hashes, lo, hi, width, size, index, best)
    return [v for _, v in sorted(best.items(), key=lambda x: (x[1][2], str(x[1][0])))]


def _match(words, hashes, lo, hi, width, size, index, best) -> None:
    """Fingerprint the windows of ``width`` words that start in [lo, hi), look
    them up among the items of ``size`` words, verify."""
    group, prints, tables = index.by_size[size]
    part = words[lo:hi + width - 1]
    votes = _votes(hashes[lo:hi + width - 1])
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(votes, axis=0, dtype=np.int32)])
    window = sums[width:] - sums[:-width]
    fp = np.packbits(window > 0, axis=1, bitorder="little").view(np.uint64).ravel()
    made: dict[int, Counter] = {}
    for w, i in zip(*(x.tolist() for x in near_pairs(fp, prints, tables, index.radius)), strict=True):
        item = group[i]
        if w not in made:
            made[w] = shingles_of(part[w:w + width])
        s = similarity(made[w], item.shingles, item.weights, item.other)
        if s >= index.min_similarity:
            key = (size, i)
            if key not in best or s > best[key][1] + 1e-12:
                best[key] = (item.item_id, s, lo + w, width)


def item_blocks(benchmark: DataFrame, limit: int, item_id: str = "item_id", text: str = "text"):
    """(items, word weights, whether it is the last) of blocks whose index fits ``limit`` bytes each.

    A word weighs 1 + log(items / items that have it), counted over the whole
    benchmark. The table is dealt by hash into as many blocks as its counted
    size asks for, so the driver holds one block, and its words, at a time."""
    sized = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    worded = map_texts(sized, ["text"], lambda texts: [[sorted(set(words_of(t))) for t in texts]],
                       "words array<string>")
    total, size = sized.agg(F.count("*"), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()
    has = worded.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    parts = max(1, -(-(int(size) * CHAR_BYTES + total * ITEM_BYTES) // max(limit, 1)))
    for p in range(parts):
        mine = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p
        own = worded.where(mine).select(F.explode("words").alias("word")).distinct()
        n_of = has.join(own, "word", "left_semi").collect()
        weights = {r["word"]: 1.0 + float(np.log(total / r["n"])) for r in n_of}
        items = [(r["item_id"], r["text"]) for r in sized.where(mine).collect()]
        yield sorted(items, key=lambda r: (str(r[0]), r[1] or "")), weights, p == parts - 1


def find_leaks(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS,
               min_similarity: float = MIN_SIMILARITY, doc_id: str = "doc_id", text: str = "text",
               item_id: str = "item_id") -> DataFrame:
    """One row per leak: doc_id, item_id, similarity, first_word, n_words."""
    marked = None
    for index, last in _indexes(docs, benchmark, radius, min_similarity, item_id):
        got = _with_leaks(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")),
                          index, "text", benchmark.schema[item_id].dataType.simpleString())
        rows = got.select("doc_id", F.explode("_leaks").alias("l")).select("doc_id", "l.*")
        if not last:                  # written, so that its items need not stay
            rows = shared_table(rows, "leaks")
            index.destroy()
        marked = rows if marked is None else marked.unionByName(rows)
    return marked


def _indexes(docs, benchmark, radius, min_similarity, item_id):
    spark = docs.sparkSession
    for items, weights, last in item_blocks(benchmark, broadcast_limit(spark), item_id):
        yield spark.sparkContext.broadcast(build_index(items, weights, radius, min_similarity)), last


def _with_leaks(docs: DataFrame, index, text: str, id_type: str) -> DataFrame:
    kind = f"array<struct<item_id:{id_type},similarity:double,first_word:int,n_words:int>>"
    names = ("item_id", "similarity", "first_word", "n_words")

    table = WordHashes()

    def run(texts):
        return [[[dict(zip(names, leak, strict=True)) for leak in leaks_in(t, index.value, table)]
                 for t in texts]]

    return map_texts(docs, [text], run, f"_leaks {kind}")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS,
               min_similarity: float = MIN_SIMILARITY, text: str = "text",
               item_id: str = "item_id") -> DataFrame:
    """The documents in which no item leaked, all columns kept."""
    id_type = benchmark.schema[item_id].dataType.simpleString()

    def run(d):
        columns = d.columns
        for index, _ in _indexes(d, benchmark, radius, min_similarity, item_id):
            d = _with_leaks(d, index, text, id_type).where(F.size("_leaks") == 0).select(*columns)
        return d

    return shielded(docs, [text], run)
