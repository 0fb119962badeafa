"""Line deduplication: lines that many documents share go everywhere.

Method. Every text is split at ``\\n``; a line's key is the line without blanks
(``[\\x20\\x09-\\x0D]``) at its ends and with A-Z lower-cased, hashed to 128 bits.
The keys of a document count once each, so the sum over documents is the number
of distinct documents of a key. Keys found in ``min_docs`` documents or more
(and of ``min_chars`` code points or more) lose all their lines, in every
document; the other lines stay at their places and are joined again.

Scale. The first pass moves 24 bytes per distinct line, summed inside each task
before the shuffle, so a line that a third of the documents share is a few rows
per task. The frequent keys are written to the shared folder and counted. Where
they fit the broadcast limit, the second pass is a map over the documents:
texts are never shuffled. Beyond it (:func:`_dropped_by_shuffle`), line hashes
are joined with the frequent keys by shuffle and the documents with the places
they lose; keys frequent enough to overload one task are joined by a broadcast
of bounded size instead (see ``heavy``).

Defined results: null and empty texts are one empty line; an empty key is never
frequent for ``min_chars`` >= 1; every input row is one document (repeated rows
count, and lose lines, each on its own; a null ``doc_id`` does no harm); texts
of any length are split whole; an empty table gives an empty result; further
columns are passed on, except those named like an output column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanga.session import broadcast_limit

from .common import map_texts, shared_table, shielded, slices, small_side, text_key

MIN_DOCS = 10
MIN_CHARS = 1
BLANKS = b" \t\n\x0b\x0c\r"
_ROW = 24       # bytes of a frequent key: two halves of the hash and its count


def line_keys(text: str | None) -> list[bytes]:
    """The keys of a text's lines in UTF-8, where lower-casing bytes changes
    A-Z only and blanks are single bytes."""
    return [x.strip(BLANKS) for x in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]


def _can_count(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


def _hashes(keys: list[bytes], min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(128-bit hashes as two columns, which keys can be frequent at all)."""
    raw = b"".join(map(xxhash.xxh3_128_digest, keys))
    counts = np.fromiter((_can_count(k, min_chars) for k in keys), bool, len(keys))
    return np.frombuffer(raw, "<i8").reshape(-1, 2), counts


def _ordered(pairs: np.ndarray) -> np.ndarray:
    return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]


def _distinct(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a two-column array and how often each occurs."""
    pairs = _ordered(pairs)
    first = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)]))
    return pairs[first], np.diff(np.concatenate([first, [len(pairs)]]))


def _is_in(pairs: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which rows of ``pairs`` occur in ``ordered`` (sorted by :func:`_ordered`)."""
    low = np.searchsorted(ordered[:, 0], pairs[:, 0], "left")
    high = np.searchsorted(ordered[:, 0], pairs[:, 0], "right")
    hit = np.zeros(len(pairs), bool)
    for step in range(int((high - low).max(initial=0))):
        at = np.flatnonzero(low + step < high)
        hit[at] |= ordered[low[at] + step, 1] == pairs[at, 1]
    return hit


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                   text: str = "text") -> DataFrame:
    """(h1, h2, n_docs): hashes of the keys found in ``min_docs`` rows or more."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found: list[bytes] = []
            for t in b.column(0).to_pylist():
                found += {k for k in line_keys(t) if _can_count(k, min_chars)}
            pairs, _ = _hashes(found, 0)
            if len(pairs):
                pairs, n = _distinct(pairs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n)], names=["h1", "h2", "n"])

    return (docs.select(F.col(text).alias("text")).mapInArrow(count, "h1 long, h2 long, n long")
            .groupBy("h1", "h2").agg(F.sum("n").alias("n_docs")).where(F.col("n_docs") >= min_docs))


def _cut(text: str | None, dropped: np.ndarray | None) -> tuple[str, int, int]:
    if dropped is None or not dropped.any():
        return text or "", (text or "").count("\n") + 1, 0
    lines = text.split("\n")
    return "\n".join([x for x, d in zip(lines, dropped, strict=True) if not d]), len(lines), int(dropped.sum())


def _dropped_by_broadcast(docs: DataFrame, frequent: DataFrame, min_chars: int) -> DataFrame:
    spark = docs.sparkSession
    table = frequent.select("h1", "h2").toArrow()
    keys = _ordered(np.column_stack([table.column(0).to_numpy(), table.column(1).to_numpy()])
                    if table.num_rows else np.zeros((0, 2), np.int64))
    shared = spark.sparkContext.broadcast(keys)

    def run(texts: list) -> tuple[list, list, list]:
        split = [line_keys(t) for t in texts]
        pairs, can = _hashes([k for keys in split for k in keys], min_chars)
        drop = np.zeros(len(can), bool)
        drop[can] = _is_in(pairs[can], shared.value)
        ends = np.cumsum([len(x) for x in split])
        return tuple(zip(*[_cut(t, drop[e - len(x):e]) for t, x, e in zip(texts, split, ends, strict=True)],
                         strict=True)) if texts else ([], [], [])

    return map_texts(docs, ["text"], run, "kept_text string, n_lines long, n_dropped long")


def _dropped_by_shuffle(docs: DataFrame, frequent: DataFrame, min_chars: int) -> DataFrame:
    """The same for any number of frequent keys. ``places`` has one row per
    document and distinct line. A key in more than ``heavy`` documents is joined
    by broadcast: there are at most (rows of all frequent keys) / heavy of them,
    which the choice of ``heavy`` keeps within the limit; any other key brings
    at most ``heavy`` rows to a task."""
    limit = broadcast_limit(docs.sparkSession)
    keyed = docs.withColumn("_key", text_key("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 100):
            for i, t in enumerate(b.column(2).to_pylist()):
                pairs, can = _hashes(line_keys(t), min_chars)
                at = np.flatnonzero(can)
                if not len(at):
                    continue
                at = at[np.lexsort((pairs[at, 1], pairs[at, 0]))]
                sorted_pairs = pairs[at]
                first = np.flatnonzero(np.concatenate(
                    [[True], (sorted_pairs[1:] != sorted_pairs[:-1]).any(axis=1)]))
                rows = pa.array(np.full(len(first), i))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([first, [len(at)]]).astype(np.int32)), pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), pa.array(sorted_pairs[first, 0]),
                     pa.array(sorted_pairs[first, 1]), lists], names=["_id", "_tk", "h1", "h2", "at"])

    placed = keyed.select("doc_id", "_key", "text").mapInArrow(
        places, f"_id {kind}, _tk long, h1 long, h2 long, at array<long>")
    total = frequent.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    heavy = max(1, -(-total * _ROW // max(limit, 1)))
    some = frequent.where(F.col("n_docs") > heavy).select("h1", "h2", F.lit(True).alias("_heavy"))
    marked = placed.join(F.broadcast(some) if limit >= _ROW else some, ["h1", "h2"], "left")
    rest = marked.where("_heavy is null").join(
        frequent.where(F.col("n_docs") <= heavy).select("h1", "h2"), ["h1", "h2"], "left_semi")
    lost = (marked.where("_heavy").select("_id", "_tk", "at")
            .unionByName(rest.select("_id", "_tk", "at"))
            .groupBy("_id", "_tk").agg(F.collect_set("at").alias("lists")))
    lost = shared_table(lost.select("_id", "_tk", F.flatten("lists").alias("_lost")), "lost-lines")
    n, items = lost.agg(F.count("*"), F.coalesce(F.sum(F.size("_lost")), F.lit(0))).first()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_key").eqNullSafe(F.col("_tk"))
    joined = keyed.join(small_side(lost, 1, 64 * n + 8 * items), same, "left").drop("_id", "_tk", "_key")

    def run(texts: list, lists: list) -> tuple[list, list, list]:
        rows = []
        for t, lost in zip(texts, lists, strict=True):
            dropped = None
            if lost:
                dropped = np.zeros((t or "").count("\n") + 1, bool)
                dropped[lost] = True
            rows.append(_cut(t, dropped))
        return tuple(zip(*rows, strict=True)) if rows else ([], [], [])

    return map_texts(joined, ["text", "_lost"], run,
                     "kept_text string, n_lines long, n_dropped long").drop("_lost")


def drop_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` (doc_id, text and any others) with ``kept_text`` (the lines that
    stay, joined), ``n_lines`` (before dropping) and ``n_dropped``."""
    def run(d: DataFrame) -> DataFrame:
        frequent = shared_table(frequent_lines(d, min_docs, min_chars), "lines")
        fits = frequent.count() * _ROW <= broadcast_limit(d.sparkSession)
        return (_dropped_by_broadcast if fits else _dropped_by_shuffle)(d, frequent, min_chars)

    return shielded(docs, ["doc_id", "text"], run, ("kept_text", "n_lines", "n_dropped"))
