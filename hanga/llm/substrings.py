"""Exact substring removal by a distributed, sparse suffix sort.

Task. A byte goes when some ``length``-byte string that covers it also starts
anywhere else in the corpus (another row or another place of the same text).

Method. Sorting every suffix of the corpus would move hundreds of bytes per
input byte, so only suffixes that decide something are sorted:

* Level 1. Every ``length``-byte window picks one anchor: the start of the
  ``gram``-byte string with the smallest hash inside the window (leftmost on
  ties). Equal windows pick the same anchor at the same offset. The windows
  that share an anchor form a block of consecutive starts. One suffix per
  block enters the sort, at its anchor (about one per hundred bytes).
* Level 2. Blocks that share their anchor string with another block but are
  not wholly equal to it are cut into aligned pieces of ``PIECE`` starts.
* Level 3. Pieces that share their core with another piece but are not wholly
  equal to it are cut into single starts.

Each level is the same sort: sampled splitters range-partition the suffixes by
leading tokens (the first eight bytes, then the core's rolling hash, the whole
piece's digest and the row, so that equal suffixes are spread over buckets when
they are many); each bucket is sorted locally by multikey quicksort; neighbours
are compared, and the first and last suffix of each bucket with those of the
next. A piece equal to a neighbour is repeated whole; a piece that shares only
the core with a neighbour goes down a level. Nothing else can repeat.

Two hashes, two duties. Anchors and cores use a rolling hash modulo 2^64: it is
the same for equal strings, and where it is also the same for different ones
(self-similar texts), more pieces go down a level, no more. Only equality of
whole pieces removes bytes, and that is decided by eight real bytes and a keyed
128-bit BLAKE2b digest of all bytes of the piece: different bytes count as
equal only if that digest collides.

Passages. On request the same sort also decides windows of ``passage_words``
words (at word starts, from the first byte of the first word to the last byte of
the last, so white space counts): a passage shorter than ``length`` bytes is
reported, not removed. Its rows carry other cores than those of byte windows, so
the two never meet. Words are hashed by their length, first and last eight bytes;
again this only chooses anchors and candidates, digests of all bytes decide.

Scale. Every level moves a bounded number of fixed-size rows per repeated run,
not texts; they are written once, counted, and dealt into buckets of bounded
size. The driver sees two rows per bucket. A document's list of removed runs is
bounded by its own length.

Defined results: null text is empty; texts shorter than ``length`` lose
nothing; repeated rows are separate places, so both lose what they share; null
or repeated ``doc_id`` and extra columns do no harm; an empty table gives an
empty result. Bytes are judged on the input, not on what is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table, slices, small_side, text_key

LENGTH = 400
GRAM = 200
PIECE = 16
PASSAGE_GRAM = 10                 # words of an anchor string
PASSAGE_PIECE = 4                 # word starts of a piece
_POS_BITS = 20                    # positions inside one chunk
_CHUNK = (1 << _POS_BITS) - 4096  # window starts handled at a time
BUCKET_ROWS = 1_000_000           # suffixes of a bucket, at most about
_DIGEST_KEY = b"substrings 1"
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, size=256, dtype=np.uint64)
_MULT = (int(_rng.integers(0, 2**63, dtype=np.uint64)) * 2 + 1) % (1 << 64)
_WORD_CORE = np.uint64(_rng.integers(0, 2**64, dtype=np.uint64))
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power_table(n: int) -> list[np.ndarray]:
    """Powers of the multiplier and of its inverse, at least n long."""
    if not _powers or len(_powers[0]) < n:
        made = []
        for base in (_MULT, pow(_MULT, -1, 1 << 64)):
            p = np.full(max(n, 1 << 17), base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[:] = made
    return _powers


class Rolling:
    """Rolling hash of any substring of one byte string, or of any run of word
    codes. Equal ones agree; so may different ones (a polynomial modulo 2^64)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers, self.inverse = _power_table(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        codes = _BYTE[data] if data.dtype == np.uint8 else data
        np.cumsum(codes * powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        s = self.sums
        return _mix((s[end] - s[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        s, n = self.sums, len(self.sums) - size
        return _mix((s[size:] - s[:n]) * self.inverse[:n] + np.uint64(size))


def _digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, shift: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray]:
    """Keyed 128-bit digests of the bytes in [start, end), as two columns; equal
    bytes cut at another distance (``shift``) from their anchor differ."""
    view = memoryview(np.ascontiguousarray(data))
    raw = b"".join([blake2b(view[a:b], digest_size=16, key=_DIGEST_KEY).digest()
                    for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    both = np.frombuffer(raw, "<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1] ^ shift


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values (block prefix/suffix minima)."""
    n = len(x)
    pad = -n % width
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]) if pad else x
    blocks = full.reshape(-1, width)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(left[:m], right[width - 1:width - 1 + m])


def _leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First eight bytes at each place as a big-endian number whose signed
    order is the byte order."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(at), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[at + i].astype(np.uint64)
    return (out ^ np.uint64(1 << 63)).view(np.int64)


def blocks_of(data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Level 1: (anchor, first start, last start, lead, core, whole, whole2)
    arrays of one text; the blocks' starts cover every window exactly once."""
    parts = []
    width = length - gram + 1
    for lo in range(0, len(data) - length + 1, _CHUNK):
        piece = data[lo:lo + _CHUNK + length - 1]
        roll = Rolling(piece)
        grams = roll.grams(gram)
        place = np.arange(len(grams), dtype=np.uint64)
        low = np.uint64((1 << _POS_BITS) - 1)
        pick = sliding_min((grams & ~low) | place, width)
        new = np.flatnonzero(np.concatenate([[True], pick[1:] != pick[:-1]]))
        first = new
        last = np.concatenate([new[1:], [len(pick)]]) - 1
        anchor = (pick[new] & low).astype(np.int64)
        core = grams[anchor]
        parts.append((anchor + lo, first + lo, last + lo, _leading(piece, anchor), core.view(np.int64),
                      *_digests(piece, first, last + length, anchor - first)))
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else _no_rows()


def _aligned(anchor: np.ndarray, first: np.ndarray, last: np.ndarray, piece: int):
    """Starts [first, last] of blocks cut at aligned distances from their anchors:
    (block's number, distance in pieces, aligned end, first start, last start)."""
    least = (anchor - last) // piece
    count = (anchor - first) // piece - least + 1
    block = np.repeat(np.arange(len(anchor)), count)
    n = np.arange(len(block)) + (least - (np.cumsum(count) - count))[block]
    high = anchor[block] - n * piece
    return block, n, high, np.maximum(high - piece + 1, first[block]), np.minimum(high, last[block])


def _cores(codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Rolling hashes of the ``size`` codes from each place, a chunk at a time."""
    out = np.zeros(len(at), np.uint64)
    for lo in np.unique(at // _CHUNK).tolist():
        here = np.flatnonzero(at // _CHUNK == lo)
        least, most = int(at[here].min()), int(at[here].max())
        out[here] = Rolling(codes[least:most + size]).of(at[here] - least, at[here] - least + size)
    return out


def pieces_of(data: np.ndarray, anchor: np.ndarray, first: np.ndarray, last: np.ndarray, piece: int,
              length: int = LENGTH):
    """Levels 2 and 3: cut the starts [first, last] of blocks of one text at
    aligned distances from their anchors (``piece`` starts each); same columns as
    :func:`blocks_of` with the piece's own first and last start."""
    block, n, high, begin, end = _aligned(anchor, first, last, piece)
    core = _mix(_cores(data, high, length - piece + 1) + n.astype(np.uint64))
    return [anchor[block], begin, end, _leading(data, high), core.view(np.int64),
            *_digests(data, begin, end + length, high - begin)]


class Words:
    """Places and codes of the words (runs of bytes outside 20 and 09-0D hex) of one text."""

    def __init__(self, data: np.ndarray):
        self.data = data
        inside = np.concatenate([[False], ~_SPACE[data], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        size = self.end - self.start
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
        mask = np.uint64(2**64 - 1) >> ((8 - np.minimum(size, 8)) * 8).astype(np.uint64)
        head = eight[self.start] & mask
        tail = eight[np.maximum(self.end - 8, self.start)] & mask
        self.codes = _mix(_mix(head + size.astype(np.uint64)) + tail)

    def blocks(self, length: int, gram: int = PASSAGE_GRAM):
        """Level 1: the columns of :func:`blocks_of` for windows of ``length``
        words; anchor, first and last are numbers of words."""
        parts = []
        width = length - gram + 1
        for lo in range(0, len(self.codes) - length + 1, _CHUNK):
            grams = Rolling(self.codes[lo:lo + _CHUNK + length - 1]).grams(gram)
            low = np.uint64((1 << _POS_BITS) - 1)
            pick = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), width)
            first = np.flatnonzero(np.concatenate([[True], pick[1:] != pick[:-1]]))
            last = np.concatenate([first[1:], [len(pick)]]) - 1
            anchor = (pick[first] & low).astype(np.int64)
            parts.append(self._rows(anchor + lo, first + lo, last + lo, anchor + lo, grams[anchor], length,
                                    anchor - first))
        return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else _no_rows()

    def pieces(self, anchor: np.ndarray, first: np.ndarray, last: np.ndarray, piece: int, length: int):
        """Levels 2 and 3: the columns of :func:`pieces_of`, in words."""
        block, n, high, begin, end = _aligned(anchor, first, last, piece)
        core = _mix(_cores(self.codes, high, length - piece + 1) + n.astype(np.uint64))
        return self._rows(anchor[block], begin, end, high, core, length, high - begin)

    def _rows(self, anchor, first, last, lead, core, length, shift):
        return [anchor, first, last, _leading(self.data, self.start[lead]), (core ^ _WORD_CORE).view(np.int64),
                *_digests(self.data, self.start[first], self.end[last + length - 1], shift)]


def _no_rows() -> list[np.ndarray]:
    return [np.zeros(0, np.int64)] * 7


def _of_both(in_bytes: list, in_words: list) -> list[np.ndarray]:
    """Rows of byte windows and of word windows, with a flag for the latter."""
    flag = np.repeat([False, True], [len(in_bytes[0]), len(in_words[0])])
    return [*(np.concatenate(c) for c in zip(in_bytes, in_words, strict=True)), flag]


TOKENS = ("lead", "core", "whole", "whole2")


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Multikey quicksort, breadth first: order by the first token; every run
    of equal tokens is ordered by the next token, until no run is left."""
    order = np.argsort(keys[0], kind="quicksort")
    run = np.zeros(len(order), np.int64)
    for depth, key in enumerate(keys):
        if depth:
            tied = np.zeros(len(order), bool)
            same = run[1:] == run[:-1]
            tied[1:] |= same
            tied[:-1] |= same
            at = np.flatnonzero(tied)
            if not len(at):
                break
            inner = np.lexsort((key[order[at]], run[at]))
            order[at] = order[at][inner]
        value = key[order]
        new = (value[1:] != value[:-1]) | (run[1:] != run[:-1])
        run = np.concatenate([[0], np.cumsum(new)]) if len(order) else run
    return order


def _compare(lead, core, whole, whole2):
    """(repeated, shares the core only) of sorted suffixes, by neighbours."""
    n = len(lead)
    same_core = (lead[1:] == lead[:-1]) & (core[1:] == core[:-1])
    equal = same_core & (whole[1:] == whole[:-1]) & (whole2[1:] == whole2[:-1])
    differ = same_core & ~equal
    repeated, shared = np.zeros(n, bool), np.zeros(n, bool)
    repeated[1:] |= equal
    repeated[:-1] |= equal
    shared[1:] |= differ
    shared[:-1] |= differ
    return repeated, shared


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort one bucket and keep what repeats, shares a core, or stands at the
    bucket's edge (1: first, 2: last, 3: both)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    del held
    keys = [t.column(c).to_numpy() for c in TOKENS]
    order = multikey_order(keys)
    repeated, shared = _compare(*(k[order] for k in keys))
    edge = np.zeros(len(order), np.int32)
    edge[0] |= 1
    edge[-1] |= 2
    keep = np.flatnonzero(repeated | shared | (edge > 0))
    out = t.take(pa.array(order[keep]))
    bucket = np.full(len(keep), TaskContext.get().partitionId(), np.int32)
    for name, column in (("repeated", repeated[keep]), ("shared", shared[keep]),
                         ("edge", edge[keep]), ("bucket", bucket)):
        out = out.append_column(name, pa.array(column))
    yield from out.to_batches()


def _sorted_neighbours(suffixes: DataFrame, name: str) -> DataFrame:
    """Range partition, sort and compare; edges of neighbouring buckets are
    compared on the driver (two rows per bucket)."""
    spark = suffixes.sparkSession
    # written first: the splitters' sample and the sort then read rows, not texts
    suffixes = shared_table(suffixes, f"{name}-suffixes")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-suffixes.count() // BUCKET_ROWS))
    dealt = suffixes.repartitionByRange(parts, *TOKENS, "doc_id", "text_key", "first")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in suffixes.schema.fields)
    done = shared_table(dealt.mapInArrow(
        _bucket, fields + ", repeated boolean, shared boolean, edge int, bucket int"), name)
    edges = [r.asDict() for r in done.where("edge > 0").collect()]
    # a one-row bucket has one row that is first and last
    edges.sort(key=lambda r: (r["bucket"], r["edge"] != 1))
    for a, b in zip(edges, edges[1:], strict=False):
        if a["bucket"] != b["bucket"] and (a["lead"], a["core"]) == (b["lead"], b["core"]):
            mark = "repeated" if all(a[c] == b[c] for c in TOKENS) else "shared"
            a[mark] = b[mark] = True
    inner = done.where("edge = 0")
    fixed = spark.createDataFrame([tuple(r[c] for c in done.columns) for r in edges], done.schema)
    return inner.unionByName(fixed).select("doc_id", "text_key", "anchor", "first", "last", "words",
                                           "repeated", "shared")


def _suffix_schema(docs: DataFrame) -> str:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (f"doc_id {kind}, text_key long, anchor long, first long, last long, "
            "lead long, core long, whole long, whole2 long, words boolean")


_COLUMNS = ("anchor", "first", "last", *TOKENS, "words")


def _emit(ids: pa.Array, keys: pa.Array, texts, cut) -> Iterator[pa.RecordBatch]:
    """One batch of suffix rows for every ~200k rows of ``cut(i, bytes)``."""
    found, rows, count = [], [], 0
    for i, text in enumerate(texts):
        if text:
            got = cut(i, np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))
            if len(got[0]):
                found.append(got)
                rows.append(np.full(len(got[0]), i))
                count += len(got[0])
        if found and (count >= 200_000 or i == len(texts) - 1):
            at = pa.array(np.concatenate(rows))
            columns = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([ids.take(at), keys.take(at), *columns],
                                             names=["doc_id", "text_key", *_COLUMNS])
            found, rows, count = [], [], 0
    if found:
        at = pa.array(np.concatenate(rows))
        columns = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
        yield pa.RecordBatch.from_arrays([ids.take(at), keys.take(at), *columns],
                                         names=["doc_id", "text_key", *_COLUMNS])


def _flat(lists: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """A column of lists of structs without nulls: the row of every item, and
    the items' fields."""
    of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    return of, [c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten()]


def _first_level(length: int, gram: int, passage_words: int | None):
    def cut(i, data):
        return _of_both(blocks_of(data, length, gram),
                        Words(data).blocks(passage_words) if passage_words else _no_rows())

    def run(batches):
        for b in slices(batches):
            yield from _emit(b.column(0), b.column(1), b.column(2).to_pylist(), cut)
    return run


def _next_level(length: int, piece: int, passage_words: int | None, passage_piece: int):
    def run(batches):
        for b in slices(batches):
            of, (anchor, first, last, words) = _flat(b.column(3))
            ends = np.searchsorted(of, np.arange(b.num_rows + 1))

            def cut(i, data, ends=ends, anchor=anchor, first=first, last=last, words=words):
                at = np.arange(ends[i], ends[i + 1])
                plain, said = at[~words[at]], at[words[at]]
                return _of_both(
                    pieces_of(data, anchor[plain], first[plain], last[plain], piece, length)
                    if len(plain) else _no_rows(),
                    Words(data).pieces(anchor[said], first[said], last[said], passage_piece, passage_words)
                    if len(said) else _no_rows())
            yield from _emit(b.column(0), b.column(1), b.column(2).to_pylist(), cut)
    return run


def _with_lists(docs: DataFrame, rows: DataFrame, item: str, how: str) -> DataFrame:
    """Join every document with the list of its rows (null-safe on the key);
    the list side is broadcast only when its counted size fits the limit."""
    lists = shared_table(rows.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
                         .agg(F.collect_set(F.expr(item)).alias("todo")), "lists")
    n, items = lists.agg(F.count("*"), F.coalesce(F.sum(F.size("todo")), F.lit(0))).first()
    side = small_side(lists, 1, 64 * n + 24 * items)
    cond = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_key").eqNullSafe(F.col("_key"))
    return docs.join(side, cond, how).drop("_id", "_key")


def repeated_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
                  piece: int = PIECE, passage_words: int | None = None) -> DataFrame:
    """(doc_id, text_key, first, last, words): runs of starts whose ``length``-byte
    string also starts anywhere else and, where ``words`` is true, runs of words
    at which a string of ``passage_words`` words starts that is found anywhere
    else. ``docs`` has doc_id, text_key, text."""
    schema = _suffix_schema(docs)
    docs = docs.select("doc_id", "text_key", "text")
    level = _sorted_neighbours(docs.mapInArrow(_first_level(length, gram, passage_words), schema), "blocks")
    columns = ["doc_id", "text_key", "first", "last", "words"]
    runs = level.where("repeated").select(columns)
    for size, said, name in ((piece, PASSAGE_PIECE, "pieces"), (1, 1, "starts")):
        # a repeated piece goes down too when it meets a different one: its
        # starts are what the other's starts may equal
        listed = _with_lists(docs, level.where("shared"), "struct(anchor, first, last, words)", "inner")
        cut = listed.select("doc_id", "text_key", "text", "todo").mapInArrow(
            _next_level(length, size, passage_words, said), schema)
        level = _sorted_neighbours(cut, name)
        runs = runs.unionByName(level.where("repeated").select(columns))
    return runs


def merge_spans(of: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, rows: int) -> pa.Array:
    """Covered ranges [start, end) of runs of starts, merged, as one list for
    each of ``rows`` rows; ``of`` is the row of every run."""
    order = np.lexsort((first, of))
    of, first, end = of[order], first[order], last[order] + length
    base = of * (int(end.max(initial=0)) + 1)       # rows do not meet
    reach = np.maximum.accumulate(base + end)
    new = np.flatnonzero(np.concatenate([[True], (base + first)[1:] > reach[:-1]])[:len(of)])
    until = np.concatenate([new[1:], [len(of)]])[:len(new)] - 1
    spans = pa.StructArray.from_arrays([pa.array(first[new]), pa.array((reach - base)[until])], ["start", "end"])
    offsets = np.searchsorted(of[new], np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), spans)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
                   piece: int = PIECE, doc_id: str = "doc_id", text: str = "text",
                   passage_words: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (merged removed byte ranges
    [start, end)) and ``kept`` (the remaining bytes, concatenated). With
    ``passage_words`` (more than ``PASSAGE_GRAM``) also ``passages``: merged
    ranges [start, end) of word numbers covered by a string of that many words
    found anywhere else, whether their bytes are removed or not."""
    if passage_words is not None and passage_words <= PASSAGE_GRAM:
        raise ValueError(f"passage_words must be over {PASSAGE_GRAM}")
    keyed = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key"),
                        F.col(text).alias("text"))
    runs = repeated_runs(keyed, length, gram, piece, passage_words)
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def merge(batches):
        for b in batches:
            of, (first, last, words) = _flat(b.column(2))
            made = [merge_spans(of[at], first[at], last[at], size, b.num_rows)
                    for at, size in ((~words, length), (words, passage_words or 0))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made],
                                             names=["_id", "_key", "spans", "passages"])

    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    ranges = "array<struct<start:long,end:long>>"
    merged = shared_table(
        runs.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "last", "words")).alias("runs"))
        .mapInArrow(merge, f"_id {kind}, _key long, spans {ranges}, passages {ranges}"), "spans")
    n, items = merged.agg(F.count("*"), F.coalesce(F.sum(F.size("spans") + F.size("passages")), F.lit(0))).first()
    cond = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_key").eqNullSafe(F.col("_key"))
    joined = keyed.join(small_side(merged, 1, 64 * n + 24 * items), cond, "left")

    def cut(batches):
        for b in slices(batches):
            spans, kept, sizes = b.column(2).to_pylist(), [], []
            for s, text in zip(spans, b.column(1).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                sizes.append(len(data))
                at, parts = 0, []
                for r in s or ():
                    parts.append(data[at:r["start"]])
                    at = r["end"]
                kept.append(b"".join([*parts, data[at:]]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()),
                 pa.array([s or [] for s in spans], span_type), pa.array(kept, pa.binary()),
                 b.column(3)],
                names=["doc_id", "n_bytes", "spans", "kept", "passages"])

    found = F.coalesce("passages", F.array().cast(ranges)).alias("passages")
    out = joined.select("doc_id", "text", "spans", found).mapInArrow(
        cut, f"doc_id {kind}, n_bytes long, spans {ranges}, kept binary, passages {ranges}")
    return out if passage_words else out.drop("passages")
