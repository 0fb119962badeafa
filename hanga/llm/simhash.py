"""SimHash near-dedup by pigeonhole blocks.

Method. Every text gets a 64-bit fingerprint (bit = majority vote over the
XXH64 of its word shingles). The fingerprint is cut into ``radius + spare``
blocks; two fingerprints at ``radius`` or fewer differing bits agree in at
least ``spare`` whole blocks, so they share the key of at least one
combination of ``spare`` blocks. Rows are exploded once per combination and
grouped by key, pairs inside a key are verified by Hamming distance, and the
links are closed to connected components.

Scale. Work is on distinct fingerprints (exact copies collapse first, by a
map-side combined aggregate). A key shared by many fingerprints is cut into
salt groups: one unit per pair of groups, each of bounded size, so no unit
holds the whole key. Units emit only links that join two not yet joined
fingerprints (at most size - 1), never all pairs.

Defined results: null text counts as empty; no word gives fingerprint zero,
which links like any other; a null ``doc_id`` takes part and takes the
component's id (the smallest non-null id, null if there is none); repeated
rows each get a row; an empty table gives an empty result; extra columns of
the input are ignored here (``near_dedup`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, map_texts, shared_table, shielded, small_side, text_key

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
SPARE_BLOCKS = 2
UNIT = 1024          # fingerprints of one salt group
_FLUSH = 100_000     # rows gathered before a flush of complete keys
_VOTE = 1 << 16      # shingles hashed at a time


def simhash64(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    # bytes.lower() and bytes.split() are ASCII-only: A-Z, and blank + 09-0D
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return 0
    if len(w) < words:
        w, n = [b" ".join(w)], 1
        parts = iter(w)
    else:
        n = len(w) - words + 1
        parts = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if words > 1 else iter(w)
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    left = n
    while left > 0:
        take = min(left, _VOTE)
        h = np.fromiter((digest(s, seed) for s, _ in zip(parts, range(take), strict=False)),
                        np.uint64, take)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += np.add.reduce(bits, axis=0, dtype=np.int64)
        left -= take
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED,
                 text: str = "text") -> DataFrame:
    """Append ``fp`` (long: the fingerprint's bits) to ``docs``."""
    def run(texts):
        fp = np.array([simhash64(t, words, seed) for t in texts], np.uint64).view(np.int64)
        return [pa.array(fp)]
    return map_texts(docs, [text], run, "fp long")


def block_keys(fp: str, radius: int, spare: int):
    """One long column per combination of ``spare`` among ``radius + spare``
    blocks: the combination's number and the blocks' bits. Key widths stay
    under 58 bits."""
    n = radius + spare
    widths = [64 // n + (i < 64 % n) for i in range(n)]
    starts = np.concatenate([[0], np.cumsum(widths)[:-1]]).tolist()
    keys = []
    for no, combo in enumerate(combinations(range(n), spare)):
        c = F.lit(no).cast("long")
        for i in combo:
            part = F.shiftrightunsigned(F.col(fp), starts[i]).bitwiseAND((1 << widths[i]) - 1)
            c = F.shiftleft(c, widths[i]).bitwiseOR(part)
        keys.append(c)
    return keys


def _links(key: np.ndarray, side: np.ndarray, cross: np.ndarray, fp: np.ndarray,
           radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key: for every offset d compare row i with
    row i + d of the same key. ``cross`` keys compare only rows of different
    ``side``. A pair is kept only if it joins two components, so at most
    len - 1 links leave."""
    n = len(key)
    label = np.arange(n)   # smallest row known to be joined with the row

    def find(x: int) -> int:
        while label[x] != x:
            x = label[x]
        return int(x)

    out_a: list[int] = []
    out_b: list[int] = []
    live = np.arange(n)
    d = 1
    while True:
        live = live[live < n - d]
        live = live[key[live] == key[live + d]]
        if not len(live):
            break
        near = np.bitwise_count(fp[live] ^ fp[live + d]) <= radius
        near &= ~(cross[live] & (side[live] == side[live + d]))
        near &= label[live] != label[live + d]
        hit = live[near]
        for i in hit.tolist():
            ra, rb = find(i), find(i + d)
            if ra != rb:
                label[max(ra, rb)] = min(ra, rb)
                out_a.append(i)
                out_b.append(i + d)
        while len(hit) and not np.array_equal(up := label[label], label):
            label = up
        d += 1
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


def _verify(radius: int):
    """mapInArrow body: rows (key, unit, cross, side, fp) sorted by (key, unit)."""
    def flush(parts: list[pa.Table], last: bool):
        t = pa.concat_tables(parts)
        key, unit = (t.column(c).to_numpy() for c in ("key", "unit"))
        new = np.flatnonzero((key[1:] != key[:-1]) | (unit[1:] != unit[:-1])) + 1
        cut = t.num_rows if last else (int(new[-1]) if len(new) else 0)
        if cut == 0:
            return None, [t]
        group = np.zeros(cut, np.int64)
        inner = new[new < cut]
        group[inner] = 1
        group = np.cumsum(group)
        fp = t.column("fp").to_numpy()[:cut]
        a, b = _links(group, t.column("side").to_numpy()[:cut],
                      t.column("cross").to_numpy()[:cut].astype(bool), fp.view(np.uint64), radius)
        out = pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])
        return out, [t.slice(cut)] if cut < t.num_rows else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            if sum(x.num_rows for x in held) >= _FLUSH:
                out, held = flush(held, False)
                if out is not None and out.num_rows:
                    yield out
        if held and sum(x.num_rows for x in held):
            out, _ = flush(held, True)
            if out is not None and out.num_rows:
                yield out
    return run


def hamming_links(fps: DataFrame, radius: int = RADIUS, spare: int = SPARE_BLOCKS,
                  unit: int = UNIT) -> DataFrame:
    """Links (a, b) that connect every pair of distinct fingerprints ``fp``
    within ``radius`` bits (transitively inside a key; no pair is lost for
    connectivity, none beyond the radius appears)."""
    rows = fps.select("fp", F.explode(F.array(*block_keys("fp", radius, spare))).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, "key")
    groups = F.ceil(F.col("n") / unit).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    low, high = F.least("side", "other"), F.greatest("side", "other")
    # one unit per pair of salt groups; across two groups only pairs of
    # different sides are compared, the rest is the business of (side, side)
    rows = (rows.withColumn("g", groups)
            .withColumn("side", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
            .withColumn("other", other)
            .select("key", "fp", "side",
                    (low.cast("long") * (1 << 31) + high).alias("unit"),
                    (low != high).alias("cross")))
    rows = rows.repartition("key", "unit").sortWithinPartitions("key", "unit")
    return rows.mapInArrow(_verify(radius), "a long, b long")


def simhash_components(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS,
                       seed: int = SEED, spare: int = SPARE_BLOCKS, unit: int = UNIT,
                       doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text_key, fp (long), root (a fingerprint
    that names the component), component_id."""
    marked = fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")),
                          words, seed)
    marked = shared_table(marked.select("doc_id", text_key().alias("text_key"), "fp"), "fingerprints")
    classes = shared_table(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(hamming_links(classes, radius, spare, unit))
    classes = (classes.join(roots, classes.fp == roots.node, "left")
               .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    ids = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = classes.join(ids, "root").select("fp", "root", "component_id")
    return marked.join(classes, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Keep one document of every component, with all columns of ``docs``: the
    one with the smallest id (null ids last), then the smallest text key (null
    text first); of fully equal rows one stays."""
    return shielded(docs, [doc_id, text], lambda d: _near_dedup(d, doc_id, text, options))


def _near_dedup(docs: DataFrame, doc_id: str, text: str, options: dict) -> DataFrame:
    marked = shared_table(simhash_components(docs, doc_id=doc_id, text=text, **options), "components")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"),
                     F.col("text_key").isNotNull(), F.col("text_key").alias("key"))
    best = marked.groupBy("root").agg(F.min(order).alias("best")).select("best.id", "best.key")
    copies = (marked.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
              .groupBy("id", "key").agg(F.count("*").alias("_n")))
    kept = shared_table(
        best.alias("b").join(copies.alias("c"), F.expr("b.id <=> c.id AND b.key <=> c.key"))
        .select(F.col("b.id").alias("_id"), F.col("b.key").alias("_key"), "_n"), "kept")
    rows, repeated = kept.agg(F.count("*"), F.sum((F.col("_n") > 1).cast("int"))).first()
    keyed = docs.withColumn("_tk", text_key(text))
    cond = F.col(doc_id).eqNullSafe(F.col("_id")) & F.col("_tk").eqNullSafe(F.col("_key"))
    joined = keyed.join(small_side(kept, rows, 96), cond).drop("_id", "_key")
    out = joined.where("_n = 1")
    if repeated:  # fully equal rows exist: only those are compared as rows
        out = out.unionByName(joined.where("_n > 1").dropDuplicates([doc_id, "_tk"]))
    return out.select(*docs.columns)
