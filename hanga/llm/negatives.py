"""Hard-negative mining by Fagin's threshold algorithm.

For each anchor the ``n_positives`` best rows of its own label are positives;
for each (anchor, positive) the ``n_negatives`` best rows of other labels whose
score lies in the window ``low * p <= 100 * score <= high * p`` (p: the
positive's score) are its hard negatives. A score is the inner product of
vectors quantised to integers (``floor(scale * x)``); higher scores come first,
ties by smaller id.

Method, inside one block of candidates: one list per dimension holds the
candidates sorted by that component. An anchor reads each list from the end
that its own component's sign prefers (sorted access), scores every candidate
it meets for the first time with all its components (random access, exact
integers), and keeps the threshold, the score that a candidate at the lists'
present places would have. No unmet candidate scores higher, so an anchor stops
once its threshold falls strictly below the kth score of every window (strictly:
at a tie an unmet row may have the smaller id), or below the window itself.
Lists are read in steps that grow, for many anchors of a block side by side.

Scale. Anchors are a stated query set against all rows, so the work is their
product. Both sides are dealt into blocks of bounded size by hashes of their
ids, each pair of blocks meets in one task (``cogroup``), and a block's best
rows (a bounded number per anchor) are merged by a top-k per anchor. No table
passes through the driver, and nothing is broadcast. Positives meet rows of
their label only, dealt again inside the label, so a hot label is many blocks.

Defined results: a null id, label or vector, or a null or non-finite component
takes no part. A row is known by its id: of rows that share one, the one with
the least (label, vector) counts. Vectors meet only vectors of their width;
empty vectors score 0. Ids must fit a long, and so must scores (a sum that does
not is an error, never a wrapped number). Empty tables give an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95          # percent of the positive's score
CANDIDATES, ANCHORS = 16_384, 1_024     # rows of a block, at most about
_FIRST_STEP, _GROWTH, _TOGETHER = 8, 4, 64


def usable(df: DataFrame, id: str, label: str | Column, vector: str) -> DataFrame:
    """(id, label, v, width) of the rows that take part, one per id."""
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id).cast("long").alias("id"),
                     (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"),
                     F.col(vector).alias("v"))
    rows = rows.where("id is not null and label is not null and v is not null").where(~odd)
    return (rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"))
            .select("id", "r.label", "r.v", F.size("r.v").alias("width")))


def _matrix(column: pa.ChunkedArray, width: int, scale: float) -> np.ndarray:
    """Quantised vectors, one per row, as exact whole numbers in doubles."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.floor(scale * flat.astype(np.float64)).reshape(len(column), width)


def _exact_type(a: np.ndarray, x: np.ndarray):
    """The cheapest number type in which every partial sum of an inner product
    is exact (Cauchy-Schwarz bounds the sum of absolute products)."""
    def longest(m: np.ndarray) -> float:
        return float(np.sqrt((m * m).sum(axis=1).max(initial=0.0)))
    bound = longest(a) * longest(x) * 1.001
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object


def _whole(m: np.ndarray, kind) -> np.ndarray:
    if kind is not object:
        return m.astype(kind)
    return np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)


class Block:
    """Candidates of one block with a sorted list per dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        at = np.argsort(ids, kind="stable")      # position order is id order
        self.ids, self.labels, self.x = ids[at], labels[at], x[at]
        self.order = np.argsort(-self.x, axis=0, kind="stable").T.astype(np.int32).copy()
        self.sorted = np.take_along_axis(self.x.T, self.order, axis=1)

    def __len__(self) -> int:
        return len(self.ids)

    def access(self, anchor: np.ndarray, start: int, end: int) -> np.ndarray:
        """Places [start, end) of every list, read from the end that the sign
        of the anchor's component prefers; zero components need no list."""
        n = len(self)
        return np.concatenate([self.order[anchor > 0, start:end].ravel(),
                               self.order[anchor < 0, n - end:n - start].ravel()])

    def threshold(self, anchors: np.ndarray, depth: int) -> np.ndarray:
        """Upper bound of the score of any row not met within ``depth`` places."""
        n = len(self)
        return (np.clip(anchors, 0, None) @ self.sorted[:, depth - 1]
                + np.clip(anchors, None, 0) @ self.sorted[:, n - depth])


def threshold_scan(block: Block, anchors: np.ndarray,
                   finished: Callable[[int, float, np.ndarray, np.ndarray], bool]
                   ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every anchor: (its number, met rows as a mask, scores where met).
    ``finished(i, threshold, met, scores)`` says whether no unmet row matters."""
    kind, n = _exact_type(anchors, block.x), len(block)
    x, a = _whole(block.x, kind), _whole(anchors, kind)
    for lo in range(0, len(anchors), _TOGETHER):
        some = slice(lo, min(lo + _TOGETHER, len(anchors)))
        count = some.stop - lo
        met, scored = np.zeros((count, n), bool), np.zeros((count, n), bool)
        scores = np.zeros((count, n), kind)
        alive, start, step = list(range(count)), 0, _FIRST_STEP
        while alive:
            end = min(start + step, n)
            for i in alive:
                met[i, block.access(anchors[lo + i], start, end)] = True
            if end == n:
                met[alive] = True                # anchors with zero components only
            new = met[alive] & ~scored[alive]
            if new.mean() > 0.1 and kind is not object:
                scores[alive] = a[some][alive] @ x.T
                scored[alive] = True             # only met rows are looked at
            else:
                for i, fresh in zip(alive, new, strict=True):
                    at = np.flatnonzero(fresh)
                    scores[i, at] = x[at] @ a[lo + i]
                    scored[i, at] = True
            # beyond exact doubles the threshold may be rounded: read on to the end
            bound = (block.threshold(anchors[some][alive], end) if kind is not object
                     else np.full(len(alive), np.inf)) if end < n else None
            still = []
            for k, i in enumerate(alive):
                if bound is not None and not finished(lo + i, bound[k], met[i], scores[i]):
                    still.append(i)
                else:
                    yield lo + i, met[i], scores[i]
            alive, start, step = still, end, step * _GROWTH


def _best(at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The k first of the places ``at`` by score, highest first, ties by place
    (places are in id order)."""
    values = scores[at]
    if len(at) > 4 * k:
        kth = np.partition(values, len(at) - k)[len(at) - k] if values.dtype != object else sorted(values)[-k]
        keep = values >= kth
        at, values = at[keep], values[keep]
    # a stable sort of the reversed places, reversed: ties stay in place order
    return at[::-1][np.argsort(values[::-1], kind="stable")][::-1][:k]


def _kth(values: np.ndarray, k: int):
    if len(values) < k:
        return None
    return sorted(values)[-k] if values.dtype == object else np.partition(values, len(values) - k)[len(values) - k]


def _read(t: pa.Table, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = t.column("width")[0].as_py()
    return (t.column("id").to_numpy(), t.column("label").to_numpy(), _matrix(t.column("v"), width, scale))


def _positives(k: int, scale: float):
    """Best k rows of the anchor's label in one pair of blocks."""
    schema = pa.schema([("anchor_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        anchor_ids, _, a = _read(left, scale)
        block = Block(*_read(right, scale))
        others = [block.ids != i for i in anchor_ids]

        def finished(i: int, bound: float, met: np.ndarray, scores: np.ndarray) -> bool:
            kth = _kth(scores[met & others[i]], k)
            return kth is not None and bound < kth

        rows: list[tuple] = []
        for i, met, scores in threshold_scan(block, a, finished):
            rows += [(anchor_ids[i], block.ids[j], int(scores[j]))
                     for j in _best(np.flatnonzero(met & others[i]), scores, k)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                                    schema=schema) if rows else schema.empty_table()
    return run


def _negatives(k: int, low: int, high: int, scale: float):
    """Best k rows of other labels in every window of one pair of blocks."""
    names = ("anchor_id", "positive_id", "positive_score", "id", "score")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        anchor_ids, labels, a = _read(left, scale)
        windows = [[(p["id"], p["score"], -(-low * p["score"] // 100), high * p["score"] // 100) for p in w]
                   for w in left.column("windows").to_pylist()]
        # a negative score has an empty window
        windows = [[w for w in some if w[2] <= w[3]] for some in windows]
        block = Block(*_read(right, scale))
        others = {y: block.labels != y for y in set(labels.tolist())}

        def finished(i: int, bound: float, met: np.ndarray, scores: np.ndarray) -> bool:
            if any(bound >= top for _, _, _, top in windows[i]):
                return False
            seen = scores[met & others[labels[i]]]
            for _, _, bottom, top in windows[i]:
                if bound >= bottom:
                    kth = _kth(seen[(seen >= bottom) & (seen <= top)], k)
                    if kth is None or bound >= kth:
                        return False
            return True

        rows: list[tuple] = []
        for i, met, scores in threshold_scan(block, a, finished):
            at = np.flatnonzero(met & others[labels[i]])
            seen = scores[at]
            for positive, score, bottom, top in windows[i]:
                inside = at[(seen >= bottom) & (seen <= top)]
                rows += [(anchor_ids[i], positive, score, block.ids[j], int(scores[j]))
                         for j in _best(inside, scores, k)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                                    schema=schema) if rows else schema.empty_table()
    return run


def _top(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("id"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, id: str = "vec_id", label: str | Column = "label",
         vector: str = "embedding", n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, scale: float = SCALE,
         block_rows: int = CANDIDATES, block_anchors: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score). ``is_anchor`` is a condition on the column ``id``."""
    spark = vectors.sparkSession
    rows = shared_table(usable(vectors, id, label, vector), "vectors")
    anchors = rows.where(is_anchor)
    n, n_anchors = rows.count(), anchors.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = max(1, -(-n_anchors // block_anchors))
    blocks = max(1, -(-n // block_rows), -(-parts // sets))

    def dealt(count: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def pairs(a: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
        left = a.withColumn("aset", dealt(sets, 1)).withColumn("cblock", every(blocks))
        right = rows.withColumn("cblock", dealt(blocks, 2)).withColumn("aset", every(sets))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(fn, schema)

    found = pairs(anchors, ["width", "label", "aset", "cblock"], _positives(n_positives, scale),
                  "anchor_id long, id long, score long")
    windows = (_top(found, ["anchor_id"], n_positives).groupBy(F.col("anchor_id").alias("id"))
               .agg(F.collect_list(F.struct(F.col("id").alias("id"), "score")).alias("windows")))
    windows = shared_table(anchors.join(windows, "id"), "windows")
    found = pairs(windows, ["width", "aset", "cblock"], _negatives(n_negatives, low, high, scale),
                  "anchor_id long, positive_id long, positive_score long, id long, score long")
    return _top(found, ["anchor_id", "positive_id"], n_negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
