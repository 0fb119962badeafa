"""Deterministic train/test split, stratified folds and class weights (M3, M7,
A12).

Rows are ordered by ``md5(seed || key)``. An exact position in that order is
needed (the split size is exact, folds are position mod k), but a global
``row_number`` would pull every row into one task. Instead:

1. count rows per (group, 4-hex-digit hash bucket) — a partial aggregate, at
   most groups x 65,536 rows;
2. turn the counts into bucket offsets with a window over that small table;
3. rank rows only inside their own bucket (about n / 65,536 rows per task
   for uniformly spread md5 values) and add the offset.

For the split only the single bucket that straddles the cut needs step 3;
every other row is decided by its bucket's offset, so the data is not
shuffled at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, measured_broadcast

BUCKET_HEX = 4
N_BUCKETS = 16 ** BUCKET_HEX


def _hashed(df: DataFrame, key_col: str, seed: str) -> DataFrame:
    h = F.md5(F.concat(F.lit(seed), F.col(key_col).cast("string")))
    return df.withColumn("__h", h).withColumn("__b", F.substring("__h", 1, BUCKET_HEX))


def _bucket_offsets(hashed: DataFrame, group_cols: list[str]) -> DataFrame:
    counts = hashed.groupBy(*group_cols, "__b").agg(F.count(F.lit(1)).alias("__cnt"))
    before = Window.partitionBy(*group_cols).orderBy("__b").rowsBetween(
        Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group_cols)
    return (counts
            .withColumn("__off", F.coalesce(F.sum("__cnt").over(before), F.lit(0)))
            .withColumn("__n", F.sum("__cnt").over(whole)))


def hash_rank(df: DataFrame, key_col: str = "key", group_cols: list[str] | None = None,
              seed: str = "") -> DataFrame:
    """Adds ``hash_rank`` (0-based position in md5 order within the group) and
    ``group_size``. The offset table is materialised and broadcast only when
    its measured size fits the limit."""
    group_cols = group_cols or []
    hashed = _hashed(df, key_col, seed)
    offsets = _bucket_offsets(hashed, group_cols)
    side = measured_broadcast(offsets, 64)
    local = Window.partitionBy(*group_cols, "__b").orderBy("__h", key_col)
    return (hashed.join(side, [*group_cols, "__b"])
            .withColumn("hash_rank", F.col("__off") + F.row_number().over(local) - 1)
            .withColumnRenamed("__n", "group_size")
            .drop("__h", "__b", "__cnt", "__off"))


def train_test_split(df: DataFrame, train_fraction: float, key_col: str = "key",
                     seed: str = "") -> DataFrame:
    """Adds ``split`` in {'train', 'test'}: the first floor(n * fraction) rows
    in md5 order are train (M3; quirk K20: train = floor)."""
    hashed = _hashed(df, key_col, seed)
    offsets = _bucket_offsets(hashed, []).withColumn(
        "__ntrain", F.floor(F.col("__n") * F.lit(float(train_fraction))))
    side = F.broadcast(cut_lineage(offsets))  # one row per bucket: a proven bound (3 MB)
    # rank only the keys of the one bucket that straddles the cut; its first
    # rows up to the cut are train, everything else follows from its bucket
    straddles = (F.col("__off") < F.col("__ntrain")) & (F.col("__off") + F.col("__cnt") > F.col("__ntrain"))
    cut = side.where(straddles).select("__b", "__off", "__ntrain")
    w = Window.partitionBy("__b").orderBy("__h", key_col)
    first = (hashed.select(key_col, "__h", "__b").join(cut, "__b")
             .withColumn("__r", F.row_number().over(w))
             .where(F.col("__off") + F.col("__r") <= F.col("__ntrain"))
             .groupBy("__b").agg(F.max(F.struct("__h", key_col)).alias("__last")))
    j = hashed.join(side, "__b").join(F.broadcast(first), "__b", "left")  # at most one bucket
    in_train = (F.col("__off") + F.col("__cnt") <= F.col("__ntrain")) | (
        straddles & (F.struct("__h", key_col) <= F.col("__last")))
    return (j.withColumn("split", F.when(F.coalesce(in_train, F.lit(False)), F.lit("train"))
                         .otherwise(F.lit("test")))
            .drop("__h", "__b", "__cnt", "__off", "__n", "__ntrain", "__last"))


def stratified_folds(df: DataFrame, n_folds: int = 3, key_col: str = "key",
                     label_col: str = "class_id", seed: str = "") -> DataFrame:
    """Adds ``fold`` = (rank within class in md5 order) mod ``n_folds`` (M7),
    so every fold gets an equal share of every class."""
    r = hash_rank(df, key_col, [label_col], seed)
    return r.withColumn("fold", (F.col("hash_rank") % n_folds).cast("int")) \
        .drop("hash_rank", "group_size")


def class_weights(df: DataFrame, label_col: str = "class_id") -> DataFrame:
    """Balanced weights ``n / (C * n_c)`` over the classes present.
    Returns ``(class_id, n_c, weight)``; at most one row per class."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))
    allw = Window.partitionBy()  # over the per-class counts only
    return counts.select(
        label_col, "n_c",
        (F.sum("n_c").over(allw) / (F.count(F.lit(1)).over(allw) * F.col("n_c")))
        .alias("weight"))


def with_class_weights(df: DataFrame, label_col: str = "class_id",
                       weight_col: str = "weight") -> DataFrame:
    """Attach each row's balanced class weight (for ``weightCol``)."""
    w = class_weights(df, label_col).select(label_col, F.col("weight").alias(weight_col))
    return df.join(measured_broadcast(w, 32), label_col)
