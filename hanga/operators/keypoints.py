"""Per-image keypoint selection and the descriptor plug point.

A keypoint table has one row per keypoint: ``key`` (image), id columns, a
``response`` and a descriptor array. Both selections are per-image top-k
filters over ``row_number``; Spark plans them with a partial
WindowGroupLimit before each shuffle.

Hot images: if one image holds a third of all keypoints, the partial limit
still sends up to k rows from *every* input task to the image's one reducer.
Both selections therefore reduce as a tree, always: first top-k per (image,
source-partition group), then top-k per image, so a reducer gets about k x
tasks / FAN_IN rows, and the last one k x FAN_IN. The order must be total (ids
that tell the keypoints of an image apart), so the result does not depend on
the grouping.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_KEYPOINTS = 4000   # kept per image by response
SAMPLE_PER_IMAGE = 42  # sampled per image for clustering


FAN_IN = 32            # first-level groups of an image's keypoints


def _two_level_top(kps: DataFrame, k: int, key_col: str, order, fan_in: int,
                   rank_col: str) -> DataFrame:
    group = F.pmod(F.spark_partition_id(), F.lit(fan_in))
    w1 = Window.partitionBy(key_col, "__grp").orderBy(*order)
    kps = (kps.withColumn("__grp", group)
           .withColumn("__r1", F.row_number().over(w1)).where(F.col("__r1") <= k)
           .drop("__grp", "__r1"))
    w = Window.partitionBy(key_col).orderBy(*order)
    return kps.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def _need_ids(cols: list[str] | None) -> list[str]:
    if not cols:
        raise ValueError("name the columns that tell the keypoints of an image apart")
    return cols


def strongest(kps: DataFrame, k: int = MAX_KEYPOINTS, key_col: str = "key",
              response_col: str = "response", tie_cols: list[str] | None = None,
              fan_in: int = FAN_IN) -> DataFrame:
    """The k keypoints with the highest response per image (T1). Equal
    responses are ordered by ``tie_cols`` ascending. Adds ``kp_rank`` (1 =
    strongest)."""
    order = [F.col(response_col).desc()] + [F.col(c).asc() for c in _need_ids(tie_cols)]
    return _two_level_top(kps, k, key_col, order, fan_in, "kp_rank")


def sample_order(key_col: str, id_cols: list[str], seed: int) -> F.Column:
    """Seeded pseudo-random order of keypoints: md5 of key, ids and seed."""
    parts = [F.col(key_col).cast("string")] + [F.col(c).cast("string") for c in id_cols]
    return F.md5(F.concat_ws(":", *parts, F.lit(str(seed))))


def sample(kps: DataFrame, n: int = SAMPLE_PER_IMAGE, key_col: str = "key",
           id_cols: list[str] | None = None, seed: int = 0,
           fan_in: int = FAN_IN) -> DataFrame:
    """At most n keypoints per image in a seeded random order (T2); an image
    with n or fewer keypoints keeps them all (quirk K15: seeded)."""
    id_cols = _need_ids(id_cols)
    order = [sample_order(key_col, id_cols, seed)] + [F.col(c) for c in id_cols]
    return _two_level_top(kps, n, key_col, order, fan_in, "sample_rank")


# --- descriptor plug point (U1) -------------------------------------------------

SQL_CHUNK = 512     # rows of a SQL partition handed to a descriptor at once
SQL_CHUNK_BYTES = 16 * 1024 * 1024      # and bytes (of text: characters) of their content, one row at least
DescriptorFn = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
_DESCRIPTORS: dict[str, tuple[DescriptorFn, str]] = {}


def register_descriptor(name: str, schema: str):
    """Register ``fn(batches) -> batches`` under ``name``; ``schema`` is the
    DDL of the rows it yields (one row per keypoint, ``key`` first)."""
    def deco(fn: DescriptorFn) -> DescriptorFn:
        _DESCRIPTORS[name] = (fn, schema)
        return fn
    return deco


def describe(images: DataFrame, name: str) -> DataFrame:
    """Run the descriptor registered as ``name`` over image rows (``key``,
    ``content``) with ``mapInPandas``; adds ``descriptor_name``. Whitelist and
    done-checks (``catalog.manifest_filter`` / ``catalog.pending``) belong
    before this call: Catalyst cannot push filters through Python."""
    if name not in _DESCRIPTORS:
        raise KeyError(f"unknown descriptor {name!r}; known: {sorted(_DESCRIPTORS)}")
    fn, schema = _DESCRIPTORS[name]
    return images.mapInPandas(fn, schema).withColumn("descriptor_name", F.lit(name))


def _object_column(values: list) -> pd.Series:
    """Values as they are: beside a null, pandas would read whole numbers as
    floating-point ones."""
    return pd.Series(values, dtype=object if any(v is None for v in values) else None)


def _table_function(name: str):
    """The registered descriptor as a table function over (key, content) rows:
    rows are handed to it in chunks, and those of the last chunk at the end of
    each SQL partition (without ``PARTITION BY``: of each task's rows)."""
    fn, schema = _DESCRIPTORS[name]

    class Describe:
        def __init__(self):
            self.rows: list[tuple] = []
            self.size = 0

        def _run(self):
            keys, contents = zip(*self.rows, strict=True)
            self.rows, self.size = [], 0
            pdf = pd.DataFrame({"key": _object_column(keys), "content": _object_column(contents)})
            for out in fn(iter([pdf])):
                # plain Python values: a table function returns rows, not arrays
                yield from zip(*[out[c].astype(object) for c in out.columns], strict=True)

        def eval(self, row):
            key, content = row["key"], row["content"]
            self.rows.append((key, content))
            self.size += len(content) if hasattr(content, "__len__") else 8
            if len(self.rows) >= SQL_CHUNK or self.size >= SQL_CHUNK_BYTES:
                yield from self._run()

        def terminate(self):
            if self.rows:
                yield from self._run()

    return F.udtf(Describe, returnType=schema)


def register_sql(spark: SparkSession) -> list[str]:
    """Make every registered descriptor callable from SQL (U1) as
    ``describe_<name>(TABLE(images))``, which describes the rows where they are,
    many at a time; returns the names. ``PARTITION BY key`` gives the same rows
    after a sort of all contents and a call of the descriptor for every key."""
    for name in _DESCRIPTORS:
        spark.udtf.register(f"describe_{name}", _table_function(name))
    return [f"describe_{name}" for name in _DESCRIPTORS]


def describe_sql(images: DataFrame, name: str) -> DataFrame:
    """:func:`describe` through SQL, over the rows of ``images`` (key, content)
    as they are partitioned. An unknown name is an error that lists the known
    ones."""
    if name not in _DESCRIPTORS:
        raise KeyError(f"unknown descriptor {name!r}; known: {sorted(_DESCRIPTORS)}")
    spark = images.sparkSession
    register_sql(spark)
    return spark.sql(f"SELECT *, '{name}' AS descriptor_name "
                     f"FROM describe_{name}(TABLE(SELECT key, content FROM {{images}}))", images=images)
