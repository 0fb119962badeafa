"""Bucketed tables: join keys laid out once, joined many times.

A table that is written with its rows dealt by a hash of their key into
``buckets`` files per task, each sorted, is joined on that key without a shuffle
of its own; only the other side is dealt into the same buckets. A growing sample
or done-key table is laid out once per run and never shuffled again.

One bucket is read by one task, so ``buckets`` should leave a few hundred
megabytes in each, and the key should not have a single value with a large share
of all rows (image keys have one row per image).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path


def write_bucketed(df: DataFrame, key: str = "key", buckets: int | None = None, path: str | None = None,
                   table: str | None = None) -> str:
    """Write ``df`` bucketed and sorted by ``key`` and return the table's name.
    ``path`` is its folder (default: a fresh one in the shared folder);
    ``buckets`` defaults to the session's shuffle partitions."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = table or f"hanga_{uuid.uuid4().hex}"
    # dealt by the same hash first: one file per bucket instead of one per task and bucket
    (df.repartition(n, key).write.bucketBy(n, key).sortBy(key)
     .option("path", path or scratch_path(spark, "bucketed")).mode("overwrite").saveAsTable(name))
    return name


def drop_bucketed(spark: SparkSession, table: str) -> None:
    """Forget the table; its files stay where they were written."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
