"""Which batches of an output table may hold given keys.

Every written batch leaves a sketch of its keys: a blocked Bloom filter, one row
per block of ``BLOCK_BITS`` bits (built by Spark's own bitmap aggregate). A key
sets ``HASHES`` bits of one block; with ``KEYS_PER_BLOCK`` keys in a block, about
one in 200,000 keys that a batch does not hold looks as if it did. A new batch
tests its keys against the sketches, reads only the batches that may hold one of
them, and compares keys exactly there: nothing is skipped or repeated because of
the sketch, it only says which files need no reading.

The sketches take four bytes per key; they are read and tested in tasks. The new
keys' hashes are sent to them when their counted size fits the broadcast limit;
a larger set of new keys looks at every batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_limit, path_exists

BLOCK_BITS = 32_768         # the size of Spark's bitmaps
HASHES, KEYS_PER_BLOCK = 8, 1_024
INDEX = "_done_index"       # beside the batches; readers pass over names with an underscore


def _hash(i: int) -> Column:
    return F.xxhash64(F.col("key").cast("string"), F.lit(i))


def write_sketch(keys: DataFrame, output: str, batch: str) -> None:
    """Sketch the column ``key`` of one batch; a repeated batch replaces its own."""
    blocks = max(1, -(-keys.count() // KEYS_PER_BLOCK))
    bit = F.explode(F.array(*[F.pmod(_hash(i), F.lit(BLOCK_BITS)) for i in range(1, HASHES + 1)]))
    (keys.select(F.pmod(_hash(0), F.lit(blocks)).alias("block"), bit.alias("bit"))
     .groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
     .select(F.lit(batch).alias("of"), F.lit(blocks).cast("long").alias("blocks"), "block", "bits")
     .write.mode("overwrite").parquet(f"{output.rstrip('/')}/{INDEX}/batch={batch}"))


def batches(spark: SparkSession, output: str) -> list[str]:
    """Names of the batches of an output table, from its folders alone."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(output)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    if path_exists(spark, f"{output.rstrip('/')}/_SUCCESS"):
        raise ValueError(f"{output} was not written batch by batch; choose another output folder")
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    done = [n for n in names if n.startswith("batch=") and path_exists(spark, f"{output.rstrip('/')}/{n}/_SUCCESS")]
    return sorted(n.removeprefix("batch=") for n in done)


def may_hold(new: DataFrame, output: str) -> list[str]:
    """The batches that may hold a ``key`` of ``new``: those whose sketch says
    so, and those that have none (a run ended before it was written)."""
    spark = new.sparkSession
    known = batches(spark, output)
    if not known or not path_exists(spark, f"{output.rstrip('/')}/{INDEX}"):
        return known
    n = new.count()
    if n * 8 * (HASHES + 1) > broadcast_limit(spark):
        return known
    sketches = spark.read.parquet(f"{output.rstrip('/')}/{INDEX}").select("of", "blocks", "block", "bits")
    table = new.select(*[_hash(i).alias(f"h{i}") for i in range(HASHES + 1)]).toArrow()
    bc = spark.sparkContext.broadcast(np.array([c.to_numpy() for c in table.columns], np.int64).reshape(HASHES + 1, n))

    def test(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = bc.value
        for b in rows:
            hit = []
            for blocks, block, bits in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                at = h[1:, h[0] % blocks == block] % BLOCK_BITS
                have = np.frombuffer(bits, np.uint8)[at >> 3] >> (at & 7) & 1
                hit.append(bool(have.all(axis=0).any()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hit, pa.bool_())], names=["of", "hit"])

    seen = {r["of"]: r["hit"] for r in sketches.mapInArrow(test, "of string, hit boolean")
            .groupBy("of").agg(F.max("hit").alias("hit")).collect()}
    sketched = set(batches(spark, f"{output.rstrip('/')}/{INDEX}"))     # an empty batch has an empty sketch
    return [b for b in known if seen.get(b, b not in sketched)]


def done_keys(spark: SparkSession, output: str, of: list[str]) -> DataFrame | None:
    """Keys of the given batches (their files alone are read); None for none."""
    if not of:
        return None
    root = output.rstrip("/")
    return spark.read.parquet(*[f"{root}/batch={b}" for b in of]).select(F.col("key").cast("string").alias("name"))
