"""Incremental processing of a growing input folder (F5 as a stream).

The reference re-runs a script and skips keys whose output file exists. The
streaming form: a file-source stream over the input folder (new files only,
progress kept in a checkpoint in the shared folder), and per micro-batch
``foreachBatch`` runs a batch function over the new files' keys, drops keys
already present in the output table and writes the rest as a batch of its own
(``batch=<stream>-<number>``, a partition column of the output). A batch that is
replayed after a failure replaces itself. ``availableNow`` processes what is
there and stops, like one run of the reference script.

Keys that are done are found through a sketch per batch (``done_index``): old
batches without any of the new keys are not opened.

No watermark, window or state is involved: the reference has none.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import basename, file_key
from ..operators.catalog import pending
from ..session import shared_root
from .done_index import done_keys, may_hold, write_sketch

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the stream of this checkpoint folder."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def run_available(spark: SparkSession, input_dir: str, output_path: str,
                  process: Callable[[DataFrame], DataFrame], glob: str = "*",
                  checkpoint: str | None = None) -> int:
    """Process every input file not seen before; ``process`` maps a
    DataFrame ``(key, path)`` of new files to output rows with a ``key``
    column; the output has a further column ``batch``. Returns the number of micro-batches run."""
    # stable per output table across runs (Python's hash() is salted per process)
    tag = hashlib.md5(output_path.encode("utf-8")).hexdigest()[:16]
    ckpt = checkpoint or f"{shared_root(spark)}/stream-{tag}"
    files = (spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
             .option("pathGlobFilter", glob).load(input_dir))
    batches = []

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        name = f"{_stream_id(spark, ckpt)}-{epoch}"
        new = batch.select(file_key(basename("path")).alias("key"), "path")
        others = [b for b in may_hold(new.select("key"), output_path) if b != name]
        done = done_keys(spark, output_path, others)
        if done is not None:
            new = pending(new, done, "key", "name")
        target = f"{output_path.rstrip('/')}/batch={name}"
        process(new).write.mode("overwrite").parquet(target)
        write_sketch(spark.read.parquet(target).select("key"), output_path, name)
        batches.append(epoch)

    q = (files.select("path").writeStream.foreachBatch(each)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return len(batches)
