"""Shared helpers of the training-data operators: table reading, row keys,
tables written to the shared folder, and connected components.

Row identity. Operators that come back to a document (rewrite its text, join a
decision on) use the pair (``doc_id``, ``xxhash64(text)``) compared null-safe,
so a null or repeated ``doc_id`` never mixes two different texts; fully equal
rows share a key and therefore always share a result.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hanga.session import broadcast_limit, ensure_checkpoint_dir

SLICE = 500   # rows turned into Python objects at a time
_written: list[str] = []
_lock = threading.Lock()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder (``spark.checkpoint.dir``) and read it
    back: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    with _lock:
        _written.append(path)
    return spark.read.parquet(path)


def clean_shared(spark: SparkSession) -> int:
    """Delete every table written by :func:`shared_table` in this process;
    call it when the results that read them have been saved."""
    with _lock:
        paths, _written[:] = list(_written), []
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def text_key(text: str | Column = "text") -> Column:
    """64-bit identity of a text (0-length and null differ)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(c.isNull(), F.lit(None).cast("long")).otherwise(F.xxhash64(c))


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint for a side whose counted size fits the limit; otherwise
    the side is returned as is and the planner shuffles both."""
    return F.broadcast(df) if rows * row_bytes <= broadcast_limit(df.sparkSession) else df


def in_fold(doc_id: str | Column, mod: int, rest: int) -> Column:
    """True when crc32 of the id as text leaves ``rest`` (null id: false)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % mod == rest, F.lit(False))


def shielded(docs: DataFrame, needed: list[str], run: Callable[[DataFrame], DataFrame],
             added: tuple[str, ...] = ()) -> DataFrame:
    """``run(docs)`` with every column but ``needed`` under a neutral name, so
    that no column of the input can clash with one the operator uses inside.
    Names are restored after; an input column of the same name as one that the
    operator returns (``added``, in any case) gives way to it."""
    names = docs.columns
    hidden = [n if n in needed else f"__extra_{i}" for i, n in enumerate(names)]
    back = {h: n for h, n in zip(hidden, names, strict=True) if h != n}
    gone = {a.lower() for a in added}
    out = run(docs.toDF(*hidden))
    return out.select(*[F.col(c).alias(back.get(c, c)) for c in out.columns
                        if c not in back or back[c].lower() not in gone])


def map_texts(df: DataFrame, columns: list[str], fn: Callable[[list], tuple | list],
              schema: str) -> DataFrame:
    """Append columns computed by ``fn`` (a list of Python values per input
    column in, one list per output column out) to the given columns of ``df``,
    one Arrow batch at a time. ``schema`` names the appended columns.

    Only ``columns`` become Python values, ``SLICE`` rows at a time whatever
    the batch size; the pass-through part is handed on as Arrow."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    added = _parse_datatype_string(schema)
    out = StructType([*df.schema.fields, *added.fields])
    idx = [df.columns.index(c) for c in columns]
    types = [_arrow_type(f.dataType) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = fn(*(b.column(i).to_pylist() for i in idx))
            arrays = b.columns + [x if isinstance(x, pa.Array) else pa.array(x, t)
                             for x, t in zip(got, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=out.fieldNames())

    return df.mapInArrow(run, out)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that texts are held as Python
    objects a few at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def _arrow_type(t):
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(t)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """Connected components of an undirected edge list of longs.

    Returns (node, root) for every node that occurs in an edge; ``root`` is the
    smallest node of its component. Alternating large-star / small-star rounds:
    each keeps at most one edge per (node, smaller neighbour), all steps are
    map-side combined minima and equi-joins, so a hub only costs its degree.
    Every round is checkpointed to the shared folder; the loop ends when a
    round changes nothing (raises if ``max_rounds`` does not suffice)."""
    e = (edges.where(F.col(a) != F.col(b))
         .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    e = shared_table(e, "edges")
    seen = None
    for _ in range(max_rounds):
        # large star: larger neighbours of u are tied to the minimum around u
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # small star: u and its smaller neighbours are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct("u", F.col("m").alias("v")))).alias("p"))
                 .select("p.*").where("u <> v").distinct())
        e = shared_table(small, "edges")
        sign = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sign) == seen:
            roots = e.groupBy("u").agg(F.min("v").alias("root"))
            return (roots.withColumnRenamed("u", "node")
                    .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
        seen = tuple(sign)
    raise RuntimeError(f"components: not converged after {max_rounds} rounds")
