"""Bounded samples of labelled documents for fitting classifiers: bounded in
rows and, together, in bytes of text (``SAMPLE_BYTES``), not in single texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import shared_table

SAMPLE_BYTES = 48 << 20


def among_smallest(df: DataFrame, rows: int, h: Column) -> Column:
    """Admits the rows that can be among the ``rows`` smallest hashes ``h`` of
    ``df``, and few others. The table is counted for it, so that no task hands
    on its own ``rows`` smallest."""
    return (h.cast("double") / float(1 << 63) + 1) / 2 * df.count() <= 2.0 * rows + 64


def smallest_hashes(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """The ``rows`` rows of ``df`` with the smallest hash of ``columns`` (rows
    equal in them count once)."""
    h = F.xxhash64(*columns)
    return (df.where(among_smallest(df, rows, h)).dropDuplicates(list(columns))
            .orderBy(h, *columns).limit(rows))


def texts_in_budget(sample: DataFrame, text: str, order: list[str], max_bytes: int = SAMPLE_BYTES) -> list[Row]:
    """The rows of a sample of bounded rows, as long as their texts together
    keep to ``max_bytes``: in the order of the columns ``order``, a text that
    does not fit in what is left is passed over, the next ones are not. Texts
    stay whole, whatever their length."""
    held = shared_table(sample, "fit-sample")
    sizes = held.groupBy(*order).agg(F.sum(F.octet_length(text)).alias("_bytes")).orderBy(*order).collect()
    left, over = max_bytes, []
    for r in sizes:
        if r["_bytes"] <= left:
            left -= r["_bytes"]
        else:
            over.append(tuple(r[c] for c in order))
    if over:
        gone = held.sparkSession.createDataFrame(over, held.select(*order).schema)
        held = held.join(F.broadcast(gone), order, "left_anti")      # at most the sample's rows
    return held.collect()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int,
                    fold: Column | None = None, max_bytes: int = SAMPLE_BYTES,
                    doc_id: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """At most ``rows`` (text, label) pairs of at most ``max_bytes`` together,
    chosen by a hash of the id, from labels that ``fold`` (a boolean column on
    the id) admits.

    Null ids and null labels are left out; of repeated labels of one id the
    largest holds; null texts count as empty. The order is fixed, so a fit does
    not depend on partitioning."""
    marks = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    if fold is not None:
        marks = marks.where(fold)
    marks = marks.groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    marks = smallest_hashes(marks, rows, "_id")
    texts = (docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
             .join(F.broadcast(marks), "_id")          # at most ``rows`` ids
             .groupBy("_id").agg(F.min("_t").alias("_t"), F.max("_y").alias("_y"))
             .select(F.xxhash64("_id").alias("_h"), "_id", "_t", "_y"))
    got = texts_in_budget(texts, "_t", ["_h", "_id"], max_bytes)
    got.sort(key=lambda r: str(r["_id"]))
    return [(r["_t"], r["_y"]) for r in got]
