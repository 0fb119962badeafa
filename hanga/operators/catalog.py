"""Catalogue filtering and labelling.

Records carry an ``artist`` column; labels are ``key::artist`` text lines.
Bad input is never silently dropped: every step that rejects rows returns the
rejects with a ``reason`` next to the accepted rows (F6).

Scale notes: the class dimension is the only side ever broadcast, after its
row count is checked. Done-output tables (F5) and manifests (F4) grow with
the data, so they are joined without a broadcast hint and left to the planner
(sort-merge, or a runtime broadcast by AQE when they turn out small).
De-duplication is an aggregate with map-side partial merge, so a key held by a
third of all lines is combined inside each task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import checksum_from_path, file_key, unicode_trim
from ..session import bounded_broadcast, col_or_name

LABEL_SEP = "::"


def _class_side(class_dim: DataFrame) -> DataFrame:
    return bounded_broadcast(class_dim, class_dim.count(), 256)


def filter_by_class(records: DataFrame, class_dim: DataFrame,
                    artist_col: str = "artist") -> DataFrame:
    """Keep records whose artist is in the allow-list (F1); NULL artists are
    dropped. Rows pass through unchanged (S2 writes the raw line)."""
    allowed = _class_side(class_dim.select(F.col("class_name").alias("__artist")))
    return records.join(allowed, F.col(artist_col) == F.col("__artist"), "left_semi")


def has_first_image(images) -> Column:
    """True when ``images`` is non-empty and its first path is non-empty (F2);
    NULL-safe."""
    imgs = col_or_name(images)
    first_path = F.get(imgs, 0).getField("path")
    return F.coalesce((F.size(imgs) > 0) & (F.coalesce(first_path, F.lit("")) != ""),
                      F.lit(False))


def image_checksum(images) -> Column:
    """Key of a record = checksum part of its first image path (P5)."""
    return checksum_from_path(F.get(col_or_name(images), 0).getField("path"))


def label_lines(records: DataFrame, key_col: str = "key",
                artist_col: str = "artist") -> DataFrame:
    """``key::artist`` text lines (S3); other columns are kept."""
    return records.withColumn("value", F.concat_ws(LABEL_SEP, key_col, artist_col))


def parse_label_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``value`` lines into ``(key, artist)``.

    Lines are stripped of unicode whitespace and split on ``::``; anything but
    exactly two parts is a reject with reason ``bad_format``. Returns
    ``(ok, rejected)``; other input columns (e.g. line order) are kept."""
    parts = F.split(unicode_trim("value"), LABEL_SEP)
    tagged = lines.withColumn("__parts", parts)
    ok = (tagged.where(F.size("__parts") == 2)
          .withColumn("key", F.get("__parts", 0))
          .withColumn("artist", F.get("__parts", 1))
          .drop("__parts"))
    bad = (tagged.where(F.size("__parts") != 2).drop("__parts")
           .withColumn("reason", F.lit("bad_format")))
    return ok, bad


def map_to_class(parsed: DataFrame, class_dim: DataFrame,
                 artist_col: str = "artist") -> tuple[DataFrame, DataFrame]:
    """Artist name -> class id (J1). Unknown artists are rejected with reason
    ``unknown_artist``. Returns ``(labelled, rejected)``."""
    side = _class_side(class_dim.select(F.col("class_name").alias("__artist"), "class_id"))
    labelled = (parsed.join(side, F.col(artist_col) == F.col("__artist"), "inner")
                .drop("__artist"))
    rejected = (parsed.join(side.select("__artist"),
                            F.col(artist_col) == F.col("__artist"), "left_anti")
                .withColumn("reason", F.lit("unknown_artist")))
    return labelled, rejected


def dedup_labels(labelled: DataFrame, order_col: str = "line_no") -> DataFrame:
    """One label per key, the last line wins (A11). ``order_col`` orders the
    lines (a line number, or a (file, offset, row) struct). Also reports how
    many lines named the key."""
    return (labelled.groupBy("key")
            .agg(F.max_by("class_id", order_col).alias("class_id"),
                 F.count(F.lit(1)).alias("n_lines")))


def tag_label_lines(lines: DataFrame, class_dim: DataFrame) -> DataFrame:
    """Every label line with ``key``, ``artist``, ``class_id`` and
    ``reason`` (NULL when the line is kept; ``bad_format`` or
    ``unknown_artist`` otherwise) — one pass: parse, then a left join with
    the (size-checked, broadcast) class dimension."""
    side = _class_side(class_dim.select(F.col("class_name").alias("__artist"), "class_id"))
    parts = F.split(unicode_trim("value"), LABEL_SEP)
    t = (lines.withColumn("__p", parts)
         .withColumn("__ok", F.size("__p") == 2)
         .withColumn("key", F.when(F.col("__ok"), F.get("__p", 0)))
         .withColumn("artist", F.when(F.col("__ok"), F.get("__p", 1))))
    j = t.join(side, (F.col("artist") == F.col("__artist")) & F.col("__ok"), "left")
    reason = (F.when(~F.col("__ok"), F.lit("bad_format"))
              .when(F.col("class_id").isNull(), F.lit("unknown_artist")))
    return j.withColumn("reason", reason).drop("__p", "__ok", "__artist")


def label_rejects(lines: DataFrame, class_dim: DataFrame) -> DataFrame:
    """All rejected label lines with their reason (F6), from one pass."""
    tagged = tag_label_lines(lines, class_dim)
    return tagged.where(F.col("reason").isNotNull()).drop("key", "artist", "class_id")


def label_summary(lines: DataFrame, class_dim: DataFrame,
                  samples: DataFrame | None = None) -> DataFrame:
    """Counts of the label step (A1) as ``(metric, value)`` rows: lines read,
    rejects per reason (zero when none), labels kept (distinct keys), and —
    given samples — samples read and samples kept after the label join.

    Lines and samples are counted together per key (rejected lines without a
    key share the NULL key), then the keys are summed: every table is read
    once and nothing is joined."""
    tagged = tag_label_lines(lines.select("value"), class_dim)
    rows = tagged.select("key", F.lit(1).alias("n"),
                         (F.col("reason") == "bad_format").alias("bad"),
                         (F.col("reason") == "unknown_artist").alias("unknown"),
                         F.col("reason").isNull().alias("kept"), F.lit(0).alias("sample"))
    names = ["lines_read", "rejected_bad_format", "rejected_unknown_artist", "labels_kept"]
    if samples is not None:
        no = F.lit(False)
        rows = rows.unionByName(samples.select("key", F.lit(0).alias("n"), no.alias("bad"), no.alias("unknown"),
                                               no.alias("kept"), F.lit(1).alias("sample")))
        names += ["samples_read", "samples_kept"]
    per_key = rows.groupBy("key").agg(
        F.sum("n").alias("n"), F.count_if("bad").alias("bad"), F.count_if("unknown").alias("unknown"),
        F.max("kept").alias("kept"), F.sum("sample").alias("sample"))
    named = F.col("kept") & F.col("key").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    stats = [total("n"), total("bad"), total("unknown"), F.count_if(named).cast("bigint"),
             total("sample"), total(F.when(named, F.col("sample")))]
    out = per_key.agg(*[c.alias(n) for c, n in zip(stats, names)])
    return out.unpivot([], names, "metric", "value")


def read_labels(lines: DataFrame, class_dim: DataFrame,
                order_col: str = "line_no") -> DataFrame:
    """Validated, class-mapped, de-duplicated label map ``(key, class_id)``."""
    ok, _ = parse_label_lines(lines)
    labelled, _ = map_to_class(ok, class_dim)
    return dedup_labels(labelled, order_col)


class Counts:
    """Named counts of the rows that pass a point of a plan, taken by whatever
    action runs it (``DataFrame.observe``); no second pass. They can be read
    once that action has ended. Observe frames of a ``session.sibling_session``
    if the session also runs MLlib models. Where Spark sees that its input is empty and
    runs nothing, it reports a row without columns: every count is zero."""

    def __init__(self, name: str, **counts: Column):
        self.observation, self.counts = Observation(name), counts

    def on(self, df: DataFrame) -> DataFrame:
        return df.observe(self.observation, *[c.alias(n) for n, c in self.counts.items()])

    def get(self) -> dict[str, int]:
        row = self.observation._jo.getRow()
        found = self.observation.get if row.length() else {}
        return {n: int(found.get(n) or 0) for n in self.counts}


def observed_labels(lines: DataFrame, class_dim: DataFrame, order_col: str = "line_no"
                    ) -> tuple[DataFrame, list[Counts]]:
    """Label map ``(key, class_id, n_lines)`` and the counts of its ingest (A1,
    F6), taken while the lines are read: whatever action first runs the labels
    fills them, and no line is read a second time."""
    read = Counts("label_lines", lines_read=F.count(F.lit(1)),
                  rejected_bad_format=F.count_if(F.col("reason") == "bad_format"),
                  rejected_unknown_artist=F.count_if(F.col("reason") == "unknown_artist"))
    kept = Counts("labels", labels_kept=F.count(F.lit(1)))
    tagged = read.on(tag_label_lines(lines, class_dim))
    return kept.on(dedup_labels(tagged.where(F.col("reason").isNull()), order_col)), [read, kept]


def observed_join(samples: DataFrame, labels: DataFrame) -> tuple[DataFrame, Counts]:
    """Samples with a label (J2) and how many there were before and after,
    counted in the same pass. (The join is an outer one up to the count, so
    that an empty label table does not make Spark leave the samples unread.)"""
    seen = Counts("samples", samples_read=F.count(F.lit(1)), samples_kept=F.count_if("__label"))
    joined = seen.on(samples.join(labels.withColumn("__label", F.lit(True)), "key", "left"))
    return joined.where("__label").drop("__label"), seen


def counts_of(spark: SparkSession, *counts: Counts) -> DataFrame:
    """``(metric, value)`` of counts whose frames have been run."""
    return spark.createDataFrame([x for c in counts for x in c.get().items()], "metric string, value bigint")


def join_labels(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """Samples with a label; unlabelled samples are discarded."""
    return samples.join(labels, "key", "inner")


def shard_filter(df: DataFrame, prefix: str | None, key_col: str = "key") -> DataFrame:
    """Keys starting with ``prefix``; ``None`` means every key."""
    if prefix is None:
        return df
    return df.where(F.col(key_col).startswith(prefix))


def manifest_filter(items: DataFrame, manifest: DataFrame | None,
                    name_col: str = "name") -> DataFrame:
    """Keep items whose full file name is listed in the manifest (F4);
    ``None`` disables the filter. The manifest is a one-column ``value``
    DataFrame (one name per line, trimmed)."""
    if manifest is None:
        return items
    names = manifest.select(unicode_trim("value").alias("__name"))  # semi join: no dedup needed
    return items.join(names, F.col(name_col) == F.col("__name"), "left_semi")


def pending(items: DataFrame, done: DataFrame, key_col: str = "key",
            done_col: str = "name", descriptor: str | None = None) -> DataFrame:
    """Items whose output does not exist yet (F5). ``done`` holds the output
    file names (``key.descriptor.npz``) or bare keys; the key is the part
    before the first dot. With ``descriptor`` only outputs of that descriptor
    count: an image described by another one is still pending."""
    if descriptor is not None:
        done = done.where(F.get(F.split(F.col(done_col), r"\."), 1) == descriptor)
    done_keys = done.select(file_key(F.col(done_col)).alias("__done"))
    return items.join(done_keys, F.col(key_col) == F.col("__done"), "left_anti")


def pending_keys(items: DataFrame, done: DataFrame, key_col: str = "key") -> DataFrame:
    """:func:`pending` for a table of bare done keys in a column of the same
    name: nothing is computed from the keys, so tables bucketed by them are
    joined as they lie."""
    return items.join(done.select(key_col), key_col, "left_anti")
