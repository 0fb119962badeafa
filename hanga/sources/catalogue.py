"""Text sources and sinks: JSON-lines catalogue (S1, S2), label files (S3,
S4), one-value-per-line lists (S5) and feature-name files (S11).

Line order matters for "last line wins" (A11). ``monotonically_increasing_id``
alone is not a file order, so every line gets ``line_order`` =
``struct(file, split start, row id)``: splits of one file are read in order
and rows inside a split keep file order, so the struct sorts exactly like the
lines of each file, however the splits are packed into tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import unicode_trim
from ..operators.catalog import LABEL_SEP, parse_label_lines

IMAGE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("checksum", T.StringType()),
])

# Fields the pipeline reads from a catalogue line (D4); the rest of the line
# is kept verbatim in ``value``.
CATALOGUE_FIELDS = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("artist", T.StringType()),
    T.StructField("images", T.ArrayType(IMAGE)),
])

CORRUPT = "_corrupt_record"


def with_line_order(df: DataFrame) -> DataFrame:
    return df.withColumn("line_order", F.struct(
        F.input_file_name().alias("file"),
        F.input_file_block_start().alias("start"),
        F.monotonically_increasing_id().alias("row")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, line_order)`` for every line of the text file(s)."""
    return with_line_order(spark.read.text(path))


def parse_json_column(df: DataFrame, schema: T.StructType, col: str = "value",
                      strict: bool = False) -> DataFrame:
    """Parse a JSON text column into top-level fields.

    ``strict=True`` fails the job on the first malformed line (the reference
    aborts); the default keeps every row and sets ``_corrupt_record`` to the
    raw text of lines that do not parse, so they can be routed to a reject
    table (F6) instead of looking like a record with NULL fields."""
    full = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    opts = {"mode": "FAILFAST"} if strict else {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_json(F.col(col), full, opts)
    return df.select("*", F.inline(F.array(parsed)))


def read_catalogue(spark: SparkSession, path: str, strict: bool = False,
                   schema: T.StructType = CATALOGUE_FIELDS) -> DataFrame:
    """Catalogue JSON lines: raw ``value`` + ``line_order`` + parsed fields."""
    return parse_json_column(read_lines(spark, path), schema, "value", strict)


def catalogue_rejects(catalogue: DataFrame) -> DataFrame:
    """Lines that did not parse or lack an artist."""
    return (catalogue.where(F.col(CORRUPT).isNotNull() | F.col("artist").isNull())
            .select("value", "line_order",
                    F.when(F.col(CORRUPT).isNotNull(), F.lit("bad_json"))
                    .otherwise(F.lit("no_artist")).alias("reason")))


def write_lines(df: DataFrame, path: str, col: str = "value", mode: str = "error") -> None:
    """Write one text line per row, unchanged."""
    df.select(F.col(col).cast("string")).write.mode(mode).text(path)


def write_label_file(labels: DataFrame, path: str, key_col: str = "key",
                     artist_col: str = "artist", mode: str = "error") -> None:
    """``key::artist`` lines (S3)."""
    write_lines(labels.select(F.concat_ws(LABEL_SEP, key_col, artist_col).alias("value")),
                path, mode=mode)


def read_label_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Label file -> ``(ok(key, artist, line_order), rejected(value, reason))``
    (S4)."""
    return parse_label_lines(read_lines(spark, path))


def read_value_list(spark: SparkSession, path: str) -> DataFrame:
    """One value per line, stripped; blank lines dropped."""
    return (spark.read.text(path).select(unicode_trim("value").alias("value"))
            .where(F.col("value") != ""))


def with_line_number(lines: DataFrame) -> DataFrame:
    """Adds ``line_no``: the exact zero-based line index across the files in
    ``line_order`` order, without a window over the lines. Rows are counted per
    file split; offsets of the splits are summed inside their file, offsets of
    the files over one row per file, and each row adds its position inside its
    split."""
    lo = F.col("line_order")
    per_split = (lines.groupBy(lo.getField("file").alias("__f"), lo.getField("start").alias("__s"))
                 .agg(F.min(lo.getField("row")).alias("__base"), F.count(F.lit(1)).alias("__n")))
    earlier = Window.orderBy("__f").rowsBetween(Window.unboundedPreceding, -1)
    files = (per_split.groupBy("__f").agg(F.sum("__n").alias("__t"))
             .select("__f", F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__foff")))
    before = Window.partitionBy("__f").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (per_split.withColumn("__soff", F.coalesce(F.sum("__n").over(before), F.lit(0)))
               .join(files, "__f").withColumn("__off", F.col("__soff") + F.col("__foff"))
               .select("__f", "__s", "__base", "__off"))
    keyed = lines.withColumn("__f", lo.getField("file")).withColumn("__s", lo.getField("start"))
    return (keyed.join(offsets, ["__f", "__s"])
            .withColumn("line_no", F.col("__off") + lo.getField("row") - F.col("__base"))
            .drop("__f", "__s", "__base", "__off"))


def read_feature_names(spark: SparkSession, path: str) -> DataFrame:
    """``(dim, name)`` from a tab-separated file: name = first field, dim =
    zero-based line index (S11)."""
    lines = with_line_number(read_lines(spark, path))
    return lines.select(F.col("line_no").cast("int").alias("dim"),
                        F.substring_index("value", "\t", 1).alias("name"))
