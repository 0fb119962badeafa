"""``keyed_files``: a Spark data source over a folder with one file per key
(S6, S7, S8, S13 with F3 and F4).

Reading gives ``(key, name, ext, path, length, content)``, key = name before the
first dot, ext = after the last. Filters on ``key``, ``name`` and ``ext``
(equality, ``IN``, prefix) are taken by the source itself, before any file is
opened: a shard prefix or a list of names never costs more than the listing.
Partitions are packed by file size (``maxPartitionBytes``, with
``openCostInBytes`` for every file), so neither a million small files nor a few
large ones make uneven tasks; a job too small to fill its cores that way is cut
finer. A task holds one batch of files of at most ``BATCH_BYTES`` (one file at
least). With the option ``content=false`` nothing is opened at all, and a file
costs the few bytes of its listing.

Writing takes ``(name, content)`` rows and writes one file each, in a hidden
folder of the task first: a task that runs twice writes the same files twice, and no
reader sees half a file.

The files are reached through Arrow's file systems (local, S3, GCS, HDFS where
libhdfs is present). :func:`reachable` says whether that holds for a path; for
any other store ``files.py`` uses Spark's own ``binaryFile`` source.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In,
                                    InputPartition, StringStartsWith, WriterCommitMessage)
from pyspark.sql.types import StructType

SCHEMA = "key string, name string, ext string, path string, length long, content binary"
BATCH_BYTES = 16 * 1024 * 1024
PARTITION_BYTES = 128 * 1024 * 1024     # Spark's default for files
# Spark's default of 4 MiB makes a task of every 32 small files, and starting it takes longer than reading them
OPEN_COST = 128 * 1024          # at most 1,024 files in a task
LEAST_BYTES = 32 * OPEN_COST    # at least 32 small files in one
LISTED_BYTES = 1024             # of a file that is only listed
_ARROW = pa.schema([("key", pa.string()), ("name", pa.string()), ("ext", pa.string()), ("path", pa.string()),
                    ("length", pa.int64()), ("content", pa.binary())])


def filesystem(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path inside it (never decoded: names
    may hold ``#`` and ``%``)."""
    if root.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + root[5:].lstrip("/")
    if "://" not in root:
        return pafs.LocalFileSystem(), root
    return pafs.FileSystem.from_uri(root)


def reachable(root: str) -> bool:
    """Whether Arrow can list this folder here."""
    try:
        fs, base = filesystem(root)
        return fs.get_file_info(base).type == pafs.FileType.Directory
    except (OSError, pa.ArrowException, ValueError):
        return False


def key_of(name: str) -> str:
    return name.split(".", 1)[0]


def ext_of(name: str) -> str | None:
    return name.rsplit(".", 1)[1] if "." in name else None


def split_bytes(total: int, cores: int, most: int = PARTITION_BYTES) -> int:
    """Bytes of a partition: ``most``, or less when ``total`` would leave cores
    without one."""
    return min(most, max(LEAST_BYTES, -(-total // max(1, cores))))


@dataclass
class FileBatch(InputPartition):
    """The (name, length) of the files of one task."""
    files: list[tuple[str, int]]


def packed(files: list[tuple[str, int]], most: int, open_cost: int) -> list[FileBatch]:
    """Files in order of size, largest first, dealt into partitions of about
    ``most`` bytes (next fit)."""
    out: list[list[tuple[str, int]]] = []
    size = most + 1
    for name, length in sorted(files, key=lambda f: (-f[1], f[0])):
        if size + length + open_cost > most:
            out.append([])
            size = 0
        out[-1].append((name, length))
        size += length + open_cost
    return [FileBatch(f) for f in out]


class KeyedFilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.content = options.get("content", "true").lower() != "false"
        self.most = int(options.get("maxpartitionbytes", PARTITION_BYTES))
        self.open_cost = int(options.get("opencostinbytes", OPEN_COST))
        self.cores = int(options.get("parallelism", 1))
        self.taken: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = getattr(f, "attribute", None)
            if column not in (("key",), ("name",), ("ext",)):
                yield f
            elif isinstance(f, EqualTo):
                self.taken.append((column[0], "in", (f.value,)))
            elif isinstance(f, In):
                self.taken.append((column[0], "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.taken.append((column[0], "prefix", (f.value,)))
            else:
                yield f

    def _wanted(self, name: str) -> bool:
        value = {"key": key_of(name), "name": name, "ext": ext_of(name)}
        return all(value[c] is not None and (value[c] in v if how == "in" else value[c].startswith(v[0]))
                   for c, how, v in self.taken)

    def files(self) -> list[tuple[str, int]]:
        """The wanted files, from the listing alone; hidden ones are left out
        like Spark's file sources do."""
        fs, base = filesystem(self.root)
        listed = fs.get_file_info(pafs.FileSelector(base))
        return [(i.base_name, i.size) for i in listed if i.type == pafs.FileType.File
                and i.base_name[:1] not in (".", "_") and self._wanted(i.base_name)]

    def partitions(self) -> list[InputPartition]:
        files = self.files()
        if self.content:
            total = sum(length + self.open_cost for _, length in files)
            made = packed(files, split_bytes(total, self.cores, self.most), self.open_cost)
        else:
            n = max(1, self.most // LISTED_BYTES)
            made = [FileBatch(files[lo:lo + n]) for lo in range(0, len(files), n)]
        # Spark reads an empty list as one partition without a description
        return made or [FileBatch([])]

    def open_file(self, fs: pafs.FileSystem, path: str) -> bytes:
        with fs.open_input_stream(path) as f:
            return f.read()

    def read(self, partition: FileBatch) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(self.root)
        rows, size = [], 0
        for name, length in partition.files:
            blob = self.open_file(fs, f"{base}/{name}") if self.content else None
            rows.append((key_of(name), name, ext_of(name), f"{self.root}/{name}", length, blob))
            size += length if self.content else 100
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)],
                                      schema=_ARROW)


class KeyedFilesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = filesystem(self.root)
        own = f"{base}/.{uuid.uuid4().hex}"     # tasks that make files in one folder wait for each other
        fs.create_dir(own, recursive=True)
        try:
            for b in iterator:
                for name, blob in zip(b.column("name").to_pylist(), b.column("content"), strict=True):
                    with fs.open_output_stream(f"{own}/part") as f:
                        f.write(blob.as_buffer())
                    fs.move(f"{own}/part", f"{base}/{name}")
        finally:
            fs.delete_dir(own)
        return WriterCommitMessage()


class KeyedFiles(DataSource):
    reader_class = KeyedFilesReader

    @classmethod
    def name(cls) -> str:
        return "keyed_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> KeyedFilesReader:
        return self.reader_class(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> KeyedFilesWriter:
        if overwrite:
            raise ValueError("keyed_files only adds files; use mode('append')")
        return KeyedFilesWriter(dict(self.options))


def register(spark: SparkSession, source: type[DataSource] = KeyedFiles) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)


def reader(spark: SparkSession, content: bool = True) -> DataFrameReader:
    register(spark)
    return (spark.read.format("keyed_files").option("content", str(content).lower())
            .option("parallelism", spark.sparkContext.defaultParallelism))


def write_files(files: DataFrame, path: str) -> None:
    """One file per ``(name, content)`` row, in the folder ``path``."""
    register(files.sparkSession)
    files.select("name", "content").write.format("keyed_files").mode("append").save(path)


def remove_files(path: str) -> None:
    """Delete a scratch folder of our own with all its files, by Arrow's file
    system: Hadoop's local one takes a third of a millisecond for each."""
    if reachable(path):
        fs, base = filesystem(path)
        fs.delete_dir(base)


def opened(files: DataFrame, root: str, open_file=KeyedFilesReader.open_file) -> DataFrame:
    """``files`` (rows of a listing of ``root``) with their ``content``: only
    these files are opened. Rows are dealt over tasks by their number and total
    size, both counted from the listing."""
    from pyspark.sql import functions as F
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    total = size + n * OPEN_COST
    parts = max(1, -(-total // split_bytes(total, files.sparkSession.sparkContext.defaultParallelism)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(root)
        for b in batches:
            start, size = 0, 0
            names, lengths, blobs = b.column("name").to_pylist(), b.column("length").to_pylist(), []
            for i, name in enumerate(names):
                blobs.append(open_file(None, fs, f"{base.rstrip('/')}/{name}"))
                size += lengths[i]
                if size >= BATCH_BYTES or i == b.num_rows - 1:
                    part = b.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(blobs, pa.binary())],
                                                     names=[*b.schema.names, "content"])
                    start, size, blobs = i + 1, 0, []

    listed = files.select("key", "name", "ext", "path", "length").repartition(parts, "name")
    return listed.mapInArrow(run, SCHEMA)
