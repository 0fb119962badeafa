"""The ``keyed_files`` data source: what it opens, how it packs, what it writes."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from hanga.sources import files as FS
from hanga.sources import keyed_files as KF


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for i in range(40):
        np.save(d / f"{'ab'[i % 2]}{i:02d}.npy", np.arange(4.0) + i)
    (d / "a_note.txt").write_text("x")
    (d / ".hidden").write_text("x")
    (d / "noext").write_text("x")
    return d


@pytest.fixture
def counting(spark, tmp_path):
    """The source under another name, which leaves a mark per opened file."""
    marks = tmp_path / "marks"
    marks.mkdir()

    class Reader(KF.KeyedFilesReader):
        def open_file(self, fs, path):
            open(f"{marks}/{os.path.basename(path)}", "w").close()
            return super().open_file(fs, path)

    class Source(KF.KeyedFiles):
        reader_class = Reader

        @classmethod
        def name(cls):
            return "counted_files"

    KF.register(spark, Source)
    return marks


@pytest.mark.parametrize("condition,opened", [
    ("key LIKE 'a%' AND ext = 'npy'", 20), ("key = 'b01'", 1), ("name IN ('a00.npy', 'b01.npy', 'zz')", 2),
    ("startswith(key, 'a0') AND key <> 'a00'", 5), ("ext = 'txt'", 1), ("key = 'none'", 0)])
def test_only_selected_files_are_opened(spark, folder, counting, condition, opened):
    df = spark.read.format("counted_files").load(str(folder)).where(condition)
    got = {r["name"] for r in df.collect()}
    assert got <= set(os.listdir(counting)) and len(os.listdir(counting)) == opened
    spark_own = {r["name"] for r in FS.list_files(spark, str(folder), "*").where(condition).collect()}
    assert got == spark_own


def test_listing_opens_nothing(spark, folder, counting):
    df = spark.read.format("counted_files").option("content", "false").load(str(folder))
    assert df.count() == 42 and os.listdir(counting) == []
    assert {r["ext"] for r in df.collect()} == {"npy", "txt", None}


def test_keys_are_joined_before_anything_is_opened(spark, folder, tmp_path):
    marks = tmp_path / "opened"
    marks.mkdir()

    def open_file(_, fs, path):
        open(f"{marks}/{os.path.basename(path)}", "w").close()
        return KF.KeyedFilesReader.open_file(None, fs, path)

    listed = FS.list_files(spark, str(folder)).where("key IN ('a00', 'b07')")
    got = {r["key"]: np.load(__import__("io").BytesIO(r["content"])).tolist()
           for r in KF.opened(listed, str(folder), open_file).collect()}
    assert got == {"a00": [0.0, 1.0, 2.0, 3.0], "b07": [7.0, 8.0, 9.0, 10.0]}
    assert sorted(os.listdir(marks)) == ["a00.npy", "b07.npy"]
    keys = spark.createDataFrame([("a02",), ("b09",), ("zz",)], "key string")
    ok, rejected = FS.read_vectors(spark, str(folder), keys=keys)
    assert {r["key"] for r in ok.collect()} == {"a02", "b09"} and rejected.count() == 0


def test_other_stores_are_read_by_spark(spark, folder, monkeypatch):
    own = sorted(map(tuple, FS.read_contents(spark, str(folder), ["npy"], "a").select("key", "ext", "content").collect()))
    monkeypatch.setattr(KF, "reachable", lambda path: False)
    spark_own = FS.read_contents(spark, str(folder), ["npy"], "a").select("key", "ext", "content")
    assert own == sorted(map(tuple, spark_own.collect())) and len(own) == 20
    assert not KF.filesystem.__globals__["reachable"]("x")


def test_partitions_are_packed_by_size(spark, folder):
    small = [(f"s{i}", 10) for i in range(100)]
    parts = KF.packed([*small, ("large", 5000), ("huge", 90_000)], 1000, 10)
    assert sorted(f for p in parts for f in p.files) == sorted([*small, ("large", 5000), ("huge", 90_000)])
    assert [p.files for p in parts[:2]] == [[("huge", 90_000)], [("large", 5000)]]
    assert all(sum(n + 10 for _, n in p.files) <= 1000 for p in parts[2:]) and len(parts) == 4
    df = KF.reader(spark).option("maxPartitionBytes", 1000).option("openCostInBytes", 10).load(str(folder))
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 5


def test_written_files(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [("a#1.npy", b"one"), ("b%2.npy", b""), ("c d.txt", "é".encode())]
    df = spark.createDataFrame(rows, "name string, content binary")
    KF.write_files(df, out)
    KF.write_files(df, out)         # a task that runs twice
    assert sorted(os.listdir(out)) == sorted(n for n, _ in rows)
    got = {r["name"]: bytes(r["content"]) for r in KF.reader(spark).load(out).collect()}
    assert got == dict(rows)
    with pytest.raises(Exception, match="append"):
        df.write.format("keyed_files").mode("overwrite").save(out)


def test_file_systems_by_path():
    assert KF.filesystem("file:/tmp/a%20b")[1] == "/tmp/a%20b" == KF.filesystem("file:///tmp/a%20b")[1]
    assert KF.filesystem("/tmp/x#1")[1] == "/tmp/x#1"
    assert not KF.reachable("viewfs://store/in") and not KF.reachable("/no/such/folder") and KF.reachable("/tmp")


def test_small_files_make_few_tasks(spark, tmp_path):
    """Many small files: one task lists them, and as many tasks as there are
    cores open them (before, one for every 32 files)."""
    d = tmp_path / "many"
    KF.write_files(spark.range(2000).selectExpr("concat(id, '.npy') AS name", "binary('x') AS content"), str(d))
    assert len(list(d.iterdir())) == 2000       # the tasks' own folders are gone
    options = {"path": str(d), "parallelism": "4"}
    listing, reading = (KF.KeyedFilesReader(options | o).partitions() for o in ({"content": "false"}, {}))
    assert [len(p.files) for p in listing] == [2000]
    assert len(reading) in (4, 5) and sorted(f for p in reading for f in p.files) == sorted(listing[0].files)
    few = KF.KeyedFilesReader(options | {"content": "false", "maxpartitionbytes": "700000"}).partitions()
    assert [len(p.files) for p in few] == [683, 683, 634]
    opened = KF.opened(FS.list_files(spark, str(d)), str(d))
    assert opened.rdd.getNumPartitions() <= max(2, spark.sparkContext.defaultParallelism) + 1
    assert opened.agg(F.count("content"), F.countDistinct("name")).first()[:] == (2000, 2000)
    KF.remove_files(str(d))
    KF.remove_files(str(d))
    assert not d.exists()


def test_vector_files_are_made_by_every_core(spark):
    from hanga.plans import fixtures as X
    files = X.vector_files(spark, "/root/testdata/sf0.001")
    assert files.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert files.select("name").distinct().count() == X.samples(spark, "/root/testdata/sf0.001").count()
