"""File sources (S6, S7, S8, S13) in temp directories, with the edge files
of FIXTURES.md part C."""

import os

import numpy as np

from hanga.operators import catalog as C
from hanga.sources import files as FS


def test_list_files_keys(spark, tmp_path):
    d = tmp_path / "img"
    d.mkdir()
    for n in ["abc.jpg", "a.b.c.png", "noext"]:
        (d / n).write_bytes(b"x")
    got = {r["name"]: (r["key"], r["ext"]) for r in FS.list_files(spark, str(d)).collect()}
    assert got == {"abc.jpg": ("abc", "jpg"), "a.b.c.png": ("a", "png"), "noext": ("noext", None)}


def test_read_vectors_edges(spark, tmp_path):
    d = tmp_path / "vec"
    d.mkdir()
    np.save(d / "k1.npy", np.arange(4.0))
    np.savetxt(d / "k2.ascii", np.arange(4.0) + 1)
    np.save(d / "k3.npy", np.arange(5.0))            # wrong width
    np.save(d / "k4.npy", np.arange(4.0) * 2)
    np.savetxt(d / "k4.ascii", np.arange(4.0))         # same key twice: .npy kept
    (d / "k5.npy").write_bytes(b"garbage")             # unreadable
    np.save(d / "k6.npy", np.arange(4.0))              # not labelled
    labels = spark.createDataFrame([(k,) for k in ["k1", "k2", "k3", "k4", "k5"]], "key string")
    ok, rej = FS.read_vectors(spark, str(d), keys=labels)
    got = {r["key"]: r["features"] for r in ok.collect()}
    assert got == {"k1": [0.0, 1.0, 2.0, 3.0], "k2": [1.0, 2.0, 3.0, 4.0], "k4": [0.0, 2.0, 4.0, 6.0]}
    reasons = {(r["key"], r["reason"].split(":")[0]) for r in rej.collect()}
    assert reasons == {("k3", "width_mismatch"), ("k4", "duplicate_key"), ("k5", "unreadable")}
    ok2, rej2 = FS.read_vectors(spark, str(d), keys=labels, max_width=3)
    assert ok2.count() == 0 or all(len(r["features"]) <= 3 for r in ok2.collect())


def test_read_keypoints(spark, tmp_path):
    d = tmp_path / "kp"
    d.mkdir()
    rng = np.random.default_rng(0)
    np.savez_compressed(d / "aa1.sift.npz", rng.normal(size=(3, 6 + 4)))
    np.savez_compressed(d / "aa2.sift.npz", np.zeros((0, 10)))   # image without keypoints
    np.savez_compressed(d / "bb3.sift.npz", rng.normal(size=(2, 10)))
    (d / "aa4.sift.npz").write_bytes(b"not a zip")
    kps, rej = FS.read_keypoints(spark, str(d), n_dims=4)
    counts = {r["key"]: r["count"] for r in kps.groupBy("key").count().collect()}
    assert counts == {"aa1": 3, "bb3": 2}
    assert [r["key"] for r in rej.collect()] == ["aa4"]
    assert all(len(r["desc"]) == 4 for r in kps.collect())
    shard, _ = FS.read_keypoints(spark, str(d), n_dims=4, prefix="bb")
    assert {r["key"] for r in shard.collect()} == {"bb3"}


def test_write_keyed_and_incremental(spark, tmp_path):
    out = str(tmp_path / "bow")
    items = spark.createDataFrame([("ab1", 1.0), ("cd2", 2.0)], "key string, v double")
    FS.write_keyed(items.where("key = 'ab1'"), out, shard_chars=1)
    done = spark.read.parquet(out).select("key")
    todo = C.pending(items, done, done_col="key")
    assert [r["key"] for r in todo.collect()] == ["cd2"]
    FS.write_keyed(todo, out, shard_chars=1)
    assert sorted(r["key"] for r in spark.read.parquet(out).collect()) == ["ab1", "cd2"]
    assert sorted(os.listdir(out))[:2] == ["_SUCCESS", "shard=a"] or "shard=a" in os.listdir(out)


def test_any_readable_file_is_read(spark, tmp_path):
    """Names with # and %, and a good .ascii beside a broken .npy."""
    d = tmp_path / "vec"
    d.mkdir()
    for name in ("a#1", "b%2", "c d"):
        np.save(d / f"{name}.npy", np.arange(3.0))
    np.savetxt(d / "dup.ascii", np.arange(3.0) + 5)
    (d / "dup.npy").write_bytes(b"garbage")
    ok, rej = FS.read_vectors(spark, str(d))
    got = {r["key"]: r["features"] for r in ok.collect()}
    assert got == {"a#1": [0.0, 1.0, 2.0], "b%2": [0.0, 1.0, 2.0], "c d": [0.0, 1.0, 2.0],
                   "dup": [5.0, 6.0, 7.0]}
    assert [(r["key"], r["reason"].split(":")[0]) for r in rej.collect()] == [("dup", "unreadable")]


def test_pending_counts_one_descriptor_only(spark):
    items = spark.createDataFrame([("abc",), ("d",)], "key string")
    done = spark.createDataFrame([("abc.gist.npz",), ("d.sift.npz",)], "name string")
    assert [r["key"] for r in C.pending(items, done, descriptor="sift").collect()] == ["abc"]
    assert C.pending(items, done).count() == 0


def test_lists_and_manifests_are_stripped_of_unicode_space(spark, tmp_path):
    from hanga.sources import catalogue as SC
    (tmp_path / "list.txt").write_text("a\t\n\u3000b \n \t\n")
    assert sorted(r["value"] for r in SC.read_value_list(spark, str(tmp_path / "list.txt")).collect()) == ["a", "b"]
    items = spark.createDataFrame([("x.jpg",), ("y.jpg",)], "name string")
    listed = spark.createDataFrame([("x.jpg\t",)], "value string")
    assert [r["name"] for r in C.manifest_filter(items, listed, "name").collect()] == ["x.jpg"]
