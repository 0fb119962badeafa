"""Incremental stream over a growing folder (F5): each run handles only new
files, replays write nothing twice."""

import numpy as np

from hanga.operators import codebook as CB
from hanga.session import path_exists
from hanga.sources import files as FS
from hanga.streaming.incremental import run_available


def test_incremental_bow(spark, tmp_path):
    src, out, ck = tmp_path / "kp", str(tmp_path / "bow"), str(tmp_path / "ck")
    src.mkdir()
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(4, 3))

    def process(new):  # new = (key, path) of files not processed yet
        kps, _ = FS.read_keypoints(spark, str(src), n_dims=3, keys=new.select("key"))
        return CB.histogram(CB.assign(kps, centers), 4)

    for k in ["a1", "a2"]:
        np.savez_compressed(src / f"{k}.sift.npz", rng.normal(size=(5, 9)))
    run_available(spark, str(src), out, process, "*.npz", ck)
    assert sorted(r["key"] for r in spark.read.parquet(out).collect()) == ["a1", "a2"]
    np.savez_compressed(src / "b3.sift.npz", rng.normal(size=(2, 9)))
    run_available(spark, str(src), out, process, "*.npz", ck)
    rows = {r["key"]: r["histogram"] for r in spark.read.parquet(out).collect()}
    assert sorted(rows) == ["a1", "a2", "b3"] and sum(rows["b3"]) == 2
    run_available(spark, str(src), out, process, "*.npz", ck)  # nothing new
    assert spark.read.parquet(out).count() == 3


def test_default_checkpoint_is_stable(spark, tmp_path):
    """Without an explicit checkpoint the location depends only on the
    output path, so a second run resumes instead of starting over."""
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "k1.txt").write_text("x")
    calls = []

    def process(new):
        calls.append(new.count())
        return new.select("key")

    run_available(spark, str(src), out, process, "*.txt")
    run_available(spark, str(src), out, process, "*.txt")
    assert calls == [1]  # the second run saw no new file, so no batch ran


def test_stream_checkpoint_is_the_same_in_every_application(spark):
    """The folder comes from the setting, not from the application's own one."""
    from hanga.session import shared_root
    root = shared_root(spark)
    assert root == shared_root(spark)
    own = spark.sparkContext.getCheckpointDir() or ""
    assert not root.endswith(own.rstrip("/").rsplit("/", 1)[-1])


def test_storage_errors_are_not_taken_for_a_fresh_start(spark):
    import pytest
    from hanga.streaming.done_index import batches
    with pytest.raises(Exception):
        batches(spark, "nosuchscheme://bucket/out")
    with pytest.raises(Exception):
        path_exists(spark, "nosuchscheme://bucket/out")


def test_cluster_without_shared_folder_is_an_error():
    import pytest
    from hanga import session as S

    class Conf:
        def get(self, key, default=None):
            return default

    class Fake:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"
    with pytest.raises(RuntimeError):
        S.shared_root(Fake())
    Fake.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        S.shared_root(Fake())


def _written(spark, out, name, keys):
    from hanga.streaming import done_index as D
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    df.write.mode("overwrite").parquet(f"{out}/batch={name}")
    D.write_sketch(df, out, name)


def test_sketches_name_the_batches_that_hold_a_key(spark, tmp_path):
    from hanga.streaming import done_index as D
    out = str(tmp_path / "out")
    assert D.may_hold(spark.createDataFrame([("x",)], "key string"), out) == []
    for b in range(6):
        _written(spark, out, f"s-{b}", [f"key{i}" for i in range(b, 9000, 6)] if b else [])
    new = spark.createDataFrame([("key1",), ("key8",), ("other",)], "key string")
    assert D.may_hold(new, out) == ["s-1", "s-2"]
    many = spark.range(9000, 12000).selectExpr("concat('key', id) AS key")
    assert len(D.may_hold(many, out)) <= 2         # hardly ever by mistake
    assert D.may_hold(new.limit(0), out) == []
    # never missed, whatever the key
    for b in range(1, 6):
        assert f"s-{b}" in D.may_hold(spark.createDataFrame([(f"key{b + 6 * 700}",)], "key string"), out)
    spark.createDataFrame([("late",)], "key string").write.parquet(f"{out}/batch=s-9")    # no sketch written
    assert D.may_hold(new, out) == ["s-1", "s-2", "s-9"]
    spark.conf.set("hanga.broadcast.maxBytes", "1")
    try:
        assert len(D.may_hold(new, out)) == 7
    finally:
        spark.conf.unset("hanga.broadcast.maxBytes")


def test_old_batches_stay_unread_and_replays_write_nothing_twice(spark, tmp_path):
    import shutil

    import pytest
    src, out, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    src.mkdir()

    def process(new):
        return new.select("key")

    def run():
        return run_available(spark, str(src), str(out), process, "*.txt", str(ck))

    def keys():
        return sorted(r["key"] for r in spark.read.parquet(str(out)).collect())

    (src / "a.txt").write_text("x")
    (src / "b.txt").write_text("x")
    run()
    (src / "b.again.txt").write_text("x")       # the same key in a later file
    (src / "c.txt").write_text("x")
    shutil.copytree(ck, tmp_path / "before")
    run()
    assert keys() == ["a", "b", "c"]
    # the second batch again, as after a failure before it was recorded
    shutil.rmtree(ck)
    shutil.copytree(tmp_path / "before", ck)
    run()
    assert keys() == ["a", "b", "c"]
    # files of old batches that nobody opens may as well be broken
    first = next(p for p in out.iterdir() if p.name.endswith("-0") and p.name.startswith("batch="))
    for f in first.glob("*.parquet"):
        f.write_bytes(b"broken")
        (first / f".{f.name}.crc").unlink(missing_ok=True)
    (src / "d.txt").write_text("x")
    run()
    assert [r["key"] for r in spark.read.parquet(str(next(p for p in out.iterdir() if p.name.endswith("-2")))).collect()] == ["d"]
    (src / "a.new.txt").write_text("x")
    with pytest.raises(Exception):              # this key needs the broken batch
        run()


def test_output_of_another_layout_is_refused(spark, tmp_path):
    import pytest
    from hanga.streaming.done_index import batches
    spark.range(3).write.parquet(str(tmp_path / "flat"))
    with pytest.raises(ValueError, match="batch by batch"):
        batches(spark, str(tmp_path / "flat"))
