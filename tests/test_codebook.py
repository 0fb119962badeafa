"""Codeword assignment, histograms, Lloyd steps and k-means (J3, A6, M2,
K13, S9)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from hanga.operators import codebook as CB


def _points(spark, n=300, m=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, m))
    data = [(i % 7, i, [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(data, "key int, kp_id int, desc array<double>"), x


def test_jvm_and_pandas_assignment_agree(spark):
    kps, x = _points(spark)
    centers = x[:12].copy()
    a = rows(CB.assign(kps, centers, method="jvm"), "kp_id", "code")
    b = rows(CB.assign(kps, centers, method="pandas"), "kp_id", "code")
    assert a == b
    d = ((x[:, None, :] - centers[None]) ** 2).sum(2)
    assert [c for _, c in a] == list(d.argmin(1))


def test_equidistant_goes_to_lowest_code_and_last_columns(spark):
    kps = spark.createDataFrame([(0, 0, [99.0, 0.0, 0.0])], "key int, kp_id int, desc array<double>")
    centers = np.array([[1.0, 0.0], [-1.0, 0.0]])[::-1].copy()  # code 0 = (-1,0), code 1 = (1,0)
    for method in ("jvm", "pandas"):
        assert CB.assign(kps, centers, method=method).first()["code"] == 0


def test_histogram_sums_and_empty_image(spark):
    kps, x = _points(spark)
    a = CB.assign(kps, x[:5].copy())
    keys = spark.createDataFrame([(k,) for k in range(8)], "key int")  # key 7 has no keypoints
    h = {r["key"]: r["histogram"] for r in CB.histogram(a, 5, keys).collect()}
    assert h[7] == [0.0] * 5
    counts = {r["key"]: r["count"] for r in kps.groupBy("key").count().collect()}
    for k, c in counts.items():
        assert sum(h[k]) == c and len(h[k]) == 5


def test_lloyd_keeps_empty_cluster(spark):
    pts = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(4)],
                                "key int, features array<double>")
    centers = np.array([[0.0, 0.0], [3.0, 0.0], [100.0, 100.0]])
    new, n = CB.lloyd_step(pts, centers)
    assert list(n) == [2, 2, 0] and list(new[2]) == [100.0, 100.0]
    assert new[0] == pytest.approx([0.5, 0.0]) and new[1] == pytest.approx([2.5, 0.0])


def test_kmeans_best_of_attempts(spark):
    rng = np.random.default_rng(1)
    blobs = np.concatenate([rng.normal(c, 0.1, size=(40, 2)) for c in ([0, 0], [5, 5], [0, 5])])
    pts = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(blobs)],
                                "key int, features array<double>")
    book, cost, costs = CB.kmeans_codebook(pts, 3, max_iter=20, attempts=4, seed=3)
    assert cost == min(costs) and book.count() == 3
    centers = np.array([r["center"] for r in book.collect()])
    for true in ([0, 0], [5, 5], [0, 5]):  # every blob found
        assert np.linalg.norm(centers - np.array(true), axis=1).min() < 0.1


def test_codebook_write_once(spark, tmp_path):
    book = CB.codebook_frame(spark, np.eye(3))
    path = str(tmp_path / "book")
    assert CB.write_codebook(book, path) is True
    assert CB.write_codebook(CB.codebook_frame(spark, np.zeros((3, 3))), path) is False
    _, back = next(CB.codebook_blocks(CB.read_codebook(spark, path), 1 << 20))
    assert (back == np.eye(3)).all()


def test_kmeans_cost_non_increasing_in_attempts(spark):
    rng = np.random.default_rng(7)
    pts = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=3)]) for i in range(150)],
                                "key int, features array<double>")
    costs = [CB.kmeans_codebook(pts, 5, max_iter=5, attempts=a, seed=11)[1] for a in (1, 3, 6)]
    assert costs[0] >= costs[1] >= costs[2]


def test_assign_reports_codebook_code_values(spark):
    book = spark.createDataFrame([(7, [0.0, 0.0]), (3, [10.0, 10.0])],
                                 "code int, center array<double>")
    kps = spark.createDataFrame([(0, 0, [9.0, 9.0]), (0, 1, [1.0, 0.0])],
                                "key int, kp_id int, desc array<double>")
    got = sorted((r["kp_id"], r["code"]) for r in CB.assign(kps, book).collect())
    assert got == [(0, 3), (1, 7)]


@pytest.mark.parametrize("as_table", [False, True])
def test_blocks_of_a_codebook_give_the_same_assignment(spark, as_table):
    kps, x = _points(spark, 200)
    centers = np.concatenate([x[:40], x[:40]])  # every centre twice: ties across blocks
    book = CB.codebook_frame(spark, centers) if as_table else centers
    whole = rows(CB.assign(kps, book), "kp_id", "code", "dist")
    spark.conf.set("hanga.broadcast.maxBytes", str(8 * 8 * 9))
    try:
        assert len(list(CB.codebook_blocks(book, 8 * 8 * 9))) > 5
        parts = rows(CB.assign(kps, book), "kp_id", "code", "dist")
    finally:
        spark.conf.unset("hanga.broadcast.maxBytes")
    assert [p[:2] for p in parts] == [w[:2] for w in whole]
    assert np.allclose([p[2] for p in parts], [w[2] for w in whole])


def test_half_written_codebook_is_replaced(spark, tmp_path):
    path = tmp_path / "book"
    path.mkdir()
    (path / "part-0").write_bytes(b"junk")
    assert CB.write_codebook(CB.codebook_frame(spark, np.eye(2)), str(path)) is True
    assert CB.read_codebook(spark, str(path)).count() == 2


def test_bounds_give_the_plain_result_with_fewer_distances(spark):
    rng = np.random.default_rng(3)
    n, k, attempts = 2000, 20, 2
    x = rng.normal(0, 1, (n, 6)) + rng.integers(0, 12, n)[:, None] * 4
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key int, features array<double>").repartition(4)
    report = {}
    book, cost, costs = CB.kmeans_codebook(pts, k, max_iter=15, tol=-1.0, attempts=attempts, seed=5, report=report)
    plain = []
    for a in range(attempts):
        start = CB.hash_init(pts, k, seed=5 + a)
        centers = start
        for _ in range(15):
            code, _ = CB.nearest_codes(x, centers)
            centers = np.array([x[code == c].mean(0) if (code == c).any() else centers[c] for c in range(k)])
        plain.append((float((CB.nearest_codes(x, centers)[1] ** 2).sum()), centers))
    assert np.allclose(costs, [p[0] for p in plain])
    got = np.array([r["center"] for r in book.orderBy("code").collect()])
    assert np.allclose(got, min(plain, key=lambda p: p[0])[1])
    assert cost == min(costs)
    assert report["distances"] < 0.5 * n * k * attempts * 16      # 15 passes and the last one


def test_attempts_in_groups_whatever_the_limit(spark):
    rng = np.random.default_rng(4)
    pts = spark.createDataFrame([(i, rng.normal(0, 1, 3).tolist()) for i in range(60)], "key int, features array<double>")
    whole = CB.kmeans_codebook(pts, 4, attempts=3, max_iter=4)
    spark.conf.set("hanga.broadcast.maxBytes", "1")
    try:
        parts = CB.kmeans_codebook(pts, 4, attempts=3, max_iter=4)
        assert CB.hash_init(pts, 4).shape == (4, 3)
    finally:
        spark.conf.unset("hanga.broadcast.maxBytes")
    assert np.allclose(whole[2], parts[2]) and whole[1] == pytest.approx(parts[1])
    assert np.allclose([r["center"] for r in whole[0].collect()], [r["center"] for r in parts[0].collect()])


def test_histogram_grows_with_k_not_its_square(spark):
    """Dense histograms of 1,000 codes, and ten times as many codes in far less
    than a hundred times the time."""
    import time
    rows = [(i % 40, (i * 37) % 1000) for i in range(20_000)]
    assigned = spark.createDataFrame(rows, "key int, code int")
    want = {}
    for key, code in rows:
        want.setdefault(key, [0.0] * 1000)[code] += 1
    got = {r["key"]: r["histogram"] for r in CB.histogram(assigned, 1000).collect()}
    assert got == want
    odd = spark.createDataFrame([("a", 0), ("a", 4), ("a", 9), ("b", None), ("c", 4)], "key string, code int")
    assert {r["key"]: r["histogram"] for r in CB.histogram(odd, 5).collect()} == {
        "a": [1.0, 0, 0, 0, 1], "b": [0.0] * 5, "c": [0.0, 0, 0, 0, 1]}
    took = []
    for k in (2_000, 20_000):
        many = spark.range(200_000).select((F.col("id") % 4).cast("int").alias("key"), (F.col("id") % k).cast("int").alias("code"))
        start = time.perf_counter()
        CB.histogram(many, k).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - start)
    assert took[1] < 30 * took[0]
