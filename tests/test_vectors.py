"""Class statistics and neighbour queries on hand-made vectors (A2-A5, A13,
J4-J6, T3-T7, quirks K1, trap 12)."""

import math

import numpy as np
import pytest

from conftest import rows
from hanga.operators import vectors as V


def _samples(spark, data):
    return spark.createDataFrame(data, "key string, class_id int, features array<double>")


@pytest.fixture
def toy(spark):
    # class 0: 5 samples, class 1: 4 samples, class 2: 1 sample, class 3: none
    data = [(f"a{i}", 0, [float(i), 0.0]) for i in range(5)]
    data += [(f"b{i}", 1, [10.0, float(i)]) for i in range(4)]
    data += [("c0", 2, [-5.0, -5.0])]
    return _samples(spark, data)


@pytest.fixture
def cdim(spark):
    return spark.createDataFrame([(f"k{i}", i) for i in range(4)], "class_name string, class_id int")


def test_class_stats_matches_numpy(toy, cdim):
    out = {r["class_id"]: r for r in V.class_stats(toy, cdim).collect()}
    assert out[3]["n_samples"] == 0 and out[3]["dist_var"] is None  # empty class listed
    assert out[2]["n_samples"] == 1 and out[2]["dist_var"] == 0.0
    x = np.array([[float(i), 0.0] for i in range(5)])
    d = np.linalg.norm(x - x.mean(0), axis=1)
    assert out[0]["dist_var"] == pytest.approx(np.var(d))
    assert out[0]["dist_mean"] == pytest.approx(d.mean())


def test_centroids_include_global(toy):
    c = {r["class_id"]: r for r in V.class_centroids(toy).collect()}
    assert c[-1]["n"] == 10
    allx = np.array([r["features"] for r in toy.collect()])
    assert c[-1]["centroid"] == pytest.approx(list(allx.mean(0)))


def test_inter_class_distance_symmetric(toy):
    cents = V.class_centroids(toy)
    d = {(r["class_i"], r["class_j"]): r["dist"] for r in
         V.inter_class_distance(cents).collect()}
    assert len(d) == 16
    for (i, j), v in d.items():
        assert v == pytest.approx(d[(j, i)])
        if i == j:
            assert v == 0.0


def test_nearest_and_outliers_small_class_lists_all(toy):
    near = rows(V.ranked_by_centroid(toy, k=5), "class_id", "rank", "key")
    far = rows(V.ranked_by_centroid(toy, k=5, farthest=True), "class_id", "rank", "key")
    assert [r for r in near if r[0] == 1] and len([r for r in near if r[0] == 1]) == 4
    assert [r[2] for r in near if r[0] == 0][0] == "a2"  # the middle point is the mean
    assert {r[2] for r in far if r[0] == 0} == {f"a{i}" for i in range(5)}


def test_knn_query_at_index_zero_and_missing(toy):
    top = rows(V.knn(toy, "a0", k=3), "rank", "key")
    assert top[0] == (0, "a0")
    with pytest.raises(KeyError):
        V.knn(toy, "nope")


def test_query_rank_with_duplicates(spark):
    s = _samples(spark, [("x", 0, [1.0, 1.0]), ("a", 0, [1.0, 1.0]), ("z", 1, [5.0, 5.0])])
    assert V.query_rank(s, "x").first()["query_rank"] == 1  # 'a' duplicates it, sorts first
    assert V.query_rank(s, "a").first()["query_rank"] == 0


def test_closest_by_class(toy):
    out = rows(V.closest_by_class(toy, "a4"), "class_id", "key")
    assert out == [(0, "a4"), (1, "b0"), (2, "c0")]


def test_distance_function(spark):
    from hanga.functions.vectors import l2_distance
    df = spark.createDataFrame([([3.0, 0.0], [0.0, 4.0])], "a array<double>, b array<double>")
    assert math.isclose(df.select(l2_distance("a", "b")).first()[0], 5.0)


def test_vectors_without_a_distance_never_rank(spark):
    """A NULL vector and one of another width are rejects, not neighbours."""
    s = _samples(spark, [("q", 0, [0.0, 0.0]), ("a", 0, [1.0, 0.0]), ("b", 1, [2.0, 0.0]),
                         ("wide", 1, [0.0, 0.0, 0.0]), ("none", 0, None)])
    assert rows(V.knn(s, "q", k=5), "rank", "key") == [(0, "q"), (1, "a"), (2, "b")]
    assert rows(V.closest_by_class(s, "q"), "class_id", "key") == [(0, "q"), (1, "b")]
    r = V.query_rank(s, "q").first()
    assert (r["query_rank"], r["n_samples"]) == (0, 3)
    assert rows(V.incomparable(s, 2), "key", "reason") == [("none", "no_vector"), ("wide", "width_mismatch")]
    near = rows(V.ranked_by_centroid(s, k=5, width=2), "class_id", "key")
    assert near == [(0, "a"), (0, "q"), (1, "b")]
    with pytest.raises(ValueError):
        V.knn(s, "none")
