"""Confusion tables and accuracies (A7-A10, quirk K5)."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from hanga.operators import metrics as M


def _pred(spark, pairs):
    return spark.createDataFrame(pairs, "label int, prediction int")


def test_confusion_and_normalised(spark):
    p = _pred(spark, [(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)])
    c = M.confusion_normalised(M.confusion(p))
    got = {(r["label"], r["prediction"]): (r["n"], r["frac"]) for r in c.collect()}
    assert got[(0, 0)] == (1, 0.5) and got[(1, 1)] == (2, 1.0) and got[(2, 0)] == (1, 1.0)
    for lab in (0, 1, 2):
        assert sum(f for (l_, _), (_, f) in got.items() if l_ == lab) == pytest.approx(1.0)


def test_accuracy_with_predicted_only_class(spark):
    # class 3 only predicted, class 2 only in truth
    p = _pred(spark, [(0, 0), (0, 0), (1, 3), (2, 1)])
    a = M.accuracy_summary(M.confusion(p)).first()
    assert a["n_test"] == 4 and a["n_correct"] == 2 and a["accuracy"] == 0.5
    # recalls: c0=1, c1=0, c2=0, c3=0 -> mean over 4 classes
    assert a["balanced_accuracy"] == pytest.approx(0.25)


def test_single_class_test_set(spark):
    a = M.accuracy_summary(M.confusion(_pred(spark, [(4, 4), (4, 4)]))).first()
    assert a["accuracy"] == 1.0 and a["balanced_accuracy"] == 1.0


def test_nearest_centroid_ties_go_to_lowest_class(spark):
    cents = spark.createDataFrame([(1, [1.0, 0.0]), (0, [-1.0, 0.0])],
                                  "class_id int, centroid array<double>")
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.9, 0.0])], "key int, f array<double>")
    assert rows(M.predict_nearest_centroid(df, cents, "f"), "key", "prediction") == [(1, 0), (2, 1)]


def test_more_classes_than_one_block_holds(spark):
    n = 1500
    cents = spark.range(n).select(F.col("id").cast("int").alias("class_id"),
                                  F.array(F.col("id").cast("double"), F.lit(0.0)).alias("centroid"))
    df = spark.createDataFrame([(i, [i + 0.2, 0.0]) for i in (0, 7, 1499)], "key int, f array<double>")
    spark.conf.set("hanga.broadcast.maxBytes", "4000")
    try:
        got = rows(M.predict_nearest_centroid(df, cents, "f"), "key", "prediction")
    finally:
        spark.conf.unset("hanga.broadcast.maxBytes")
    assert got == [(0, 0), (7, 7), (1499, 1499)]
