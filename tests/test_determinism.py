"""SURVEY §5.4: results do not depend on the number of shuffle partitions."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

NAMES = ["class_stats", "label_dedup", "train_test_split", "strat_folds", "bow_histogram",
         "keypoint_sample", "keypoint_topk", "lloyd_steps", "confusion_matrix"]


@pytest.mark.parametrize("name", NAMES)
def test_same_result_for_other_partitioning(spark, name):
    fn = E.queries()[name]
    base = sorted(map(tuple, fn(spark, SF_SMALL).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        other = sorted(map(tuple, fn(spark, SF_SMALL).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert base == other
