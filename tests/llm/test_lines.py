import random
from collections import Counter

import pytest

from hanga.llm import lines as X
from llm_fixtures import hard_rows, make_docs, make_labels  # noqa: F401

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(texts, min_docs, min_chars=1):
    split = [(t or "").split("\n") for t in texts]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(AZ)
    often = Counter(k for x in split for k in {key(y) for y in x})
    gone = {k for k, n in often.items() if n >= min_docs and len(k) >= min_chars}
    return [("\n".join(y for y in x if key(y) not in gone), len(x), sum(key(y) in gone for y in x)) for x in split]


def check(spark, make_docs, rows, min_docs, min_chars=1, limit=None):
    docs = make_docs(rows, clash=True).repartition(5)
    if limit is not None:
        spark.conf.set("hanga.broadcast.maxBytes", str(limit))
    try:
        got = X.drop_frequent_lines(docs, min_docs, min_chars)
        assert set(docs.columns) < set(got.columns)
        have = sorted(((r["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=str)
    finally:
        spark.conf.unset("hanga.broadcast.maxBytes")
    assert have == sorted(((r[0], *s) for r, s in zip(rows, slow([r[1] for r in rows], min_docs, min_chars),
                                                      strict=True)), key=str)


def some_rows(seed, n=60):
    rnd = random.Random(seed)
    pool = ["Subscribe now", " subscribe NOW\t", "ÄRGER", "ärger", "", "  ", "x", "a\r", "A", *map(str, range(12))]
    return [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 9)))) for i in range(n)]


@pytest.mark.parametrize("limit", [None, 0, 1, 100])
def test_against_brute_force_by_broadcast_and_by_shuffle(spark, make_docs, hard_rows, limit):
    check(spark, make_docs, some_rows(1) + hard_rows, 10, limit=limit)


def test_other_thresholds_and_a_line_of_every_document(spark, make_docs):
    rows = [(i, f"Home | About\nown {i}\n\nhome | about ") for i in range(300)]
    for limit in (None, 50):
        check(spark, make_docs, rows, 300, limit=limit)
    check(spark, make_docs, some_rows(2), 3, min_chars=2)


def test_repeated_rows_are_documents_of_their_own(spark, make_docs):
    for limit in (None, 1):
        check(spark, make_docs, [(7, "same\nrow"), (7, "same\nrow"), (None, "same"), (None, None), (1, "row\nrow")],
              3, limit=limit)
    got = X.drop_frequent_lines(make_docs([]))
    assert got.count() == 0 and "kept_text" in got.columns


def test_long_text_with_many_lines(spark, make_docs):
    long = "\n".join(f"line {i % 5000}" for i in range(40_000))
    for limit in (None, 1):
        check(spark, make_docs, [(1, long), (2, "line 7\nother"), (3, "LINE 7")], 3, limit=limit)


def test_clashing_columns_of_the_result_give_way(spark, make_docs):
    from pyspark.sql import functions as F
    docs = make_docs([(1, "a\nb")]).withColumn("n_lines", F.lit("old")).withColumn("_lost", F.lit(3))
    got = X.drop_frequent_lines(docs, 1)
    row = got.first()
    assert (row["kept_text"], row["n_lines"], row["n_dropped"], row["_lost"]) == ("", 2, 2, 3)


def test_two_hashes_of_one_half():
    import numpy as np
    pairs = np.array([[1, 5], [1, 6], [2, 5], [1, 7], [-3, 1]], np.int64)
    known = X._ordered(np.array([[1, 7], [1, 5], [-3, 1], [9, 9]], np.int64))
    assert X._is_in(pairs, known).tolist() == [True, False, False, True, True]
