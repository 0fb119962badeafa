import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hanga.llm import negatives as X

SCHEMA = "vec_id long, embedding array<double>, label int, id string, v string, windows int, score int"


def slow(rows, every, kp=5, kn=3, low=50, high=95):
    """By the definition: all scores of every anchor, in Python integers."""
    least = {}
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i not in least or (y, v) < least[i]:
            least[i] = (y, v)
    q = {i: (y, [math.floor(256 * x) for x in v]) for i, (y, v) in least.items()}
    out = []
    for a, (y, v) in q.items():
        if a % every:
            continue
        score = sorted((-sum(m * n for m, n in zip(v, w, strict=True)), i, z)
                       for i, (z, w) in q.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in score if x[2] == y][:kp]:
            ok = [(i, -t) for t, i, z in score if z != y and low * -s <= -100 * t <= high * -s][:kn]
            out += [(a, p, r + 1, i, -s, t) for r, (i, t) in enumerate(ok)]
    return sorted(out)


def run(spark, rows, every, **options):
    df = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA)
    got = X.mine(df, F.col("id") % every == 0, **options)
    return sorted(tuple(r) for r in got.collect())


def cloud(seed, n, width, labels, places=2):
    rnd = random.Random(seed)
    mids = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(labels)]
    out = []
    for i in range(n):
        y = rnd.randrange(labels)
        out.append((i, [round(m + rnd.gauss(0, 1), places) for m in mids[y]], rnd.choice([y, y, 0])))
    return out


@pytest.mark.parametrize("seed,width,blocks", [(1, 3, 40), (2, 12, 500), (3, 1, 17), (4, 40, 200)])
def test_against_brute_force(spark, seed, width, blocks):
    rows = cloud(seed, 400, width, 4)
    want = slow(rows, 20)
    assert want and run(spark, rows, 20, block_rows=blocks, block_anchors=7) == want


def test_ties_go_to_smaller_ids(spark):
    rnd = random.Random(9)
    rows = [(i, [rnd.choice([0.0, 0.5, 1.0]) for _ in range(3)], i % 3) for i in range(300)]
    rows += [(1000 + i, [1.0, 1.0, 1.0], 1) for i in range(200)]      # one very common vector
    rnd.shuffle(rows)
    assert run(spark, rows, 10, block_rows=64) == slow(rows, 10)


def test_hard_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = cloud(5, 120, 4, 3)
    rows += [(None, [1.0] * 4, 1), (500, None, 1), (510, [1.0, None, 0.0, 0.0], 1), (520, [nan, 1.0, 1.0, 1.0], 1),
             (530, [inf, 1.0, 1.0, 1.0], 2), (540, [1.0] * 4, None), (550, [0.0] * 4, 1), (560, [-2.0] * 4, 2),
             (570, [1.0, 2.0], 1), (580, [2.0, 1.0], 1), (590, [1.5, 1.0], 2), (600, [], 1), (610, [], 1), (620, [], 2),
             (10, [9.0] * 4, 2), (10, [9.0] * 4, 2), (640, [1.0, 1e-300, -0.0, 5.0], 0)]
    assert run(spark, rows, 10, block_rows=50) == slow(rows, 10)
    assert run(spark, [], 10) == []
    assert run(spark, [(None, [1.0], 1), (1, [1.0], 1)], 10) == []


def test_huge_components_stay_exact(spark):
    rows = [(0, [1e7, 3.0], 1), (10, [1e7, 1.0], 1), (2, [9.0000001e6, 7.0], 2), (3, [9.0000001e6, 6.0], 2),
            (4, [9.0000001e6, 8.0], 2), (5, [-1e7, 0.0], 2), (6, [1e6, 2.0], 1)]
    assert run(spark, rows, 10) == slow(rows, 10)


def test_scan_stops_early_and_only_when_allowed():
    """Lists are left once the threshold is strictly below the kth score."""
    rng = np.random.default_rng(3)
    x = np.concatenate([np.full((5, 2), 1000.0), rng.integers(-50, 50, (5000, 2)).astype(float)])
    block = X.Block(np.arange(len(x)), np.zeros(len(x), int), x)
    anchors = np.array([[1.0, 2.0], [-1.0, 1.0], [0.0, 3.0]])
    bounds = {}

    def finished(i, bound, met, scores):
        kth = X._kth(scores[met], 5)
        bounds.setdefault(i, []).append((bound, kth))
        return kth is not None and bound < kth

    for i, met, scores in X.threshold_scan(block, anchors, finished):
        exact = x @ anchors[i]
        assert (scores[met] == exact[met]).all()
        assert sorted(scores[met])[-5:] == sorted(exact)[-5:]
        if i == 0:
            assert met.sum() < 100
        assert exact[~met].max() <= bounds[i][-1][0]


def test_plan_has_no_cross_join_and_no_broadcast(spark):
    df = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in cloud(6, 50, 3, 2)], SCHEMA)
    plan = X.mine(df, F.col("id") % 10 == 0)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "BroadcastExchange" not in plan
