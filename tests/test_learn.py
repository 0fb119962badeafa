"""Learned models (M1, M4-M6, M8, T8, J7, P13, P14, S10), checked by the
properties of SURVEY §5."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hanga.operators import learn as LN
from hanga.operators import linear as LIN
from hanga.operators import split as SP


def _blobs(spark, n_per=30, seed=0):
    rng = np.random.default_rng(seed)
    centres = np.array([[0.0, 0.0, 0.0], [6.0, 0.0, 0.0], [0.0, 6.0, 0.0]])
    rows = []
    for c, mu in enumerate(centres):
        for i in range(n_per):
            rows.append((f"{c}-{i}", c, [float(v) for v in mu + rng.normal(0, 0.5, 3)]))
    return spark.createDataFrame(rows, "key string, class_id int, features array<double>")


def test_c_grid():
    g = LN.c_grid()
    assert len(g) == 13 and g[0] == pytest.approx(0.01) and g[-1] == pytest.approx(1e10)


def test_pca_centres_and_reduces(spark):
    df = _blobs(spark)
    out = LN.pca_project(df, 2, 3)
    m = np.array([r["pca"] for r in out.collect()])
    assert m.shape == (90, 2)
    assert np.abs(m.mean(0)).max() < 1e-9  # centred before projecting (trap 1)
    same = LN.pca_project(df, 3, 3)  # p >= width: no PCA
    assert same.first()["pca"] == df.where(F.col("key") == same.first()["key"]).first()["features"]


def test_pca_full_rotation_preserves_distances(spark):
    df = _blobs(spark, 10)
    model = LN.fit_pca(df, 2, 3)  # two of three components
    full = LN.Pipeline(stages=LN.pca_stages(2, 3)[0]).fit(LN.to_ml(df))
    assert model is not None and full is not None
    x = np.array([r["features"] for r in df.collect()])
    from pyspark.ml.feature import PCA
    p = PCA(k=3, inputCol="vec", outputCol="p").fit(LN.to_ml(df))
    y = np.array([r["p"].toArray() for r in p.transform(LN.to_ml(df)).collect()])
    dx = np.linalg.norm(x[:, None] - x[None], axis=2)
    dy = np.linalg.norm(y[:, None] - y[None], axis=2)
    assert np.allclose(dx, dy)


def test_batched_svm_separates_and_roundtrips(spark, tmp_path):
    df = SP.stratified_folds(_blobs(spark), 3)
    model, report = LIN.fit(df, [0.01, 1.0, 100.0], 3, max_iter=50)
    acc = model.transform(df).select(
        F.avg((F.col("prediction") == F.col("class_id")).cast("double"))).first()[0]
    assert acc == 1.0
    rep = report.collect()
    assert len(rep) == 3 and sum(r["best"] for r in rep) == 1
    assert max(r["cv_accuracy"] for r in rep) == 1.0
    path = str(tmp_path / "m")
    model.save(spark, path)
    back = LIN.LinearOvRModel.load(spark, path)
    a = [r["prediction"] for r in model.transform(df).orderBy("key").collect()]
    b = [r["prediction"] for r in back.transform(df).orderBy("key").collect()]
    assert a == b and np.allclose(back.coef, model.coef)


def test_batched_matches_single_model_newton(spark):
    """The batched pass computes the same optimum as a local Newton solve."""
    df = _blobs(spark, 20, seed=3)
    model, _ = LIN.fit(df, [1.0], 0, max_iter=50, tol=1e-8)
    pdf = df.toPandas()
    x = np.hstack([np.array(pdf.features.tolist()), np.ones((len(pdf), 1))])
    y = np.where(pdf.class_id.to_numpy() == 0, 1.0, -1.0)
    n_c = (pdf.class_id == 0).sum()
    s = np.where(y > 0, len(pdf) / (3 * n_c), 1.0)  # LIBLINEAR: positives weighted
    w = np.zeros(4)
    for _ in range(50):
        m = 1 - y * (x @ w)
        a = m > 0
        g = w - 2 * x.T @ (s * y * np.where(a, m, 0))
        H = np.eye(4) + 2 * (x[a] * s[a, None]).T @ x[a]
        w = w - np.linalg.solve(H, g)
    assert np.allclose(np.append(model.coef[0], model.intercept[0]), w, atol=1e-5)


def test_top_weights_and_names(spark):
    w = spark.createDataFrame([(0, j, float(v)) for j, v in enumerate([0.1, -3.0, 2.0, 0.5])],
                              "class_id int, dim int, weight double")
    top = LN.top_weights(w, None, k=2).orderBy("rank").collect()
    assert [(r["dim"], r["weight"]) for r in top] == [(1, -3.0), (2, 2.0)]
    assert top[0]["name"] is None
    names = spark.createDataFrame([(1, "red"), (2, "green")], "dim int, name string")
    top = LN.top_weights(w, names, k=2).orderBy("rank").collect()
    assert [r["name"] for r in top] == ["red", "green"]


def test_mllib_svm_pipeline_roundtrip(spark, tmp_path):
    df = _blobs(spark, 15)
    model = LN.fit_svm(df, 3, C=1.0, max_iter=20, parallelism=2)
    path = str(tmp_path / "pm")
    LN.save_model(model, path)
    a = LN.predict(model, df).orderBy("key").collect()
    b = LN.predict(LN.load_model(path), df).orderBy("key").collect()
    assert [r["prediction"] for r in a] == [r["prediction"] for r in b]
    assert np.mean([r["prediction"] == r["label"] for r in a]) > 0.9


def test_pca_travels_with_batched_model(spark, tmp_path):
    """K2: the saved model carries its PCA basis; K3: basis fitted on all
    given rows when asked."""
    df = SP.stratified_folds(_blobs(spark, 20, seed=5), 3)
    model, _ = LIN.fit(df, [1.0], 0, max_iter=50, n_components=2, width=3, pca_fit_rows=df)
    assert model.pca is not None and model.coef.shape == (3, 2)
    path = str(tmp_path / "mp")
    model.save(spark, path)
    back = LIN.LinearOvRModel.load(spark, path)
    a = [r["prediction"] for r in model.transform(df).orderBy("key").collect()]
    b = [r["prediction"] for r in back.transform(df).orderBy("key").collect()]
    assert a == b and back.pca is not None
    acc = np.mean([p == c for p, c in zip(a, [r["class_id"] for r in df.orderBy("key").collect()])])
    assert acc > 0.95


def test_mllib_grid_search_reports_every_c(spark):
    df = _blobs(spark, 12, seed=9)
    model, report = LN.grid_search(df, 3, Cs=[0.1, 10.0], n_folds=3, max_iter=10,
                                   parallelism=2)
    rep = report.orderBy("C").collect()
    assert [r["C"] for r in rep] == [0.1, 10.0] and sum(r["best"] for r in rep) == 1
    acc = LN.predict(model, df).select(
        F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert acc > 0.9


def test_batched_svm_ignores_rows_outside_classes(spark):
    df = _blobs(spark, 10, seed=2)
    model, _ = LIN.fit(df, [1.0], 0, classes=[0, 1], max_iter=30)
    assert model.classes == [0, 1] and model.coef.shape == (2, 3)
    preds = {r["prediction"] for r in model.transform(df.where("class_id < 2")).collect()}
    assert preds <= {0, 1}


def test_saved_model_never_takes_an_older_basis(spark, tmp_path):
    df = _blobs(spark, 20, seed=5)
    path = str(tmp_path / "m")
    with_pca, _ = LIN.fit(df, [1.0], 0, max_iter=50, n_components=2, width=3)
    with_pca.save(spark, path)
    plain, _ = LIN.fit(df, [1.0], 0, max_iter=50)
    plain.save(spark, path)
    back = LIN.LinearOvRModel.load(spark, path)
    assert back.pca is None
    a = [r["prediction"] for r in plain.transform(df).orderBy("key").collect()]
    assert a == [r["prediction"] for r in back.transform(df).orderBy("key").collect()]
    with_pca.save(spark, path)
    import shutil
    for d in tmp_path.glob("m/pca-*"):
        shutil.rmtree(d)
    with pytest.raises(Exception):  # a missing basis is an error, not "no PCA"
        LIN.LinearOvRModel.load(spark, path)


def test_same_answer_whatever_the_limit(spark):
    """Blocks of models: the chosen C and the weights do not depend on it."""
    rng = np.random.default_rng(4)
    rows = [(f"{i}", int(i % 3), [float(v) for v in rng.normal(0, 1, 6) + 0.7 * (i % 3)]) for i in range(150)]
    df = SP.stratified_folds(spark.createDataFrame(rows, "key string, class_id int, features array<double>"), 3)
    Cs = [0.01, 1.0, 1e4, 1e10]
    whole, report = LIN.fit(df, Cs, 3, max_iter=100)
    spark.conf.set("hanga.broadcast.maxBytes", "1000")  # two models at a time
    try:
        parts, report2 = LIN.fit(df, Cs, 3, max_iter=100)
    finally:
        spark.conf.unset("hanga.broadcast.maxBytes")
    assert whole.C == parts.C and np.allclose(whole.coef, parts.coef)
    same = ["C", "cv_accuracy", "best", "n_models", "n_unconverged", "max_iterations"]
    assert report.select(same).collect() == report2.select(same).collect()
    rep = report.collect()
    assert all(r["n_unconverged"] == 0 and r["n_models"] == 12 and r["max_rel_gradient"] <= 1e-4 for r in rep)
    _, cut = LIN.fit(df, [1e10], 0, max_iter=1)
    assert cut.first()["n_unconverged"] > 0  # an early end is reported


def test_wide_vectors_use_the_same_solver(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 1000))
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(str(i), int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))],
                               "key string, class_id int, features array<double>").repartition(3)
    model, report = LIN.fit(df, [1.0], 0, max_iter=60)
    assert model.coef.shape == (2, 1000) and report.first()["n_unconverged"] == 0
    acc = model.transform(df).select(F.avg((F.col("prediction") == F.col("class_id")).cast("double"))).first()[0]
    assert acc == 1.0


def test_newton_cg_finds_the_optimum_of_the_dense_solver(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(f"{i}", int(i % 3), [float(v) for v in rng.normal(0, 1, 12) + 0.4 * (i % 3)]) for i in range(200)]
    df = SP.stratified_folds(spark.createDataFrame(rows, "key string, class_id int, features array<double>"), 3)
    Cs = [0.01, 1.0, 100.0]
    dense, report = LIN.fit(df, Cs, 3, max_iter=100, tol=1e-6)
    monkeypatch.setattr(LIN, "DENSE_WIDTH", 1)
    free, report2 = LIN.fit(df, Cs, 3, max_iter=100, tol=1e-6)
    assert free.C == dense.C
    assert np.allclose(free.coef, dense.coef, atol=1e-4) and np.allclose(free.intercept, dense.intercept, atol=1e-4)
    for a, b in zip(report.collect(), report2.collect(), strict=True):
        assert (a["C"], a["best"], a["n_models"]) == (b["C"], b["best"], b["n_models"])
        assert a["cv_accuracy"] == pytest.approx(b["cv_accuracy"], abs=0.02) and b["n_unconverged"] == 0


def test_3000_wide_vectors_need_no_array_of_width_squared(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 3000))
    y = np.arange(80) % 4
    x[np.arange(80), y] += 30
    df = spark.createDataFrame([(str(i), int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))],
                               "key string, class_id int, features array<double>").repartition(3)
    lengths, plain = [], LIN._reduce_chunks

    def noted(parts, length):
        lengths.append(length)
        return plain(parts, length)

    monkeypatch.setattr(LIN, "_reduce_chunks", noted)
    model, report = LIN.fit(df, [1e-4], 0, max_iter=50)
    assert max(lengths) <= 4 * 3001 + 8     # models x width, a loss and a trace each
    assert report.first()["n_unconverged"] == 0
    got = model.transform(df)
    assert got.where("prediction = class_id").count() == 80


def test_a_pass_takes_a_batch_in_blocks(spark):
    """A task's matrices of rows x models do not grow with the Arrow batches."""
    rows = spark.range(0, 3000, 1, 1).selectExpr("array(double(id), 1D) AS x", "int(id % 2) AS ci", "0 AS fold")

    def add(total, x, ci, fold, w):
        total += [len(x), x[:, 0].sum(), ci.sum(), max(0, len(x) * w.shape[1] * 8 - (4 << 20)), len(x) > 512]

    for n_models in (3, 4000):
        p = LIN._Problem(rows, 2, *[np.zeros(n_models)] * 4)
        got = p._pass(5, (np.zeros((3, n_models)),), add)
        assert got[:3].tolist() == [3000, 2999 * 1500, 1500] and not got[3:].any()
    z = np.random.default_rng(1).normal(size=(3, 3))
    few, many = (LIN._Problem(rows.limit(n), 2, np.array([0, 1, 0]), np.ones(3), np.array([-1, -1, 0]), np.ones((3, 2)))
                 .sums(z, np.arange(3)) for n in (512, 3000))
    whole = np.array([(i, 1.0, 1.0) for i in range(3000)])
    y = np.where(np.arange(3000)[:, None] % 2 == np.array([0, 1, 0]), 1.0, -1.0)
    slack = np.maximum(1 - y * (whole @ z), 0) * [1, 1, 0]      # the third model's fold is all rows
    assert np.allclose(many[0], (slack ** 2).sum(0) + 0.5 * (z * z).sum(0))
    assert np.allclose(many[1], whole.T @ (-2 * y * slack) + z) and not np.allclose(few[0][:2], many[0][:2])
