"""Dimension reduction and linear one-vs-rest classifiers (M1, M3-M8, A12,
T8, J7, P13, P14, S10) on MLlib.

Everything the reference fits is wrapped in one ``PipelineModel`` (centring
+ PCA + classifier), so a saved model carries its own basis (quirk K2 fixed)
and LOAD never re-fits PCA on new data.

Parameter mapping (trap 3): the reference's LinearSVC minimises
``1/2 ||w||^2 + C * sum(w_i * loss_i)``; MLlib's minimises
``sum(w_i * loss_i) / sum(w_i) + regParam/2 ||w||^2``. Dividing the first by
``C * sum(w_i)`` gives ``regParam = 1 / (C * sum(w_i))``; with balanced
weights ``sum(w_i) = n``. MLlib uses the hinge loss, not its square, so
scores agree only roughly. ``standardization`` stays off like the reference.

Scale: training data is cut from its lineage once (reliable checkpoint) and
cached before the fold/grid loop, so executor loss during one of the many
fits recomputes from the checkpoint, not from the raw tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel  # noqa: F401 (re-exported)
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .split import stratified_folds, with_class_weights

VEC = "vec"


def c_grid(lo: int = -2, hi: int = 10, n: int = 13) -> list[float]:
    """Log-spaced C values, 10^lo .. 10^hi (P14; reference default 13)."""
    return [float(c) for c in np.logspace(lo, hi, n)]


def to_ml(df: DataFrame, col: str = "features", label_col: str = "class_id") -> DataFrame:
    """``array<double>`` features -> ML vector column ``vec``; label as
    double ``label``."""
    return (df.withColumn(VEC, array_to_vector(F.col(col)))
            .withColumn("label", F.col(label_col).cast("double")))


def pca_stages(n_components: int | None, width: int, in_col: str = VEC,
               out_col: str = "pca") -> tuple[list, str]:
    """Centring + PCA stages when ``n_components < width`` (M1), else none.
    Spark's PCA does not centre (trap 1), so a mean-only scaler goes first.
    Returns (stages, output column)."""
    if n_components is None or n_components >= width:
        return [], in_col
    return [StandardScaler(withMean=True, withStd=False, inputCol=in_col, outputCol="__centred"),
            PCA(k=n_components, inputCol="__centred", outputCol=out_col)], out_col


def fit_pca(samples: DataFrame, n_components: int, width: int) -> PipelineModel:
    stages, _ = pca_stages(n_components, width)
    return Pipeline(stages=stages).fit(to_ml(samples))


def pca_project(samples: DataFrame, n_components: int, width: int) -> DataFrame:
    """Samples with ``pca array<double>``, fitted on all given rows (the
    reference fits before splitting, quirk K3)."""
    stages, out = pca_stages(n_components, width)
    model = Pipeline(stages=stages).fit(to_ml(samples))
    return (model.transform(to_ml(samples))
            .select("key", "class_id", vector_to_array(out, "float64").alias("pca")))


def svm_pipeline(width: int, n_components: int | None = None, C: float = 1.0,
                 n_train: int = 1, max_iter: int = 100, parallelism: int = 1,
                 weight_col: str | None = "weight") -> tuple[Pipeline, LinearSVC]:
    stages, feat = pca_stages(n_components, width)
    svc = LinearSVC(featuresCol=feat, labelCol="label", maxIter=max_iter,
                    regParam=1.0 / (C * n_train), standardization=False)
    if weight_col:
        svc = svc.setWeightCol(weight_col)
    ovr = OneVsRest(classifier=svc, featuresCol=feat, labelCol="label",
                    parallelism=parallelism)
    if weight_col:
        ovr = ovr.setWeightCol(weight_col)
    return Pipeline(stages=stages + [ovr]), svc


def prepare_training(train: DataFrame, n_folds: int = 3,
                     checkpoint: bool = True) -> DataFrame:
    """Balanced weights (A12) + stratified folds (M7) + ML columns; lineage
    cut in the shared checkpoint folder and cached for the fit loop."""
    df = with_class_weights(train)
    df = stratified_folds(df, n_folds)
    df = to_ml(df).select("key", "class_id", "label", VEC, "weight", "fold")
    if checkpoint:
        df = cut_lineage(df)
    return df.cache()


def fit_svm(train: DataFrame, width: int, C: float = 1.0,
            n_components: int | None = None, max_iter: int = 100,
            parallelism: int = 4) -> PipelineModel:
    """One one-vs-rest linear SVM with balanced class weights (M4)."""
    df = prepare_training(train)
    n = df.count()
    pipe, _ = svm_pipeline(width, n_components, C, n, max_iter, parallelism)
    return pipe.fit(df)


def grid_search(train: DataFrame, width: int,
                Cs: list[float] | None = None, n_folds: int = 3,
                n_components: int | None = None, max_iter: int = 100,
                parallelism: int = 4) -> tuple[PipelineModel, DataFrame]:
    """Choose C by stratified k-fold cross-validation (accuracy), refit on all
    training rows (M5). Returns (best model, one row per C with its mean CV
    score and ``best`` flag — M8)."""
    Cs = Cs or c_grid()
    df = prepare_training(train, n_folds)
    n = df.count()
    pipe, svc = svm_pipeline(width, n_components, 1.0, n, max_iter, parallelism=1)
    grid = ParamGridBuilder().addGrid(svc.regParam, [1.0 / (c * n) for c in Cs]).build()
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid,
                        evaluator=MulticlassClassificationEvaluator(metricName="accuracy"),
                        foldCol="fold", parallelism=parallelism)
    cvm = cv.fit(df)
    scores = list(cvm.avgMetrics)
    best = int(np.argmax(scores))
    rows = [(float(c), float(s), i == best) for i, (c, s) in enumerate(zip(Cs, scores))]
    report = train.sparkSession.createDataFrame(rows, "C double, cv_accuracy double, best boolean")
    df.unpersist()
    return cvm.bestModel, report


def predict(model: PipelineModel, samples: DataFrame) -> DataFrame:
    """``(key, label, prediction)`` (M6)."""
    return model.transform(to_ml(samples)).select(
        "key", F.col("class_id").alias("label"), F.col("prediction").cast("int").alias("prediction"))


def weights_table(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """``(class_id, dim, weight)`` from the one-vs-rest coefficients (model
    metadata, C x d values)."""
    ovr = model.stages[-1]
    rows = [(int(ci), j, float(w)) for ci, m in enumerate(ovr.models)
            for j, w in enumerate(m.coefficients.toArray())]
    return spark.createDataFrame(rows, "class_id int, dim int, weight double")


def top_weights(weights: DataFrame, names: DataFrame | None = None, k: int = 5) -> DataFrame:
    """Per class, the k largest-magnitude weights with sign and feature name
    (T8, P13, J7). Without names (e.g. after PCA) the name is NULL (quirk
    K4 fixed)."""
    w = Window.partitionBy("class_id").orderBy(F.abs("weight").desc(), "dim")
    top = weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if names is None:
        return top.withColumn("name", F.lit(None).cast("string"))
    return top.join(names, "dim", "left")


def save_model(model: PipelineModel, path: str) -> None:
    """Persist the whole fitted pipeline."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
