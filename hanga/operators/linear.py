"""Batched one-vs-rest linear SVMs with cross-validated C (M4, M5, M6, A12;
SURVEY build step B3).

The reference fits a squared-hinge linear SVM per class, per C value and per
fold, then refits the best C on all training rows: 13 C x (3 folds + refit) x
C classes fits. Fitting them one by one means one pass over the data per
optimiser iteration *per model*. Here every model is a column of one weight
matrix W (d+1 x J), and every optimiser iteration is **one** pass over the
training rows for all J models together:

* each task turns its Arrow batches into dense blocks X of at most 512 rows,
  computes the margins X @ W for all models, and accumulates sums — only those
  partial sums leave the task, and its memory does not follow the batches;
* the partial sums travel as raw float64 bytes cut into small chunks and are
  added in two levels, first per (chunk, task group), then per chunk, so no
  reducer ever holds one chunk of every task;
* the driver runs a Newton method for each model independently.

Up to ``DENSE_WIDTH`` columns the sums are loss, gradient and generalized
Hessian (width squared per model): the fewest passes. Beyond it no Hessian is
ever formed: the same damped Newton steps are solved by conjugate gradients,
whose passes return Hessian-vector products (width per model), so that the
reference's widest input (3000) takes 24 KB per model instead of 72 MB, and all
models still share every pass. Models are solved in blocks whose sums fit the
broadcast limit. A model that does not reach the tolerance is reported, with its
gradient.

Objective per model j (class c, cost C, fold f; bias folded into w like
LIBLINEAR's ``bias = 1``):

    1/2 ||w||^2 + C * sum_{i in train(f)} s_ij * max(0, 1 - y_ij w.x_i)^2

with ``y_ij = +1`` for class c and -1 otherwise. ``weighting="positive"``
(LIBLINEAR parity, trap 4) scales only the positives by the balanced class
weight ``n_f / (K_f * n_{f,c})`` of the fold's training rows;
``weighting="row"`` gives every row its own class weight.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import dense
from ..session import broadcast_limit, cut_lineage

CHUNK = 32768   # doubles per reduce chunk (256 KiB)
DENSE_WIDTH = 512   # widest input whose Hessians are formed (2 MB per model)
CG_TOLERANCE = 1e-6     # residual of a step, relative to the gradient
GROUPS = 64     # first-level groups of tasks in the reduction
BLOCK_ROWS, BLOCK_BYTES = 512, 4 * 1024 * 1024      # of a (rows x models) matrix in a task


@dataclass
class LinearOvRModel:
    """Fitted one-vs-rest linear model: ``coef`` (K x d), ``intercept`` (K),
    and the PCA basis it was trained in, if any (quirk K2: the basis travels
    with the model, a loaded model never re-fits it)."""
    classes: list[int]
    coef: np.ndarray
    intercept: np.ndarray
    C: float
    pca: PipelineModel | None = None

    def features_of(self, df: DataFrame, features: str = "features") -> DataFrame:
        """``df`` with ``features`` replaced by the model's input space."""
        if self.pca is None:
            return df
        return project(self.pca, df, features)

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Adds ``prediction``: the class with the largest decision value (ties
        go to the first class), one matrix product per Arrow batch."""
        rows = self.features_of(df, features)
        coef, intercept, classes = self.coef, self.intercept, np.array(self.classes, np.int32)
        bc = rows.sparkSession.sparkContext.broadcast((coef, intercept, classes))

        def run(batches):
            w, b, names = bc.value
            for batch in batches:
                x = dense(batch.column(features), w.shape[1])
                best = names[(x @ w.T + b).argmax(1)] if len(x) else names[:0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best)],
                                                 names=[*batch.schema.names, "prediction"])

        out = T.StructType([*rows.schema.fields, T.StructField("prediction", T.IntegerType())])
        return rows.mapInArrow(run, out)

    def weights(self, spark: SparkSession) -> DataFrame:
        """``(class_id, dim, weight)`` — model metadata, K x d values."""
        rows = [(int(c), j, float(w)) for i, c in enumerate(self.classes)
                for j, w in enumerate(self.coef[i])]
        return spark.createDataFrame(rows, "class_id int, dim int, weight double")

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model; the weight table names the folder of its own basis
        (a fresh one per save), or none, so an older basis is never used."""
        basis = None
        if self.pca is not None:
            basis = f"pca-{uuid.uuid4().hex}"
            self.pca.write().save(f"{path}/{basis}")
        rows = [(int(c), [float(v) for v in self.coef[i]], float(self.intercept[i]), float(self.C), basis)
                for i, c in enumerate(self.classes)]
        (spark.createDataFrame(rows, "class_id int, coef array<double>, intercept double, C double, basis string")
         .coalesce(1).write.mode("overwrite").parquet(f"{path}/weights"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> "LinearOvRModel":
        rows = sorted(spark.read.parquet(f"{path}/weights").collect(), key=lambda r: r["class_id"])
        basis = rows[0]["basis"] if rows else None
        pca = PipelineModel.load(f"{path}/{basis}") if basis else None
        return LinearOvRModel([r["class_id"] for r in rows],
                              np.array([r["coef"] for r in rows], dtype=np.float64),
                              np.array([r["intercept"] for r in rows], dtype=np.float64),
                              rows[0]["C"] if rows else 1.0, pca)


def project(pca: PipelineModel, df: DataFrame, features: str = "features") -> DataFrame:
    """Apply a fitted centring + PCA pipeline to an ``array<double>``
    column, keeping its name."""
    from .learn import to_ml
    out = pca.stages[-1].getOutputCol()
    return (pca.transform(to_ml(df, features).drop("label"))
            .withColumn(features, vector_to_array(out, "float64"))
            .drop("vec", "__centred", out))


def _rows_of(batch: pa.RecordBatch, d: int):
    """(x with a column of ones, class numbers, folds) of one Arrow batch."""
    x = dense(batch.column("x"), d)
    return (np.hstack([x, np.ones((len(x), 1))]), batch.column("ci").to_numpy(), batch.column("fold").to_numpy())


def _sum_chunk(t: pa.Table) -> pa.Table:
    total = None
    for blob in t.column("v"):
        part = np.frombuffer(blob.as_buffer(), dtype=np.float64)
        total = part.copy() if total is None else np.add(total, part, out=total)
    return t.slice(0, 1).set_column(t.column_names.index("v"), "v", pa.array([total.tobytes()], pa.binary()))


def _reduce_chunks(parts: DataFrame, length: int) -> np.ndarray:
    """Sum the per-task partial vectors: rows ``(chunk, g, v)`` with ``v`` raw
    float64 bytes are added per (chunk, task group), then per chunk; the sums
    are decoded on the driver."""
    kind = "chunk int, g int, v binary"
    summed = (parts.groupBy("chunk", "g").applyInArrow(_sum_chunk, kind)
              .groupBy("chunk").applyInArrow(_sum_chunk, kind).collect())
    out = np.zeros(length)
    for r in summed:
        v = np.frombuffer(r["v"], dtype=np.float64)
        start = r["chunk"] * CHUNK
        out[start:start + len(v)] = v
    return out


def _emit(flat: np.ndarray) -> pa.RecordBatch:
    """A task's partial vector as ``(chunk, g, v)`` rows of raw float64 bytes."""
    g, n = TaskContext.get().partitionId() % GROUPS, -(-len(flat) // CHUNK)
    parts = [np.ascontiguousarray(flat[i * CHUNK:(i + 1) * CHUNK]).tobytes() for i in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([g] * n, pa.int32()),
                                       pa.array(parts, pa.binary())], names=["chunk", "g", "v"])


def _active(z: np.ndarray, ci, fold, mc, mC, mf, wm):
    """(label signs, row costs where the hinge is active, margins' slack)."""
    y = np.where(ci[:, None] == mc[None, :], 1.0, -1.0)
    in_train = (mf[None, :] < 0) | (fold[:, None] != mf[None, :])
    slack = 1.0 - y * z
    return y, np.where((slack > 0) & in_train, mC[None, :] * wm[:, ci].T, 0.0), slack


class _Problem:
    """Training rows (x, ci, fold) plus the model table; evaluates loss and
    gradient of every model in one pass."""

    def __init__(self, data: DataFrame, d: int, m_class, m_C, m_fold, weight_mat):
        self.data, self.d = data, d
        self.m_class, self.m_C, self.m_fold = m_class, m_C, m_fold
        self.weight_mat = weight_mat  # J x K: weight of a row of class k in model j
        self.J = len(m_class)

    def _pass(self, length: int, shared: tuple, add) -> np.ndarray:
        """One pass: ``add(total, x, ci, fold, *shared)`` over blocks of every
        batch; the tasks' totals (``length`` doubles each) are added up. The
        first of ``shared`` is the weights, a column per model: a block's
        matrices of rows x models hold ``BLOCK_BYTES`` each at most."""
        bc = self.data.sparkSession.sparkContext.broadcast(shared)
        d, rows = self.d, max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(shared[0].shape))))

        def run(batches):
            total, seen = np.zeros(length), False
            for batch in batches:
                for lo in range(0, batch.num_rows, rows):
                    seen = True
                    add(total, *_rows_of(batch.slice(lo, rows), d), *bc.value)
            if seen:
                yield _emit(total)

        out = _reduce_chunks(self.data.mapInArrow(run, "chunk int, g int, v binary"), length)
        bc.destroy()
        return out

    def _models(self, cols: np.ndarray) -> tuple:
        return self.m_class[cols], self.m_C[cols], self.m_fold[cols], self.weight_mat[cols]

    def sums(self, W: np.ndarray, cols, hessian: bool = True):
        """Loss, gradient, trace of the generalized Hessian and, if wanted, the
        Hessian (len(cols) x D x D; else None) at W of the models ``cols`` (W
        has one column each), in one pass."""
        cols = np.asarray(cols)
        D, J = W.shape

        def add(total, xt, ci, fold, w, *models):
            y, coef, slack = _active(xt @ w, ci, fold, *models)
            total[:D * J] += (xt.T @ (-2.0 * coef * y * slack)).ravel()
            total[D * J:D * J + J] += (coef * slack * slack).sum(0)
            total[D * J + J:D * J + 2 * J] += 2.0 * (xt * xt).sum(1) @ coef
            if not hessian:
                return
            hess = total[D * J + 2 * J:].reshape(J, D * D)
            if J > 1 and D <= 256:
                # all Hessians at once: coef^T @ (row outer products), in row blocks
                for lo in range(0, len(xt), 512):
                    xb = xt[lo:lo + 512]
                    outer = (xb[:, :, None] * xb[:, None, :]).reshape(len(xb), -1)
                    hess += 2.0 * coef[lo:lo + 512].T @ outer
            else:
                for m in range(J):
                    hit = coef[:, m] > 0
                    xb = xt[hit]
                    hess[m] += 2.0 * ((xb * coef[hit, m][:, None]).T @ xb).ravel()

        flat = self._pass(D * J + 2 * J + (J * D * D if hessian else 0), (W, *self._models(cols)), add)
        grad = flat[:D * J].reshape(D, J) + W
        loss = flat[D * J:D * J + J] + 0.5 * (W * W).sum(0)
        trace = flat[D * J + J:D * J + 2 * J] + D
        return loss, grad, trace, flat[D * J + 2 * J:].reshape(J, D, D) + np.eye(D)[None] if hessian else None

    def hessian_times(self, W: np.ndarray, V: np.ndarray, cols) -> np.ndarray:
        """Generalized Hessian at W times V, a column per model, in one pass;
        the Hessian itself is never formed."""
        def add(total, xt, ci, fold, w, v, *models):
            _, coef, _ = _active(xt @ w, ci, fold, *models)
            total += (xt.T @ (2.0 * coef * (xt @ v))).ravel()
        return V + self._pass(W.size, (W, V, *self._models(np.asarray(cols))), add).reshape(W.shape)

    def fold_accuracy(self, W: np.ndarray, groups: list[np.ndarray], group_fold: np.ndarray,
                      ) -> np.ndarray:
        """Accuracy of each group of K models (one per class, same C and fold)
        on the rows of its held-out fold."""
        n = len(groups)

        def add(total, xt, ci, fold, w, g, gf):
            z = xt @ w
            for k in range(n):
                rows = fold == gf[k]
                if rows.any():
                    total[k] += (z[rows][:, g[k]].argmax(1) == ci[rows]).sum()
                    total[n + k] += rows.sum()

        flat = self._pass(2 * n, (W, np.array(groups), group_fold), add)
        return flat[:n] / np.maximum(flat[n:], 1.0)


def _conjugate_gradients(problem: _Problem, W, g, lam, cols, stop):
    """(p, r) with (H + lam I) p = -g - r and ||r|| <= stop per model: one data
    pass per step for all models that are not done."""
    p, r = np.zeros_like(g), -g.copy()
    way, rr = r.copy(), (r * r).sum(0)
    for _ in range(2 * len(g)):
        k = np.nonzero(np.sqrt(rr) > stop)[0]
        if not len(k):
            break
        hv = problem.hessian_times(W[:, k], way[:, k], cols[k]) + lam[k] * way[:, k]
        alpha = rr[k] / (way[:, k] * hv).sum(0)
        p[:, k] += alpha * way[:, k]
        r[:, k] -= alpha * hv
        new = (r[:, k] * r[:, k]).sum(0)
        way[:, k] = r[:, k] + new / rr[k] * way[:, k]
        rr[k] = new
    return p, r


def _newton(problem: _Problem, D: int, cols: np.ndarray, max_iter: int, tol: float, dense_steps: bool = True):
    """Damped Newton (Levenberg-Marquardt) on the generalized Hessian of the
    models ``cols``, advanced together with one data pass per iteration.

    Each model solves (H + lam I) p = -g; a step is kept when it lowers the
    objective by a fair share of the quadratic model's prediction, and lam
    shrinks after good steps and grows after rejected ones. The squared hinge
    is piecewise quadratic, so undamped steps converge in a few iterations;
    damping keeps large-C models stable where the active set keeps changing.

    ``dense_steps`` False solves by conjugate gradients on Hessian-vector
    products, a pass each, to ``CG_TOLERANCE``; the driver and the tasks then
    hold a few arrays of models x width, no more.
    Returns (W, iterations, gradient norm relative to the start's) per model."""
    J = len(cols)
    eye = np.eye(D) if dense_steps else None
    W = np.zeros((D, J))
    f, g, trace, H = problem.sums(W, cols, dense_steps)
    g0 = np.maximum(np.linalg.norm(g, axis=0), 1e-12)
    lam, used = np.zeros(J), np.zeros(J, int)
    active = np.linalg.norm(g, axis=0) > tol * g0
    it = 0
    while it < max_iter and active.any():
        it += 1
        a = np.nonzero(active)[0]  # converged models are not evaluated again
        used[a] = it
        if dense_steps:
            p = np.linalg.solve(H[a] + lam[a, None, None] * eye[None], -g[:, a].T[:, :, None])[:, :, 0].T
            curved = np.einsum("jd,jde,je->j", p.T, H[a], p.T)
        else:
            # nearly exact steps: rough ones leave the active set changing back and forth
            p, r = _conjugate_gradients(problem, W[:, a], g[:, a], lam[a], cols[a],
                                        CG_TOLERANCE * np.linalg.norm(g[:, a], axis=0))
            curved = (p * (-g[:, a] - r - lam[a] * p)).sum(0)
        f_try, g_try, trace_try, H_try = problem.sums(W[:, a] + p, cols[a], dense_steps)
        predicted = -(g[:, a] * p).sum(0) - 0.5 * curved
        ratio = (f[a] - f_try) / np.maximum(predicted, 1e-300)
        good = ((f_try < f[a]) & (ratio > 1e-4)) | \
               ((f_try <= f[a]) & (predicted <= 1e-14 * np.abs(f[a])))
        ok = a[good]
        W[:, ok] += p[:, good]
        f[ok], g[:, ok], trace[ok] = f_try[good], g_try[:, good], trace_try[good]
        if dense_steps:
            H[ok] = H_try[good]
        scale = trace[a] / D
        lam[a] = np.where(good, np.where(ratio > 0.75, lam[a] / 10, lam[a]),
                          np.maximum(lam[a] * 10, 1e-6 * scale))
        lam[a] = np.where(good & (lam[a] < 1e-12 * scale), 0.0, lam[a])
        active &= np.linalg.norm(g, axis=0) > tol * g0
    return W, used, np.linalg.norm(g, axis=0) / g0


def fit(df: DataFrame, Cs: list[float], n_folds: int = 3, classes: list[int] | None = None,
        max_iter: int = 200, tol: float = 1e-4, weighting: str = "positive",
        label_col: str = "class_id", features: str = "features",
        fold_col: str | None = "fold",
        n_components: int | None = None, width: int | None = None,
        pca_fit_rows: DataFrame | None = None) -> tuple[LinearOvRModel, DataFrame]:
    """Fit every (class, C, fold) model plus the all-rows refit per C, pick
    C by mean fold accuracy (first best wins, like the reference's grid
    search) and return ``(model for the best C, report)``. With one C value or
    ``n_folds = 0`` no cross-validation runs.

    The report has one row per C: ``C, cv_accuracy, best``, and over the
    models of that C ``n_models``, ``n_unconverged`` (tolerance not reached
    within ``max_iter``), ``max_iterations`` and ``max_rel_gradient``.

    ``n_components`` below the vector ``width`` (M1) centres and projects the
    features first; the basis is fitted on ``pca_fit_rows`` (the reference
    fits on all labelled rows, quirk K3) or else on the training rows, and
    is stored in the model."""
    spark = df.sparkSession
    pca = None
    if n_components is not None and width is not None and n_components < width:
        from .learn import fit_pca
        pca = fit_pca(pca_fit_rows if pca_fit_rows is not None else df, n_components, width)
        df = project(pca, df, features)
    if classes is None:
        # the classes are columns of the model that this returns: K x width values
        classes = sorted(r[0] for r in df.select(label_col).where(F.col(label_col).isNotNull()).distinct().collect())
    K = len(classes)
    cls_lit = F.array(*[F.lit(int(c)) for c in classes])
    use_cv = n_folds > 0 and len(Cs) > 1 and fold_col is not None
    fold_expr = F.col(fold_col).cast("int") if use_cv else F.lit(-2)
    data = df.select(F.col(features).cast("array<double>").alias("x"),
                     (F.array_position(cls_lit, F.col(label_col)) - 1).cast("int").alias("ci"),
                     fold_expr.alias("fold"))
    data = data.where(F.col("ci") >= 0)  # rows of classes outside ``classes`` are not trained on
    data = cut_lineage(data).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first = data.select(F.size("x")).first()
        d = int(first[0])
        folds = list(range(n_folds)) if use_cv else []
        counts = {(r["fold"], r["ci"]): r["count"]
                  for r in data.groupBy("fold", "ci").count().collect()}
        # balanced weights of each training set (fold f = -1: all rows)
        wts = {}
        for f in [-1] + folds:
            n_c = np.array([sum(v for (fo, c), v in counts.items() if c == k and fo != f)
                            for k in range(K)], dtype=float)
            present = (n_c > 0).sum()
            wts[f] = np.where(n_c > 0, n_c.sum() / (max(present, 1) * np.maximum(n_c, 1)), 0.0)
        m_class, m_C, m_fold, wmat, groups, group_fold, group_C = [], [], [], [], [], [], []
        for C in Cs:
            for f in [-1] + folds:
                idx = []
                for k in range(K):
                    idx.append(len(m_class))
                    m_class.append(k)
                    m_C.append(float(C))
                    m_fold.append(f)
                    if weighting == "positive":
                        row = np.ones(K)
                        row[k] = wts[f][k]
                    else:
                        row = wts[f].copy()
                    wmat.append(row)
                if f >= 0:
                    groups.append(np.array(idx))
                    group_fold.append(f)
                    group_C.append(float(C))
        D = d + 1
        prob = _Problem(data, d, np.array(m_class), np.array(m_C), np.array(m_fold),
                        np.array(wmat))
        # as many models at a time as their sums fit the limit, one at least
        dense_steps = d <= DENSE_WIDTH
        step = max(1, int(broadcast_limit(spark) // (D * 8 * (D if dense_steps else 2))))
        solved = [_newton(prob, D, np.arange(lo, min(lo + step, prob.J)), max_iter, tol, dense_steps)
                  for lo in range(0, prob.J, step)]
        W, used, rel = (np.concatenate([x[i] for x in solved], axis=-1) for i in range(3))
        if use_cv:
            acc = prob.fold_accuracy(W, groups, np.array(group_fold))
            mean = [float(np.mean([a for a, c in zip(acc, group_C) if c == C])) for C in Cs]
            best = int(np.argmax(mean))
        else:
            mean, best = [float("nan")] * len(Cs), 0
    finally:
        data.unpersist()
    Cb = float(Cs[best])
    pick = [j for j in range(len(m_class)) if m_C[j] == Cb and m_fold[j] == -1]
    model = LinearOvRModel(list(classes), W[:d, pick].T.copy(), W[d, pick].copy(), Cb, pca)
    of_C = np.array(m_C)
    rows = []
    for i, (c, m) in enumerate(zip(Cs, mean)):
        at = of_C == float(c)
        rows.append((float(c), m, i == best, int(at.sum()), int((rel[at] > tol).sum()),
                     int(used[at].max()), float(rel[at].max())))
    report = spark.createDataFrame(rows, "C double, cv_accuracy double, best boolean, n_models int, "
                                         "n_unconverged int, max_iterations int, max_rel_gradient double")
    return model, report
