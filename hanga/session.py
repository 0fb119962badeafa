"""Session helpers: building a session, the shared checkpoint folder, and
size-checked broadcasts.

Cluster settings (executor memory, ``spark.checkpoint.dir``, shuffle
partitions) belong to whoever submits the job; the helpers here only fill in
what is missing, so the same code runs under ``local[8]`` tests and on a
cluster.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Default cap for a side we broadcast after proving its size (bytes).
DEFAULT_BROADCAST_LIMIT = 64 * 1024 * 1024
# Widest sample vector the pipeline accepts (vectors are validated on read).
MAX_WIDTH = 3000


def build_session(master: str | None = None, app: str = "hanga",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings this library relies on.

    AQE stays on so that shuffle partitions coalesce and skewed joins split at
    run time; the UI stays off (no server). Python workers started by this
    process find the package from any working directory; on a cluster it is
    installed or shipped with the job (README, "Cluster settings")."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # 3000-wide double vectors are ~24 KB a row: keep Arrow batches near 50 MB
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
        "spark.sql.session.timeZone": "UTC",
        # checkpoint files go when the frame that reads them is gone
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def sibling_session(spark: SparkSession) -> SparkSession:
    """A session of its own in the same application, with the same settings.

    For jobs that use ``DataFrame.observe``: from the first observation on,
    Spark 4.1 cannot ship functions that hold on to the session (MLlib's
    one-vs-rest model does), because its observation manager is not
    serialisable. Observed in a sibling, the caller's session stays usable."""
    other = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            other.conf.set(key, value)
    return other


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is; a cluster without it is an error, because a folder of one machine is
    not seen by the others. Only a ``local[...]`` master (one process) gets a
    fresh folder under the system temp dir."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    sc.setCheckpointDir(shared_root(spark))
    return sc.getCheckpointDir()


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, the same in every
    application that is configured alike (``getCheckpointDir`` ends in a random
    folder per application). Unset: an error on a cluster, a temp folder kept
    for the session on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = spark.conf.get("hanga.local.root", None)
    if not root:
        root = tempfile.mkdtemp(prefix="hanga-ckpt-")
        spark.conf.set("hanga.local.root", root)
    return root


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its file system; storage errors are raised."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove_path(spark: SparkSession, path: str) -> bool:
    """Delete a scratch folder of our own."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder (survives executor
    loss; never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_limit(spark: SparkSession) -> int:
    raw = spark.conf.get("hanga.broadcast.maxBytes", None)
    return int(raw) if raw else DEFAULT_BROADCAST_LIMIT


def bounded_broadcast(df: DataFrame, max_rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast only when ``max_rows * row_bytes`` (a proven upper
    bound, e.g. number of classes x vector width x 8) fits the limit.

    Beyond the limit the side is returned unchanged, so the planner falls back
    to a shuffle join (which AQE can still convert at run time)."""
    if max_rows * row_bytes <= broadcast_limit(df.sparkSession):
        return F.broadcast(df)
    return df


def measured(df: DataFrame, row_bytes: int = 64, sized: str | None = None) -> tuple[DataFrame, int, int]:
    """Materialise a small derived table once (reliable checkpoint) and measure
    it: (the table, its rows, its bytes). ``sized`` names an array column of
    doubles whose elements count eight bytes each on top of ``row_bytes``."""
    done = cut_lineage(df)
    items = F.coalesce(F.sum(F.size(sized)), F.lit(0)) if sized else F.lit(0)
    n, elements = done.agg(F.count(F.lit(1)), items).first()
    return done, n, n * row_bytes + 8 * elements


def measured_broadcast(df: DataFrame, row_bytes: int = 64, sized: str | None = None) -> DataFrame:
    """Broadcast hint on a derived table whose measured size fits the limit;
    a larger one is returned as is and joined by a shuffle."""
    done, _, size = measured(df, row_bytes, sized)
    return F.broadcast(done) if size <= broadcast_limit(df.sparkSession) else done


def vector_width(df: DataFrame, col: str) -> int:
    """Width of the first vector (the reference fixes the width from its first
    accepted sample). One ``LIMIT 1`` job."""
    row = df.select(F.size(col).alias("w")).where(F.col(col).isNotNull()).first()
    if row is None:
        raise ValueError("no vectors")
    return int(row["w"])


def col_or_name(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for intermediate outputs inside the shared checkpoint
    folder (never a machine-local folder on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/hanga-scratch/{name}-{uuid.uuid4().hex}"
