"""Statistics over labelled sample vectors.

Input convention: a *samples* DataFrame with ``key``, ``class_id`` (int) and
``features`` (``array<double>``, one fixed width), and a *class dimension*
``class_dim(class_name, class_id)``.

Scale notes
-----------
* Means use ``Summarizer`` (an MLlib aggregate with map-side partial merge):
  one buffer of width d per class per task, so a class holding a third of all
  rows costs no more than any other class and nothing is exploded per element.
* The centroid table has one row per class that occurs; it is materialised
  once and broadcast only when its measured size fits the limit.
* A NULL vector, or one of another width, has no distance: such samples take
  no part in any ranking and ``incomparable`` lists them with a reason.
* Top-k per class uses ``row_number`` with a rank filter, which Spark plans
  as a partial WindowGroupLimit before the shuffle, so at most k rows per
  class leave each task.
* k-NN needs one query vector; it is fetched once (bounded by d) and inlined
  as a literal, so the scan stays a map-only stage followed by Spark's
  built-in top-k (TakeOrderedAndProject). No cross join anywhere.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import l2_distance, vector_literal
from ..session import (MAX_WIDTH, measured_broadcast, vector_width)  # noqa: F401

GLOBAL_CLASS = -1  # class id of the all-samples centroid (A4)


def _mean_vectors(df: DataFrame, group_cols: list[str]) -> DataFrame:
    vec = array_to_vector(F.col("features"))
    summary = Summarizer.metrics("mean", "count").summary(vec).alias("s")
    agg = df.groupBy(*group_cols).agg(summary) if group_cols else df.agg(summary)
    return agg.select(*group_cols,
                      F.col("s.count").alias("n"),
                      vector_to_array(F.col("s.mean"), "float64").alias("centroid"))


def class_centroids(samples: DataFrame, include_global: bool = True) -> DataFrame:
    """Per-class mean vector (A3), plus the global mean as class -1 (A4).

    Returns ``(class_id int, n bigint, centroid array<double>)``."""
    per_class = _mean_vectors(samples, ["class_id"])
    if not include_global:
        return per_class
    # The global mean is the count-weighted mean of the class means: computed
    # from the small per-class table (classes x width rows), not a second scan.
    long = per_class.select("n", F.posexplode("centroid").alias("dim", "v"))
    per_dim = long.groupBy("dim").agg(
        (F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("m"), F.sum("n").alias("n"))
    overall = per_dim.agg(
        F.max("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))),
                    lambda e: e.getField("m")).alias("centroid"))
    return per_class.unionByName(overall.select(
        F.lit(GLOBAL_CLASS).cast("int").alias("class_id"), "n", "centroid"))


def comparable(samples: DataFrame, width: int) -> DataFrame:
    """Samples whose vector has the given width."""
    return samples.where(F.size("features") == width)  # NULL: not equal


def incomparable(samples: DataFrame, width: int) -> DataFrame:
    """Reject table: ``(key, class_id, reason)`` of samples that have no
    vector or one of another width."""
    reason = F.when(F.col("features").isNull(), F.lit("no_vector")) \
        .when(F.size("features") != width, F.lit("width_mismatch"))
    return samples.select("key", "class_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def with_centroid_distance(samples: DataFrame, width: int | None = None) -> DataFrame:
    """Each sample joined to its own class centroid (J5) with ``dist``. With
    ``width`` samples of another width are left out first (``incomparable``);
    without it all vectors must share one width."""
    if width is not None:
        samples = comparable(samples, width)
    cents = class_centroids(samples, include_global=False).select("class_id", "centroid")
    side = measured_broadcast(cents, 64, "centroid")
    return (samples.join(side, "class_id")
            .withColumn("dist", l2_distance("features", "centroid"))
            .drop("centroid"))


def class_stats(samples: DataFrame, class_dim: DataFrame, width: int | None = None) -> DataFrame:
    """Per class: sample count (A2), mean and population variance of the
    distance to the class centroid (A5). Classes without samples are listed
    with n = 0 and NULL statistics (trap 12)."""
    dist = with_centroid_distance(samples, width)
    stats = dist.groupBy("class_id").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg("dist").alias("dist_mean"),
        F.var_pop("dist").alias("dist_var"))
    return (class_dim.join(stats, "class_id", "left")
            .select("class_id", "class_name",
                    F.coalesce("n_samples", F.lit(0)).cast("bigint").alias("n_samples"),
                    "dist_mean", "dist_var"))


def centroids_long(centroids: DataFrame) -> DataFrame:
    """``(class_id, dim, mean)`` — one row per centroid element."""
    return centroids.select("class_id", "n",
                            F.posexplode("centroid").alias("dim", "mean"))


def inter_class_distance(centroids: DataFrame) -> DataFrame:
    """L2 distance between every pair of centroids including the global one
    (J6). The pair count is bounded by the classes, not by the data; it is
    computed as an equi-join on the element index."""
    long = centroids.select("class_id", F.posexplode("centroid").alias("dim", "v"))
    long = measured_broadcast(long, 24)
    left = long.select(F.col("class_id").alias("class_i"), "dim", F.col("v").alias("vi"))
    right = long.select(F.col("class_id").alias("class_j"), "dim", F.col("v").alias("vj"))
    return (left.join(right, "dim")
            .groupBy("class_i", "class_j")
            .agg(F.sqrt(F.sum((F.col("vi") - F.col("vj")) ** 2)).alias("dist")))


def ranked_by_centroid(samples: DataFrame, k: int = 5, farthest: bool = False,
                       width: int | None = None) -> DataFrame:
    """The k samples nearest to (T6) or farthest from (T7) their class
    centroid, ranked 1..k per class. Ties on distance (rounded to 1e-6) go to
    the lower key; a class with fewer than k samples lists all of them."""
    dist = with_centroid_distance(samples, width).where(F.col("dist").isNotNull())
    d6 = F.round("dist", 6)
    order = [d6.desc(), F.col("key").desc()] if farthest else [d6.asc(), F.col("key").asc()]
    w = Window.partitionBy("class_id").orderBy(*order)
    return (dist.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k)
            .select("class_id", "rank", "key", "dist"))


def query_vector(samples: DataFrame, query_key):
    """Fetch the query sample's vector (bounded by the width). A missing key
    raises (quirk K1 fixed: index 0 is a valid query)."""
    row = samples.where(F.col("key") == F.lit(query_key)).select("features").first()
    if row is None:
        raise KeyError(f"Key not found: {query_key}")
    if row["features"] is None:
        raise ValueError(f"Key without a vector: {query_key}")
    return list(row["features"])


def with_query_distance(samples: DataFrame, query_key) -> DataFrame:
    """All comparable samples with ``dist`` to the query vector (J4); samples
    without a vector of the query's width are left out (``incomparable``)."""
    q = query_vector(samples, query_key)
    return comparable(samples, len(q)).withColumn("dist", l2_distance("features", vector_literal(q)))


def knn(samples: DataFrame, query_key, k: int = 10) -> DataFrame:
    """The k samples nearest to the query, the query itself included at rank
    0 (T3, T4). Order: distance rounded to 1e-6, then key."""
    d = with_query_distance(samples, query_key)
    top = (d.select("key", "class_id", "dist")
           .orderBy(F.round("dist", 6), "key").limit(k))
    w = Window.orderBy(F.round("dist", 6), "key")  # over the k rows only
    return top.withColumn("rank", (F.row_number().over(w) - 1).cast("int"))


def query_rank(samples: DataFrame, query_key) -> DataFrame:
    """Zero-based position of the query in its own distance ordering (T5):
    the number of samples ordered strictly before it. A filtered count, no
    global window."""
    d = with_query_distance(samples, query_key)
    before = ((F.round("dist", 6) < F.lit(0.0)) |
              ((F.round("dist", 6) == F.lit(0.0)) & (F.col("key") < F.lit(query_key))))
    return d.agg(F.lit(query_key).alias("query_key"),
                 F.count_if(before).cast("bigint").alias("query_rank"),
                 F.count(F.lit(1)).cast("bigint").alias("n_samples"))


def closest_by_class(samples: DataFrame, query_key) -> DataFrame:
    """For each class, its sample closest to the query (A13) — one arg-min
    aggregate per class instead of a sorted scan."""
    d = with_query_distance(samples, query_key)
    best = F.min_by(F.struct("key", "dist"), F.struct(F.round("dist", 6), F.col("key")))
    return (d.groupBy("class_id").agg(best.alias("b"))
            .select("class_id", F.col("b.key").alias("key"), F.col("b.dist").alias("dist")))
