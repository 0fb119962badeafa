"""Registered queries: each ``(spark, sf_dir) -> DataFrame`` runs a library
operator over the driver's whole tables (stand-ins in ``fixtures``).

Output columns are rounded where floating-point summation order could differ
between engines, and named exactly as in ``oracle.ORACLE_SQL``.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..operators import catalog as C
from ..operators import codebook as CB
from ..operators import keypoints as KP
from ..operators import learn as LN
from ..operators import linear as LIN
from ..operators import metrics as M
from ..operators import pages as PG
from ..operators import split as SP
from ..operators import vectors as V
from ..session import cut_lineage, remove_path, scratch_path, sibling_session
from ..sources import bucketed as BK
from ..sources import catalogue as SC
from ..sources import files as FS
from ..sources import keyed_files as KF
from . import fixtures as X

QUERY_KEY = 0  # the query sample for the k-NN family (index 0 is valid, K1)


def _r(c, n=6):
    return F.round(F.col(c), n)


# --- sample-vector statistics -------------------------------------------------

def q_class_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = V.class_stats(X.samples(spark, sf), X.class_dim(spark))
    return out.select("class_id", "class_name", "n_samples",
                      _r("dist_mean", 8).alias("dist_mean"),
                      _r("dist_var", 8).alias("dist_var"))


def q_class_centroids(spark: SparkSession, sf: str) -> DataFrame:
    cents = V.class_centroids(X.samples(spark, sf), include_global=True)
    return V.centroids_long(cents).select(
        "class_id", F.col("n").cast("bigint").alias("n"), "dim", _r("mean").alias("mean"))


def q_inter_class_distance(spark: SparkSession, sf: str) -> DataFrame:
    cents = V.class_centroids(X.samples(spark, sf), include_global=True)
    d = V.inter_class_distance(cents)
    return d.select("class_i", "class_j", _r("dist").alias("dist"))


def q_closest_to_mean(spark: SparkSession, sf: str) -> DataFrame:
    d = V.ranked_by_centroid(X.samples(spark, sf), k=5)
    return d.select("class_id", "rank", "key", _r("dist").alias("dist"))


def q_class_outliers(spark: SparkSession, sf: str) -> DataFrame:
    d = V.ranked_by_centroid(X.samples(spark, sf), k=5, farthest=True)
    return d.select("class_id", "rank", "key", _r("dist").alias("dist"))


def q_knn_top10(spark: SparkSession, sf: str) -> DataFrame:
    d = V.knn(X.samples(spark, sf), QUERY_KEY, k=10)
    return d.select("rank", "key", "class_id", _r("dist").alias("dist"))


def q_query_rank(spark: SparkSession, sf: str) -> DataFrame:
    return V.query_rank(X.samples(spark, sf), QUERY_KEY).select(
        F.col("query_key").cast("bigint").alias("query_key"), "query_rank", "n_samples")


def q_closest_by_class(spark: SparkSession, sf: str) -> DataFrame:
    d = V.closest_by_class(X.samples(spark, sf), QUERY_KEY)
    return d.select("class_id", "key", _r("dist").alias("dist"))


QUERIES = {
    "class_stats": q_class_stats,
    "class_centroids": q_class_centroids,
    "inter_class_distance": q_inter_class_distance,
    "closest_to_mean": q_closest_to_mean,
    "class_outliers": q_class_outliers,
    "knn_top10": q_knn_top10,
    "query_rank": q_query_rank,
    "closest_by_class": q_closest_by_class,
}


# --- catalogue filtering and labelling ---------------------------------------

SHARD_PREFIX = "a"


def q_artist_filter(spark: SparkSession, sf: str) -> DataFrame:
    docs = X.documents(spark, sf)
    return C.filter_by_class(docs, X.class_dim(spark)).select(
        "doc_id", F.col("artist").alias("source"))


def q_label_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return C.read_labels(X.label_lines(spark, sf), X.class_dim(spark), "line_no")


def q_label_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return C.label_rejects(X.label_lines(spark, sf), X.class_dim(spark)).select(
        "line_no", "value", "reason")


def q_label_join(spark: SparkSession, sf: str) -> DataFrame:
    labels = C.read_labels(X.label_lines(spark, sf), X.class_dim(spark), "line_no")
    return C.join_labels(X.labelled_features(spark, sf), labels.drop("n_lines")).select(
        "doc_id", "key", "class_id", "quality", "toxic")


def q_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.label_summary(X.label_lines(spark, sf), X.class_dim(spark),
                           X.labelled_features(spark, sf))


def q_has_image_filter(spark: SparkSession, sf: str) -> DataFrame:
    ev = X.table(spark, sf, "events").select("event_id", F.col("props").alias("value"))
    parsed = SC.parse_json_column(ev, T.StructType([T.StructField("k", T.IntegerType())]))
    path = F.concat(F.lit("full/"), F.md5(F.col("event_id").cast("string")), F.lit(".jpg"))
    image = F.struct(F.lit(None).cast("string").alias("url"), path.alias("path"),
                     F.lit(None).cast("string").alias("checksum"))
    recs = parsed.withColumn(
        "images", F.when(F.col("k") >= 10, F.array(image)).otherwise(F.array().cast(
            T.ArrayType(SC.IMAGE))))
    return (recs.where(C.has_first_image("images"))
            .select("event_id", C.image_checksum("images").alias("key")))


def q_checksum_key(spark: SparkSession, sf: str) -> DataFrame:
    docs = X.table(spark, sf, "documents").select("doc_id")
    path = F.concat(F.lit("full/"), F.md5(F.col("doc_id").cast("string")), F.lit(".jpg"))
    return docs.select("doc_id", path.alias("path")).select(
        "doc_id", "path", TX.checksum_from_path("path").alias("key"),
        TX.file_ext(TX.basename("path")).alias("ext"))


def q_prefix_shard(spark: SparkSession, sf: str) -> DataFrame:
    return C.shard_filter(X.documents(spark, sf), SHARD_PREFIX).select("doc_id", "key")


def q_manifest_filter(spark: SparkSession, sf: str) -> DataFrame:
    images = X.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("name"))
    manifest = X.table(spark, sf, "labels").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("value"))
    return C.manifest_filter(images, manifest, "name").select(
        "doc_id", "name", TX.file_key("name").alias("key"))


def q_incremental_pending(spark: SparkSession, sf: str) -> DataFrame:
    items = X.table(spark, sf, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("key"))
    kind = F.when(F.col("item_id") % 3 == 0, F.lit(".gist.npz")).otherwise(F.lit(".sift.npz"))
    done = X.table(spark, sf, "benchmark").select(
        F.concat(F.col("item_id").cast("string"), kind).alias("name"))
    return C.pending(items, done, "key", "name", descriptor="sift").select("doc_id", "key")


def q_vector_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of another width or without a vector."""
    k = F.col("key") % 7
    s = X.samples(spark, sf).withColumn(
        "features", F.when(k == 1, F.slice("features", 1, 32)).when(k != 2, F.col("features")))
    return V.incomparable(s, 64).select("key", "class_id", "reason")


def q_text_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Artist cut at its marker (P6), first present title (P8), default date."""
    d = X.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    named = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" (Japan) "), "source")) \
        .when(F.col("doc_id") % 5 != 1, F.concat("source", F.lit(" (Japan, 1800) x (Japan)"))) \
        .otherwise(F.col("source"))
    maybe = F.when(F.col("doc_id") % 3 == 0, F.lit("")).when(F.col("doc_id") % 3 == 1, F.col("lang"))
    return d.select("doc_id", TX.cut_at_marker(named, " (Japan").alias("artist"),
                    TX.first_present(maybe, "source").alias("title"),
                    TX.default_to(F.when(F.col("doc_id") % 2 == 0, F.col("n_chars").cast("string"))).alias("date"))


def q_label_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Label lines of the catalogue (S3), written as text and read back."""
    path = scratch_path(spark, "label-lines")
    docs = X.documents(spark, sf)
    SC.write_label_file(docs, path)
    ok, _ = SC.read_label_file(spark, path)
    out = cut_lineage(ok.select("key", "artist"))
    remove_path(spark, path)
    return out


def q_value_list(spark: SparkSession, sf: str) -> DataFrame:
    """A text list with blanks around its values."""
    path = scratch_path(spark, "value-list")
    value = F.when(F.col("doc_id") % 4 == 0, F.lit(" \u3000\t")) \
        .otherwise(F.concat(F.lit("\u3000 "), "source", F.lit("\t ")))
    SC.write_lines(X.table(spark, sf, "documents").select(value.alias("value")), path)
    out = cut_lineage(SC.read_value_list(spark, path).groupBy("value").agg(F.count(F.lit(1)).alias("n")))
    remove_path(spark, path)
    return out


def q_keyed_shard(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed output in two runs, the second adding what is pending."""
    path = scratch_path(spark, "keyed")
    docs = X.documents(spark, sf).dropDuplicates(["key"]).select("key")
    FS.write_keyed(docs.where(F.col("key") < "8"), path, shard_chars=1)
    FS.write_keyed(C.pending(docs, spark.read.parquet(path), "key", "key"), path, shard_chars=1)
    out = cut_lineage(spark.read.parquet(path).select("key", "shard"))
    remove_path(spark, path)
    return out


def _vector_files(spark: SparkSession, sf: str):
    """The sample vectors as files (some as text, some narrower, some broken),
    and what is read back for the labelled keys (S6, S13, P12): (ok, rejected)."""
    path = scratch_path(spark, "vector-files")
    files = X.vector_files(spark, sf)
    KF.write_files(files, path)
    keys = X.samples(spark, sf).where("key % 6 <> 5").select(F.md5(F.col("key").cast("string")).alias("key"))
    ok, bad = FS.read_vectors(spark, path, keys=keys, width=64)
    KF.remove_files(path)
    return ok, bad


def q_vector_files(spark: SparkSession, sf: str) -> DataFrame:
    ok, _ = _vector_files(spark, sf)
    return ok.select("key", F.posexplode("features").alias("dim", "value")).select("key", "dim", _r("value").alias("value"))


def q_vector_file_rejects(spark: SparkSession, sf: str) -> DataFrame:
    _, bad = _vector_files(spark, sf)
    return bad.select("key", F.split("reason", ":")[0].alias("reason"))


def q_keypoint_files(spark: SparkSession, sf: str) -> DataFrame:
    """Keypoint blocks written and read again, shard after shard."""
    path = scratch_path(spark, "keypoint-files")
    KF.write_files(X.keypoint_files(spark, sf), path)
    shards = [FS.read_keypoints(spark, path, n_dims=64, prefix=p)[0] for p in "0123456789abcdef"]
    out = cut_lineage(reduce(DataFrame.unionByName, shards).select(
        "key", "kp_id", F.col("x").cast("bigint").alias("vec_id"), _r("response").alias("response"),
        F.posexplode("desc").alias("dim", "value")))
    KF.remove_files(path)
    return out.withColumn("value", _r("value"))


def q_catalogue_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue lines that are no JSON or name no artist."""
    d = X.table(spark, sf, "documents").select("doc_id", "source")
    line = F.when(F.col("doc_id") % 9 == 4, F.concat(F.lit('{"artist": "'), "source")) \
        .when(F.col("doc_id") % 9 == 7, F.lit('{"url": "u"}')) \
        .otherwise(F.concat(F.lit('{"artist": "'), "source", F.lit('"}')))
    parsed = SC.parse_json_column(d.select(line.alias("value"), F.col("doc_id").alias("line_order")),
                                  SC.CATALOGUE_FIELDS)
    return SC.catalogue_rejects(parsed).select(F.col("line_order").alias("doc_id"), "reason")


def q_ingest_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the label step, taken while the joined samples are written."""
    path, own = scratch_path(spark, "ingest"), sibling_session(spark)
    labels, seen = C.observed_labels(X.label_lines(own, sf), X.class_dim(own))
    labels.drop("n_lines").write.parquet(f"{path}/labels")
    kept, samples = C.observed_join(X.labelled_features(own, sf), own.read.parquet(f"{path}/labels"))
    kept.write.parquet(f"{path}/samples")
    remove_path(spark, path)
    return C.counts_of(spark, *seen, samples)


def q_bucketed_label_join(spark: SparkSession, sf: str) -> DataFrame:
    """The label join over samples laid out in buckets."""
    labels = C.read_labels(X.label_lines(spark, sf), X.class_dim(spark), "line_no")
    table = BK.write_bucketed(X.labelled_features(spark, sf))
    out = cut_lineage(C.join_labels(spark.table(table), labels.drop("n_lines")).select(
        "doc_id", "key", "class_id", "quality", "toxic"))
    BK.drop_bucketed(spark, table)
    return out


def q_bucketed_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Pending items against a done table laid out in buckets."""
    items = X.table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"))
    done = X.table(spark, sf, "benchmark").where("item_id % 3 <> 0").select(F.col("item_id").cast("string").alias("key"))
    left, right = BK.write_bucketed(items), BK.write_bucketed(done)
    out = cut_lineage(C.pending_keys(spark.table(left), spark.table(right)).select("doc_id", "key"))
    BK.drop_bucketed(spark, left)
    BK.drop_bucketed(spark, right)
    return out


@KP.register_descriptor("letters", "key long, kp_id int, response double, desc array<double>")
def _letters(batches):
    """A stand-in descriptor: one keypoint per non-empty image, described by
    how often each of four letters stands in it."""
    for pdf in batches:
        rows = pdf[pdf["content"].str.len() > 0]
        desc = [[float(c.count(x)) for x in "aeio"] for c in rows["content"]]
        yield rows[["key"]].assign(kp_id=0, response=rows["content"].str.len().astype(float), desc=desc)


def q_descriptor_job(spark: SparkSession, sf: str) -> DataFrame:
    """A registered descriptor over whole documents."""
    docs = X.table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("content"))
    return _letter_counts(KP.describe(docs, "letters"))


def q_descriptor_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The same descriptor as a SQL table function."""
    docs = X.table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("content"))
    return _letter_counts(KP.describe_sql(docs, "letters"))


def _letter_counts(described: DataFrame) -> DataFrame:
    return described.select("key", F.col("response").cast("long").alias("size"),
                            *[F.get("desc", i).cast("long").alias(f"n_{c}") for i, c in enumerate("aeio")])


QUERIES.update({
    "artist_filter": q_artist_filter,
    "label_dedup": q_label_dedup,
    "label_rejects": q_label_rejects,
    "label_join": q_label_join,
    "label_counts": q_label_counts,
    "has_image_filter": q_has_image_filter,
    "checksum_key": q_checksum_key,
    "prefix_shard": q_prefix_shard,
    "manifest_filter": q_manifest_filter,
    "incremental_pending": q_incremental_pending,
    "vector_rejects": q_vector_rejects,
    "text_fields": q_text_fields,
    "label_lines": q_label_lines,
    "value_list": q_value_list,
    "keyed_shard": q_keyed_shard,
    "vector_files": q_vector_files,
    "vector_file_rejects": q_vector_file_rejects,
    "keypoint_files": q_keypoint_files,
    "catalogue_rejects": q_catalogue_rejects,
    "descriptor_job": q_descriptor_job,
    "descriptor_sql": q_descriptor_sql,
    "ingest_counts": q_ingest_counts,
    "bucketed_label_join": q_bucketed_label_join,
    "bucketed_pending": q_bucketed_pending,
})


# --- split, folds, weights, evaluation ---------------------------------------

def q_train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    s = X.samples(spark, sf).drop("features")
    return SP.train_test_split(s, X.TRAIN_FRACTION).select("key", "class_id", "split")


def q_strat_folds(spark: SparkSession, sf: str) -> DataFrame:
    s = X.samples(spark, sf).drop("features")
    return SP.stratified_folds(s, 3).select("key", "class_id", "fold")


def q_class_weights(spark: SparkSession, sf: str) -> DataFrame:
    w = SP.class_weights(X.samples(spark, sf).drop("features"))
    return w.select("class_id", F.col("n_c").cast("bigint").alias("n_c"),
                    _r("weight", 8).alias("weight"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-centroid predictions for the test split: centroids fitted on
    the train split only."""
    s = SP.train_test_split(X.samples(spark, sf), X.TRAIN_FRACTION)
    train = s.where(F.col("split") == "train")
    cents = V.class_centroids(train, include_global=False)
    test = s.where(F.col("split") == "test")
    return M.predict_nearest_centroid(test, cents).select(
        "key", F.col("class_id").alias("label"), "prediction")


def q_confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return M.confusion(predictions(spark, sf)).select(
        "label", "prediction", F.col("n").cast("bigint").alias("n"))


def q_confusion_normalised(spark: SparkSession, sf: str) -> DataFrame:
    c = M.confusion_normalised(M.confusion(predictions(spark, sf)))
    return c.select("label", "prediction", F.col("n").cast("bigint").alias("n"),
                    _r("frac", 8).alias("frac"))


def q_accuracy_summary(spark: SparkSession, sf: str) -> DataFrame:
    a = M.accuracy_summary(M.confusion(predictions(spark, sf)))
    return a.select("n_test", "n_correct", _r("accuracy", 8).alias("accuracy"),
                    _r("balanced_accuracy", 8).alias("balanced_accuracy"))


QUERIES.update({
    "train_test_split": q_train_test_split,
    "strat_folds": q_strat_folds,
    "class_weights": q_class_weights,
    "confusion_matrix": q_confusion_matrix,
    "confusion_normalised": q_confusion_normalised,
    "accuracy_summary": q_accuracy_summary,
})


# --- keypoints and codebook ----------------------------------------------------

def q_keypoint_topk(spark: SparkSession, sf: str) -> DataFrame:
    kps = X.keypoints_from_lineitem(spark, sf)
    return KP.strongest(kps, X.TOPK, tie_cols=X.KP_IDS).select(
        "key", "kp_rank", *X.KP_IDS, "response")


def q_keypoint_sample(spark: SparkSession, sf: str) -> DataFrame:
    kps = X.keypoints_from_lineitem(spark, sf)
    return KP.sample(kps, X.TOPK, id_cols=X.KP_IDS, seed=0).select(
        "key", "sample_rank", *X.KP_IDS)


def _codebook_init(spark: SparkSession, sf: str):
    return CB.hash_init(X.samples(spark, sf), X.N_CODES, seed=0)


def q_codeword_assign(spark: SparkSession, sf: str) -> DataFrame:
    a = CB.assign(X.keypoints_from_embeddings(spark, sf), _codebook_init(spark, sf))
    return a.select("key", "kp_id", "code", _r("dist").alias("dist"))


def q_bow_histogram(spark: SparkSession, sf: str) -> DataFrame:
    a = CB.assign(X.keypoints_from_embeddings(spark, sf), _codebook_init(spark, sf))
    h = CB.histogram_long(CB.histogram(a, X.N_CODES))
    return h.select("key", "code", F.col("cnt").cast("bigint").alias("cnt"))


def q_lloyd_steps(spark: SparkSession, sf: str) -> DataFrame:
    pts = X.samples(spark, sf).select("key", "features")
    centers, _ = CB.lloyd(pts, _codebook_init(spark, sf), max_iter=2, tol=-1.0)
    final = CB.lloyd_step_frame(pts, centers)
    return final.select("code", "n", F.posexplode("center").alias("dim", "value")) \
        .select("code", "n", "dim", _r("value").alias("value"))


QUERIES.update({
    "keypoint_topk": q_keypoint_topk,
    "keypoint_sample": q_keypoint_sample,
    "codeword_assign": q_codeword_assign,
    "bow_histogram": q_bow_histogram,
    "lloyd_steps": q_lloyd_steps,
})


# --- stored pages --------------------------------------------------------------

def q_page_key(spark: SparkSession, sf: str) -> DataFrame:
    return PG.with_keys(X.long_urls(X.pages(spark, sf))).select("page_id", "page_key", "short_key")


def q_page_site(spark: SparkSession, sf: str) -> DataFrame:
    return X.pages(spark, sf).select("page_id", PG.site_of("url", X.HOSTS).alias("site"))


def q_page_links(spark: SparkSession, sf: str) -> DataFrame:
    return PG.links(X.pages(spark, sf), X.HOSTS)


def q_page_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """Links of all pages but those already visited: the stored pages, and
    what every fifth page links to."""
    p = X.pages(spark, sf)
    found = PG.outgoing(p, X.HOSTS, box=None)
    visited = p.select("url").unionByName(
        found.where(F.col("page_id") % 5 == 0).select(F.col("link").alias("url")))
    return PG.frontier(found, visited)


def q_listing_links(spark: SparkSession, sf: str) -> DataFrame:
    return PG.outgoing(X.listing_pages(spark, sf), X.HOSTS)


def q_crawl_closure(spark: SparkSession, sf: str) -> DataFrame:
    """All that following result and pager links from page 1 reaches (H1, H2)."""
    seeds = spark.createDataFrame([(f"{X.SITE}/p/1",)], "url string")
    return PG.crawl_closure(X.crawl_pages(spark, sf), seeds, X.HOSTS)


def q_site_a_records(spark: SparkSession, sf: str) -> DataFrame:
    r = PG.records_a(X.object_pages_a(spark, sf), "example.org")
    return r.select("page_key", "title_EN", "title_JP", "artist", "date", "dimensions", "series",
                    F.get("image_urls", 0).alias("image_url"), "reject_reason")


def q_site_b_records(spark: SparkSession, sf: str) -> DataFrame:
    r = PG.records_b(X.object_pages_b(spark, sf))
    return r.select("page_key", "title_EN", "title_JP", "artist", "publisher", "date", "medium", "format",
                    "acc_num", "mfa_dups", "signed", "markings", F.get("image_urls", 0).alias("image_url"),
                    "reject_reason")


def q_page_record(spark: SparkSession, sf: str) -> DataFrame:
    return PG.record_fields(X.pages(spark, sf)).select(
        "page_id", "page_key", "title", "h1", "comment", "image_url", "date")


QUERIES.update({
    "page_key": q_page_key,
    "page_site": q_page_site,
    "page_links": q_page_links,
    "page_frontier": q_page_frontier,
    "page_record": q_page_record,
    "listing_links": q_listing_links,
    "crawl_closure": q_crawl_closure,
    "site_a_records": q_site_a_records,
    "site_b_records": q_site_b_records,
})


# --- learned models ------------------------------------------------------------
#
# The oracles find the same optima by other means: eigenvectors by squaring the
# covariance, SVM weights by accelerated gradient steps (at a C where those end
# quickly), k-means unrolled. At C = 1 and for the whole grid, SQL states what
# makes a fit right: a vanishing gradient, every model converged.

SVM_C = 0.01    # of the queries whose weights the oracle solves for
SVM_ITER = 100  # damped-Newton passes (all models share each pass)


def _train_test(spark: SparkSession, sf: str):
    s = SP.train_test_split(X.samples(spark, sf), X.TRAIN_FRACTION)
    return (s.where(F.col("split") == "train").drop("split"),
            s.where(F.col("split") == "test").drop("split"))


def q_pca_project(spark: SparkSession, sf: str) -> DataFrame:
    """Projection on the three leading components (squares: their signs are free)."""
    s = X.samples(spark, sf)
    p = LN.pca_project(s, 3, V.vector_width(s, "features"))
    return p.select("key", "class_id", *[F.round(F.get("pca", i) ** 2, 6).alias(f"sq_{i}") for i in range(3)])


def q_kmeans_codebook(spark: SparkSession, sf: str) -> DataFrame:
    book, cost, _ = CB.kmeans_codebook(X.samples(spark, sf), X.N_CODES, max_iter=10,
                                       tol=1e-4, attempts=10, seed=0)
    return (book.select("code", F.posexplode("center").alias("dim", "value"))
            .select("code", "dim", _r("value").alias("value"), F.round(F.lit(cost), 6).alias("cost")))


def _svm(spark: SparkSession, sf: str, Cs=(1.0,), tol: float = 1e-4):
    train, test = _train_test(spark, sf)
    if len(Cs) > 1:  # folds only matter when there is a C to choose
        train = SP.stratified_folds(train, 3)
    model, report = LIN.fit(train, list(Cs), 3 if len(Cs) > 1 else 0, max_iter=SVM_ITER, tol=tol)
    return model, report, train, test


def q_svm_ovr(spark: SparkSession, sf: str) -> DataFrame:
    """Per class: the gradient of its objective vanishes at the fitted weights
    (relative to the gradient at zero), computed apart from the solver."""
    model, _, train, _ = _svm(spark, sf)
    models = json.dumps([{"class_id": int(c), "w": [*map(float, w), float(b)]}
                         for c, w, b in zip(model.classes, model.coef, model.intercept, strict=True)])
    balance = F.broadcast(SP.class_weights(train).select("class_id", F.col("weight").alias("s")))   # a row per class
    # every row meets every model, all of them metadata of K x width values
    rows = train.select(F.col("class_id").alias("label"), F.concat("features", F.array(F.lit(1.0))).alias("x"),
                        F.explode(F.from_json(F.lit(models), "array<struct<class_id:int,w:array<double>>>")).alias("m"))
    rows = rows.select("label", "x", "m.class_id", "m.w").join(balance, "class_id")
    y = F.when(F.col("label") == F.col("class_id"), 1.0).otherwise(-1.0)
    z = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    rows = rows.withColumn("k0", -2 * y * F.when(y > 0, F.col("s")).otherwise(1.0)).withColumn(
        "k", F.col("k0") * F.greatest(F.lit(0.0), 1 - y * z))
    total = lambda k: vector_to_array(
        Summarizer.sum(array_to_vector(F.transform("x", lambda e: e * F.col(k)))), "float64")
    g = rows.groupBy("class_id").agg(total("k").alias("g"), total("k0").alias("g0"), F.first("w").alias("w"))
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, e: t + e * e))
    rel = length(F.zip_with("g", "w", lambda a, b: a + b)) / length(F.col("g0"))
    return g.select("class_id", (rel < 1e-3).alias("optimal"))


def q_svm_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Per C: its models (every class, all rows and three folds) all converged;
    accuracies are shares and the chosen C has the highest."""
    _, report, _, _ = _svm(spark, sf, LN.c_grid())
    top = report.agg(F.max("cv_accuracy").alias("top")).first()["top"]
    return report.select(
        F.round(F.log10("C")).cast("int").alias("log_c"), "n_models", "n_unconverged",
        (F.col("cv_accuracy").between(0.0, 1.0) & (~F.col("best") | (F.col("cv_accuracy") == top)))
        .alias("consistent"))


def q_svm_top_weights(spark: SparkSession, sf: str) -> DataFrame:
    """The five largest weights of every class with the names of their
    features, read from a tab-separated name file (S11, J7, T8)."""
    model, _, _, _ = _svm(spark, sf, (SVM_C,), 1e-10)
    path = scratch_path(spark, "feature-names")
    names = (X.samples(spark, sf).select(F.explode(F.sequence(F.lit(0), F.size("features") - 1)).alias("dim"))
             .distinct().orderBy("dim")
             .select(F.concat(F.lit("feature "), F.col("dim").cast("string"), F.lit("\tunused")).alias("value")))
    SC.write_lines(names.coalesce(1), path)
    top = cut_lineage(LN.top_weights(model.weights(spark), SC.read_feature_names(spark, path), k=5))
    remove_path(spark, path)
    return top.select("class_id", "rank", "dim", "name", _r("weight").alias("weight"))


def q_model_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of a model that was saved and loaded (M6, S10), and their
    margins from the saved weight table."""
    model, _, _, test = _svm(spark, sf, (SVM_C,), 1e-10)
    path = scratch_path(spark, "svm-model")
    model.save(spark, path)
    loaded = LIN.LinearOvRModel.load(spark, path)
    weights = cut_lineage(spark.read.parquet(f"{path}/weights"))
    remove_path(spark, path)
    got = loaded.transform(test).select("key", F.col("class_id").alias("label"), "features", "prediction")
    side = F.broadcast(weights.select(F.col("class_id").alias("prediction"), "coef", "intercept"))    # a row per class
    margin = F.aggregate(F.zip_with("features", "coef", lambda a, b: a * b), F.col("intercept"), lambda t, v: t + v)
    return got.join(side, "prediction").select("key", "label", "prediction", F.round(margin, 6).alias("margin"))


QUERIES.update({
    "pca_project": q_pca_project,
    "kmeans_codebook": q_kmeans_codebook,
    "svm_ovr": q_svm_ovr,
    "svm_grid": q_svm_grid,
    "svm_top_weights": q_svm_top_weights,
    "model_roundtrip": q_model_roundtrip,
})
