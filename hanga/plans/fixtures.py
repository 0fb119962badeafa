"""How the driver's tables stand in for the reference's inputs.

* sample vectors  = ``embeddings(vec_id, embedding, label)``; key = vec_id,
  class id = label, features = embedding as ``array<double>``.
* class dimension = classes 0..14 named ``src0``..``src14`` (the catalogue's
  artist column is ``documents.source``).
* catalogue rows  = ``documents``; artist = ``source``; the image checksum is
  the md5 of the document text, so exact copies share a key.
* keypoints       = ``lineitem`` rows of an order (response =
  ``l_extendedprice``) for top-k / sampling; ``embeddings`` rows for codeword
  assignment, grouped into images by ``vec_id % 25``.
* stored pages    = ``pages``; JSON lines = ``events.props``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import as_double_array
from ..operators.catalog import label_lines as label_lines_of
from ..sources.files import encode_ascii, encode_npy, encode_npz

N_CLASSES = 15
N_IMAGES = 25  # embeddings grouped into this many "images" for A6
FILES_PER_TASK = 2000   # vector files that one task writes, about


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def class_dim(spark: SparkSession, n: int = N_CLASSES) -> DataFrame:
    """``class_dim(class_name, class_id)`` for the stand-in artists."""
    return (spark.range(n)
            .select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("class_name"),
                    F.col("id").cast("int").alias("class_id")))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled sample vectors ``(key, class_id, features)``."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("key"),
        F.col("label").cast("int").alias("class_id"),
        as_double_array("embedding").alias("features"))


def keypoints_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keypoint rows: image key = order, response = extended price."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), "l_partkey", "l_suppkey", "l_linenumber",
        F.col("l_extendedprice").alias("response"))


def keypoints_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptor rows for codeword assignment ``(key, kp_id, desc)``."""
    return table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % N_IMAGES).alias("key"),
        F.col("vec_id").alias("kp_id"),
        as_double_array("embedding").alias("desc"))


def vector_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(name, content)``: one file per sample, key = md5 of the vector's id;
    every fourth as text, some only half as wide, some no vector at all."""
    def encode(batches):
        for b in batches:
            names, blobs = [], []
            for i, key, v in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                v = np.array(v[:32] if i % 10 == 3 else v)
                text = i % 4 == 1
                names.append(f"{key}.{'ascii' if text else 'npy'}")
                blobs.append(b"no vector" if i % 10 == 7 else encode_ascii(v) if text else encode_npy(v))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(blobs, pa.binary())], names=["name", "content"])

    # a stored table of vectors is a few partitions, too few to write a file per row
    rows = samples(spark, sf_dir)
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // FILES_PER_TASK))
    return rows.repartition(parts).select("key", F.md5(F.col("key").cast("string")), "features").mapInArrow(
        encode, "name string, content binary")


PER_IMAGE = 20  # keypoints of an image in the keypoint files


def keypoint_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(name, content)``: one ``.npz`` per 20 consecutive vectors, six
    attributes (the first is the vector's id, the last its label) before the
    descriptor."""
    def encode(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")
        desc = np.array(t.column("features").to_pylist())
        a = np.zeros((len(desc), 6 + desc.shape[1]))
        a[:, 0], a[:, 5], a[:, 6:] = t.column("key").to_numpy(), t.column("class_id").to_numpy(), desc
        return pa.table({"name": [t.column("image")[0].as_py() + ".sift.npz"], "content": [encode_npz(a)]})

    image = F.md5(F.floor(F.col("key") / PER_IMAGE).cast("string"))
    return samples(spark, sf_dir).withColumn("image", image).groupBy("image").applyInArrow(
        encode, "name string, content binary")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue records: artist = source, key = checksum of the content."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("artist"), F.md5("text").alias("key"))


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines, one per catalogue record, in doc order: ``key::artist`` as
    ``catalog.label_lines`` writes them, with some broken ones (one separator
    short, one too many)."""
    lines = label_lines_of(documents(spark, sf_dir))
    kind = F.col("doc_id") % 11
    broken = F.when(kind == 3, F.concat("key", F.lit(":"), "artist")) \
        .when(kind == 5, F.concat("value", F.lit("::x"))).otherwise(F.col("value"))
    return lines.select(F.col("doc_id").alias("line_no"), broken.alias("value"))


def labelled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows keyed like the label map: the ``labels`` table's scores
    for each document, keyed by the document's content checksum."""
    docs = documents(spark, sf_dir).select("doc_id", "key")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "doc_id", "key", "quality", "toxic")

TRAIN_FRACTION = 0.75

N_CODES = 16  # codebook size for the embeddings stand-in
TOPK = 3      # keypoints kept / sampled per order (orders have at most 7 lines)
KP_IDS = ["l_partkey", "l_suppkey", "l_linenumber"]

HOSTS = ["example.com", "example.net", "example.org"]  # crawled site suffixes


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", "html")


def long_urls(pages: DataFrame) -> DataFrame:
    """The pages with every tenth url lengthened beyond the key limit."""
    longer = F.concat("url", F.lit("/"), F.repeat(F.lit("segment-"), 30), F.col("page_id").cast("string"))
    return pages.withColumn("url", F.when(F.col("page_id") % 10 == 1, longer).otherwise(F.col("url")))


SITE = "http://collections.example.org"


def _page(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages built from catalogue rows: navigation, a result box with
    a nested container and both quote styles, a pager on most pages."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    i = F.col("doc_id")
    pager = F.when(i % 4 != 0, _page('<ul><li class="pager-next last"><a href="/s?page=', i, '">next</a></li></ul>')) \
        .otherwise("")
    html = _page('<nav><a href="/nav/', i, '">nav</a></nav><div class="search-result-data"><div><a href="/o/', i,
                 '?a=1&amp;b=2">one</a></div><a class="x" href=\'/p/', i,
                 '\'>two</a><a href="mailto:x@example.org">mail</a></div>', pager,
                 '<footer><a href="http://other.example.com/">out</a></footer>')
    return d.select(i.alias("page_id"), _page(SITE, "/search/", i).alias("url"), html.alias("html"))


def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages that link to each other: page i to 2i and 2i + 1 in its
    result box (the later ones are not stored), its pager back to i / 3, so
    there are cycles of every length; every seventh page is not stored."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i")).where("i % 7 <> 6")
    i = F.col("i")
    html = _page('<a href="/p/', i + 7, '">nav</a><div class="search-result-data"><a href="/p/', 2 * i,
                 '">one</a><div><a href="', SITE, "/p/", 2 * i + 1,
                 '">two</a></div></div><li class="pager-next"><a href="/p/', F.floor(i / 3), '">next</a></li>')
    return d.select(i.alias("page_id"), _page(SITE, "/p/", i).alias("url"), html.alias("html"))


def object_pages_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site-A object pages whose fields are columns of ``documents``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    i, n = F.col("doc_id"), F.col("n_chars")
    hires = F.when(i % 3 == 0, _page('<a href="/dl/', i, '.tif">  Download  publication quality tiff </a>')).otherwise("")
    lowres = F.when(i % 5 != 1, _page('<div class="media-asset-image box"><img alt="x" src="http://img/', i,
                                      '.jpg"></div>')).otherwise("")
    artist = F.when(i % 7 != 2, _page('<div class="artist-name"><a href="/a">', F.col("source"),
                                      ' (Japan, ', n, ')</a></div>')).otherwise("")
    html = _page("<h1>site</h1>", lowres, '<div class="group-right"><div><h1>Work &amp; ', i, "</h1></div>", artist,
                 '<div class="field">Japan, ', n, "\t</div>",
                 '<div class="field">Series: old; Alternate Title:\u3000', F.col("lang"), "\u3000; Paper: ", n,
                 ' cm</div><div class="field">Series: ', F.col("source"), "</div></div>", hires)
    return d.select(i.alias("page_id"), _page(SITE, "/node/", i).alias("url"), html.alias("html"))


def object_pages_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site-B object pages whose fields are columns of ``documents``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    i, n = F.col("doc_id"), F.col("n_chars")
    date = F.when(i % 4 != 1, _page("<br>Edo ", n, "<br>more")).otherwise("")
    origin = F.when(i % 6 == 2, "China").when(i % 6 == 4, "").otherwise("Japan, Edo")
    kind = F.when(i % 5 == 3, "Drawings").otherwise("Prints")
    image = F.when(i % 9 == 5, "").otherwise(_page('<!-- <img src="http://img/', i, '.jpg"> -->'))
    marks = F.when(i % 2 == 0, _page("<div>x</div><p>mark ", i, "</p>")).otherwise("")
    html = _page('<!-- ad --><p><a href="/a">', F.col("source"), '</a> <a href="/p">', F.col("lang"), "</a>", date,
                 '</p><div class="grid-6">1</div><div class="x grid-6">2</div><div class="grid-6 main"><p>', origin,
                 "</p><h2> Work ", i, " </h2><h3>\u3000", F.col("lang"), "</h3><h4>Classifications</h4><p><a>", kind,
                 "</a></p><h4> Medium  or Technique </h4><p>ink ", n, "</p><h4>Dimensions</h4><div></div><p>", n,
                 " mm</p><h4>Accession Number</h4><p>", i, '</p></div><div class="grid-6 side"><div class="body"><p>'
                 "Other MFA impressions: ", n, "</p></div><h3>Signed</h3><div>y</div><p>", F.col("source"),
                 "</p><h3>Markings</h3>", marks, '</div><div class="image">', image, "</div>")
    return d.select(i.alias("page_id"), _page("http://www.example.net/o/", i).alias("url"), html.alias("html"))
