"""Scalar string functions (P1-P9) and their quirks."""

from pyspark.sql import functions as F

from hanga.functions import text as TX


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr.alias("o")).first()["o"]


def test_page_key_and_shortening(spark):
    assert _one(spark, TX.page_key("v"), "http://a.org/x/obj-1?q=2") == "obj-1?q=2"
    assert _one(spark, TX.page_key("v"), "http://a.org/x/") == ""
    long_key = "first-" + "-".join(["m"] * 120) + "-last"
    assert _one(spark, TX.shorten_key("v"), long_key) == "first-TRUNC-last"
    assert _one(spark, TX.shorten_key("v"), "short-key") == "short-key"


def test_site_prefix(spark):
    assert _one(spark, TX.site_prefix("v", "example.org"),
                "http://collections.example.org/node/1") == "http://collections.example.org"
    assert _one(spark, TX.site_prefix("v", "example.org"), "http://other.com/x") is None


def test_file_names(spark):
    assert _one(spark, TX.file_key("v"), "abc.sift.npz") == "abc"
    assert _one(spark, TX.file_ext("v"), "abc.sift.npz") == "npz"
    assert _one(spark, TX.file_ext("v"), "noext") == "noext"
    assert _one(spark, TX.checksum_from_path("v"), "full/dir/0a1b.jpg") == "0a1b"


def test_marker_cut_only_after_position_zero(spark):
    m = " (Japan"
    assert _one(spark, TX.cut_at_marker("v", m), "Hokusai (Japanese, 1760)") == "Hokusai"
    assert _one(spark, TX.cut_at_marker("v", m), " (Japan, x)") == " (Japan, x)"
    assert _one(spark, TX.cut_at_marker("v", m), "Hokusai") == "Hokusai"


def test_unicode_trim_and_defaults(spark):
    assert _one(spark, TX.unicode_trim("v"), "　 title 　") == "title"
    assert _one(spark, TX.default_to(F.col("v")), None) == "Unknown"
    df = spark.createDataFrame([(None, "", "low")], "a string, b string, c string")
    assert df.select(TX.first_present("a", "b", "c")).first()[0] == "low"
