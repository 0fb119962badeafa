"""Extraction over the stored-page table (S12, P1-P3, P6, P8, P9, H1-H15,
F7, F8).

Crawling is replaced by a table ``pages(page_id, url, html)``; every
extraction is a pure projection of it, so re-running extraction never
re-fetches anything. All operators here are built-in column expressions
(one map-only stage); only the frontier (a distinct plus an anti join against
the visited URLs, which grow with the crawl and are therefore not broadcast)
and the closure over stored pages shuffle.

A catalogue record is one projection: the regions of the page become columns
first, each field is an expression over its region, and the conditions a page
must meet (an image, the origin, the class) are predicates whose first failure
is the reject reason.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.text import (cut_at_marker, default_to, first_present, null_if_empty, page_key,
                              shorten_key, site_prefix, unicode_trim)
from ..session import broadcast_limit, cut_lineage

# Markup of the two catalogue sites (class tokens, headings,
# link texts, field keys and markers); they must equal the sites' pages.
RESULT_BOX = "search-result-data"
PAGER = "pager-next"
MARKUP_A = {
    "hires_link": "Download publication quality tiff", "lowres_box": "media-asset-image",
    "record_box": "group-right", "artist_box": "artist-name", "field_box": "field",
    "artist_suffix": " (Japan", "date_prefix": "Japan, ", "title_jp": "Alternate Title",
    "series": "Series", "dimensions": "Paper",
}
MARKUP_B = {
    "column": "grid-6", "main": 3, "side": 4, "origin": "Japan", "class_heading": "Classifications",
    "class_word": "Prints", "image_box": "image", "medium": "Medium or Technique",
    "format": "Dimensions", "acc_num": "Accession Number", "state_box": "body",
    "impressions": "MFA impressions: ", "signed": "Signed", "markings": "Markings",
}


def site_of(url, host_suffixes: list[str]) -> Column:
    """Site prefix for whichever configured host suffix the URL contains
    first in the list (P3)."""
    return F.coalesce(*[site_prefix(url, h) for h in host_suffixes])


def absolute(site, href) -> Column:
    """A link made absolute against its page's site: links with any scheme
    stay as they are (P3)."""
    has_scheme = F.col(href).rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:")
    return F.when(has_scheme, F.col(href)).otherwise(F.concat(site, F.col(href)))


def with_keys(pages: DataFrame, max_len: int = 200) -> DataFrame:
    """Adds ``page_key`` (P1) and ``short_key``."""
    return (pages.withColumn("page_key", page_key("url"))
            .withColumn("short_key", shorten_key("page_key", max_len)))


def links(pages: DataFrame, host_suffixes: list[str], box: str | None = None) -> DataFrame:
    """One row per link of each page, in page order (H1): ``(page_id, pos,
    href, link)``; with ``box`` only links inside ``div``s of that class (the
    result box of a listing page)."""
    hrefs = H.link_hrefs("html", "div", box) if box else H.link_hrefs("html")
    exploded = pages.select("page_id", site_of("url", host_suffixes).alias("site"),
                            F.posexplode(hrefs).alias("pos", "href"))
    return exploded.select("page_id", "pos", "href", absolute(F.col("site"), "href").alias("link"))


def next_page(pages: DataFrame, host_suffixes: list[str]) -> DataFrame:
    """Next-page link of listing pages (H2); pages without one are dropped."""
    found = pages.select("page_id", site_of("url", host_suffixes).alias("site"),
                         H.first_href_in("html", "li", PAGER).alias("href"))
    return (found.where(F.col("href").isNotNull())
            .select("page_id", absolute(F.col("site"), "href").alias("link")))


def outgoing(pages: DataFrame, host_suffixes: list[str], box: str | None = RESULT_BOX) -> DataFrame:
    """Every page a crawl would follow from each listing page — the links of
    the result box (H1; ``box=None``: of the whole page) plus the next-page
    link (H2) — as ``(page_id, link)``, made absolute, from a single read of
    the page HTML. Links that are not web pages (``mailto:`` and the like) are
    left out."""
    boxes = {"pager": ("li", PAGER), **({"result": ("div", box)} if box else {})}
    parts = pages.select("page_id", "html", site_of("url", host_suffixes).alias("site"),
                         H.containers("html", **boxes).alias("box"))
    hrefs = F.flatten(F.transform("box.result", H.links_in)) if box else H.link_hrefs("html")
    nxt = F.slice(F.flatten(F.transform("box.pager", H.links_in)), 1, 1)
    exploded = parts.select("page_id", "site", F.explode(F.concat(hrefs, nxt)).alias("href"))
    other = F.col("href").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:") & ~F.col("href").rlike("(?i)^https?://")
    return exploded.where(~other).select("page_id", absolute(F.col("site"), "href").alias("link"))


def frontier(found: DataFrame, visited: DataFrame, link_col: str = "link",
             url_col: str = "url") -> DataFrame:
    """Distinct links not yet visited: the next crawl's input (H1 + H2)."""
    seen = visited.select(F.col(url_col).alias("__seen"))
    return (found.select(link_col).where(F.col(link_col).isNotNull()).distinct()
            .join(seen, F.col(link_col) == F.col("__seen"), "left_anti"))


def crawl_closure(pages: DataFrame, seeds: DataFrame, host_suffixes: list[str], box: str | None = RESULT_BOX,
                  max_depth: int | None = None, url_col: str = "url") -> DataFrame:
    """Every page that following result and pager links reaches from ``seeds``
    (a table with ``url_col``), with the least number of links to it:
    ``(url, depth, stored)``; ``stored`` says whether the page is in ``pages``
    (the others are what a crawl still has to fetch). ``max_depth`` stops
    after so many links; cycles end by themselves.

    Semi-naive: links are taken from the pages once; a round joins only the
    pages that the round before found with them, and keeps what no round has
    found yet. Each round is a table in the shared folder, so that plans do not
    grow and a lost executor costs one round at most. A page that millions
    link to is one row per task before the shuffle."""
    spark = pages.sparkSession
    edges = cut_lineage(outgoing(pages.select(F.col("url").alias("page_id"), "url", "html"), host_suffixes, box)
                        .select(F.col("page_id").alias("__src"), "link")
                        .where("__src is not null and link is not null").distinct())
    found = cut_lineage(seeds.select(F.col(url_col).alias("url")).where("url is not null").distinct()
                        .withColumn("depth", F.lit(0)))
    rounds, size, depth = [found], found.count(), 0
    while size and (max_depth is None or depth < max_depth):
        depth += 1
        last = rounds[-1].select(F.col("url").alias("__src"))
        if size * 256 <= broadcast_limit(spark):
            last = F.broadcast(last)
        known = reduce(DataFrame.unionByName, rounds).select(F.col("url").alias("__seen"))
        new = (edges.join(last, "__src").select(F.col("link").alias("url")).distinct()
               .join(known, F.col("url") == F.col("__seen"), "left_anti").withColumn("depth", F.lit(depth)))
        rounds.append(cut_lineage(new))
        size = rounds[-1].count()
    stored = pages.select(F.col("url").alias("__page"), F.lit(True).alias("__in")).where("__page is not null").distinct()
    return (reduce(DataFrame.unionByName, rounds).join(stored, F.col("url") == F.col("__page"), "left")
            .select("url", "depth", F.coalesce("__in", F.lit(False)).alias("stored")))


def record_fields(pages: DataFrame) -> DataFrame:
    """Common record fields of a stored page: key, title, first heading, first
    comment and its image source, the ``<br>`` date span of the first
    paragraph, ``Unknown`` when it has none (H5, H10, H11, P9)."""
    comment = H.first_comment("html")
    return with_keys(pages).select(
        "page_id", "url", "page_key",
        H.first_text("html", "title").alias("title"),
        H.first_text("html", "h1").alias("h1"),
        comment.alias("comment"),
        H.comment_src(comment).alias("image_url"),
        default_to(H.br_span(F.get(H.elements("html", "p"), 0))).alias("date"))


def _with_reason(records: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Adds ``reject_reason``: the name of the first check that does not hold,
    NULL for an accepted record."""
    failed = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks]
    return records.withColumn("reject_reason", F.coalesce(*failed))


def records_a(pages: DataFrame, host: str, markup: dict = MARKUP_A) -> DataFrame:
    """Object records of site A (H13): title, artist, date, dimensions and
    images per page. A page without any image has ``reject_reason``
    ``no_image``; a missing artist stays NULL (K8)."""
    m = markup
    parts = pages.select(
        "url", page_key("url").alias("page_key"),
        H.link_with_text("html", m["hires_link"]).alias("hires"),
        H.containers("html", lowres=("div", m["lowres_box"]), record=("div", m["record_box"])).alias("box"))
    parts = parts.select(
        "url", "page_key", "hires", H.first_attr_of(F.col("box.lowres"), "img", "src").alias("lowres"),
        F.array_join("box.record", "\n").alias("record"))
    parts = parts.withColumn("box", H.containers("record", field=("div", m["field_box"]), artist=("div", m["artist_box"])))
    parts = parts.withColumn(
        "fields", F.transform("box.field", lambda f: H.unescape(F.regexp_extract(f, "^([^<]*)", 1))))
    dates = F.filter(F.transform("fields", lambda f: H.anchored_field(f, m["date_prefix"])),
                     lambda d: d.isNotNull())
    hires = F.concat(F.coalesce(site_prefix("url", host), F.lit("")), F.col("hires"))
    image = first_present(F.when(F.col("hires") != "", hires), "lowres")
    artist = H.first_text(F.get("box.artist", 0), "a")
    records = parts.select(
        "url", "page_key",
        H.first_text("record", "h1").alias("title_EN"),
        H.key_value("fields", m["title_jp"]).alias("title_JP"),
        cut_at_marker(artist, m["artist_suffix"]).alias("artist"),
        F.try_element_at(dates, F.lit(-1)).alias("date"),
        H.key_value("fields", m["dimensions"]).alias("dimensions"),
        H.key_value("fields", m["series"]).alias("series"),
        F.when(image.isNotNull(), F.array(image)).alias("image_urls"))
    return _with_reason(records, [("no_image", F.col("image_urls").isNotNull())])


def records_b(pages: DataFrame, markup: dict = MARKUP_B) -> DataFrame:
    """Object records of site B (H14). The origin (F7), the class (F8) and an
    image in the comment of the image box (H10) are required; the artist, the
    publisher and the date stand in the page's first paragraph (K11)."""
    m = markup
    parts = with_keys(pages).select(
        "url", F.col("short_key").alias("page_key"),
        H.containers("html", column=("div", m["column"]), image=("div", m["image_box"])).alias("box"),
        F.get(H.elements("html", "p"), 0).alias("first_p"))
    parts = parts.select(
        "url", "page_key", F.get("box.column", m["main"] - 1).alias("main"),
        F.get("box.column", m["side"] - 1).alias("side"),
        H.comment_src(null_if_empty(F.get(F.flatten(F.transform("box.image", H.comments)), 0))).alias("image"),
        "first_p")
    parts = parts.withColumn("state", F.get(H.regions("side", "div", m["state_box"]), 0))

    def of(region, heading, level="h4", **how):
        return H.text_after_heading(region, level, heading, **how)

    state = H.first_text("state", "p")
    records = parts.select(
        "url", "page_key",
        unicode_trim(H.first_text("main", "h2")).alias("title_EN"),
        unicode_trim(H.first_text("main", "h3")).alias("title_JP"),
        H.nth_link_text("first_p", 1).alias("artist"),
        H.nth_link_text("first_p", 2).alias("publisher"),
        default_to(H.br_span("first_p")).alias("date"),
        of("main", m["medium"]).alias("medium"),
        of("main", m["format"]).alias("format"),
        of("main", m["acc_num"]).alias("acc_num"),
        H.after_marker(state, m["impressions"]).alias("mfa_dups"),
        of("side", m["signed"], "h3", adjacent=False).alias("signed"),
        of("side", m["markings"], "h3", adjacent=False).alias("markings"),
        F.when(F.col("image").isNotNull(), F.array("image")).alias("image_urls"),
        H.first_text("main", "p").alias("origin"),
        of("main", m["class_heading"], link=True).alias("classes"))
    return _with_reason(records, [
        ("no_origin", F.col("origin").isNotNull()),
        ("other_origin", from_origin("origin", m["origin"])),
        ("no_classification", F.col("classes").isNotNull()),
        ("other_class", of_class("classes", m["class_word"])),
        ("no_image", F.col("image_urls").isNotNull()),
    ]).drop("origin", "classes")


def from_origin(origin, wanted: str = MARKUP_B["origin"]) -> Column:
    """The origin text starts with the wanted country."""
    return F.col(origin).startswith(wanted)


def of_class(classes, word: str = MARKUP_B["class_word"]) -> Column:
    """The classification text names the wanted class (F8)."""
    return F.col(classes).contains(word)
