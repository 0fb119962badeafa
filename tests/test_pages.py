"""Page extraction on hand-written pages."""

from pyspark.sql import functions as F

from hanga.functions import html as H
from hanga.operators import pages as PG

SITE_A = """<html><body>
<div class="group-left"><div class="media-asset-image"><img src="http://img.example/low.jpg"></div></div>
<div class="group-right">
  <h1>The Great Wave</h1>
  <div class="artist-name"><a href="/a/1">Katsushika Hokusai (Japan, 1760-1849)</a></div>
  <div class="field">Japan, 1831 </div>
  <div class="field">Alternate Title: Kanagawa oki; Series: Thirty-six Views; Paper: 25 x 37 cm</div>
  <div class="field">Series:   Later Series  </div>
</div>
<a href="/download/hi.tif">  Download   publication quality tiff </a>
</body></html>"""

SITE_A_LOW_ONLY = """<div class="media-asset-image"><span>x</span><img src="http://img/low2.jpg"></div>
<div class="group-right"><h1>T</h1><div class="artist-name"><a> (Japan) Anonymous</a></div></div>"""

SITE_A_NO_IMAGE = """<div class="group-right"><h1>T</h1></div>"""

SITE_B = """<html><body>
<p><a href="/artist">Utagawa Hiroshige I</a>, <a href="/pub">Uoya Eikichi</a><br>Edo period, 1857<br>more</p>
<div class="grid-6">nav</div>
<div class=" grid-6 x">left</div>
<div class="grid-6 main">
  <p>Japan, Edo period</p>
  <h2> Sudden Shower </h2>
  <h3> Ohashi atake </h3>
  <h4> Classifications </h4>
  <p><a href="/c">Prints</a></p>
  <h4>Medium or Technique</h4>
  <p>Woodblock print (nishiki-e)</p>
  <h4>Dimensions</h4>
  <p>Vertical oban</p>
  <h4>Accession Number</h4>
  <p>11.123</p>
</div>
<div class="grid-6 side">
  <div class="body"><p>Other MFA impressions: 21.1, 21.2</p></div>
  <h3>Signed</h3>
  <div>not a p</div>
  <p>Hiroshige ga</p>
  <h3>Markings</h3>
</div>
<div class="image"><!-- <img src="http://img.example/b.jpg" alt=""> --></div>
</body></html>"""


def _pages(spark, items):
    return spark.createDataFrame(items, "page_id long, url string, html string")


def _a(spark, html, url="http://collections.example.org/node/42"):
    return PG.records_a(_pages(spark, [(1, url, html)]), "example.org").first().asDict()


def _b(spark, html, url="http://www.example.net/o/abc"):
    return PG.records_b(_pages(spark, [(1, url, html)])).first().asDict()


def test_site_a_record(spark):
    a = _a(spark, SITE_A)
    assert a["image_urls"] == ["http://collections.example.org/download/hi.tif"]  # hi-res first
    assert a["title_EN"] == "The Great Wave"
    assert a["artist"] == "Katsushika Hokusai"
    assert a["date"] == "1831"
    assert a["title_JP"] == "Kanagawa oki"
    assert a["series"] == "Later Series"  # repeated key: last wins (H6), emitted (K7)
    assert a["dimensions"] == "25 x 37 cm"
    assert a["page_key"] == "42" and a["reject_reason"] is None
    low = _a(spark, SITE_A_LOW_ONLY)
    assert low["image_urls"] == ["http://img/low2.jpg"]
    assert low["artist"] == " (Japan) Anonymous"  # marker at position 0 kept (K19)
    assert _a(spark, SITE_A_NO_IMAGE)["reject_reason"] == "no_image"


def test_site_b_record(spark):
    b = _b(spark, SITE_B, "http://www.example.net/collections/object/" + "-".join(["w"] * 120) + "-129277")
    assert b["reject_reason"] is None
    assert b["page_key"] == "w-TRUNC-129277"
    assert b["image_urls"] == ["http://img.example/b.jpg"]
    assert (b["title_EN"], b["title_JP"]) == ("Sudden Shower", "Ohashi atake")
    assert (b["artist"], b["publisher"]) == ("Utagawa Hiroshige I", "Uoya Eikichi")  # K11
    assert b["date"] == "Edo period, 1857"
    assert (b["medium"], b["format"], b["acc_num"]) == ("Woodblock print (nishiki-e)",
                                                        "Vertical oban", "11.123")
    assert b["mfa_dups"] == "21.1, 21.2"
    assert b["signed"] == "Hiroshige ga"  # any following p, not only the next sibling (H9)
    assert b["markings"] is None


def test_site_b_gates(spark):
    def reason(html):
        return _b(spark, html)["reject_reason"]
    assert reason(SITE_B.replace("Japan, Edo", "China, Qing")) == "other_origin"
    assert reason(SITE_B.replace(">Prints<", ">Drawings<")) == "other_class"
    assert reason(SITE_B.replace("Classifications", "Other")) == "no_classification"
    assert reason("<p>x</p>") == "no_origin"
    assert reason(SITE_B.replace('src="', 'href="')) == "no_image"
    # a comment outside the image box is no image
    assert reason("<!-- src=\"x\" -->" + SITE_B.replace('class="image"', 'class="pic"')) == "no_image"
    no_br = SITE_B.replace("<br>Edo period, 1857<br>more", "")
    assert _b(spark, no_br)["date"] == "Unknown"
    # a later paragraph's span is not the date
    late = no_br.replace("<p>Vertical oban</p>", "<p>Vertical oban <br>1999<br></p>")
    assert _b(spark, late)["date"] == "Unknown"


def test_unicode_space_is_stripped_from_fields(spark):
    page = SITE_A.replace("Alternate Title: Kanagawa oki;", "Alternate Title:\u3000Kanagawa oki\t\u3000;") \
        .replace("Japan, 1831 ", "Japan, \u30001831\u3000")
    a = _a(spark, page)
    assert (a["title_JP"], a["date"]) == ("Kanagawa oki", "1831")


def test_regions_count_nested_containers(spark):
    html = ('<div class="x"><div>in<div class="y">deep</div></div>still</div><div class="x z">two</div>'
            "<div class='a x'>three</div><div class=\"xx\">no</div>")
    r = _pages(spark, [(1, "u", html)]).select(H.regions("html", "div", "x").alias("r"),
                                               H.region("html", "div", "y").alias("y"),
                                               H.region("html", "div", "none").alias("n")).first()
    assert r["r"] == ['<div>in<div class="y">deep</div></div>still', "two", "three"]
    assert r["y"] == "deep" and r["n"] is None


def test_links_are_scoped_decoded_and_resolved(spark):
    html = ('<nav><a href="/nav">n</a></nav><div class="search-result-data"><div><a href="/s?a=1&amp;b=2">x</a></div>'
            "<a class='k' href='/single'>y</a><a href=\"mailto:x@y\">m</a><a name='q'>z</a></div>"
            '<footer><a href="http://other.org/f">f</a></footer>')
    pages = _pages(spark, [(1, "http://c.example.org/s", html)])
    got = [r["link"] for r in PG.links(pages, ["example.org"], "search-result-data").orderBy("pos").collect()]
    assert got == ["http://c.example.org/s?a=1&b=2", "http://c.example.org/single", "mailto:x@y"]
    assert [r["link"] for r in PG.outgoing(pages, ["example.org"]).collect()] == got[:2]
    whole = [r["href"] for r in PG.links(pages, ["example.org"]).orderBy("pos").collect()]
    assert whole == ["/nav", "/s?a=1&b=2", "/single", "mailto:x@y", "http://other.org/f"]


def test_regex_helpers(spark):
    html = ('<div class="search-result-data"><a href="/o/1">one</a><a href="/o/2">two</a></div>'
            '<ul><li class="pager-next last"><a href="/s?page=2">next</a></li></ul>'
            '<div class="media-asset-image"><img alt="x" src="http://i/low.jpg"></div>'
            '<p><a>First</a> and <a>Second</a></p><h1>A &amp; B</h1>'
            '<a href="/t.tif"> Download  publication quality tiff</a>')
    df = _pages(spark, [(1, "http://collections.example.org/search", html)])
    r = df.select(
        H.link_hrefs("html").alias("links"),
        H.first_href_in("html", "li", "pager-next").alias("next"),
        H.first_attr("html", "div", "media-asset-image", "img", "src").alias("low"),
        H.nth_link_text(F.regexp_extract("html", "<p>.*?</p>", 0), 2).alias("second"),
        H.first_text("html", "h1").alias("h1"),
        H.link_with_text("html", "Download publication quality tiff").alias("hi"),
    ).first()
    assert r["links"][:2] == ["/o/1", "/o/2"] and r["next"] == "/s?page=2"
    assert r["low"] == "http://i/low.jpg" and r["second"] == "Second"
    assert r["h1"] == "A & B" and r["hi"] == "/t.tif"
    nxt = PG.next_page(df, ["example.org"]).first()["link"]
    assert nxt == "http://collections.example.org/s?page=2"
    fields = df.select(F.array(F.lit("Japan, 1832"), F.lit("Series: A; Paper: 3 cm"),
                               F.lit("Series: B")).alias("f"))
    got = fields.select(H.key_value("f", "Series").alias("s"), H.key_value("f", "Paper").alias("p"),
                        H.anchored_field(F.get("f", 0), "Japan, ").alias("d")).first()
    assert (got["s"], got["p"], got["d"]) == ("B", "3 cm", "1832")


def test_frontier_removes_visited(spark):
    pages = _pages(spark, [(1, "http://s.org/a", '<a href="/b">b</a><a href="/a">a</a>'),
                           (2, "http://s.org/b", '<a href="http://other.org/x">x</a>')])
    f = sorted(r["link"] for r in PG.frontier(PG.links(pages, ["s.org"]), pages).collect())
    assert f == ["http://other.org/x"]


def test_site_a_missing_artist_keeps_record(spark):
    """K8: no artist node -> the record is kept with a NULL artist."""
    page = ('<div class="media-asset-image"><img src="http://img/x.jpg"></div>'
            '<div class="group-right"><h1>Untitled</h1><div class="field">Japan, 1800</div></div>')
    rec = _a(spark, page, "http://c.example.org/node/9")
    assert rec["reject_reason"] is None and rec["artist"] is None
    assert rec["title_EN"] == "Untitled" and rec["date"] == "1800"


def test_outgoing_includes_next_page_once(spark):
    html = ('<div class="search-result-data"><a href="/o/1">one</a></div>'
            '<ul><li class="pager-next"><a href="/s?page=2">next</a></li></ul>')
    pages = _pages(spark, [(1, "http://c.example.org/s", html)])
    links = sorted(r["link"] for r in PG.outgoing(pages, ["example.org"]).collect())
    assert links == ["http://c.example.org/o/1", "http://c.example.org/s?page=2"]
    f = sorted(r["link"] for r in PG.frontier(PG.outgoing(pages, ["example.org"]), pages).collect())
    assert f == ["http://c.example.org/o/1", "http://c.example.org/s?page=2"]


def test_crawl_closure_ends_in_cycles_and_keeps_least_depth(spark):
    """a <-> b, a page that links to itself, two ways of different length to
    one page, a seed that is not stored, a null link."""
    def page(url, *links, pager=None):
        box = "".join(f'<a href="{x}">x</a>' for x in links)
        more = f'<li class="pager-next"><a href="{pager}">n</a></li>' if pager else ""
        return (url, f'<a href="/never">nav</a><div class="search-result-data">{box}</div>{more}')
    site = "http://x.example.org"
    rows = [page(f"{site}/a", "/b", "/a"), page(f"{site}/b", "/a", pager="/c"), page(f"{site}/c", "/d", "mailto:x@y.z"),
            page(f"{site}/d", "/b", "/e"), page(f"{site}/far", "/a"), page(f"{site}/a", "/e"), (None, "<p>")]
    pages = spark.createDataFrame(rows, "url string, html string")
    seeds = spark.createDataFrame([(f"{site}/a",), (f"{site}/gone",), (None,), (f"{site}/a",)], "url string")
    want = {"a": (0, True), "gone": (0, False), "b": (1, True), "e": (1, False), "c": (2, True), "d": (3, True)}
    for limit, broadcast in ((None, None), (None, "1"), (1, None), (0, None)):
        if broadcast:
            spark.conf.set("hanga.broadcast.maxBytes", broadcast)
        try:
            got = PG.crawl_closure(pages, seeds, ["example.org"], max_depth=limit).collect()
        finally:
            spark.conf.unset("hanga.broadcast.maxBytes")
        assert {r["url"].split("/")[-1]: (r["depth"], r["stored"]) for r in got} == {
            k: v for k, v in want.items() if limit is None or v[0] <= limit}
        assert len(got) == len({r["url"] for r in got})
    assert PG.crawl_closure(pages, seeds.limit(0), ["example.org"]).count() == 0


def _slow_regions(html, tag, cls):
    """Each container on its own, by counting from its opening tag."""
    import re
    out = []
    for m in re.finditer(H._open_tag(tag, cls), html, re.ASCII):
        depth, end = 1, len(html)
        for e in re.finditer(rf"<(/?){tag}(?=[\s>])", html[m.end():], re.ASCII):
            depth += -1 if e[1] else 1
            if not depth:
                end = m.end() + e.start()
                break
        out.append(html[m.end():end])
    return out


def test_containers_against_counting_each_on_its_own(spark):
    import random
    rnd = random.Random(2)
    bits = ['<div class="a">', '<div class="b a">', "<div>", "</div>", "<li class='c'>", "</li>", "x", "<divx>", "　é",
            '<div id="1" class="ab">', "<div\n class='a' >", "</div >", ">"]
    pages = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(300)] + ["", None]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    got = df.select("i", H.containers("html", a=("div", "a"), b=("div", "b"), c=("li", "c")).alias("r")).collect()
    for r in got:
        page = pages[r["i"]] or ""
        assert (r["r"]["a"], r["r"]["b"], r["r"]["c"]) == (
            _slow_regions(page, "div", "a"), _slow_regions(page, "div", "b"), _slow_regions(page, "li", "c")), page


def test_page_structure_is_linear_in_the_page(spark):
    """5,000 and 20,000 containers in one page: about four times the time."""
    import time
    import re
    took = []
    tags = re.compile(r"<(/?)(div)(?=[\s>])[^>]*>?", re.ASCII)
    spec = [(re.compile(H._open_tag("div", "grid-6"), re.ASCII), "div")]
    for n in (5_000, 20_000):
        page = "".join(f'<div class="grid-6"><div>{i}</div></div>' for i in range(n))
        start = time.perf_counter()
        got = H._containers_of(page, spec, tags)[0]
        took.append(time.perf_counter() - start)
        assert len(got) == n and got[-1] == f"<div>{n - 1}</div>"
    assert took[1] < 12 * took[0] and took[1] < 2
    wide = spark.createDataFrame([("http://x/1", "".join(f'<div class="grid-6">{i}</div>' for i in range(5_000)))],
                                 "url string, html string")
    assert wide.select(F.size(H.regions("html", "div", "grid-6"))).first()[0] == 5_000
