"""Column expressions over stored pages.

Pages are text columns and nearly everything here is a built-in expression:
regular expressions for tags and attributes. The inside of a container is found
by matching the opening and closing tags of its kind, so nested containers are
closed correctly; that is one pass over the page for all containers a record
needs (``containers``), in an Arrow function.

Patterns use ``[^\\n]`` instead of ``.`` so that a line break ends a match in
every engine (Java's ``.`` also stops at U+0085 / U+2028). ``regexp_extract``
yields '' on no match; these helpers turn that into NULL like the reference's
``None``.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import col_or_name
from .text import null_if_empty, unicode_trim

# Entities decoded in extracted text (fixed values: the five XML entities plus
# the non-breaking space; ``&amp;`` last so it cannot create new entities).
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
            ("&nbsp;", " "), ("&amp;", "&")]


def unescape(c) -> Column:
    out = col_or_name(c)
    for ent, ch in ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


def _lit_re(s: str) -> str:
    return re.escape(s).replace("\\ ", " ")


def _open_tag(tag: str, cls: str | None = None) -> str:
    """Pattern of an opening tag, with a class token when ``cls`` is given."""
    if cls is None:
        return rf"<{tag}(?:\s[^>]*)?>"
    return rf"""<{tag}\s[^>]*?class=(?:"(?:[^">]*\s)?{_lit_re(cls)}(?:\s[^">]*)?"|'(?:[^'>]*\s)?{_lit_re(cls)}(?:\s[^'>]*)?')[^>]*>"""


def _attr(name: str) -> str:
    """Pattern of an attribute in either quotes (two groups)."""
    return rf"""\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def _either(c: Column, pattern: str) -> Column:
    """First non-empty of a pattern's two groups, entities decoded; NULL when
    the pattern does not match."""
    both = F.concat(F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2))
    return F.when(c.rlike(pattern), unescape(both))


def _containers_of(html: str, specs: list[tuple[re.Pattern, str]], tags: re.Pattern) -> list[list[str]]:
    """One pass over a page's opening and closing tags: a stack per kind of
    tag, and for every opening tag that fits a spec the text up to the closing
    tag that belongs to it (or the page's end, if there is none)."""
    found: list[list] = [[] for _ in specs]
    open_tags: dict[str, list] = {}
    for event in tags.finditer(html):
        stack = open_tags.setdefault(event[2], [])
        if not event[1]:
            # where this tag's text goes once it is closed: (spec, slot, start)
            fits = []
            for n, (pattern, tag) in enumerate(specs):
                if tag == event[2] and (m := pattern.match(html, event.start())):
                    fits.append((n, len(found[n]), m.end()))
                    found[n].append(None)
            stack.append(fits)
        elif stack:
            for n, slot, start in stack.pop():
                found[n][slot] = html[start:event.start()]
    for stack in open_tags.values():
        for n, slot, start in (f for fits in stack for f in fits):
            found[n][slot] = html[start:]
    return found


def containers(html, **specs: tuple[str, str]) -> Column:
    """A struct with, per named spec ``(tag, class)``, the inside of every
    ``<tag class="... class ...">`` in document order (nested ones are listed
    on their own as well); empty for a null page (H12).

    All specs share one pass over the page, linear in its size: the tag events
    with their depth are kept on a stack while the page is read, one page of an
    Arrow batch at a time. (Built-in array functions can count depth, too, but
    copy or rescan the page for every container.)"""
    kinds = "|".join(sorted({re.escape(tag) for tag, _ in specs.values()}))
    tags = re.compile(rf"<(/?)({kinds})(?=[\s>])[^>]*>?", re.ASCII)    # no tag begins inside another
    wanted = [(re.compile(_open_tag(tag, cls), re.ASCII), tag) for tag, cls in specs.values()]
    names, kind = list(specs), pa.list_(pa.string())

    @F.arrow_udf(", ".join(f"{n} array<string>" for n in names))
    def run(pages: pa.Array) -> pa.Array:
        columns: list[list] = [[] for _ in names]
        for page in pages:
            text = page.as_py()
            for column, got in zip(columns, _containers_of(text, wanted, tags) if text else [[]] * len(names),
                                   strict=True):
                column.append(got)
        return pa.StructArray.from_arrays([pa.array(c, kind) for c in columns], names=names)

    return run(col_or_name(html))


def regions(html, tag: str, cls: str) -> Column:
    """The inside of every ``<tag class="... cls ...">``, in document order
    (nested ones are listed on their own as well)."""
    return containers(html, inside=(tag, cls)).getField("inside")


def region(html, tag: str, cls: str, n: int = 1) -> Column:
    """The inside of the n-th (1-based) such container (H12); NULL if there
    are fewer."""
    return F.get(regions(html, tag, cls), n - 1)


def elements(html, tag: str) -> Column:
    """The inside of every ``<tag>`` that holds no further ``<tag>``."""
    return F.regexp_extract_all(col_or_name(html), F.lit(rf"(?s){_open_tag(tag)}(.*?)(?=</?{tag}[\s>]|$)"), F.lit(1))


def links_in(html) -> Column:
    """Targets of all ``<a href>`` in document order, in either quotes,
    entities decoded; empty targets are left out (H1)."""
    tags = F.regexp_extract_all(col_or_name(html), F.lit(r"(<a\s[^>]*>)"), F.lit(1))
    return F.filter(F.transform(tags, lambda t: _either(t, _attr("href"))),
                    lambda h: h.isNotNull() & (h != ""))


def link_hrefs(html, container_tag: str | None = None, container_class: str | None = None) -> Column:
    """Link targets of the page, or only those inside the containers with a
    class token, in document order (H1)."""
    if container_tag is None:
        return links_in(html)
    return F.flatten(F.transform(regions(html, container_tag, container_class), links_in))


def first_href_in(html, container_tag: str, container_class: str) -> Column:
    """First link inside the containers (H2: next-page link); NULL if none."""
    return F.get(link_hrefs(html, container_tag, container_class), 0)


def first_attr(html, container_tag: str, container_class: str, tag: str, attr: str) -> Column:
    """First ``attr`` of ``tag`` inside a container with a class token (H4)."""
    return first_attr_of(regions(html, container_tag, container_class), tag, attr)


def first_attr_of(inside: Column, tag: str, attr: str) -> Column:
    """First ``attr`` of ``tag`` in an array of texts; NULL if none."""
    found = F.transform(inside, lambda r: _either(r, rf"<{tag}(?=\s)[^>]*?" + _attr(attr)))
    return F.get(F.filter(found, lambda v: v.isNotNull() & (v != "")), 0)


def first_text(html, tag: str) -> Column:
    """Text directly after the first ``<tag>`` opening, up to the next
    markup, entities decoded (H5: ``tag::text`` first)."""
    pat = rf"<{tag}(?:\s[^>]*)?>([^<]*)"
    return null_if_empty(unescape(F.regexp_extract(col_or_name(html), pat, 1)))


def link_with_text(html, text: str) -> Column:
    """href of the first link whose whitespace-normalised text equals
    ``text`` (H3)."""
    pairs = F.regexp_extract_all(col_or_name(html), F.lit(r"(<a\s[^>]*>[^<]*</a>)"), F.lit(1))

    def said(p):
        words = F.regexp_replace(F.regexp_extract(p, r">([^<]*)</a>", 1), r"(?U)\s+", " ")
        return unicode_trim(unescape(words)) == F.lit(text)

    return F.get(F.transform(F.filter(pairs, said), lambda p: _either(p, _attr("href"))), 0)


def comments(html) -> Column:
    """Bodies of the HTML comments in order."""
    return F.regexp_extract_all(col_or_name(html), F.lit(r"(?s)<!--(.*?)-->"), F.lit(1))


def first_comment(html, container_tag: str | None = None, container_class: str | None = None) -> Column:
    """Body of the first comment of the page or of the containers."""
    if container_tag is None:
        return null_if_empty(F.get(comments(html), 0))
    return null_if_empty(F.get(F.flatten(F.transform(
        regions(html, container_tag, container_class), comments)), 0))


def comment_src(comment) -> Column:
    """``src="..."`` inside a comment, greedy non-space."""
    return null_if_empty(F.regexp_extract(col_or_name(comment), r'src="(\S*)"', 1))


def br_span(blob) -> Column:
    """Greedy text between the first and last ``<br>`` on one line."""
    return null_if_empty(unescape(F.regexp_extract(col_or_name(blob), r"<br\s*/?>([^\n]*)<br\s*/?>", 1)))


def after_marker(text, marker: str) -> Column:
    """Rest of the line after ``marker`` (H11: ``impressions: (.*)``)."""
    return null_if_empty(F.regexp_extract(col_or_name(text), rf"{_lit_re(marker)}([^\n]*)", 1))


def anchored_field(field, prefix: str) -> Column:
    """Rest of a field that starts with ``prefix`` (H7: ``^Japan, (.*)``),
    stripped of Unicode white space."""
    return null_if_empty(unicode_trim(F.regexp_extract(col_or_name(field), rf"^{_lit_re(prefix)}([^\n]*)", 1)))


def text_after_heading(html, heading_tag: str, heading: str, tag: str = "p", link: bool = False,
                       adjacent: bool = True) -> Column:
    """Text of the first ``tag`` after the heading that says ``heading``
    (white space normalised): the next such sibling (H8), or with
    ``adjacent=False`` the first later one that has any text (H9); with
    ``link`` the text of its first link."""
    parts = F.split(col_or_name(html), rf"(?=<{heading_tag}[\s>])")

    def says(part):
        said = F.regexp_extract(part, rf"^{_open_tag(heading_tag)}([^<]*)", 1)
        return unicode_trim(unescape(F.regexp_replace(said, r"(?U)\s+", " "))) == F.lit(heading)

    rest = F.array_join(F.slice(parts, F.array_position(F.transform(parts, says), True).cast("int"),
                                F.size(parts)), "")
    blocks = F.when(F.exists(parts, says), elements(rest, tag))
    if link:
        blocks = F.transform(blocks, lambda b: F.regexp_extract(b, r"<a(?:\s[^>]*)?>([^<]*)", 1))
    texts = F.transform(blocks, lambda b: F.regexp_extract(b, r"^([^<]*)", 1))
    if not adjacent:
        texts = F.filter(texts, lambda t: t != "")
    return null_if_empty(unescape(F.get(texts, 0)))


def key_value(fields, key: str) -> Column:
    """Value of ``key:`` up to ``;`` over an array of field texts, stripped
    of Unicode white space; the last field that has the key wins (H6)."""
    pat = rf"{_lit_re(key)}:([^;]*)"
    hits = F.filter(col_or_name(fields), lambda f: f.rlike(pat))
    vals = F.transform(hits, lambda f: unicode_trim(F.regexp_extract(f, pat, 1)))
    return F.try_element_at(vals, F.lit(-1))


def nth_link_text(blob, n: int) -> Column:
    """Text of the n-th (1-based) link in a blob."""
    texts = F.regexp_extract_all(col_or_name(blob), F.lit(r"<a[^>]*>([^<]*)</a>"), F.lit(1))
    return F.get(texts, n - 1)
