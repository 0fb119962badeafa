"""Scalar string expressions for keys, URLs and record fields.

Every function returns a Column built from ``pyspark.sql.functions``; none of
them runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import col_or_name


def page_key(url) -> Column:
    """Last ``/`` segment of a URL, query string kept; '' for a trailing '/'
    (P1)."""
    return F.element_at(F.split(col_or_name(url), "/"), -1)


def shorten_key(key, max_len: int = 200, marker: str = "-TRUNC-") -> Column:
    """Keys longer than ``max_len``: first '-' part + marker + last '-' part
    (P2)."""
    k = col_or_name(key)
    parts = F.split(k, "-")
    short = F.concat(F.element_at(parts, 1), F.lit(marker), F.element_at(parts, -1))
    return F.when(F.length(k) > max_len, short).otherwise(k)


def site_prefix(url, host_suffix: str) -> Column:
    """URL up to and including the first ``host_suffix``; NULL when the
    suffix does not occur (P3; the reference would silently cut wrong)."""
    u = col_or_name(url)
    return F.when(F.instr(u, host_suffix) > 0,
                  F.concat(F.substring_index(u, host_suffix, 1), F.lit(host_suffix)))


def file_key(name) -> Column:
    """File name before the first dot."""
    return F.substring_index(col_or_name(name), ".", 1)


def file_ext(name) -> Column:
    """File name after the last dot (P4); the whole name when there is none."""
    return F.substring_index(col_or_name(name), ".", -1)


def basename(path) -> Column:
    return F.substring_index(col_or_name(path), "/", -1)


def checksum_from_path(path) -> Column:
    """Image checksum = basename of the stored path, before its first dot
    (P5)."""
    return file_key(basename(path))


def cut_at_marker(text, marker: str) -> Column:
    """Cut ``text`` at the first ``marker`` only when the marker is not at
    position 0 (P6, quirk K19)."""
    t = col_or_name(text)
    return F.when(F.instr(t, marker) > 1, F.substring_index(t, marker, 1)).otherwise(t)


def unicode_trim(text) -> Column:
    """Strip leading/trailing unicode whitespace (P7; ``trim`` only strips
    ASCII blanks)."""
    return F.regexp_replace(col_or_name(text), r"(?U)^\s+|\s+$", "")


def null_if_empty(c) -> Column:
    """'' -> NULL (regexp_extract returns '' on no match)."""
    return F.nullif(col_or_name(c), F.lit(""))


def first_present(*cols) -> Column:
    """First non-NULL, non-empty candidate (P8 fallback chain)."""
    return F.coalesce(*[null_if_empty(c) for c in cols])


def default_to(c, value: str = "Unknown") -> Column:
    """Default literal for a missing field."""
    return F.coalesce(col_or_name(c), F.lit(value))
