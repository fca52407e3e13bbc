"""Identifier, hash and URL column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_ws


def content_hash(html: Column) -> Column:
    """S-1: sha256 of lower(strip(html)); '' when the html is NULL or empty."""
    h = F.coalesce(html, F.lit(""))
    return F.when(h == "", F.lit("")).otherwise(F.sha2(F.lower(strip_ws(h)), 256))


def sha256_hex(c: Column) -> Column:
    """S-3: 64-hex content hash."""
    return F.sha2(c.cast("string"), 256)


def doc_id(*parts: Column) -> Column:
    """S-2: first 16 hex of sha256 over the parts joined by ':'."""
    return F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 16)


def dead_letter_id(source_id: Column, url: Column) -> Column:
    """SNK-9: ``source_id:`` + first 8 hex of sha256(url)."""
    return F.concat(source_id, F.lit(":"), F.substring(F.sha2(url, 256), 1, 8))


def netloc(url: Column) -> Column:
    """Host[:port] of an absolute URL, lower-cased (S-4)."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def domain(url: Column) -> Column:
    return netloc(url)


def normalize_url(url: Column) -> Column:
    """S-5: lower-case scheme and host, drop trailing slashes."""
    m = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)(.*)$"
    head = F.lower(F.regexp_extract(url, m, 1))
    tail = F.regexp_extract(url, m, 2)
    joined = F.when(head == "", url).otherwise(F.concat(head, tail))
    return F.regexp_replace(joined, "/+$", "")


def without_dot_segments(url: Column) -> Column:
    """An absolute url whose path has no ``.`` and ``..`` segments: each ``..`` takes the segment before it with it."""
    parts = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)([^?#]*)(.*)$"
    segments = F.split(F.substr(F.regexp_extract(url, parts, 2), F.lit(2)), "/")
    last = F.element_at(segments, -1)
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda out, s: F.when(s == ".", out)
                       .when(s == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(s))))
    path = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))
    return F.when(F.regexp_extract(url, parts, 2).rlike(r"/\.\.?(/|$)"),
                  F.concat(F.regexp_extract(url, parts, 1), path, F.regexp_extract(url, parts, 3))).otherwise(url)


def urljoin(base: Column, href: Column) -> Column:
    """S-6: resolve ``href`` against ``base`` (absolute, scheme-relative,
    root-relative, query, fragment and path-relative references, ``.`` and ``..`` segments)."""
    h = strip_ws(href)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    no_frag = F.regexp_replace(base, "#.*$", "")
    no_query = F.regexp_replace(no_frag, r"\?.*$", "")
    path = F.regexp_extract(no_query, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/.*)?$", 1)
    directory = F.concat(origin, F.regexp_replace(path, "[^/]*$", ""))
    directory = F.when(path == "", F.concat(origin, F.lit("/"))).otherwise(directory)
    return (F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
            .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
            .when(h.startswith("/"), without_dot_segments(F.concat(origin, h)))
            .when(h.startswith("?"), F.concat(no_query, h))
            .when(h.startswith("#"), F.concat(no_frag, h))
            .when(h == "", base)
            .otherwise(without_dot_segments(F.concat(directory, h))))


def credibility(url: Column, paywalled: Column) -> tuple[Column, Column]:
    """S-23: (score, label). .edu/.gov hosts 0.9 authority; paywalled pages
    capped at 0.6; others 0.7."""
    host = F.regexp_replace(netloc(url), r":\d+$", "")
    authority = F.when(host.rlike(r"\.(edu|gov)$"), 0.9).otherwise(0.7)
    score = F.when(F.coalesce(paywalled, F.lit(False)), F.least(authority, F.lit(0.6))).otherwise(authority)
    label = F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")
    return score, label
