"""Page extraction jobs (P-13, P-14, S-12, UF-2).

The built-in path is pure column expressions (regex over the whole page,
JVM-side, no shuffle). A user extractor runs through ``mapInPandas`` with a
fixed output schema; a failing row falls back to the basic extraction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html as H
from ..functions.ids import content_hash, doc_id
from ..functions.text import explode_values

EXTRACTED = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("publish_date", T.TimestampNTZType()),
    T.StructField("article_text", T.StringType()),
    T.StructField("links", T.ArrayType(T.StringType())),
    T.StructField("images", T.ArrayType(T.StringType())),
])


def basic_extract(pages: DataFrame, html_col: str = "raw_html") -> DataFrame:
    """S-12: title and whole-page text by the basic regex rules."""
    h = F.col(html_col)
    return pages.select("id", "url", H.basic_title(h).alias("title"), H.basic_text(h).alias("text"))


def extract_pages(pages: DataFrame, html_col: str = "raw_html", keep: list[str] | None = None) -> DataFrame:
    """P-13: title, author, publish date, article text, links, images, plus
    content hash and a deterministic document id; ``keep`` names further columns to carry."""
    keep = keep or []
    # Scripts, styles and comments are stripped once per page; every field
    # then reads the projected clean column.
    p = pages.select("id", "url", H.without_noise(F.col(html_col)).alias("_clean"),
                     content_hash(F.col(html_col)).alias("content_hash"), *keep)
    h = F.col("_clean")
    return p.select(
        "id", "url",
        H.title(h, cleaned=True).alias("title"),
        H.author(h, cleaned=True).alias("author"),
        H.publish_date(h, cleaned=True).alias("publish_date"),
        H.article_text(h, cleaned=True).alias("article_text"),
        H.links(h, F.col("url"), cleaned=True).alias("links"),
        H.images(h, F.col("url"), cleaned=True).alias("images"),
        "content_hash",
        doc_id(F.col("url"), F.col("id")).alias("doc_id"), *keep,
    )


def page_links(pages: DataFrame, html_col: str = "raw_html") -> DataFrame:
    """P-14: distinct (src_url, dst_url) edges."""
    e = pages.select(F.col("url").alias("src_url"),
                     explode_values(H.links(F.col(html_col), F.col("url"))).alias("dst_url"))
    return e.where(F.col("dst_url").isNotNull()).dropDuplicates(["src_url", "dst_url"])


def extract_with(pages: DataFrame, fn: Callable, html_col: str = "raw_html") -> DataFrame:
    """UF-2: run a user extractor ``fn(html, url) -> dict`` per page inside
    ``mapInPandas`` (Arrow batches). Rows where ``fn`` raises get the basic
    extraction (title from <title>, text with tags removed)."""
    import re

    from ..session import ship_code
    ship_code(pages.sparkSession)
    fields = [f.name for f in EXTRACTED.fields]

    def run(batches):
        import pandas as pd
        for pdf in batches:
            out = []
            for pid, url, html in zip(pdf["id"], pdf["url"], pdf[html_col]):
                try:
                    r = dict(fn(html, url) or {})
                except Exception:  # noqa: BLE001 - fallback is the contract
                    m = re.search(r"<title>(.*?)</title>", html or "", re.I | re.S)
                    text = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", html or "")).strip()
                    r = {"title": m.group(1).strip() if m else "Untitled", "article_text": text}
                r.update(id=pid, url=url)
                out.append({k: r.get(k) for k in fields})
            yield pd.DataFrame(out, columns=fields)

    return pages.select("id", "url", html_col).mapInPandas(run, EXTRACTED)
