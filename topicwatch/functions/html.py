"""HTML extraction as column expressions (S-7..S-12, P-13 built-in path).

Scripts, styles and comments are removed before any tag-based match: test
pages carry ``"</p>"`` inside ``<script>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import urljoin
from .text import strip_ws

NOISE = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"


def without_noise(html: Column) -> Column:
    return F.regexp_replace(html, NOISE, " ")


def tag_text(fragment: Column) -> Column:
    """Text of an HTML fragment: tags -> space, entities for &amp; &lt; &gt;
    &quot; &#39; &nbsp; decoded, whitespace collapsed, stripped."""
    t = F.regexp_replace(fragment, r"<[^>]+>", " ")
    for ent, ch in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]:
        t = F.replace(t, F.lit(ent), F.lit(ch))
    return strip_ws(F.regexp_replace(t, r"\s+", " "))


def meta_content(html: Column, attr: str, value: str) -> Column:
    """content="..." of the first <meta attr="value">, either attribute order."""
    a = rf'(?is)<meta\b[^>]*\b{attr}\s*=\s*["\']{value}["\'][^>]*\bcontent\s*=\s*["\']([^"\']*)["\']'
    b = rf'(?is)<meta\b[^>]*\bcontent\s*=\s*["\']([^"\']*)["\'][^>]*\b{attr}\s*=\s*["\']{value}["\']'
    ea, eb = F.regexp_extract(html, a, 1), F.regexp_extract(html, b, 1)
    return F.when(ea != "", ea).when(eb != "", eb)


def first_tag_text(html: Column, tag: str) -> Column:
    v = tag_text(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))
    return F.when(v != "", v)


def first_class_text(html: Column, cls: str, tag: str = r"[a-z0-9]+") -> Column:
    pat = rf'(?is)<({tag})\b[^>]*\bclass\s*=\s*["\'][^"\']*\b{cls}\b[^"\']*["\'][^>]*>(.*?)</\1>'
    v = tag_text(F.regexp_extract(html, pat, 2))
    return F.when(v != "", v)


def _clean(html: Column, cleaned: bool) -> Column:
    return html if cleaned else without_noise(html)


def title(html: Column, cleaned: bool = False) -> Column:
    """S-7: og:title -> twitter:title -> <title> -> h1 -> 'Untitled'."""
    h = _clean(html, cleaned)
    return F.coalesce(meta_content(h, "property", "og:title"), meta_content(h, "name", "twitter:title"),
                      first_tag_text(h, "title"), first_tag_text(h, "h1"), F.lit("Untitled"))


def author(html: Column, cleaned: bool = False) -> Column:
    """S-8: meta author -> byline/author class."""
    h = _clean(html, cleaned)
    return F.coalesce(meta_content(h, "name", "author"), first_class_text(h, "byline"),
                      first_class_text(h, "author"))


# Date formats tried in order (ISO forms first); a zone is added where the text has none.
DATE_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX", "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS]XXX",
                "yyyy-MM-ddXXX", "MMMM d, yyyyXXX", "d MMMM yyyyXXX"]
ZONE = r"(?:Z|[+-]\d{2}:\d{2})$"


def parse_date(s: Column) -> Column:
    """S-9 / S-15: first format that parses, as TIMESTAMP_NTZ in UTC; NULL when
    none does. Takes 0 to 9 fraction digits and an optional zone (none: UTC);
    the session time zone plays no part."""
    s = F.regexp_replace(strip_ws(s), r"(T.*[+-]\d{2})(\d{2})$", "$1:$2")
    zoned = F.when(s.rlike(ZONE), s).otherwise(F.concat(s, F.lit("Z")))
    instant = F.coalesce(*[F.try_to_timestamp(zoned, F.lit(f)) for f in DATE_FORMATS])
    seconds = (F.unix_micros(instant.cast("timestamp_ltz")) / F.lit(1_000_000)).cast("decimal(20,6)")
    return F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def publish_date(html: Column, cleaned: bool = False) -> Column:
    """S-9: article:published_time -> <time datetime> -> <time> text."""
    h = _clean(html, cleaned)
    meta = meta_content(h, "property", "article:published_time")
    dt_attr = F.regexp_extract(h, r'(?is)<time\b[^>]*\bdatetime\s*=\s*["\']([^"\']*)["\']', 1)
    ttext = first_tag_text(h, "time")
    raw = F.when(meta.isNotNull(), meta).when(dt_attr != "", dt_attr).otherwise(ttext)
    return parse_date(raw)


def clean_text(t: Column) -> Column:
    """S-11: blank-line runs -> one blank line, space/tab runs -> one space,
    strip."""
    t = F.regexp_replace(t, r"\n\s*\n", "\n\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return strip_ws(t)


def block_text(fragment: Column) -> Column:
    """Block-level text: tags -> newline, lines stripped, blank lines dropped."""
    t = F.regexp_replace(fragment, r"<[^>]+>", "\n")
    for ent, ch in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]:
        t = F.replace(t, F.lit(ent), F.lit(ch))
    lines = F.transform(F.split(t, "\n"), lambda s: strip_ws(F.regexp_replace(s, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def paragraphs(html: Column, cleaned: bool = False) -> Column:
    """Texts of all <p> elements (a <p> ends at the next <p> or </p>)."""
    h = _clean(html, cleaned)
    raw = F.regexp_extract_all(h, F.lit(r"(?is)<p\b[^>]*>(.*?)(?=</p>|<p\b|</article>|</main>|</body>|$)"), 1)
    return F.transform(raw, tag_text)


def element(html: Column, open_tag: str, tag: str) -> Column:
    """Inner HTML of the first element whose start tag matches ``open_tag``, up to
    the end tag that balances it (all the rest if none does); '' without one."""
    start = F.regexp_instr(html, F.lit(open_tag))
    rest = F.regexp_replace(F.substring(html, start, F.length(html)), rf"(?s)\A<[^>]*>", "")
    parts = F.split(rest, rf"(?i)</{tag}\s*>")
    depth = lambda part: F.regexp_count(part, F.lit(rf"(?i)<{tag}\b"))
    none = F.struct(F.lit("").alias("text"), F.lit(0).alias("open"), F.lit(False).alias("done"))

    def add(seen: Column, part: Column) -> Column:
        left = seen["open"] + depth(part) - 1
        joined = F.when((seen["text"] == "") & (seen["open"] == 0), part).otherwise(
            F.concat(seen["text"], F.lit(f"</{tag}>"), part))
        return F.when(seen["done"], seen).otherwise(
            F.struct(joined.alias("text"), left.cast("int").alias("open"), (left < 0).alias("done")))

    return F.when(start > 0, F.aggregate(parts, none, add, lambda seen: seen["text"])).otherwise("")


CONTENT_TAG = r'(?i)<div\b[^>]*\bclass\s*=\s*["\'][^"\']*\b(?:article-content|post-content|entry-content|content)\b[^"\']*["\'][^>]*>'


def article_text(html: Column, cleaned: bool = False) -> Column:
    """S-10: <article> / class content / <main> text; else paragraphs longer
    than 50 chars joined by a blank line."""
    h = _clean(html, cleaned)
    art = element(h, r"(?i)<article\b[^>]*>", "article")
    cont = element(h, CONTENT_TAG, "div")
    main = element(h, r"(?i)<main\b[^>]*>", "main")
    fallback = F.array_join(F.filter(paragraphs(h, cleaned=True), lambda p: F.length(p) > 50), "\n\n")
    chosen = (F.when(art != "", block_text(art)).when(cont != "", block_text(cont))
              .when(main != "", block_text(main)).otherwise(fallback))
    return clean_text(chosen)


def hrefs(html: Column, cleaned: bool = False) -> Column:
    return F.regexp_extract_all(_clean(html, cleaned),
                                F.lit(r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["']"""), 1)


def links(html: Column, base_url: Column, cleaned: bool = False) -> Column:
    """Absolute, de-duplicated link targets (sorted)."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(hrefs(html, cleaned), lambda x: x != ""),
                                                     lambda x: urljoin(base_url, x))))


def images(html: Column, base_url: Column, cleaned: bool = False) -> Column:
    srcs = F.regexp_extract_all(_clean(html, cleaned),
                                F.lit(r"""(?is)<img\b[^>]*\bsrc\s*=\s*["']([^"']*)["']"""), 1)
    return F.array_sort(F.array_distinct(F.transform(F.filter(srcs, lambda x: x != ""),
                                                     lambda x: urljoin(base_url, x))))


def basic_title(html: Column) -> Column:
    """S-12: first <title> (case-insensitive, dot-all), stripped, else
    'Untitled'."""
    m = F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)
    found = html.rlike(r"(?is)<title>(.*?)</title>")
    return F.when(found, strip_ws(m)).otherwise(F.lit("Untitled"))


def basic_text(html: Column) -> Column:
    """S-12: tags -> space, whitespace runs collapsed, stripped (whole text)."""
    t = F.regexp_replace(html, r"<[^>]+>", " ")
    return strip_ws(F.regexp_replace(t, r"\s+", " "))
