"""Collection-stage queries: de-duplication, change detection, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions.ids import content_hash, netloc
from ..operators import dedup as D
from ..operators import extract as X
from ..operators.known import KnownContent
from ..session import scratch_folder
from . import register

wv = V.with_views

HASH_SQL = ("CASE WHEN coalesce({c}, '') = '' THEN '' "
            "ELSE sha256(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))) END")


@register("content_dedup", wv(f"""
WITH h AS (SELECT id, ts, source_id, {HASH_SQL.format(c='content')} AS content_hash FROM docs)
SELECT id, ts, source_id, content_hash,
       CASE WHEN content_hash = '' THEN 'rejected'
            WHEN row_number() OVER (PARTITION BY content_hash ORDER BY ts, id) = 1 THEN 'kept'
            ELSE 'duplicate' END AS status
FROM h""", "docs"))
def content_dedup(spark, sf):
    d = V.docs(spark, sf).select("id", "ts", "source_id", "content")
    return D.content_dedup(d).drop("content")


@register("story_collapse", wv(f"""
WITH h AS (SELECT id, ts, source_id, {HASH_SQL.format(c='content')} AS content_hash FROM docs)
SELECT content_hash, min(ts) AS first_seen, count(DISTINCT source_id) AS source_count, count(*) AS copies
FROM h WHERE content_hash <> '' GROUP BY content_hash""", "docs"))
def story_collapse(spark, sf):
    return D.story_collapse(V.docs(spark, sf).select("id", "ts", "source_id", "content"))


@register("url_changes", wv("""
SELECT id, url, ts, content_hash,
       coalesce(lag(content_hash) OVER w <> content_hash, true) AS changed
FROM versions WINDOW w AS (PARTITION BY url ORDER BY ts, id)""", "versions"))
def url_changes(spark, sf):
    return D.url_changes(V.versions(spark, sf), bucket="day")


@register("fresh_content", wv(f"""
WITH h AS (SELECT id, ts, {HASH_SQL.format(c='content')} AS content_hash FROM docs)
SELECT n.id, n.content_hash FROM h n
WHERE n.ts >= TIMESTAMP '2024-01-25 00:00:00' AND n.content_hash <> ''
  AND NOT EXISTS (SELECT 1 FROM h k WHERE k.ts < TIMESTAMP '2024-01-25 00:00:00' AND k.content_hash = n.content_hash)
""", "docs"))
def fresh_content(spark, sf):
    h = V.docs(spark, sf).select("id", "ts", content_hash(F.col("content")).alias("content_hash"))
    cut = V.ntz("2024-01-25 00:00:00")
    batch = h.where((F.col("ts") >= cut) & (F.col("content_hash") != ""))
    known = h.where(F.col("ts") < cut)
    return D.unseen(batch, known, "content_hash").select("id", "content_hash")


@register("known_content", wv(f"""
WITH h AS (SELECT id, ts, {HASH_SQL.format(c='content')} AS content_hash FROM docs),
r AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY ts, id) AS rn FROM h WHERE content_hash <> '')
SELECT id, content_hash, CASE WHEN ts < TIMESTAMP '2024-01-10 00:00:00' THEN 0 WHEN ts < TIMESTAMP '2024-01-25 00:00:00' THEN 1 ELSE 2 END AS loaded_in
FROM r WHERE rn = 1""", "docs"))
def known_content(spark, sf):
    """J-8 / X-2 / W-1: three loads of documents against a store of known hashes; the documents that each brought."""
    h = V.docs(spark, sf).select("id", "ts", content_hash(F.col("content")).alias("content_hash"))
    first, second = V.ntz("2024-01-10 00:00:00"), V.ntz("2024-01-25 00:00:00")
    store, ts = KnownContent(spark, scratch_folder(spark, "known-content")), F.col("ts")
    loads = [h.where(ts < first), h.where((ts >= first) & (ts < second)), h.where(ts >= second)]
    new = [store.load(b, ["ts", "id"]).select("id", "content_hash", F.lit(n).alias("loaded_in")) for n, b in enumerate(loads)]
    return new[0].unionByName(new[1]).unionByName(new[2])


@register("basic_extract", wv("""
SELECT id, url,
       CASE WHEN regexp_matches(raw_html, '(?is)<title>(.*?)</title>')
            THEN regexp_replace(regexp_extract(raw_html, '(?is)<title>(.*?)</title>', 1), '^\\s+|\\s+$', '', 'g')
            ELSE 'Untitled' END AS title,
       regexp_replace(regexp_replace(regexp_replace(raw_html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'),
                      '^\\s+|\\s+$', '', 'g') AS text
FROM raw_pages""", "raw_pages"))
def basic_extract(spark, sf):
    return X.basic_extract(V.raw_pages(spark, sf))


def urljoin_sql(base: str, href: str) -> str:
    """SQL twin of topicwatch.functions.ids.urljoin."""
    h = f"regexp_replace({href}, '^\\s+|\\s+$', '', 'g')"
    scheme = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)"
    origin = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1)"
    no_frag = f"regexp_replace({base}, '#.*$', '')"
    no_query = f"regexp_replace({no_frag}, '\\?.*$', '')"
    path = f"regexp_extract({no_query}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*(/.*)?$', 1)"
    directory = (f"CASE WHEN {path} = '' THEN {origin} || '/' "
                 f"ELSE {origin} || regexp_replace({path}, '[^/]*$', '') END")
    return (f"CASE WHEN regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN {h} "
            f"WHEN starts_with({h}, '//') THEN {scheme} || ':' || {h} "
            f"WHEN starts_with({h}, '/') THEN {origin} || {h} "
            f"WHEN starts_with({h}, '?') THEN {no_query} || {h} "
            f"WHEN starts_with({h}, '#') THEN {no_frag} || {h} "
            f"WHEN {h} = '' THEN {base} "
            f"ELSE ({directory}) || {h} END")


NOISE_SQL = "regexp_replace(raw_html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g')"


@register("page_links", wv(f"""
WITH hrefs AS (
  SELECT url AS src_url, unnest(regexp_extract_all({NOISE_SQL},
         '(?is)<a\\b[^>]*\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href
  FROM raw_pages)
SELECT DISTINCT src_url, {urljoin_sql('src_url', 'href')} AS dst_url FROM hrefs WHERE href <> ''""",
                             "raw_pages"))
def page_links(spark, sf):
    return X.page_links(V.raw_pages(spark, sf))


@register("page_extract")
def page_extract(spark, sf):
    """P-13 full extraction; checked by unit tests against fixtures."""
    e = X.extract_pages(V.raw_pages(spark, sf))
    return e.select("id", "url", "title", "author", "publish_date", "article_text",
                    F.array_join("links", " ").alias("links"), F.size("images").alias("image_count"),
                    "content_hash", "doc_id")


@register("domain_counts", wv("""
SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)) AS domain, count(*) AS pages
FROM raw_pages GROUP BY 1""", "raw_pages"))
def domain_counts(spark, sf):
    p = V.raw_pages(spark, sf)
    return p.groupBy(netloc(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("pages"))


@register("distinct_sources", wv("""
WITH n AS (SELECT id, url,
  regexp_replace(CASE WHEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)(.*)$', 1) = '' THEN url
       ELSE lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)(.*)$', 1))
            || regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)(.*)$', 2) END, '/+$', '') AS url_norm
  FROM raw_pages)
SELECT url_norm, min(id) AS id FROM n GROUP BY url_norm""", "raw_pages"))
def distinct_sources(spark, sf):
    p = V.raw_pages(spark, sf).select("id", "url")
    return D.dedup_sources(p).select("url_norm", "id")
