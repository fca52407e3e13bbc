"""Queries on found sources (pages) and on documents' topic/readability."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions import text as TX
from ..functions.timecols import age_label
from ..operators import discovery as DS
from ..operators import metrics as M
from ..operators import textops as TO
from . import register
from .dashboard import _KW_SQL
from .text import _NEG, _POS, _STOP_LIST, WORDS_SQL

NOW = V.NOW
wv = V.with_views

CATEGORY_SQL = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*/([^/?#]+)', 1)"


def _page_sources(spark, sf):
    p = V.raw_pages(spark, sf)
    return p.select("id", "url", "raw_html",
                    F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]+)", 1).alias("category"))


@register("sources_per_category", wv(f"""
SELECT id, url, category FROM (
  SELECT id, url, {CATEGORY_SQL} AS category,
         row_number() OVER (PARTITION BY {CATEGORY_SQL} ORDER BY id) AS rn FROM raw_pages) WHERE rn <= 3""",
                                     "raw_pages"))
def sources_per_category(spark, sf):
    return DS.limit_per_category(_page_sources(spark, sf).drop("raw_html"), 3)


@register("preferred_sources", wv(f"""
SELECT id, url, {CATEGORY_SQL} AS category FROM raw_pages
WHERE {CATEGORY_SQL} IN ('en', 'fr') AND {CATEGORY_SQL} NOT IN ('de')""", "raw_pages"))
def preferred_sources(spark, sf):
    s = _page_sources(spark, sf).drop("raw_html")
    cats = lambda xs: spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in xs])).alias("category"))  # noqa
    return DS.by_preferences(DS.by_preferences(s, cats(["en", "fr"]), True), cats(["de"]), False)


@register("source_credibility", wv("""
WITH p AS (SELECT id, url, coalesce(regexp_matches(raw_html, '(?i)(paywall|subscribe to read|subscribers only|premium content)'), false) AS is_paywalled,
           CASE WHEN regexp_matches(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)), ':\\d+$', ''), '\\.(edu|gov)$')
                THEN 0.9 ELSE 0.7 END AS authority FROM raw_pages)
SELECT id, url, is_paywalled, CASE WHEN is_paywalled THEN least(authority, 0.6) ELSE authority END AS credibility_score,
       CASE WHEN (CASE WHEN is_paywalled THEN least(authority, 0.6) ELSE authority END) >= 0.8 THEN 'high'
            WHEN (CASE WHEN is_paywalled THEN least(authority, 0.6) ELSE authority END) >= 0.5 THEN 'medium'
            ELSE 'low' END AS credibility_label
FROM p""", "raw_pages"))
def source_credibility(spark, sf):
    return DS.with_credibility(V.raw_pages(spark, sf)).select("id", "url", "is_paywalled", "credibility_score",
                                                               "credibility_label")


@register("situation_topics", wv(f"""
WITH u AS (SELECT situation_id, id, t.tok, t.pos FROM docs,
           unnest(list_filter({WORDS_SQL.format(c='content')},
                  lambda x: regexp_full_match(x, '\\p{{L}}{{3,}}') AND NOT list_contains({_STOP_LIST}, x)))
           WITH ORDINALITY AS t(tok, pos)),
b AS (SELECT a.situation_id, a.tok || ' ' || b.tok AS topic FROM u a JOIN u b ON a.id = b.id AND b.pos = a.pos + 1),
g AS (SELECT situation_id, topic, count(*) AS n FROM b GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY situation_id ORDER BY n DESC, topic) AS rank FROM g)
WHERE rank <= 5""", "docs"))
def situation_topics(spark, sf):
    out = DS.topics(V.docs(spark, sf).select("situation_id", "content"), 5)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@register("document_relevance", wv(_KW_SQL + """
, sk AS (SELECT situation_id, tok FROM (
    SELECT situation_id, tok, row_number() OVER (PARTITION BY situation_id ORDER BY count(*) DESC, tok) AS r
    FROM doc_kw GROUP BY situation_id, tok) WHERE r <= 20),
nk AS (SELECT situation_id, count(*) AS n FROM sk GROUP BY 1),
hit AS (SELECT d.id, count(*) AS h FROM doc_kw d JOIN sk ON sk.situation_id = d.situation_id AND sk.tok = d.tok GROUP BY 1)
SELECT d.id, d.situation_id, CAST(coalesce(hit.h, 0) AS DOUBLE) / nk.n AS relevance_score
FROM docs d JOIN nk ON nk.situation_id = d.situation_id LEFT JOIN hit ON hit.id = d.id""", "docs"))
def document_relevance(spark, sf):
    d = V.docs(spark, sf).select("id", "situation_id", TX.simple_keywords(F.col("content"), 10).alias("keywords"))
    top = M.keyword_frequency(d, top_n=20).groupBy("situation_id").agg(F.collect_list("keyword").alias("keywords"))
    return DS.relevance(d, top).select("id", "situation_id", "relevance_score")


@register("readability", wv(f"""
SELECT id, CASE WHEN len({WORDS_SQL.format(c='content')}) > 0 THEN round(206.835
   - 1.015 * (len({WORDS_SQL.format(c='content')}) / greatest(len(regexp_extract_all(content, '[^.!?]+[.!?]*', 0)), 1))
   - 84.6 * (len(regexp_extract_all(lower(content), '[aeiouy]+', 0)) / len({WORDS_SQL.format(c='content')})), 6) END
   AS readability FROM docs""", "docs"))
def readability(spark, sf):
    return V.docs(spark, sf).select("id", DS.readability(F.col("content")).alias("readability"))


@register("alert_documents", wv("""
SELECT a.id, a.document_id, d.title AS document_title FROM alerts_v a LEFT JOIN docs d ON d.id = a.document_id""",
                                "alerts_v", "docs"))
def alert_documents(spark, sf):
    a = V.alerts(spark, sf).select("id", "document_id")
    d = V.docs(spark, sf).select(F.col("id").alias("document_id"), F.col("title").alias("document_title"))
    return a.join(d, "document_id", "left").select("id", "document_id", "document_title")


@register("document_cards", wv(f"""
WITH s AS (SELECT id, title, content, ts, {_POS} AS p, {_NEG} AS n FROM docs),
c AS (SELECT *, date_sub('second', ts, TIMESTAMP '{NOW}') AS secs,
             CASE WHEN length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) = 0 THEN NULL WHEN p + n = 0 THEN 0.0
                  ELSE CAST(p - n AS DOUBLE) / (p + n) END AS score FROM s)
SELECT id, coalesce(title, 'Untitled') AS title,
       CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS preview,
       CASE WHEN secs < 60 THEN 'Just now' WHEN secs < 3600 THEN CAST(secs // 60 AS VARCHAR) || 'm ago'
            WHEN secs < 86400 THEN CAST(secs // 3600 AS VARCHAR) || 'h ago' WHEN secs // 86400 = 1 THEN 'Yesterday'
            WHEN secs // 86400 < 7 THEN CAST(secs // 86400 AS VARCHAR) || 'd ago' ELSE strftime(ts, '%Y-%m-%d') END
         AS age,
       CASE WHEN score IS NULL THEN 'Unknown' WHEN score > 0.5 THEN 'Very Positive' WHEN score > 0.1 THEN 'Positive'
            WHEN score < -0.5 THEN 'Very Negative' WHEN score < -0.1 THEN 'Negative' ELSE 'Neutral' END AS sentiment_label
FROM c""", "docs"))
def document_cards(spark, sf):
    d = V.docs(spark, sf)
    return d.select("id", F.coalesce("title", F.lit("Untitled")).alias("title"),
                    TX.preview(F.col("content"), 200).alias("preview"),
                    age_label(F.col("ts"), V.ntz(NOW)).alias("age"),
                    TX.sentiment_label(TX.lexicon_score(F.col("content")), "utils").alias("sentiment_label"))
