"""Row-level forms of operators that other queries only use in passing: single
documents, presets, pages, labels, identifiers, flags and per-alert deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions import ids as I
from ..functions import text as TX
from ..functions.timecols import in_custom_days, in_preset
from ..operators import alerts as AL
from ..operators import discovery as DS
from ..operators import health as H
from ..operators import metrics as M
from ..operators import quality as Q
from ..sources.readers import decode_json_list, json_map_value
from . import register
from .text import _EMPTY, _NEG, _POS
from .trends import ENTITY_SQL

NOW = V.NOW
wv = V.with_views


@register("document_by_id", wv("SELECT id, situation_id, source_id, title, ts FROM docs WHERE id = 3", "docs"))
def document_by_id(spark, sf):
    """F-4."""
    return M.document_by_id(V.docs(spark, sf), 3).select("id", "situation_id", "source_id", "title", "ts")


@register("preset_windows", wv(f"""
SELECT id, ts >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AS last_24h, ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AS last_7d,
       ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13' AS custom_days, true AS all_time FROM docs""", "docs"))
def preset_windows(spark, sf):
    """F-10: which filter windows hold each document."""
    now = V.ntz(NOW)
    return V.docs(spark, sf).select(
        "id", in_preset(F.col("ts"), now, "24h").alias("last_24h"), in_preset(F.col("ts"), now, "7d").alias("last_7d"),
        in_custom_days(F.col("ts"), "2024-01-10", "2024-01-12").alias("custom_days"),
        in_preset(F.col("ts"), now, "all").alias("all_time"))


def _found(spark, sf):
    """Pages as found sources with settings derived from their id."""
    return V.raw_pages(spark, sf).select(
        "id", "url", F.when(F.col("id") % 7 != 0, F.col("id") % 3 != 0).alias("enabled"),
        ((F.col("id") * 37) % 100 / F.lit(100.0)).alias("relevance_score"), (F.col("id") % 2 == 0).alias("has_keywords"))


@register("enabled_sources", wv("SELECT id, url FROM raw_pages WHERE id % 7 <> 0 AND id % 3 <> 0", "raw_pages"))
def enabled_sources(spark, sf):
    """F-11."""
    return M.enabled_only(_found(spark, sf)).select("id", "url")


@register("relevant_sources", wv("""
SELECT id, url, relevance_score FROM (SELECT id, url, (id * 37) % 100 / 100.0 AS relevance_score, id % 2 = 0 AS k FROM raw_pages)
WHERE relevance_score * CASE WHEN k THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END > 0.5""", "raw_pages"))
def relevant_sources(spark, sf):
    """L-5."""
    return DS.relevant_sources(_found(spark, sf)).select("id", "url", "relevance_score")


_LABELS = ["PERSON", "ORG", "GPE", "PRODUCT", "LOC"]


@register("entity_labels", wv(f"""
WITH e AS (SELECT conv_id, turn, {ENTITY_SQL.format(c='text')} AS ents FROM requests)
SELECT conv_id, turn,
       array_to_string(list_filter(ents, lambda x: length(x) % 5 IN (2, 4)), ',') AS geography,
       len(list_distinct(list_filter(ents, lambda x: length(x) % 5 < 4))) AS kept
FROM e""", "requests"))
def entity_labels(spark, sf):
    """F-18 / F-19 over phrases labelled by their length."""
    labels = F.array(*[F.lit(x) for x in _LABELS])
    ents = F.transform(TX.capitalised_phrases(F.col("text")), lambda e: F.struct(
        e.alias("text"), F.element_at(labels, F.length(e) % 5 + 1).alias("label")))
    r = V.requests(spark, sf).select("conv_id", "turn", ents.alias("entities"))
    return r.select("conv_id", "turn", F.array_join(M.geography(F.col("entities")), ",").alias("geography"),
                    F.size(M.kept_entity_labels(F.col("entities"))).cast("bigint").alias("kept"))


@register("situation_page", wv("SELECT id, name, updated_at FROM situations ORDER BY updated_at DESC, id DESC LIMIT 10 OFFSET 20",
                               "situations"))
def situation_page(spark, sf):
    """L-2, offset form."""
    s = V.situations(spark, sf).select("id", "name", "updated_at")
    return M.page(s, [F.col("updated_at").desc(), F.col("id").desc()], 10, 20)


@register("alert_keyset_page", wv("""
SELECT id, ts, severity FROM alerts_v WHERE ts < TIMESTAMP '2024-01-20' OR (ts = TIMESTAMP '2024-01-20' AND id < 500)
ORDER BY ts DESC, id DESC LIMIT 25""", "alerts_v"))
def alert_keyset_page(spark, sf):
    """L-2, keyset form."""
    return M.keyset_page(V.alerts(spark, sf).select("id", "ts", "severity"), "2024-01-20 00:00:00", 500, 25)


@register("alerts_of_situation", wv("""
SELECT a.id, a.situation_id, s.name AS situation_name, a.severity FROM alerts_v a
JOIN (SELECT min(id) AS id, name FROM situations WHERE name = 'Customer#000000007' GROUP BY name) s ON s.id = a.situation_id""",
                                    "alerts_v", "situations"))
def alerts_of_situation(spark, sf):
    """J-9 / F-9: alerts of a situation given by name."""
    out = M.alert_page_filter(V.alerts(spark, sf), V.situations(spark, sf), situation_name="Customer#000000007")
    return out.select("id", "situation_id", "situation_name", "severity")


@register("page_ids", wv("""
SELECT id, substr(sha256(url || ':' || CAST(id AS VARCHAR)), 1, 16) AS document_id, sha256(raw_html) AS html_sha256
FROM raw_pages""", "raw_pages"))
def page_ids(spark, sf):
    """S-2 / S-3."""
    return V.raw_pages(spark, sf).select("id", I.doc_id(F.col("url"), F.col("id")).alias("document_id"),
                                         I.sha256_hex(F.col("raw_html")).alias("html_sha256"))


@register("request_searches", wv(f"""
SELECT conv_id, turn, array_to_string(list_concat(['monitor'], {ENTITY_SQL.format(c='text')}), ' ') AS query FROM requests""",
                                 "requests"))
def request_searches(spark, sf):
    """S-26: the search text of each request."""
    return V.requests(spark, sf).select(
        "conv_id", "turn", TX.search_query(F.array(F.lit("monitor")), TX.capitalised_phrases(F.col("text"))).alias("query"))


@register("json_settings", """
SELECT event_id AS id, event_type AS kind, CAST(user_id AS VARCHAR) AS owner, NULL::VARCHAR AS absent,
       len([event_type, 'x']) AS tags FROM events""")
def json_settings(spark, sf):
    """S-31 / SRC-6: values and lists read back from JSON texts."""
    e = V.table(spark, sf, "events")
    e = e.select(F.col("event_id").alias("id"),
                 F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("owner"))).alias("j"),
                 F.to_json(F.array("event_type", F.lit("x"))).alias("l"))
    return e.select("id", json_map_value(F.col("j"), "kind").alias("kind"), json_map_value(F.col("j"), "owner").alias("owner"),
                    json_map_value(F.col("j"), "none").alias("absent"),
                    F.size(decode_json_list(F.col("l"))).cast("bigint").alias("tags"))


@register("flagged_documents", wv("SELECT id, coalesce(content, '') <> '' AND coalesce(source_id, '') <> '' AS is_valid FROM docs",
                                  "docs"))
def flagged_documents(spark, sf):
    """DQ-7."""
    return Q.flag_bad_rows(V.docs(spark, sf).select("id", "content", "source_id"), ["content", "source_id"]).select("id", "is_valid")


@register("document_analyses", wv("""
SELECT d.id, d.situation_id, d.source_id, s.sentiment, s.ts AS analysed_at, s.id IS NOT NULL AS analysed
FROM docs d LEFT JOIN sent s ON s.id = d.id""", "docs", "sent"))
def document_analyses(spark, sf):
    """J-7: every document with its stored analysis, if it has one."""
    a = V.sent(spark, sf).select("id", "sentiment", F.col("ts").alias("analysed_at"), F.lit(True).alias("analysed"))
    d = V.docs(spark, sf).select("id", "situation_id", "source_id")
    return d.join(a, "id", "left").withColumn("analysed", F.coalesce("analysed", F.lit(False)))


@register("execution_log", wv("""
SELECT source_id, id, ts, rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, id DESC) AS rank
                                     FROM fetch_log WHERE ok) WHERE rank <= 100""", "fetch_log"))
def execution_log(spark, sf):
    """W-6: the last 100 successful executions of each source, as rows."""
    return H.last_executions(V.fetch_log(spark, sf), 100).withColumn("rank", F.col("rank").cast("bigint"))


@register("simple_alerts", wv(f"""
WITH h AS (SELECT id, {_POS} AS p, {_NEG} AS n, {_EMPTY} AS empty, len(list_distinct({ENTITY_SQL.format(c='content')})) AS entities
           FROM docs)
SELECT id, entities AS entity_count,
       (CASE WHEN empty OR p + n = 0 THEN 0.0 ELSE abs(CAST(p - n AS DOUBLE) / (p + n)) END > 0.8) OR entities > 5 AS alert
FROM h""", "docs"))
def simple_alerts(spark, sf):
    """S-18: strong sentiment or more than five entities."""
    d = V.docs(spark, sf).select("id", "content", F.size(F.array_distinct(TX.capitalised_phrases(F.col("content")))).alias("n"))
    score = F.coalesce(TX.lexicon_score(F.col("content")), F.lit(0.0))
    return d.select("id", F.col("n").cast("bigint").alias("entity_count"), AL.should_alert_simple(score, F.col("n")).alias("alert"))
