"""Dashboard queries (filters, aggregates, tops) over the canonical views."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions.text import simple_keywords
from ..operators import metrics as M
from . import register

NOW = V.NOW
wv = V.with_views


@register("sentiment_trend", wv(f"""
SELECT situation_id, CAST(ts AS DATE) AS day, round(avg(sentiment), 6) AS avg_sentiment,
       count(*) AS doc_count
FROM sent
WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND sentiment IS NOT NULL
GROUP BY situation_id, CAST(ts AS DATE)""", "sent"))
def sentiment_trend(spark, sf):
    return M.sentiment_trend(V.sent(spark, sf), NOW, days=7)


@register("activity_heatmap", wv(f"""
SELECT situation_id, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS doc_count
FROM docs WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY
GROUP BY ALL""", "docs"))
def activity_heatmap(spark, sf):
    return M.activity_heatmap(V.docs(spark, sf), NOW, days=30)


_pivot_cols = ", ".join(f"CAST(coalesce(sum(CASE WHEN hour = {h} THEN doc_count END), 0) AS BIGINT) AS h{h}"
                        for h in range(24))


@register("heatmap_pivot", wv(f"""
WITH hm AS (
  SELECT situation_id, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS doc_count
  FROM docs WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY GROUP BY ALL)
SELECT situation_id, day, {_pivot_cols} FROM hm GROUP BY situation_id, day""", "docs"))
def heatmap_pivot(spark, sf):
    return M.heatmap_pivot(M.activity_heatmap(V.docs(spark, sf), NOW, days=30))


@register("docs_by_day", wv("""
SELECT situation_id, day, doc_count FROM (
  SELECT situation_id, CAST(ts AS DATE) AS day, count(*) AS doc_count,
         row_number() OVER (PARTITION BY situation_id ORDER BY CAST(ts AS DATE) DESC) AS rn
  FROM docs GROUP BY situation_id, CAST(ts AS DATE)) WHERE rn <= 30""", "docs"))
def docs_by_day(spark, sf):
    return M.docs_by_day(V.docs(spark, sf), newest=30)


@register("alerts_by_severity", wv("""
SELECT situation_id, severity, count(*) AS alert_count FROM alerts_v GROUP BY ALL""", "alerts_v"))
def alerts_by_severity(spark, sf):
    return M.alerts_by_severity(V.alerts(spark, sf))


@register("sentiment_stats", wv("""
SELECT situation_id, round(avg(sentiment), 6) AS avg_sentiment, min(sentiment) AS min_sentiment,
       max(sentiment) AS max_sentiment, count(*) AS n
FROM sent WHERE sentiment IS NOT NULL GROUP BY situation_id""", "sent"))
def sentiment_stats(spark, sf):
    return M.sentiment_stats(V.sent(spark, sf))


@register("sentiment_distribution", wv("""
SELECT situation_id, count(*) FILTER (WHERE sentiment > 0.1) AS positive,
       count(*) FILTER (WHERE sentiment BETWEEN -0.1 AND 0.1) AS neutral,
       count(*) FILTER (WHERE sentiment < -0.1) AS negative
FROM sent WHERE sentiment IS NOT NULL GROUP BY situation_id""", "sent"))
def sentiment_distribution(spark, sf):
    return M.sentiment_distribution(V.sent(spark, sf))


@register("alert_summary", wv(f"""
SELECT count(*) AS total, count(*) FILTER (WHERE NOT acknowledged) AS unacknowledged,
       count(*) FILTER (WHERE severity = 'critical') AS critical,
       count(*) FILTER (WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR) AS last_24h
FROM alerts_v""", "alerts_v"))
def alert_summary(spark, sf):
    return M.alert_summary(V.alerts(spark, sf), NOW)


@register("log_summary", wv("""
SELECT count(*) AS total, count(*) FILTER (WHERE level = 'ERROR') AS errors,
       count(*) FILTER (WHERE level = 'WARNING') AS warnings FROM logs_v""", "logs_v"))
def log_summary(spark, sf):
    return M.log_summary(V.logs(spark, sf))


@register("system_health", wv("""
SELECT s.active_situations, d.total_documents, a.total_alerts, a.unacknowledged_alerts, l.last_error,
       CASE WHEN a.unacknowledged_alerts > 10 THEN 'warning' ELSE 'healthy' END AS status
FROM (SELECT count(*) FILTER (WHERE status = 'active') AS active_situations FROM situations) s,
     (SELECT count(*) AS total_documents FROM docs) d,
     (SELECT count(*) AS total_alerts, count(*) FILTER (WHERE NOT acknowledged) AS unacknowledged_alerts
      FROM alerts_v) a,
     (SELECT max({'ts': ts, 'id': id, 'message': message}).message AS last_error
      FROM logs_v WHERE level = 'ERROR') l""", "situations", "docs", "alerts_v", "logs_v"))
def system_health(spark, sf):
    return M.system_health(V.situations(spark, sf), V.docs(spark, sf), V.alerts(spark, sf), V.logs(spark, sf))


def _j1_children(spark, sf):
    t = lambda n: V.table(spark, sf, n)
    sources = t("conversations").select(F.col("conv_id").alias("situation_id"),
                                        F.concat_ws(":", "conv_id", "turn").alias("id"))
    documents = t("orders").select(F.col("o_custkey").alias("situation_id"), F.col("o_orderkey").alias("id"))
    alerts = t("events").select(F.col("user_id").alias("situation_id"), F.col("event_id").alias("id"))
    return sources, documents, alerts


@register("situation_counts", wv("""
SELECT s.id, s.name, s.status,
       coalesce(src.n, 0) AS source_count, coalesce(d.n, 0) AS document_count, coalesce(a.n, 0) AS alert_count
FROM situations s
LEFT JOIN (SELECT conv_id AS situation_id, count(DISTINCT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)) AS n
           FROM conversations GROUP BY 1) src ON src.situation_id = s.id
LEFT JOIN (SELECT o_custkey AS situation_id, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1) d
       ON d.situation_id = s.id
LEFT JOIN (SELECT user_id AS situation_id, count(DISTINCT event_id) AS n FROM events GROUP BY 1) a
       ON a.situation_id = s.id""", "situations"))
def situation_counts(spark, sf):
    s = V.situations(spark, sf).select("id", "name", "status")
    return M.situation_counts(s, *_j1_children(spark, sf))


@register("latest_situations", wv("""
SELECT id, name, status, updated_at FROM situations ORDER BY updated_at DESC, id DESC LIMIT 100""",
                                  "situations"))
def latest_situations(spark, sf):
    s = V.situations(spark, sf).select("id", "name", "status", "updated_at")
    return M.latest_situations(s, 100)


@register("situation_search", wv("""
SELECT id, name, query, status FROM situations
WHERE status = 'active' AND (name ILIKE '%build%' OR query ILIKE '%build%')""", "situations"))
def situation_search(spark, sf):
    s = V.situations(spark, sf).select("id", "name", "query", "status")
    return M.situations_filter(s, status="active", search="build")


@register("document_search", wv("""
SELECT id, situation_id, source_id, title, ts FROM docs
WHERE (title ILIKE '%ment%' OR content ILIKE '%ment%')
  AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'
ORDER BY ts DESC, id DESC LIMIT 100""", "docs"))
def document_search(spark, sf):
    d = M.documents_filter(V.docs(spark, sf), search="ment", since="2024-01-10 00:00:00",
                           until="2024-01-20 00:00:00")
    return M.page(d.select("id", "situation_id", "source_id", "title", "ts"),
                  [F.col("ts").desc(), F.col("id").desc()], limit=100)


@register("recent_alerts", wv(f"""
SELECT id, situation_id, severity, title, ts FROM alerts_v
WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR ORDER BY ts DESC, id DESC LIMIT 50""", "alerts_v"))
def recent_alerts(spark, sf):
    a = V.alerts(spark, sf).select("id", "situation_id", "severity", "title", "ts")
    return M.recent_alerts(a, NOW, hours=24, limit=50)


@register("alert_page_filter", wv(f"""
SELECT a.id, a.situation_id, s.name AS situation_name, a.severity, a.ts
FROM alerts_v a LEFT JOIN situations s ON s.id = a.situation_id
WHERE a.severity IN ('error', 'critical') AND NOT a.acknowledged
  AND a.ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAY""", "alerts_v", "situations"))
def alert_page_filter(spark, sf):
    a = V.alerts(spark, sf).select("id", "situation_id", "severity", "ts", "acknowledged")
    out = M.alert_page_filter(a, V.situations(spark, sf), severities=["error", "critical"],
                              ack_mode="unacknowledged", cutoff="2024-01-24 00:00:00")
    return out.select("id", "situation_id", "situation_name", "severity", "ts")


@register("error_logs", wv(f"""
SELECT id, ts, level, source, message FROM logs_v
WHERE upper(level) = 'ERROR' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 3 DAY
ORDER BY ts DESC, id DESC LIMIT 100""", "logs_v"))
def error_logs(spark, sf):
    lg = M.logs_filter(V.logs(spark, sf), level="error", since="2024-01-28 00:00:00")
    return M.page(lg, [F.col("ts").desc(), F.col("id").desc()], 100)


@register("log_page_filter", wv("""
SELECT id, ts, level, source, message FROM logs_v
WHERE level IN ('ERROR', 'WARNING') AND contains(lower(source), 'sign') AND contains(lower(message), '"k": 1')""",
                                "logs_v"))
def log_page_filter(spark, sf):
    return M.log_page_filter(V.logs(spark, sf), levels=["ERROR", "WARNING"], source_q="SIGN", message_q='"k": 1')


@register("severity_band", wv("""
SELECT id, severity FROM alerts_v WHERE severity IN ('warning', 'error')""", "alerts_v"))
def severity_band(spark, sf):
    return M.severity_band(V.alerts(spark, sf), "warning", "error").select("id", "severity")


_KW_SQL = """
WITH toks AS (
  SELECT d.id, d.situation_id, d.ts, t.tok, t.pos
  FROM docs d, unnest(regexp_split_to_array(lower(d.content), '[^\\p{L}\\p{N}_]+')) WITH ORDINALITY AS t(tok, pos)
  WHERE regexp_full_match(t.tok, '[a-z]{4,}')
    AND t.tok NOT IN ('this','that','with','from','they','have','been','their','than','what')),
firsts AS (SELECT id, situation_id, ts, tok, min(pos) AS p FROM toks GROUP BY ALL),
doc_kw AS (SELECT id, situation_id, ts, tok FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS r FROM firsts) WHERE r <= 10)
"""


@register("keyword_frequency", wv(_KW_SQL + """
SELECT situation_id, keyword, kw_count, rank FROM (
  SELECT situation_id, tok AS keyword, count(*) AS kw_count,
         row_number() OVER (PARTITION BY situation_id ORDER BY count(*) DESC, tok) AS rank
  FROM doc_kw GROUP BY situation_id, tok) WHERE rank <= 20""", "docs"))
def keyword_frequency(spark, sf):
    d = V.docs(spark, sf).select("situation_id", simple_keywords(F.col("content"), 10).alias("keywords"))
    return M.keyword_frequency(d, top_n=20).select("situation_id", "keyword", "kw_count",
                                                   F.col("rank").cast("bigint").alias("rank"))


@register("volume_by_date", wv(f"""
SELECT CAST(ts AS DATE) AS day, count(*) AS doc_count FROM docs
WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 14 DAY GROUP BY 1""", "docs"))
def volume_by_date(spark, sf):
    return M.volume_by_date(V.docs(spark, sf), NOW, days=14)


@register("open_critical_alerts", wv("""
SELECT id, situation_id, ts FROM alerts_v WHERE NOT acknowledged AND severity = 'critical'""", "alerts_v"))
def open_critical_alerts(spark, sf):
    """F-5: tri-state acknowledged filter + severity."""
    a = V.alerts(spark, sf)
    return M.alerts_filter(a, acknowledged=False, severity="critical").select("id", "situation_id", "ts")


@register("daily_top_keywords", wv(_KW_SQL + """
SELECT situation_id, day, keyword, kw_count, rank FROM (
  SELECT situation_id, CAST(ts AS DATE) AS day, tok AS keyword, count(*) AS kw_count,
         row_number() OVER (PARTITION BY situation_id, CAST(ts AS DATE) ORDER BY count(*) DESC, tok) AS rank
  FROM doc_kw GROUP BY situation_id, CAST(ts AS DATE), tok) WHERE rank <= 5""", "docs"))
def daily_top_keywords(spark, sf):
    """W-4: top 5 keywords per situation and day (A-15's top keywords)."""
    d = V.docs(spark, sf).select(F.col("situation_id").alias("_s"), F.to_date("ts").alias("day"),
                                 simple_keywords(F.col("content"), 10).alias("keywords"))
    d = d.select(F.struct("_s", "day").alias("situation_id"), "keywords")
    out = M.keyword_frequency(d, top_n=5)
    return out.select(F.col("situation_id._s").alias("situation_id"), F.col("situation_id.day").alias("day"),
                      "keyword", "kw_count", F.col("rank").cast("bigint").alias("rank"))
