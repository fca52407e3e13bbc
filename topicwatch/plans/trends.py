"""Trend, shift, spike and rollup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions.text import capitalised_phrases, simple_keywords
from ..operators import metrics as M
from ..operators import trends as T
from . import register
from .dashboard import _KW_SQL

NOW = V.NOW
wv = V.with_views

ENTITY_SQL = (r"regexp_extract_all(regexp_replace(regexp_replace({c}, '[^\x00-\x7F\P{{L}}]', '0', 'g'), "
              r"'[^\x00-\x7F\P{{N}}]', '0', 'g'), '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b', 0)")


@register("trend_change", f"""
WITH agg AS (
  SELECT user_id AS situation_id, event_type AS keyword,
         sum(value) FILTER (WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR) AS cur,
         sum(value) FILTER (WHERE ts <= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR) AS previous
  FROM events WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 48 HOUR AND ts <= TIMESTAMP '{NOW}'
  GROUP BY ALL),
r AS (SELECT situation_id, keyword, coalesce(cur, 0) AS cur, previous,
             round((coalesce(cur, 0) - previous) / previous * 100, 6) AS pct_change
      FROM agg WHERE previous > 0)
SELECT situation_id, keyword, round(cur, 6) AS current, round(previous, 6) AS previous, pct_change,
       CASE WHEN pct_change > 0 THEN 'increasing' ELSE 'decreasing' END AS direction
FROM r WHERE abs(pct_change) >= 25""")
def trend_change(spark, sf):
    pts = V.table(spark, sf, "events").select(F.col("user_id").alias("situation_id"),
                                               F.col("event_type").alias("keyword"), "ts", "value")
    return T.trend_change(pts, NOW, hours=24, threshold_pct=25.0, keys=["situation_id", "keyword"])


@register("volume_spikes", """
WITH c AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL),
span AS (SELECT event_type, min(hour) AS lo, max(hour) AS hi FROM c GROUP BY 1),
cal AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour FROM span),
s AS (SELECT cal.event_type, cal.hour, coalesce(c.n, 0) AS n FROM cal LEFT JOIN c
      ON c.event_type = cal.event_type AND c.hour = cal.hour),
w AS (SELECT *, avg(n) OVER win AS baseline, stddev_samp(n) OVER win AS sd, count(*) OVER win AS cnt
      FROM s WINDOW win AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT event_type, hour, n AS doc_count, round(baseline, 6) AS baseline, round((n - baseline) / sd, 6) AS z_score
FROM w WHERE cnt = 24 AND sd > 0 AND round((n - baseline) / sd, 6) >= 3""")
def volume_spikes(spark, sf):
    ev = V.table(spark, sf, "events").select("event_type", "ts")
    return T.volume_spikes(ev, ["event_type"], lookback=24, z_threshold=3.0)


@register("sentiment_shift", wv("""
WITH d AS (SELECT situation_id, CAST(ts AS DATE) AS day, round(avg(sentiment), 6) AS avg_value
           FROM sent WHERE sentiment IS NOT NULL GROUP BY ALL),
l AS (SELECT *, lag(avg_value) OVER (PARTITION BY situation_id ORDER BY day) AS prev_avg FROM d)
SELECT situation_id, day, avg_value AS avg_sentiment, prev_avg, round(avg_value - prev_avg, 6) AS shift,
       CASE WHEN abs(round(avg_value - prev_avg, 6)) >= 0.5 THEN 'high' ELSE 'medium' END AS severity
FROM l WHERE abs(round(avg_value - prev_avg, 6)) >= 0.3""", "sent"))
def sentiment_shift(spark, sf):
    return T.sentiment_shift(V.sent(spark, sf), threshold=0.3, high=0.5)


@register("trend_direction", """
WITH d AS (SELECT user_id AS situation_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL),
g AS (SELECT situation_id, count(*) AS points, regr_slope(n, x) AS s, corr(n, x) AS c, var_samp(n) AS vy
      FROM (SELECT *, CAST(day - DATE '2024-01-01' AS DOUBLE) AS x FROM d) GROUP BY 1),
r AS (SELECT situation_id, points, round(s, 6) AS slope,
             CASE WHEN vy = 0 THEN 0.0 ELSE round(abs(c), 6) END AS strength FROM g WHERE points >= 3)
SELECT *, CASE WHEN strength >= 0.3 AND slope > 0 THEN 'increasing'
               WHEN strength >= 0.3 AND slope < 0 THEN 'decreasing' ELSE 'stable' END AS direction FROM r""")
def trend_direction(spark, sf):
    ev = V.table(spark, sf, "events")
    daily = ev.groupBy(F.col("user_id").alias("situation_id"), F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"))
    return T.trend_direction(daily, ["situation_id"], value="n")


@register("metric_change", """
WITH c AS (SELECT event_type AS metric, count(*) AS v FROM events
           WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1),
p AS (SELECT event_type AS metric, count(*) AS v FROM events
      WHERE ts >= TIMESTAMP '2024-01-17 00:00:00' AND ts < TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1)
SELECT coalesce(c.metric, p.metric) AS metric, c.v AS current, p.v AS previous,
       CASE WHEN p.v > 0 THEN round((c.v - p.v) / p.v * 100, 6) END AS pct_change
FROM c FULL OUTER JOIN p ON c.metric = p.metric""")
def metric_change(spark, sf):
    ev = V.table(spark, sf, "events")

    def period(lo, hi):
        return (ev.where((F.col("ts") >= V.ntz(lo)) & (F.col("ts") < V.ntz(hi)))
                .groupBy(F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).alias("value")))
    return T.metric_change(period("2024-01-24 00:00:00", "2024-01-31 00:00:00"),
                           period("2024-01-17 00:00:00", "2024-01-24 00:00:00"))


def _mentions(spark, sf):
    d = V.docs(spark, sf).select("situation_id", "id", "ts", "content")
    return T.entity_mentions(d, capitalised_phrases(F.col("content")))


_MENTIONS_SQL = f"""
WITH m AS (SELECT DISTINCT situation_id, id, ts, e AS entity
           FROM docs, unnest({ENTITY_SQL.format(c='content')}) AS t(e))
"""


@register("new_entities", wv(_MENTIONS_SQL + f"""
SELECT situation_id, entity, count(*) AS mentions, min(ts) AS first_seen
FROM m p
WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{NOW}'
  AND NOT EXISTS (SELECT 1 FROM m h WHERE h.situation_id = p.situation_id AND h.entity = p.entity
                  AND h.ts <= TIMESTAMP '{NOW}' - INTERVAL 7 DAY)
GROUP BY situation_id, entity""", "docs"))
def new_entities(spark, sf):
    return T.new_entities(_mentions(spark, sf), NOW, days=7)


@register("entity_history", wv(_MENTIONS_SQL + """
SELECT entity, count(*) AS mentions, min(ts) AS first_seen, max(ts) AS last_seen FROM m GROUP BY entity""",
                               "docs"))
def entity_history(spark, sf):
    return T.entity_history(_mentions(spark, sf))


_TIMELINE_SQL = f"""
WITH tl AS (SELECT situation_id, CAST(ts AS DATE) AS day, e AS entity, count(*) AS mentions
            FROM docs, unnest({ENTITY_SQL.format(c='content')}) AS t(e)
            WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY GROUP BY ALL)
"""


@register("entity_timeline", wv(_TIMELINE_SQL + "SELECT * FROM tl", "docs"))
def entity_timeline(spark, sf):
    d = V.docs(spark, sf).select("situation_id", "ts", capitalised_phrases(F.col("content")).alias("entities"))
    return M.entity_timeline(d, NOW, days=7)


@register("top_entity_timeline", wv(_TIMELINE_SQL + """
, tot AS (SELECT situation_id, entity, row_number() OVER (PARTITION BY situation_id
          ORDER BY sum(mentions) DESC, entity) AS r FROM tl GROUP BY situation_id, entity)
SELECT tl.* FROM tl JOIN tot ON tot.situation_id = tl.situation_id AND tot.entity = tl.entity WHERE tot.r <= 10""",
                                    "docs"))
def top_entity_timeline(spark, sf):
    d = V.docs(spark, sf).select("situation_id", "ts", capitalised_phrases(F.col("content")).alias("entities"))
    return M.top_entity_timeline(M.entity_timeline(d, NOW, days=7), n=10)


@register("keyword_spikes", wv(_KW_SQL + f"""
, g AS (SELECT situation_id, tok AS keyword,
         count(*) FILTER (WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS current,
         count(*) FILTER (WHERE ts <= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS previous
       FROM doc_kw WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 14 DAY AND ts <= TIMESTAMP '{NOW}' GROUP BY ALL)
SELECT * FROM g WHERE (previous > 0 AND current >= previous * 2.0) OR (previous = 0 AND current >= 3)""", "docs"))
def keyword_spikes(spark, sf):
    d = V.docs(spark, sf).select("situation_id", "ts", simple_keywords(F.col("content"), 10).alias("keywords"))
    return T.keyword_spikes(d, NOW, days=7, factor=2.0, min_new=3)


@register("daily_metrics", wv("""
WITH d AS (SELECT situation_id, CAST(ts AS DATE) AS day, count(*) AS documents, count(DISTINCT source_id) AS sources
           FROM docs GROUP BY ALL),
s AS (SELECT situation_id, CAST(ts AS DATE) AS day, round(avg(sentiment), 6) AS avg_sentiment,
             count(*) FILTER (WHERE sentiment > 0.1) AS positive, count(*) FILTER (WHERE sentiment < -0.1) AS negative,
             count(*) FILTER (WHERE sentiment BETWEEN -0.1 AND 0.1) AS neutral
      FROM sent WHERE sentiment IS NOT NULL GROUP BY ALL),
a AS (SELECT situation_id, CAST(ts AS DATE) AS day, count(*) AS alerts FROM alerts_v GROUP BY ALL),
ds AS (SELECT coalesce(d.situation_id, s.situation_id) AS situation_id, coalesce(d.day, s.day) AS day,
              d.documents, d.sources, s.avg_sentiment, s.positive, s.negative, s.neutral
       FROM d FULL OUTER JOIN s ON d.situation_id = s.situation_id AND d.day = s.day)
SELECT coalesce(ds.situation_id, a.situation_id) AS situation_id, coalesce(ds.day, a.day) AS day,
       coalesce(documents, 0) AS documents, coalesce(sources, 0) AS sources, avg_sentiment,
       coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative, coalesce(neutral, 0) AS neutral,
       coalesce(alerts, 0) AS alerts
FROM ds FULL OUTER JOIN a ON ds.situation_id = a.situation_id AND ds.day = a.day""", "docs", "sent", "alerts_v"))
def daily_metrics(spark, sf):
    return T.daily_metrics(V.docs(spark, sf), V.sent(spark, sf), V.alerts(spark, sf))


@register("daily_digest", wv(_KW_SQL + f"""
, v AS (SELECT situation_id, CAST(ts AS DATE) AS day, 'keywords' AS kind, tok AS value FROM doc_kw
        UNION ALL SELECT situation_id, CAST(ts AS DATE), 'entities', unnest({ENTITY_SQL.format(c='content')}) FROM docs),
top AS (SELECT *, row_number() OVER (PARTITION BY situation_id, day, kind ORDER BY n DESC, value) AS r
        FROM (SELECT situation_id, day, kind, value, count(*) AS n FROM v GROUP BY ALL)),
tops AS (SELECT situation_id, day, coalesce(string_agg(value, ', ' ORDER BY r) FILTER (WHERE kind = 'keywords'), '') AS top_keywords,
                coalesce(string_agg(value, ', ' ORDER BY r) FILTER (WHERE kind = 'entities'), '') AS top_entities
         FROM top WHERE r <= 5 GROUP BY situation_id, day),
d AS (SELECT situation_id, CAST(ts AS DATE) AS day, count(*) AS documents, count(DISTINCT source_id) AS sources FROM docs GROUP BY ALL),
a AS (SELECT situation_id, CAST(ts AS DATE) AS day, count(*) AS alerts FROM alerts_v GROUP BY ALL),
da AS (SELECT coalesce(d.situation_id, a.situation_id) AS situation_id, coalesce(d.day, a.day) AS day, coalesce(documents, 0) AS documents,
              coalesce(sources, 0) AS sources, coalesce(alerts, 0) AS alerts
       FROM d FULL OUTER JOIN a ON d.situation_id = a.situation_id AND d.day = a.day)
SELECT da.*, coalesce(top_keywords, '') AS top_keywords, coalesce(top_entities, '') AS top_entities
FROM da LEFT JOIN tops ON tops.situation_id = da.situation_id AND tops.day = da.day""", "docs", "alerts_v"))
def daily_digest(spark, sf):
    """A-15: daily counters with the day's five top keywords and entities, those from hourly counts."""
    docs = V.docs(spark, sf)
    values = docs.select("situation_id", "ts", simple_keywords(F.col("content"), 10).alias("k"), capitalised_phrases(F.col("content")).alias("e"))
    tops = T.daily_tops(T.hourly_values(values, {"keywords": "k", "entities": "e"}), ["keywords", "entities"], n=5)
    days = T.daily_metrics(docs, V.sent(spark, sf), V.alerts(spark, sf)).where((F.col("documents") > 0) | (F.col("alerts") > 0))
    out = days.select("situation_id", "day", "documents", "sources", "alerts").join(tops, ["situation_id", "day"], "left")
    return out.fillna("", ["top_keywords", "top_entities"])


@register("hourly_metrics", wv(f"""
WITH d AS (SELECT situation_id, date_trunc('hour', ts) AS hour, count(*) AS documents,
                  count(DISTINCT source_id) AS sources
           FROM docs WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY GROUP BY ALL),
a AS (SELECT situation_id, date_trunc('hour', ts) AS hour, count(*) AS alerts FROM alerts_v
      WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY GROUP BY ALL)
SELECT coalesce(d.situation_id, a.situation_id) AS situation_id, coalesce(d.hour, a.hour) AS hour,
       coalesce(documents, 0) AS documents, coalesce(sources, 0) AS sources, coalesce(alerts, 0) AS alerts
FROM d FULL OUTER JOIN a ON d.situation_id = a.situation_id AND d.hour = a.hour""", "docs", "alerts_v"))
def hourly_metrics(spark, sf):
    return T.hourly_metrics(V.docs(spark, sf), V.alerts(spark, sf), NOW, keep_days=30)


@register("entity_day_pivot", wv(_TIMELINE_SQL + """
, tot AS (SELECT situation_id, entity, row_number() OVER (PARTITION BY situation_id
          ORDER BY sum(mentions) DESC, entity) AS r FROM tl GROUP BY situation_id, entity),
top AS (SELECT * FROM tot WHERE r <= 10),
days AS (SELECT tl.situation_id, tl.day, CAST(coalesce(sum(CASE WHEN r = 1 THEN mentions END), 0) AS BIGINT) AS e1, CAST(coalesce(sum(CASE WHEN r = 2 THEN mentions END), 0) AS BIGINT) AS e2, CAST(coalesce(sum(CASE WHEN r = 3 THEN mentions END), 0) AS BIGINT) AS e3, CAST(coalesce(sum(CASE WHEN r = 4 THEN mentions END), 0) AS BIGINT) AS e4, CAST(coalesce(sum(CASE WHEN r = 5 THEN mentions END), 0) AS BIGINT) AS e5, CAST(coalesce(sum(CASE WHEN r = 6 THEN mentions END), 0) AS BIGINT) AS e6, CAST(coalesce(sum(CASE WHEN r = 7 THEN mentions END), 0) AS BIGINT) AS e7, CAST(coalesce(sum(CASE WHEN r = 8 THEN mentions END), 0) AS BIGINT) AS e8, CAST(coalesce(sum(CASE WHEN r = 9 THEN mentions END), 0) AS BIGINT) AS e9, CAST(coalesce(sum(CASE WHEN r = 10 THEN mentions END), 0) AS BIGINT) AS e10
         FROM tl JOIN top ON top.situation_id = tl.situation_id AND top.entity = tl.entity GROUP BY ALL),
names AS (SELECT situation_id, max(CASE WHEN r = 1 THEN entity END) AS name1, max(CASE WHEN r = 2 THEN entity END) AS name2, max(CASE WHEN r = 3 THEN entity END) AS name3, max(CASE WHEN r = 4 THEN entity END) AS name4, max(CASE WHEN r = 5 THEN entity END) AS name5, max(CASE WHEN r = 6 THEN entity END) AS name6, max(CASE WHEN r = 7 THEN entity END) AS name7, max(CASE WHEN r = 8 THEN entity END) AS name8, max(CASE WHEN r = 9 THEN entity END) AS name9, max(CASE WHEN r = 10 THEN entity END) AS name10 FROM top GROUP BY situation_id)
SELECT * FROM days JOIN names USING (situation_id)""", "docs"))
def entity_day_pivot(spark, sf):
    d = V.docs(spark, sf).select("situation_id", "ts", capitalised_phrases(F.col("content")).alias("entities"))
    return M.entity_day_pivot(M.entity_timeline(d, NOW, days=7), n=10)
