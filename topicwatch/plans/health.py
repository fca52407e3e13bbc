"""Source-health queries over the fetch log (events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..operators import dedup as D
from ..operators import folds as FO
from ..operators import health as H
from . import register
from .collect import HASH_SQL

NOW = V.NOW
wv = V.with_views


@register("consecutive_failures", wv("""
WITH lo AS (SELECT source_id, max({'ts': ts, 'id': id}) FILTER (WHERE ok) AS lo FROM fetch_log GROUP BY 1),
n AS (SELECT f.source_id, count(*) FILTER (WHERE NOT f.ok AND (lo.lo IS NULL OR {'ts': f.ts, 'id': f.id} > lo.lo))
        AS consecutive_failures
      FROM fetch_log f JOIN lo ON lo.source_id = f.source_id GROUP BY 1)
SELECT source_id, consecutive_failures,
       CASE WHEN consecutive_failures = 0 THEN 0.0 ELSE pow(2.0, least(consecutive_failures, 6)) END AS backoff_seconds
FROM n""", "fetch_log"))
def consecutive_failures(spark, sf):
    return H.consecutive_failures(V.fetch_log(spark, sf))


FRESH_NOW = "2024-01-30 12:00:00"


def _sources(spark, sf):
    fl = V.fetch_log(spark, sf)
    return fl.select("source_id").distinct().select(
        "source_id", (F.col("source_id") % 4 + 1).cast("int").alias("priority"),
        F.when(F.col("source_id") % 5 == 0, F.lit(30)).alias("check_interval_minutes"),
        H.min_request_spacing(10 + F.col("source_id") % 50).alias("min_spacing_seconds"))


@register("source_freshness", wv(f"""
WITH src AS (SELECT DISTINCT source_id, CAST(source_id % 4 + 1 AS INTEGER) AS priority,
                    CASE WHEN source_id % 5 = 0 THEN 30 END AS check_interval_minutes,
                    greatest(6.0, 60.0 / (10 + source_id % 50)) AS min_spacing_seconds FROM fetch_log),
last AS (SELECT source_id, max(ts) AS last_check FROM fetch_log GROUP BY 1),
lo AS (SELECT source_id, max({{'ts': ts, 'id': id}}) FILTER (WHERE ok) AS lo FROM fetch_log GROUP BY 1),
fails AS (SELECT f.source_id, count(*) FILTER (WHERE NOT f.ok AND (lo.lo IS NULL OR {{'ts': f.ts, 'id': f.id}} > lo.lo))
          AS consecutive_failures FROM fetch_log f JOIN lo ON lo.source_id = f.source_id GROUP BY 1),
s AS (SELECT src.*, last.last_check, coalesce(fails.consecutive_failures, 0) AS consecutive_failures,
             CAST(coalesce(check_interval_minutes, CASE priority WHEN 1 THEN 5 WHEN 2 THEN 15 WHEN 3 THEN 60
                  WHEN 4 THEN 360 END, 60) AS BIGINT) AS interval_minutes,
             CAST(CASE WHEN coalesce(fails.consecutive_failures, 0) = 0 THEN 0
                  ELSE least(pow(2, fails.consecutive_failures), 360) END AS BIGINT) AS backoff_minutes
      FROM src LEFT JOIN last USING (source_id) LEFT JOIN fails USING (source_id)),
n AS (SELECT *, last_check + to_minutes(CAST(interval_minutes + backoff_minutes AS INTEGER)) AS next_check FROM s)
SELECT *, date_sub('second', next_check, TIMESTAMP '{FRESH_NOW}') AS overdue_seconds FROM n
WHERE last_check IS NULL OR next_check <= TIMESTAMP '{FRESH_NOW}'""", "fetch_log"))
def source_freshness(spark, sf):
    return H.source_freshness(_sources(spark, sf), V.fetch_log(spark, sf), FRESH_NOW)


@register("recent_errors", wv("""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, id DESC) AS rank
               FROM fetch_log WHERE NOT ok) WHERE rank <= 10""", "fetch_log"))
def recent_errors(spark, sf):
    return H.recent_errors(V.fetch_log(spark, sf), 10).withColumn("rank", F.col("rank").cast("bigint"))


@register("pipeline_health", wv("""
WITH g AS (SELECT source_id, count(*) AS total, count(*) FILTER (WHERE NOT ok) AS failed FROM fetch_log GROUP BY 1),
r AS (SELECT *, round(CAST(failed AS DOUBLE) / total, 6) AS failed_ratio, least(failed, 10) AS recent_errors FROM g)
SELECT *, CASE WHEN failed_ratio > 0.5 OR recent_errors > 5 THEN 'unhealthy'
               WHEN failed_ratio > 0.2 OR recent_errors > 2 THEN 'degraded' ELSE 'healthy' END AS status FROM r""",
                                "fetch_log"))
def pipeline_health(spark, sf):
    return H.pipeline_health(V.fetch_log(spark, sf))


@register("source_counters", wv("""
SELECT source_id, count(*) AS fetch_count, count(*) FILTER (WHERE NOT ok) AS error_count,
       max(ts) FILTER (WHERE ok) AS last_fetched,
       (max({'ts': ts, 'id': id, 'error_message': error_message}) FILTER (WHERE NOT ok)).error_message AS last_error
FROM fetch_log GROUP BY source_id""", "fetch_log"))
def source_counters(spark, sf):
    return H.source_counters(V.fetch_log(spark, sf))


@register("scheduler_totals", wv("""
SELECT count(*) AS scheduled, count(*) FILTER (WHERE ok) AS executed, count(*) FILTER (WHERE NOT ok) AS failed,
       count(DISTINCT source_id) AS sources FROM fetch_log""", "fetch_log"))
def scheduler_totals(spark, sf):
    return H.scheduler_totals(V.fetch_log(spark, sf))


@register("collection_counters", wv(f"""
WITH h AS (SELECT id, ts, CASE WHEN content IS NULL OR content = '' THEN '' ELSE {HASH_SQL.format(c='content')} END
           AS content_hash FROM docs),
s AS (SELECT CASE WHEN content_hash = '' THEN 'rejected'
                  WHEN row_number() OVER (PARTITION BY content_hash ORDER BY ts, id) = 1 THEN 'kept'
                  ELSE 'duplicate' END AS status FROM h)
SELECT count(*) AS fetched, count(*) FILTER (WHERE status = 'duplicate') AS deduplicated,
       count(*) FILTER (WHERE status = 'rejected') AS failed, count(*) FILTER (WHERE status = 'rejected') AS dead_letter
FROM s""", "docs"))
def collection_counters(spark, sf):
    d = V.docs(spark, sf).select("id", "ts", "source_id", "content")
    return H.collection_counters(D.content_dedup(d))


@register("dead_letters", wv("""
WITH f AS (SELECT fl.id, fl.source_id, v.url, fl.ts, fl.error_message FROM fetch_log fl JOIN versions v ON v.id = fl.id
           WHERE NOT fl.ok),
r AS (SELECT *, row_number() OVER (ORDER BY ts DESC, id DESC) AS rn, count(*) OVER () AS total FROM f)
SELECT id, source_id, url, ts, error_message,
       CAST(source_id AS VARCHAR) || ':' || substr(sha256(url), 1, 8) AS document_id,
       total <= 1000 OR rn <= 500 AS retained
FROM r""", "fetch_log", "versions"))
def dead_letters(spark, sf):
    """SNK-9 + W-8 over failed fetches (rows-only: ids use sha256)."""
    fl = V.fetch_log(spark, sf)
    v = V.versions(spark, sf).select("id", "url")
    failures = fl.where(~F.col("ok")).join(v, "id")
    return H.dead_letters(failures, keep_newest=500, over=1000)


BREAKER_SQL = """
WITH RECURSIVE o AS (
  SELECT CAST(user_id AS VARCHAR) AS source_id, ts, event_type <> 'error' AS ok,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
st(source_id, rn, state, fails, succ, opened, times) AS (
  SELECT DISTINCT source_id, CAST(0 AS BIGINT), 'closed', 0, 0, CAST(NULL AS TIMESTAMP), 0 FROM o
  UNION ALL
  SELECT source_id, rn,
    CASE WHEN st1 = 'closed' THEN CASE WHEN ok THEN 'closed' WHEN fails + 1 >= 3 THEN 'open' ELSE 'closed' END
         WHEN st1 = 'half_open' THEN CASE WHEN NOT ok THEN 'open' WHEN succ1 + 1 >= 2 THEN 'closed' ELSE 'half_open' END
         ELSE 'open' END,
    CASE WHEN st1 = 'open' THEN fails WHEN ok THEN 0 ELSE fails + 1 END,
    CASE WHEN st1 = 'half_open' AND ok AND succ1 + 1 < 2 THEN succ1 + 1 ELSE
         CASE WHEN st1 = 'open' THEN succ1 ELSE 0 END END,
    CASE WHEN (st1 = 'closed' AND NOT ok AND fails + 1 >= 3) OR (st1 = 'half_open' AND NOT ok) THEN ts ELSE opened END,
    CASE WHEN (st1 = 'closed' AND NOT ok AND fails + 1 >= 3) OR (st1 = 'half_open' AND NOT ok) THEN times + 1
         ELSE times END
  FROM (SELECT s.source_id, o.rn, o.ts, o.ok, s.fails, s.opened, s.times,
          CASE WHEN s.state = 'open' AND o.ts - s.opened >= INTERVAL 3600 SECOND THEN 'half_open' ELSE s.state END
            AS st1,
          CASE WHEN s.state = 'open' AND o.ts - s.opened >= INTERVAL 3600 SECOND THEN 0 ELSE s.succ END AS succ1
        FROM st s JOIN o ON o.source_id = s.source_id AND o.rn = s.rn + 1) x),
last AS (SELECT * FROM st WHERE (source_id, rn) IN (SELECT source_id, max(rn) FROM st GROUP BY source_id)),
breaker AS (
  SELECT source_id,
    CASE WHEN state = 'open' AND TIMESTAMP '2024-01-31 00:00:00' - opened >= INTERVAL 3600 SECOND THEN 'half_open' ELSE state END
      AS state,
    CAST(fails AS BIGINT) AS consecutive_failures,
    CAST(CASE WHEN state = 'open' AND TIMESTAMP '2024-01-31 00:00:00' - opened >= INTERVAL 3600 SECOND THEN 0 ELSE succ END AS BIGINT)
      AS half_open_successes,
    CAST(times AS BIGINT) AS times_opened, CAST(rn AS BIGINT) AS outcomes, opened AS opened_at FROM last)
"""


@register("breaker_states", BREAKER_SQL + "SELECT * FROM breaker")
def breaker_states(spark, sf):
    """ST-8 circuit breaker per source as of NOW (rows-only; tests compare
    with a plain Python state machine)."""
    return FO.breaker_states(V.fetch_log(spark, sf), NOW, failure_threshold=3, timeout_s=3600.0,
                             half_open_successes=2)


@register("source_status", BREAKER_SQL + """
, ex AS (SELECT user_id AS source_id, least(count(*) FILTER (WHERE event_type <> 'error'), 100) AS last_execution_times
         FROM events GROUP BY 1)
SELECT ex.source_id, 'source-' || CAST(ex.source_id AS VARCHAR) AS name,
       CASE ex.source_id % 4 + 1 WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
       true AS enabled, coalesce(b.state, 'closed') AS circuit_breaker, ex.last_execution_times
FROM ex LEFT JOIN breaker b ON b.source_id = CAST(ex.source_id AS VARCHAR)""")
def source_status(spark, sf):
    """A-19: name, priority, enabled, breaker state, executions kept."""
    src = _sources(spark, sf)
    br = FO.breaker_states(V.fetch_log(spark, sf), NOW, failure_threshold=3, timeout_s=3600.0,
                           half_open_successes=2).select(F.col("source_id").cast("bigint").alias("source_id"),
                                                         F.col("state").alias("circuit_breaker"))
    ex = H.executions_kept(V.fetch_log(spark, sf))
    names = F.create_map(*[x for k, v in H.PRIORITY_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return (src.join(br, "source_id", "left").join(ex, "source_id", "left")
            .select("source_id", F.concat(F.lit("source-"), F.col("source_id").cast("string")).alias("name"),
                    F.try_element_at(names, F.col("priority")).alias("priority"), F.lit(True).alias("enabled"),
                    F.coalesce("circuit_breaker", F.lit("closed")).alias("circuit_breaker"),
                    "last_execution_times"))
