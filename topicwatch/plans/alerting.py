"""Alerting queries: rule matching, gates, caps, cooldown folds, digests,
channel delivery and the notification outbox."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions.text import capitalised_phrases, simple_keywords
from ..functions import severity as SEV
from ..operators import alerts as AL
from ..operators import trends as T
from . import register
from .dashboard import _KW_SQL
from .trends import ENTITY_SQL

NOW = V.NOW
wv = V.with_views


def _sql_list(xs) -> str:
    if not xs:
        return "[]::VARCHAR[]"
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _rules_values(rules) -> str:
    rows = []
    for r in rules:
        rows.append(f"('{r['rule_id']}', '{r['name']}', '{r['severity']}', {_sql_list(r.get('keywords'))}, "
                    f"{_sql_list(r.get('regex_patterns'))})")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS r(rule_id, name, severity, keywords, patterns)"


@register("rule_matches", wv(f"""
WITH rules AS ({_rules_values(AL.EXAMPLE_RULES)})
SELECT d.id, r.rule_id, r.severity, 'Alert: ' || r.name AS alert_title,
       'Keywords matched in ' || d.source_id || ': ' || substr(lower(d.content), 1, 100) || '...' AS alert_message
FROM docs d, rules r
WHERE len(list_filter(r.keywords, lambda k: contains(lower(d.content), lower(k)))) > 0
   OR len(list_filter(r.patterns, lambda p: regexp_matches(d.content, '(?i)' || p))) > 0""", "docs"))
def rule_matches(spark, sf):
    d = V.docs(spark, sf).select("id", "source_id", "content")
    m = AL.match_rules(d, AL.rules_frame(spark))
    return m.select("id", "rule_id", "severity", "alert_title", "alert_message")


@register("hourly_cap", wv("""
SELECT id, rule_id, date_trunc('hour', ts) AS hour, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY rule_id, date_trunc('hour', ts) ORDER BY ts, id) AS rn FROM alerts_v)
WHERE rn <= 2""", "alerts_v"))
def hourly_cap(spark, sf):
    a = V.alerts(spark, sf).select("id", "rule_id", "ts")
    return AL.hourly_cap(a, cap=2, keys=["rule_id"]).select("id", "rule_id", "hour", "ts")


def _recursive_cooldown_sql(cand_sql: str, keys: list[str], interval: str, views: tuple) -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"c.{x} IS NOT DISTINCT FROM kk.{x}" for x in keys)
    back = " AND ".join(f"c.{x} IS NOT DISTINCT FROM kept.{x}" for x in keys)
    sql = f"""
WITH RECURSIVE cand AS ({cand_sql}),
kept({k}, ts) AS (
  SELECT {k}, min(ts) FROM cand GROUP BY {k}
  UNION ALL
  SELECT {", ".join("kk." + x for x in keys)}, min(c.ts) FROM kept kk JOIN cand c ON {on}
    AND c.ts >= kk.ts + INTERVAL {interval} GROUP BY {", ".join("kk." + x for x in keys)})
SELECT c.id, {", ".join("c." + x for x in keys)}, c.ts FROM cand c JOIN kept ON {back} AND c.ts = kept.ts"""
    ctes = "".join(f"{n} AS ({V.SQL_VIEWS[n]}),\n" for n in views)
    return sql.replace("WITH RECURSIVE ", f"WITH RECURSIVE {ctes}", 1)


@register("cooldown_alerts", _recursive_cooldown_sql(
    "SELECT id, situation_id, ts FROM sent WHERE abs(sentiment) > 0.8", ["situation_id"], "12 HOUR", ("sent",)))
def cooldown_alerts(spark, sf):
    """ST-3: S-18 candidates (|sentiment| > 0.8), greedy 12-hour cooldown per
    situation."""
    s = V.sent(spark, sf)
    cand = s.where(AL.should_alert_simple(F.col("sentiment"), F.lit(0))).select("id", "situation_id", "ts")
    return AL.cooldown(cand, ["situation_id"], cooldown_s=12 * 3600)


@register("alert_dedup", _recursive_cooldown_sql(
    "SELECT id, rule_id, source_id, severity, title, message, ts FROM alerts_v", AL.DEDUP_KEY, "6 HOUR",
    ("alerts_v",)))
def alert_dedup(spark, sf):
    """ST-6: identical alerts (rule, source, severity, title, message)
    within 6 hours of a passed one are dropped."""
    a = V.alerts(spark, sf).select("id", *AL.DEDUP_KEY, "ts")
    return AL.dedup_alerts(a, window_s=6 * 3600).select("id", *AL.DEDUP_KEY, "ts")


@register("rule_cooldown", _recursive_cooldown_sql(
    "SELECT event_id AS id, event_type AS rule_id, ts FROM events", ["rule_id"], "600 SECOND", ()))
def rule_cooldown(spark, sf):
    """ST-3 with five rules that share all events: no gaps, and each rule's rows go to many tasks."""
    return AL.cooldown_dense(V.alerts(spark, sf).select("id", "rule_id", "ts"), ["rule_id"], 600)


@register("global_cooldown", _recursive_cooldown_sql(
    "SELECT event_id AS id, 'all' AS scope, ts FROM events", ["scope"], "900 SECOND", ()))
def global_cooldown(spark, sf):
    """ST-3 / ST-6 with one key for all events."""
    a = V.alerts(spark, sf).select("id", F.lit("all").alias("scope"), "ts")
    return AL.cooldown_dense(a, ["scope"], 900)


@register("rule_throttle", """
WITH RECURSIVE cand AS (SELECT event_id AS id, event_type AS rule_id, ts FROM events),
kept(rule_id, ts, recent) AS (
  SELECT rule_id, min(ts), [min(ts)] FROM cand GROUP BY rule_id
  UNION ALL
  SELECT n.rule_id, n.ts, list_append(list_filter(n.recent, lambda x: x > n.ts - INTERVAL 1 HOUR), n.ts)
  FROM (SELECT kk.rule_id, kk.recent, min(c.ts) AS ts FROM kept kk JOIN cand c ON c.rule_id = kk.rule_id
          AND c.ts >= kk.ts + INTERVAL 600 SECOND
          AND len(list_filter(kk.recent, lambda x: x > c.ts - INTERVAL 1 HOUR)) < 4
        GROUP BY kk.rule_id, kk.recent) n)
SELECT c.id, c.rule_id, c.ts FROM cand c JOIN kept k ON k.rule_id = c.rule_id AND k.ts = c.ts""")
def rule_throttle(spark, sf):
    """ST-4: per rule, 10-minute cooldown and at most 4 alerts in any sliding
    hour (checked against a Python loop in tests)."""
    a = V.alerts(spark, sf).select("id", "rule_id", "ts")
    return AL.throttle(a, ["rule_id"], cooldown_s=600, max_per_hour=4)


@register("alert_digest", wv("""
SELECT rule_id, time_bucket(INTERVAL 60 MINUTE, ts) AS window_start,
       time_bucket(INTERVAL 60 MINUTE, ts) + INTERVAL 60 MINUTE AS window_end,
       count(*) AS alert_count, min(ts) AS first_ts, max(ts) AS last_ts,
       CASE max(CASE severity WHEN 'info' THEN 0 WHEN 'warning' THEN 1 WHEN 'error' THEN 2 WHEN 'critical' THEN 3 END)
            WHEN 0 THEN 'info' WHEN 1 THEN 'warning' WHEN 2 THEN 'error' ELSE 'critical' END AS severity,
       CAST(count(*) AS VARCHAR) || ' alerts' AS title
FROM alerts_v GROUP BY rule_id, time_bucket(INTERVAL 60 MINUTE, ts)""", "alerts_v"))
def alert_digest(spark, sf):
    a = V.alerts(spark, sf).select("id", "rule_id", "severity", "ts")
    return AL.digests(a, 60, ["rule_id"])


# Gate configuration keyed by the alert view's rule ids (event types).
GATE_RULES = [
    dict(rule_id="error", name="errors", enabled=True, min_severity="warning", severity="critical"),
    dict(rule_id="purchase", name="purchases", enabled=True, keywords=['"k": 1'], severity="error"),
    dict(rule_id="signup", name="signups", enabled=True, source_ids=["src1", "src2", "src3"], severity="warning"),
    dict(rule_id="view", name="views", enabled=True, quiet_hours_start=22, quiet_hours_end=6,
         quiet_hours_severity_exemption="critical", severity="info"),
    dict(rule_id="click", name="clicks", enabled=False, severity="info"),
]


@register("alert_gate", wv("""
SELECT id, rule_id,
  CASE WHEN rule_id NOT IN ('error', 'purchase', 'signup', 'view', 'click') THEN 'no rule'
       WHEN rule_id = 'click' THEN 'disabled'
       WHEN rule_id = 'signup' AND source_id NOT IN ('src1', 'src2', 'src3') THEN 'source'
       WHEN rule_id = 'error' AND severity NOT IN ('warning', 'error', 'critical') THEN 'severity'
       WHEN rule_id = 'purchase' AND NOT contains(lower(concat_ws(' ', title, message)), '"k": 1') THEN 'keywords'
       WHEN rule_id = 'view' AND (hour(ts) >= 22 OR hour(ts) < 6) AND severity <> 'critical' THEN 'quiet hours'
       ELSE 'pass' END AS gate
FROM alerts_v""", "alerts_v"))
def alert_gate(spark, sf):
    a = V.alerts(spark, sf).select("id", "rule_id", "source_id", "severity", "title", "message", "ts")
    g = AL.keyword_gate(a, AL.rules_frame(spark, GATE_RULES))
    return g.select("id", "rule_id", "gate")


CHANNELS = [
    dict(channel="console", kind="console", enabled=True, min_severity="info", rate_limit_seconds=0),
    dict(channel="email", kind="email", enabled=True, min_severity="error", quiet_hours_start=22,
         quiet_hours_end=7),
    dict(channel="discord", kind="discord", enabled=True, min_severity="warning", rate_limit_seconds=3600),
    dict(channel="webhook", kind="webhook", enabled=False, min_severity="info",
         template='{"id": "{{alert_id}}", "text": "{{title}}"}'),
]


def _deliveries(spark, sf):
    a = V.alerts(spark, sf).select("id", *AL.DEDUP_KEY, "ts")
    return AL.channel_fanout(a, AL.config_frame(spark, CHANNELS, AL.CHANNEL_SCHEMA))


_SEV_RANK = ("CASE severity WHEN 'info' THEN 0 WHEN 'warning' THEN 1 WHEN 'error' THEN 2 "
             "WHEN 'critical' THEN 3 END")
_DISCORD_KEPT = _recursive_cooldown_sql(
    f"SELECT id, rule_id, source_id, severity, title, message, ts FROM alerts_v WHERE {_SEV_RANK} >= 1",
    AL.DEDUP_KEY, "3600 SECOND", ("alerts_v",))
_DELIVERY_SQL = _DISCORD_KEPT.replace("\nSELECT c.id,", ", kept_ids AS (SELECT c.id FROM cand c JOIN kept ON "
                                      + " AND ".join(f"c.{x} IS NOT DISTINCT FROM kept.{x}" for x in AL.DEDUP_KEY)
                                      + " AND c.ts = kept.ts)\nSELECT c.id,", 1)
_DELIVERY_SQL = _DELIVERY_SQL[:_DELIVERY_SQL.rindex("\nSELECT c.id,")] + f"""
, deliveries AS (
  SELECT id, 'console' AS channel, 'sent' AS status FROM alerts_v
  UNION ALL
  SELECT id, 'email', CASE WHEN {_SEV_RANK} < 2 THEN 'filtered'
                           WHEN hour(ts) >= 22 OR hour(ts) < 7 THEN 'quiet hours' ELSE 'sent' END FROM alerts_v
  UNION ALL
  SELECT id, 'discord', CASE WHEN {_SEV_RANK} < 1 THEN 'filtered'
                             WHEN id IN (SELECT id FROM kept_ids) THEN 'sent' ELSE 'rate limited' END FROM alerts_v)
"""


@register("channel_delivery", _DELIVERY_SQL + "SELECT id, channel, status FROM deliveries")
def channel_delivery(spark, sf):
    """J-11 + ST-7: per (alert, channel) status; the rate-limit fold makes
    this a rows-only query (tests compare it with a Python loop)."""
    return _deliveries(spark, sf).select("id", "channel", "status")


@register("delivery_stats", _DELIVERY_SQL + """SELECT channel, count(*) AS attempted,
  count(*) FILTER (WHERE status = 'sent') AS delivered FROM deliveries GROUP BY channel""")
def delivery_stats(spark, sf):
    """A-20 per channel."""
    return AL.delivery_stats(_deliveries(spark, sf))[1]


@register("notification_outbox", _DELIVERY_SQL + """
, sent AS (SELECT d.id, d.channel, a.severity, a.title, coalesce(a.message, '') AS message, a.ts
           FROM deliveries d JOIN alerts_v a ON a.id = d.id WHERE d.status = 'sent')
SELECT id AS alert_id, channel, channel AS kind,
  CASE channel
    WHEN 'discord' THEN to_json({'embeds': [{'title': title, 'description': message,
        'color': CASE severity WHEN 'critical' THEN 15158332 WHEN 'error' THEN 15105570
                               WHEN 'warning' THEN 16776960 ELSE 3447003 END,
        'timestamp': strftime(ts, '%Y-%m-%dT%H:%M:%S')}]})::VARCHAR
    WHEN 'email' THEN printf('Subject: [%s] %s\n\n%s', upper(severity), title, message)
    ELSE printf('[%s] %s %s: %s', strftime(ts, '%Y-%m-%d %H:%M:%S'), upper(severity), title, message) END AS payload
FROM sent""")
def notification_outbox(spark, sf):
    """SNK-11 payload rows."""
    return AL.outbox(_deliveries(spark, sf))


@register("situation_alerts", wv(_KW_SQL + f"""
, m AS (SELECT DISTINCT situation_id, id, ts, e AS entity FROM docs, unnest({ENTITY_SQL.format(c='content')}) AS t(e)),
ne AS (SELECT situation_id, list(DISTINCT entity ORDER BY entity) AS new_entities FROM m p
       WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{NOW}'
         AND NOT EXISTS (SELECT 1 FROM m h WHERE h.situation_id = p.situation_id AND h.entity = p.entity
                         AND h.ts <= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) GROUP BY situation_id),
g AS (SELECT situation_id, tok AS keyword,
         count(*) FILTER (WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS current,
         count(*) FILTER (WHERE ts <= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS previous
       FROM doc_kw WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 14 DAY AND ts <= TIMESTAMP '{NOW}' GROUP BY ALL),
ks AS (SELECT situation_id, list(keyword ORDER BY keyword) AS spikes FROM g
       WHERE (previous > 0 AND current >= previous * 2.0) OR (previous = 0 AND current >= 3) GROUP BY situation_id),
sc AS (SELECT situation_id,
         round(avg(sentiment) FILTER (WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAY), 6) AS score,
         round(avg(sentiment) FILTER (WHERE ts <= TIMESTAMP '{NOW}' - INTERVAL 7 DAY), 6) AS prev_score
       FROM sent WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 14 DAY AND ts <= TIMESTAMP '{NOW}'
         AND sentiment IS NOT NULL GROUP BY situation_id),
dc AS (SELECT situation_id, count(*) AS documents, count(DISTINCT source_id) AS sources FROM docs
       WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{NOW}' GROUP BY situation_id),
ids AS (SELECT situation_id FROM ne UNION SELECT situation_id FROM ks UNION SELECT situation_id FROM sc
        UNION SELECT situation_id FROM dc),
a AS (SELECT i.situation_id, sc.score, round(sc.score - sc.prev_score, 6) AS change,
        coalesce(ne.new_entities, []::VARCHAR[]) AS new_entities, coalesce(ks.spikes, []::VARCHAR[]) AS spikes,
        coalesce(dc.documents, 0) AS documents, coalesce(dc.sources, 0) AS sources
      FROM ids i LEFT JOIN ne USING (situation_id) LEFT JOIN ks USING (situation_id)
      LEFT JOIN sc USING (situation_id) LEFT JOIN dc USING (situation_id))
SELECT situation_id, score, change, len(new_entities) AS new_entity_count, len(spikes) AS spike_count,
  documents, sources,
  CASE WHEN coalesce(score, 0) <= -0.8 OR abs(coalesce(change, 0)) >= 0.5 THEN 'critical'
       WHEN coalesce(score, 0) <= -0.5 OR abs(coalesce(change, 0)) >= 0.3 OR len(new_entities) >= 3 THEN 'warning'
       ELSE 'info' END AS severity,
  CASE WHEN change <= -0.3 THEN 'Sentiment drop detected' WHEN change >= 0.3 THEN 'Sentiment rise detected'
       WHEN len(new_entities) > 0 THEN 'New entities detected' WHEN len(spikes) > 0 THEN 'Keyword spikes detected'
       ELSE 'Situation update' END AS title,
  concat_ws('. ', CASE WHEN len(new_entities) > 0 THEN 'New entities: ' || array_to_string(new_entities, ', ') END,
                  CASE WHEN len(spikes) > 0 THEN 'Keyword spikes: ' || array_to_string(spikes, ', ') END,
                  printf('%d documents from %d sources', documents, sources)) AS message
FROM a
WHERE abs(coalesce(change, 0)) >= 0.3 OR len(new_entities) > 0 OR len(spikes) > 0 OR coalesce(score, 0) <= -0.8""",
                                  "docs", "sent"))
def situation_alerts(spark, sf):
    """A-23 period analysis per situation + S-19 should-alert, S-20
    severity, S-21 title and message."""
    docs = V.docs(spark, sf).select("situation_id", "id", "ts", "source_id", "content")
    n = V.ntz(NOW)
    lo = n - F.expr("INTERVAL 7 DAYS")
    ments = T.entity_mentions(docs, capitalised_phrases(F.col("content")))
    ne = T.new_entities(ments, NOW, days=7).groupBy("situation_id").agg(
        F.array_sort(F.collect_set("entity")).alias("new_entities"))
    kw = docs.select("situation_id", "ts", simple_keywords(F.col("content"), 10).alias("keywords"))
    ks = T.keyword_spikes(kw, NOW, days=7, factor=2.0, min_new=3).groupBy("situation_id").agg(
        F.array_sort(F.collect_set("keyword")).alias("spikes"))
    s = V.sent(spark, sf).where((F.col("ts") > n - F.expr("INTERVAL 14 DAYS")) & (F.col("ts") <= n)
                                & F.col("sentiment").isNotNull())
    sc = s.groupBy("situation_id").agg(
        F.round(F.avg(F.when(F.col("ts") > lo, F.col("sentiment"))), 6).alias("score"),
        F.round(F.avg(F.when(F.col("ts") <= lo, F.col("sentiment"))), 6).alias("prev_score"))
    dc = docs.where((F.col("ts") > lo) & (F.col("ts") <= n)).groupBy("situation_id").agg(
        F.count(F.lit(1)).alias("documents"), F.countDistinct("source_id").alias("sources"))
    a = (ne.join(ks, "situation_id", "full_outer").join(sc, "situation_id", "full_outer")
         .join(dc, "situation_id", "full_outer"))
    empty = F.array().cast("array<string>")
    a = a.select("situation_id", "score", F.round(F.col("score") - F.col("prev_score"), 6).alias("change"),
                 F.coalesce("new_entities", empty).alias("new_entities"), F.coalesce("spikes", empty).alias("spikes"),
                 F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("sources", F.lit(0)).alias("sources"))
    title, message = AL.alert_content(F.col("change"), F.col("new_entities"), F.col("spikes"),
                                      F.col("documents"), F.col("sources"))
    out = a.where(AL.should_alert_analysis(F.col("score"), F.col("change"), F.size("new_entities"),
                                           F.size("spikes")))
    return out.select("situation_id", "score", "change",
                      F.size("new_entities").cast("bigint").alias("new_entity_count"),
                      F.size("spikes").cast("bigint").alias("spike_count"), "documents", "sources",
                      SEV.from_analysis(F.col("score"), F.col("change"), F.size("new_entities")).alias("severity"),
                      title.alias("title"), message.alias("message"))
