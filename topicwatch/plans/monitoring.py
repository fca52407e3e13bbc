"""The whole flow as a stream over landed documents (ST-16)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .. import views as V
from ..operators import alerts as AL
from ..session import scratch_folder
from ..streaming import monitor as M
from . import register
from .collect import HASH_SQL
from .text import _EMPTY, _NEG, _POS

RULES = [
    dict(rule_id="articles", name="Articles", enabled=True, severity="info", keywords=["the ", " les "], cooldown_seconds=7200,
         max_alerts_per_hour=3),
    dict(rule_id="ments", name="Ments", enabled=True, severity="warning", keywords=["ment"], regex_patterns=["qu[a-z]+ly"],
         max_alerts_per_hour=2, quiet_hours_start=22, quiet_hours_end=6, quiet_hours_severity_exemption="critical"),
    dict(rule_id="tone", name="Tone", enabled=True, severity="info", min_severity="warning", keywords=["a"], max_alerts_per_hour=1),
    dict(rule_id="off", name="Off", enabled=False, severity="critical", keywords=["a"], max_alerts_per_hour=1),
]
CHANNELS = [dict(channel="console", kind="console", enabled=True),
            dict(channel="mail", kind="email", enabled=True, min_severity="warning", quiet_hours_start=0, quiet_hours_end=7)]
LOADS = [dt.datetime(2024, 1, d) for d in (1, 9, 17, 25)]


def landed_loads(spark, sf) -> list:
    """All documents as landed pages, in loads of about a week; rows before or after the named weeks go to the first and last."""
    raw = V.docs(spark, sf).select("id", F.concat(F.lit("doc/"), F.col("id").cast("string")).alias("url"), "source_id",
                                   F.col("content").alias("raw_html"), F.col("ts").alias("fetched_at"))
    load = sum((F.col("fetched_at") >= F.lit(d).cast("timestamp_ntz")).cast("int") for d in LOADS[1:])
    return [raw.where(load == n) for n in range(len(LOADS))]


@register("monitored_outbox", V.with_views(f"""
WITH RECURSIVE first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {HASH_SQL.format(c='content')} ORDER BY ts, id) AS rn
           FROM docs WHERE coalesce(content, '') <> '') WHERE rn = 1),
pages AS (SELECT id, source_id, ts, regexp_replace(regexp_replace(regexp_replace(content, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'),
            '^\\s+|\\s+$', '', 'g') AS content FROM first),
scored AS (SELECT *, {_POS} AS p, {_NEG} AS n FROM pages WHERE NOT ({_EMPTY})),
toned AS (SELECT *, CASE WHEN p + n = 0 THEN 0.0 ELSE (p - n) / (p + n) END AS score FROM scored),
hit AS (
  SELECT *, 'articles' AS rule_id, 'Articles' AS name, 0 AS rule_rank, 7200 AS cooldown, 3 AS cap FROM toned
    WHERE contains(lower(content), 'the ') OR contains(lower(content), ' les ')
  UNION ALL SELECT *, 'ments', 'Ments', 1, 0, 2 FROM toned WHERE contains(lower(content), 'ment') OR regexp_matches(content, '(?i)qu[a-z]+ly')
  UNION ALL SELECT *, 'tone', 'Tone', 0, 0, 1 FROM toned WHERE contains(lower(content), 'a')),
ranked AS (SELECT *, greatest(rule_rank, CASE WHEN score <= -0.8 THEN 3 WHEN score <= -0.5 THEN 1 ELSE 0 END) AS r FROM hit),
cand AS (SELECT *, ['info', 'warning', 'error', 'critical'][r + 1] AS severity, row_number() OVER (PARTITION BY rule_id ORDER BY ts, id) AS place
         FROM ranked WHERE (rule_id <> 'tone' OR r >= 1) AND (rule_id <> 'ments' OR r >= 3 OR hour(ts) BETWEEN 6 AND 21)),
kept(rule_id, place, ts, recent) AS (
  SELECT rule_id, place, ts, [ts] FROM cand WHERE place = 1
  UNION ALL
  SELECT x.rule_id, x.place, x.ts, list_append(list_filter(x.recent, lambda y: y > x.ts - INTERVAL 1 HOUR), x.ts)
  FROM (SELECT k.rule_id, k.recent, min(c.place) AS place, arg_min(c.ts, c.place) AS ts FROM kept k JOIN cand c ON c.rule_id = k.rule_id
          AND c.place > k.place AND c.ts >= k.ts + to_seconds(c.cooldown)
          AND len(list_filter(k.recent, lambda y: y > c.ts - INTERVAL 1 HOUR)) < c.cap GROUP BY k.rule_id, k.recent) x),
alert AS (SELECT c.*, 'Alert: ' || name AS title, 'Keywords matched in ' || source_id || ': ' || substr(lower(content), 1, 100) || '...' AS message
          FROM cand c JOIN kept k ON k.rule_id = c.rule_id AND k.place = c.place)
SELECT id AS alert_id, 'console' AS channel, 'console' AS kind, rule_id, source_id, severity, ts,
       printf('[%s] %s %s: %s', strftime(ts, '%Y-%m-%d %H:%M:%S'), upper(severity), title, message) AS payload FROM alert
UNION ALL
SELECT id, 'mail', 'email', rule_id, source_id, severity, ts, printf('Subject: [%s] %s\n\n%s', upper(severity), title, message)
FROM alert WHERE r >= 1 AND hour(ts) >= 7""", "docs").replace("WITH docs AS", "WITH RECURSIVE docs AS", 1).replace("),\nRECURSIVE first", "),\nfirst", 1))
def monitored_outbox(spark, sf):
    """ST-16: all documents as landed pages, in weekly loads. The stream is started anew for each load from its checkpoint and ends when the
    load is read; the result is what its outbox then holds."""
    loads = landed_loads(spark, sf)
    folder = scratch_folder(spark, "monitor")
    rules = AL.rules_frame(spark, RULES)
    for n, load in enumerate(loads):
        load.write.mode("overwrite").parquet(f"{folder}/landed/load={n}")
        landed = spark.readStream.schema(load.schema).parquet(f"{folder}/landed/load=*")
        out = M.monitor_stream(landed, rules, CHANNELS, extract=M.basic_pages)
        M.start_monitor(out, f"{folder}/outbox", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(M.outbox_schema()).json(f"{folder}/outbox")
