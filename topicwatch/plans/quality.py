"""Data-quality and maintenance queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import views as V
from ..functions import severity as SEV
from ..operators import metrics as M
from ..operators import quality as Q
from ..session import scratch_folder
from ..sources import sinks as K
from . import register

NOW = V.NOW
wv = V.with_views

RELATIONS = [("orders.o_custkey->customer", "orders", "o_custkey", "customer", "c_custkey"),
             ("lineitem.l_orderkey->orders", "lineitem", "l_orderkey", "orders", "o_orderkey"),
             ("lineitem.l_partkey->part", "lineitem", "l_partkey", "part", "p_partkey"),
             ("lineitem.l_suppkey->supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
             ("customer.c_nationkey->nation", "customer", "c_nationkey", "nation", "n_nationkey"),
             ("nation.n_regionkey->region", "nation", "n_regionkey", "region", "r_regionkey"),
             ("labels.doc_id->documents", "labels", "doc_id", "documents", "doc_id"),
             ("events.user_id->customer", "events", "user_id", "customer", "c_custkey")]


@register("fk_orphans", " UNION ALL ".join(
    f"SELECT '{n}' AS relation, count(*) AS orphans FROM {c} x WHERE x.{ck} IS NOT NULL AND NOT EXISTS "
    f"(SELECT 1 FROM {p} y WHERE y.{pk} = x.{ck})" for n, c, ck, p, pk in RELATIONS))
def fk_orphans(spark, sf):
    t = lambda n: V.table(spark, sf, n)
    return Q.orphan_counts([(n, t(c), ck, t(p), pk) for n, c, ck, p, pk in RELATIONS])


def daily_rows(spark, daily: DataFrame) -> list[DataFrame]:
    """DQ-4 on the daily table as it is written: loaded twice (a load that was repeated), then read back, so that a load
    that appends instead of replacing its days shows as repeated keys and as rows too many."""
    path = scratch_folder(spark, "daily-docs")
    for _ in range(2):
        K.overwrite_partitions(daily, path, ["day"])
    written = spark.read.schema(daily.schema).parquet(path)
    signed = written.select(F.lit(1).alias("n")).unionByName(daily.select(F.lit(-1).alias("n")))
    return [Q.duplicate_keys(written, ["situation_id", "day"], "daily_docs"),
            signed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(
                F.lit("daily_docs").alias("table_name"), F.lit("rows").alias("check"), "violations")]


@register("dq_violations", wv("""
SELECT 'alerts' AS table_name, 'severity_enum' AS "check",
       count(*) FILTER (WHERE severity IS NULL OR severity NOT IN ('info', 'warning', 'error', 'critical')) AS violations
FROM alerts_v
UNION ALL SELECT 'situations', 'status_enum',
       count(*) FILTER (WHERE status IS NULL OR status NOT IN ('active', 'paused', 'archived', 'error')) FROM situations
UNION ALL SELECT 'sent', 'sentiment_range',
       count(*) FILTER (WHERE sentiment IS NULL OR sentiment < -1 OR sentiment > 1) FROM sent
UNION ALL SELECT 'docs', 'content_not_null', count(*) FILTER (WHERE content IS NULL) FROM docs
UNION ALL SELECT 'docs', 'source_id_pattern',
       count(*) FILTER (WHERE source_id IS NULL OR NOT regexp_full_match(source_id, '[A-Za-z0-9_-]+')) FROM docs
UNION ALL SELECT 'docs', 'unique(id)', count(*) FROM (SELECT id FROM docs GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'labels', 'unique(doc_id)', count(*) FROM (SELECT doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1)
UNION ALL SELECT 'daily_docs', 'unique(situation_id,day)', count(*) FROM (
  SELECT situation_id, day FROM (SELECT situation_id, CAST(ts AS DATE) AS day FROM docs GROUP BY ALL)
  GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'daily_docs', 'rows', (SELECT count(*) FROM (SELECT DISTINCT situation_id, CAST(ts AS DATE) FROM docs)) - (
  SELECT count(*) FROM (SELECT situation_id, CAST(ts AS DATE) FROM docs GROUP BY ALL))
UNION ALL SELECT 'labels', 'quality_enum', count(*) FILTER (WHERE quality IS NULL OR quality NOT IN (0, 1)) FROM labels
UNION ALL SELECT 'labels', 'toxic_enum', count(*) FILTER (WHERE toxic IS NULL OR toxic NOT IN (0, 1)) FROM labels
UNION ALL SELECT 'conversations', 'role_enum', count(*) FILTER (WHERE role IS NULL OR role NOT IN ('user', 'assistant')) FROM conversations
UNION ALL SELECT 'conversations', 'unique(conv_id,turn)', count(*) FROM (SELECT conv_id, turn FROM conversations GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'pages', 'url_not_null', count(*) FILTER (WHERE url IS NULL) FROM pages
UNION ALL SELECT 'pages', 'unique(url)', count(*) FROM (SELECT url FROM pages GROUP BY url HAVING count(*) > 1)
UNION ALL SELECT 'documents', 'n_chars', count(*) FILTER (WHERE n_chars IS NULL OR n_chars < 0 OR n_chars > length(text)) FROM documents""", "alerts_v", "situations", "sent", "docs"))
def dq_violations(spark, sf):
    a = V.alerts(spark, sf)
    s = V.situations(spark, sf)
    se = V.sent(spark, sf)
    d = V.docs(spark, sf)
    t = lambda n: V.table(spark, sf, n)
    parts = [
        Q.violations(a, {"severity_enum": F.col("severity").isin(*SEV.SEVERITIES)}, "alerts"),
        Q.violations(s, {"status_enum": F.col("status").isin(*V.SITUATION_STATUS)}, "situations"),
        Q.violations(se, {"sentiment_range": F.col("sentiment").between(-1, 1)}, "sent"),
        Q.violations(d, {"content_not_null": F.col("content").isNotNull(),
                         "source_id_pattern": F.col("source_id").rlike("^[A-Za-z0-9_-]+$")}, "docs"),
        Q.duplicate_keys(d, ["id"], "docs"),
        Q.duplicate_keys(V.table(spark, sf, "labels"), ["doc_id"], "labels"),
        *daily_rows(spark, M.docs_by_day(d, newest=None)),
        Q.violations(t("labels"), {"quality_enum": F.col("quality").isin(0, 1), "toxic_enum": F.col("toxic").isin(0, 1)}, "labels"),
        Q.violations(t("conversations"), {"role_enum": F.col("role").isin("user", "assistant")}, "conversations"),
        Q.duplicate_keys(t("conversations"), ["conv_id", "turn"], "conversations"),
        Q.violations(t("pages"), {"url_not_null": F.col("url").isNotNull()}, "pages"),
        Q.duplicate_keys(t("pages"), ["url"], "pages"),
        Q.violations(t("documents"), {"n_chars": F.col("n_chars").between(0, F.length("text"))}, "documents"),
    ]
    return reduce(DataFrame.unionByName, parts)


@register("retention_split", wv(f"""
SELECT 'documents' AS table_name, id, CASE WHEN ts IS NULL THEN 'undated'
       WHEN ts >= TIMESTAMP '{NOW}' - INTERVAL 365 DAY THEN 'keep' ELSE 'expired' END AS status FROM docs
UNION ALL
SELECT 'logs', id, CASE WHEN ts IS NULL THEN 'undated' WHEN ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY THEN 'keep' ELSE 'expired' END FROM logs_v""",
                                "docs", "logs_v"))
def retention_split(spark, sf):
    return Q.retention_split(V.docs(spark, sf), NOW, 365, "documents").unionByName(
        Q.retention_split(V.logs(spark, sf), NOW, 7, "logs"))


@register("upsert_situations", wv(f"""
WITH u AS (SELECT id, name, status, updated_at, 0 AS src FROM situations
           UNION ALL SELECT c_custkey, c_name, 'active', TIMESTAMP '{NOW}', 1 FROM customer WHERE c_acctbal > 5000)
SELECT id, name, status, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, src DESC) AS rn FROM u) WHERE rn = 1""",
                                  "situations"))
def upsert_situations(spark, sf):
    base = V.situations(spark, sf).select("id", "name", "status", "updated_at")
    c = V.table(spark, sf, "customer").where(F.col("c_acctbal") > 5000)
    upd = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("active").alias("status"),
                   V.ntz(NOW).alias("updated_at"))
    return Q.upsert(base, upd, "id", "updated_at")


@register("cascade_delete", wv("""
WITH gone AS (SELECT id FROM situations WHERE status = 'archived'),
removed_docs AS (SELECT id FROM docs WHERE situation_id IN (SELECT id FROM gone))
SELECT a.id, a.situation_id, CASE WHEN a.document_id IN (SELECT id FROM removed_docs) THEN NULL ELSE a.document_id END
       AS document_id
FROM alerts_v a WHERE a.situation_id NOT IN (SELECT id FROM gone)""", "situations", "docs", "alerts_v"))
def cascade_delete(spark, sf):
    gone = V.situations(spark, sf).where(F.col("status") == "archived").select("id")
    d = V.docs(spark, sf).select("id", "situation_id")
    a = V.alerts(spark, sf).select("id", "situation_id", "document_id")
    _, alerts_left = Q.cascade_delete(gone, d, a)
    return alerts_left.select("id", "situation_id", "document_id")


@register("acknowledge_alerts", wv(f"""
SELECT id, acknowledged OR (severity = 'critical' AND NOT acknowledged) AS acknowledged,
       CASE WHEN severity = 'critical' AND NOT acknowledged THEN TIMESTAMP '{NOW}' END AS acknowledged_at,
       CASE WHEN severity = 'critical' AND NOT acknowledged THEN 'ops' END AS acknowledged_by
FROM alerts_v""", "alerts_v"))
def acknowledge_alerts(spark, sf):
    a = V.alerts(spark, sf).select("id", "severity", "acknowledged")
    acks = a.where(F.col("severity") == "critical").select("id", V.ntz(NOW).alias("acknowledged_at"),
                                                           F.lit("ops").alias("acknowledged_by"))
    return Q.acknowledge(a, acks).select("id", "acknowledged", "acknowledged_at", "acknowledged_by")
