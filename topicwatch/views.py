"""Canonical views over the driver's tables.

The monitoring data model (situations, documents, alerts, sentiment, fetch log,
logs, page versions) is mapped onto the given parquet tables by fixed rules.
Each view exists twice: as a Spark DataFrame builder and as a SQL fragment
that DuckDB can run, so every registered query has an independent oracle.
All timestamps stay ``TIMESTAMP_NTZ`` (DuckDB ``TIMESTAMP``) so results do not
depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the mapping (shared by the Spark and SQL forms).
EPOCH = "2024-01-01 00:00:00"
NOW = "2024-01-31 00:00:00"
DOC_SITUATIONS = 20          # documents.doc_id % 20 -> situation
DOC_HOURS = 720              # documents spread over 30 days of hours
SITUATION_STATUS = ["active", "paused", "archived", "error"]


def ntz(ts: str) -> Column:
    return F.to_timestamp_ntz(F.lit(ts))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Set to "true" by callers whose text tables are single row groups (the bench does).
SPREAD_CONF = "topicwatch.views.spread"


def spread(df: DataFrame, key: str = "id") -> DataFrame:
    """With ``topicwatch.views.spread`` set, hash-repartition by ``key`` to the
    session's default parallelism when the scan yields fewer partitions (a table
    stored as one large row group is read by one task however the file is
    split). Off by default: tables of many files need no shuffle."""
    if df.sparkSession.conf.get(SPREAD_CONF, "false") != "true":
        return df
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key)


def hours_after_epoch(hours: Column) -> Column:
    return ntz(EPOCH) + F.make_dt_interval(F.lit(0), hours, F.lit(0), F.lit(0))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    return d.select(
        F.col("doc_id").alias("id"),
        (F.col("doc_id") % DOC_SITUATIONS).alias("situation_id"),
        F.col("source").alias("source_id"),
        F.col("text").alias("content"),
        F.col("lang").alias("language"),
        hours_after_epoch((F.col("doc_id") % DOC_HOURS).cast("int")).alias("ts"),
        F.substring("text", 1, 60).alias("title"),
    )


def severity_of_event(event_type: Column) -> Column:
    return (F.when(event_type == "error", "critical")
            .when(event_type == "purchase", "error")
            .when(event_type == "signup", "warning")
            .otherwise("info"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("situation_id"),
        F.col("event_type").alias("rule_id"),
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source_id"),
        F.col("event_id").alias("document_id"),
        severity_of_event(F.col("event_type")).alias("severity"),
        F.col("event_type").alias("title"),
        F.col("props").alias("message"),
        F.col("ts"),
        ((F.col("event_id") % 3) == 0).alias("acknowledged"),
    )


def sentiment_of_value(value: Column) -> Column:
    return ((F.round(value * 100).cast("bigint") % 201) - 100).cast("double") / 100


def sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("situation_id"),
        F.col("ts"),
        sentiment_of_value(F.col("value")).alias("sentiment"),
    )


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ok = F.col("event_type") != "error"
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("source_id"),
        F.col("ts"),
        ok.alias("ok"),
        F.when(~ok, F.col("props")).alias("error_message"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts"),
        F.when(F.col("event_type") == "error", "ERROR")
         .when(F.col("event_type") == "signup", "WARNING")
         .otherwise("INFO").alias("level"),
        F.col("event_type").alias("source"),
        F.col("props").alias("message"),
    )


def situations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    status = F.element_at(F.array(*[F.lit(s) for s in SITUATION_STATUS]),
                          (F.col("c_custkey") % 4 + 1).cast("int"))
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("query"),
        status.alias("status"),
        ntz(EPOCH).alias("created_at"),
        (ntz(EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0),
                                         ((F.col("c_custkey") * 37) % 43200).cast("int"),
                                         F.lit(0))).alias("updated_at"),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.concat_ws("/", F.col("user_id").cast("string"), F.col("event_type")).alias("url"),
        (F.floor("value").cast("bigint") % 3).cast("string").alias("content_hash"),
        F.col("ts"),
    )


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "pages"), "page_id")
    return p.select(F.col("page_id").alias("id"), "url", F.col("html").alias("raw_html"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(table(spark, sf_dir, "conversations"), "conv_id")
    return c.where(F.col("role") == "user").select("conv_id", "turn", "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


# ---------------------------------------------------------------------------
# The same views as SQL (DuckDB dialect) for the oracle queries.

SQL_VIEWS = {
    "docs": f"""SELECT doc_id AS id, doc_id % {DOC_SITUATIONS} AS situation_id, source AS source_id,
        text AS content, lang AS language,
        TIMESTAMP '{EPOCH}' + to_hours(CAST(doc_id % {DOC_HOURS} AS INTEGER)) AS ts,
        substr(text, 1, 60) AS title
      FROM documents""",
    "alerts_v": """SELECT event_id AS id, user_id AS situation_id, event_type AS rule_id,
        'src' || CAST(user_id % 20 AS VARCHAR) AS source_id, event_id AS document_id,
        CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'error'
                        WHEN 'signup' THEN 'warning' ELSE 'info' END AS severity,
        event_type AS title, props AS message, ts, (event_id % 3) = 0 AS acknowledged
      FROM events""",
    "sent": """SELECT event_id AS id, user_id AS situation_id, ts,
        CAST(CAST(round(value * 100) AS BIGINT) % 201 - 100 AS DOUBLE) / 100 AS sentiment
      FROM events""",
    "fetch_log": """SELECT event_id AS id, user_id AS source_id, ts, event_type <> 'error' AS ok,
        CASE WHEN event_type = 'error' THEN props END AS error_message
      FROM events""",
    "logs_v": """SELECT event_id AS id, ts,
        CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
        event_type AS source, props AS message
      FROM events""",
    "situations": f"""SELECT c_custkey AS id, c_name AS name, c_mktsegment AS query,
        CASE c_custkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'paused' WHEN 2 THEN 'archived' ELSE 'error' END AS status,
        TIMESTAMP '{EPOCH}' AS created_at,
        TIMESTAMP '{EPOCH}' + to_minutes(CAST((c_custkey * 37) % 43200 AS INTEGER)) AS updated_at
      FROM customer""",
    "versions": """SELECT event_id AS id, CAST(user_id AS VARCHAR) || '/' || event_type AS url,
        CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR) AS content_hash, ts
      FROM events""",
    "raw_pages": "SELECT page_id AS id, url, html AS raw_html FROM pages",
    "requests": "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'",
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named canonical views as CTEs."""
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
