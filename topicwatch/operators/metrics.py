"""Dashboard filters, aggregates and top-N reports (F-*, A-1..A-14, J-1, L-*).

All are declarative DataFrame plans: filters reach the Parquet scan, every
aggregate is partial/final (map-side combine), every top-N per group is a
``row_number() <= n`` filter that Spark turns into a map-side group limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import severity as sev
from ..functions.text import explode_values, sentiment_label
from ..functions.timecols import as_ntz, minus


def like_pattern(q: str) -> str:
    """``%q%`` with LIKE wildcards in q escaped (the reference passed them
    through unescaped)."""
    esc = q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return f"%{esc}%"


# ---------------------------------------------------------------- filters

def situations_filter(situations: DataFrame, status: str | None = None,
                      search: str | None = None) -> DataFrame:
    """F-1 status, F-2 case-insensitive search on name or query."""
    df = situations
    if status:
        df = df.where(F.col("status") == status)
    if search:
        p = like_pattern(search)
        df = df.where(F.col("name").ilike(p) | F.col("query").ilike(p))
    return df


def documents_filter(docs: DataFrame, situation_id=None, source_id=None, search: str | None = None,
                     since=None, until=None) -> DataFrame:
    """F-3: situation, source, title/content search, since <= ts <= until."""
    df = docs
    if situation_id is not None:
        df = df.where(F.col("situation_id") == situation_id)
    if source_id is not None:
        df = df.where(F.col("source_id") == source_id)
    if search:
        p = like_pattern(search)
        df = df.where(F.col("title").ilike(p) | F.col("content").ilike(p))
    if since is not None:
        df = df.where(F.col("ts") >= as_ntz(since))
    if until is not None:
        df = df.where(F.col("ts") <= as_ntz(until))
    return df


def page(df: DataFrame, order: list[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    """L-2/L-3: ordered page; the caller's order must end in a unique key."""
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(limit)


def keyset_page(df: DataFrame, after_ts=None, after_id=None, limit: int = 100) -> DataFrame:
    """L-2 deep pages: rows strictly after (ts, id) in (ts desc, id desc)
    order, so no offset rows are ever sorted and skipped."""
    if after_ts is not None:
        t = as_ntz(after_ts)
        df = df.where((F.col("ts") < t) | ((F.col("ts") == t) & (F.col("id") < F.lit(after_id))))
    return df.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit)


def document_by_id(docs: DataFrame, doc_id) -> DataFrame:
    """F-4: the document or no row."""
    return docs.where(F.col("id") == doc_id).limit(1)


def alerts_filter(alerts: DataFrame, situation_id=None, acknowledged: bool | None = None,
                  severity: str | None = None) -> DataFrame:
    """F-5: tri-state acknowledged (None = both)."""
    df = alerts
    if situation_id is not None:
        df = df.where(F.col("situation_id") == situation_id)
    if acknowledged is not None:
        df = df.where(F.col("acknowledged") == F.lit(acknowledged))
    if severity:
        df = df.where(F.col("severity") == severity)
    return df


def recent(df: DataFrame, now, hours: float = 24, ts: str = "ts") -> DataFrame:
    """F-6: rows with ts >= now - hours."""
    return df.where(F.col(ts) >= minus(as_ntz(now), hours=hours))


def recent_alerts(alerts: DataFrame, now, hours: float = 24, limit: int = 50) -> DataFrame:
    return page(recent(alerts, now, hours), [F.col("ts").desc(), F.col("id").desc()], limit)


def logs_filter(logs: DataFrame, level: str | None = None, since=None) -> DataFrame:
    """F-7: level compared upper-cased."""
    df = logs
    if level:
        df = df.where(F.upper(F.col("level")) == level.upper())
    if since is not None:
        df = df.where(F.col("ts") >= as_ntz(since))
    return df


def log_page_filter(logs: DataFrame, levels: list[str] | None = None, source_q: str | None = None,
                    message_q: str | None = None) -> DataFrame:
    """F-8: level in set, case-folded substring on source and message."""
    df = logs
    if levels:
        df = df.where(F.col("level").isin(levels))
    if source_q:
        df = df.where(F.instr(F.lower(F.col("source")), source_q.lower()) > 0)
    if message_q:
        df = df.where(F.instr(F.lower(F.col("message")), message_q.lower()) > 0)
    return df


def alert_page_filter(alerts: DataFrame, situations: DataFrame, severities: list[str] | None = None,
                      ack_mode: str = "all", situation_name: str | None = None, cutoff=None) -> DataFrame:
    """F-9: severity in set, unacknowledged/acknowledged/all, situation
    name -> id (first match by id), ts > cutoff (strict). Adds the
    situation name (J-9) for display."""
    df = alerts
    if severities:
        df = df.where(F.col("severity").isin(severities))
    if ack_mode == "unacknowledged":
        df = df.where(~F.col("acknowledged"))
    elif ack_mode == "acknowledged":
        df = df.where(F.col("acknowledged"))
    if cutoff is not None:
        df = df.where(F.col("ts") > as_ntz(cutoff))
    names = situations.select(F.col("id").alias("situation_id"), F.col("name").alias("situation_name"))
    if situation_name:
        first = (names.where(F.col("situation_name") == situation_name)
                 .groupBy("situation_name").agg(F.min("situation_id").alias("situation_id")))
        return df.join(first, "situation_id", "inner")
    return df.join(names, "situation_id", "left")


def enabled_only(df: DataFrame) -> DataFrame:
    """F-11."""
    return df.where(F.coalesce(F.col("enabled"), F.lit(False)))


def non_null(df: DataFrame, col: str) -> DataFrame:
    """F-16."""
    return df.where(F.col(col).isNotNull())


# ------------------------------------------------------------- aggregates

def docs_by_day(docs: DataFrame, newest: int | None = 30) -> DataFrame:
    """A-1: documents per situation and day, newest ``newest`` days present (None: all)."""
    daily = docs.groupBy("situation_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("doc_count"))
    if newest is None:
        return daily
    w = Window.partitionBy("situation_id").orderBy(F.col("day").desc())
    return daily.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= newest).drop("_rn")


def alerts_by_severity(alerts: DataFrame) -> DataFrame:
    """A-2."""
    return alerts.groupBy("situation_id", "severity").agg(F.count(F.lit(1)).alias("alert_count"))


def sentiment_stats(sent: DataFrame, digits: int = 6) -> DataFrame:
    """A-3: avg/min/max of non-NULL sentiment; AVG over none stays NULL."""
    s = sent.where(F.col("sentiment").isNotNull())
    return s.groupBy("situation_id").agg(
        F.round(F.avg("sentiment"), digits).alias("avg_sentiment"),
        F.min("sentiment").alias("min_sentiment"),
        F.max("sentiment").alias("max_sentiment"),
        F.count(F.lit(1)).alias("n"))


def sentiment_trend(sent: DataFrame, now, days: int = 7, digits: int = 6) -> DataFrame:
    """A-4: daily average sentiment and count over the last ``days`` days."""
    s = sent.where((F.col("ts") >= minus(as_ntz(now), days=days)) & F.col("sentiment").isNotNull())
    return (s.groupBy("situation_id", F.to_date("ts").alias("day"))
            .agg(F.round(F.avg("sentiment"), digits).alias("avg_sentiment"),
                 F.count(F.lit(1)).alias("doc_count")))


def keyword_frequency(doc_keywords: DataFrame, top_n: int = 20, keywords_col: str = "keywords") -> DataFrame:
    """A-5: keyword counts per situation, top N (ties: keyword asc); a
    keyword repeated in one document's list counts each time."""
    ex = doc_keywords.select("situation_id", explode_values(F.col(keywords_col)).alias("keyword")).where(
        F.col("keyword").isNotNull())
    counts = ex.groupBy("situation_id", "keyword").agg(F.count(F.lit(1)).alias("kw_count"))
    w = Window.partitionBy("situation_id").orderBy(F.col("kw_count").desc(), F.col("keyword"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def entity_timeline(doc_entities: DataFrame, now, days: int = 7, entities_col: str = "entities") -> DataFrame:
    """A-6: entity mentions per situation and day; struct entities use
    name, then text, then 'Unknown'."""
    d = doc_entities.where((F.col("ts") >= minus(as_ntz(now), days=days)) & F.col(entities_col).isNotNull())
    ex = d.select("situation_id", F.to_date("ts").alias("day"), explode_values(F.col(entities_col)).alias("e")).where(
        F.col("e").isNotNull())
    etype = dict(ex.dtypes)["e"]
    if etype.startswith("struct"):
        fields = [f.name for f in ex.schema["e"].dataType.fields]
        cands = [F.col(f"e.{f}") for f in ("name", "text") if f in fields]
        name = F.coalesce(*cands, F.lit("Unknown"))
    else:
        name = F.coalesce(F.col("e"), F.lit("Unknown"))
    return ex.groupBy("situation_id", "day", name.alias("entity")).agg(F.count(F.lit(1)).alias("mentions"))


def top_entity_timeline(timeline: DataFrame, n: int = 10) -> DataFrame:
    """A-9: timeline restricted to each situation's ``n`` most-mentioned
    entities (ties: entity asc)."""
    totals = timeline.groupBy("situation_id", "entity").agg(F.sum("mentions").alias("total"))
    w = Window.partitionBy("situation_id").orderBy(F.col("total").desc(), F.col("entity"))
    top = totals.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).select("situation_id", "entity")
    return timeline.join(top, ["situation_id", "entity"], "left_semi")


def activity_heatmap(docs: DataFrame, now, days: int = 30) -> DataFrame:
    """A-7: documents per situation, day and hour."""
    d = docs.where(F.col("ts") >= minus(as_ntz(now), days=days))
    return (d.groupBy("situation_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"))
            .agg(F.count(F.lit(1)).alias("doc_count")))


def heatmap_pivot(heatmap: DataFrame) -> DataFrame:
    """A-8: one row per (situation, day), columns h0..h23, missing -> 0.
    Conditional sums over the fixed 24 hours: one pass, no distinct job."""
    cols = [F.coalesce(F.sum(F.when(F.col("hour") == h, F.col("doc_count"))), F.lit(0)).cast("bigint").alias(f"h{h}")
            for h in range(24)]
    return heatmap.groupBy("situation_id", "day").agg(*cols)


def volume_by_date(docs: DataFrame, now, days: int = 30) -> DataFrame:
    """A-10: documents per date with ts > now - days (strict)."""
    d = docs.where(F.col("ts") > minus(as_ntz(now), days=days))
    return d.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("doc_count"))


def sentiment_distribution(sent: DataFrame) -> DataFrame:
    """A-11: positive (> 0.1) / negative (< -0.1) / neutral (rest)."""
    lab = sentiment_label(F.col("sentiment"), "distribution")
    s = sent.where(F.col("sentiment").isNotNull())
    return s.groupBy("situation_id").agg(
        F.count_if(lab == "positive").alias("positive"),
        F.count_if(lab == "neutral").alias("neutral"),
        F.count_if(lab == "negative").alias("negative"))


def alert_summary(alerts: DataFrame, now) -> DataFrame:
    """A-12: total, unacknowledged, critical, last 24 h."""
    return alerts.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("acknowledged")).alias("unacknowledged"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("ts") >= minus(as_ntz(now), hours=24)).alias("last_24h"))


def log_summary(logs: DataFrame) -> DataFrame:
    """A-13: total, ERROR, WARNING."""
    return logs.agg(F.count(F.lit(1)).alias("total"),
                    F.count_if(F.col("level") == "ERROR").alias("errors"),
                    F.count_if(F.col("level") == "WARNING").alias("warnings"))


def system_health(situations: DataFrame, docs: DataFrame, alerts: DataFrame, logs: DataFrame,
                  warn_unacknowledged: int = 10) -> DataFrame:
    """A-14: one row of scalar aggregates. The four inputs are narrowed,
    tagged and unioned, then reduced by a single aggregation (no joins)."""
    def tagged(df: DataFrame, tag: str, **cols: Column) -> DataFrame:
        base = {"tag": F.lit(tag), "flag": F.lit(None).cast("boolean"),
                "ts": F.lit(None).cast("timestamp_ntz"), "id": F.lit(None).cast("bigint"),
                "message": F.lit(None).cast("string")}
        base.update(cols)
        return df.select(*[c.alias(n) for n, c in base.items()])
    u = (tagged(situations, "s", flag=F.col("status") == "active")
         .unionByName(tagged(docs, "d"))
         .unionByName(tagged(alerts, "a", flag=~F.col("acknowledged")))
         .unionByName(tagged(logs.where(F.col("level") == "ERROR"), "l", ts=F.col("ts"),
                             id=F.col("id").cast("bigint"), message=F.col("message"))))
    one = u.agg(
        F.count_if((F.col("tag") == "s") & F.col("flag")).alias("active_situations"),
        F.count_if(F.col("tag") == "d").alias("total_documents"),
        F.count_if(F.col("tag") == "a").alias("total_alerts"),
        F.count_if((F.col("tag") == "a") & F.col("flag")).alias("unacknowledged_alerts"),
        F.max(F.when(F.col("tag") == "l", F.struct("ts", "id", "message"))).alias("_m"))
    return one.select("active_situations", "total_documents", "total_alerts", "unacknowledged_alerts",
                      F.col("_m.message").alias("last_error"),
                      F.when(F.col("unacknowledged_alerts") > warn_unacknowledged, "warning")
                      .otherwise("healthy").alias("status"))


def situation_counts(situations: DataFrame, sources: DataFrame, documents: DataFrame,
                     alerts: DataFrame) -> DataFrame:
    """J-1: per situation, distinct sources, documents and alerts (0 when
    none). Each child is reduced to one row per situation first, so the three
    left joins never fan out."""
    def per(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("situation_id").agg(F.countDistinct("id").alias(name))
    out = (situations.join(per(sources, "source_count").withColumnRenamed("situation_id", "id"), "id", "left")
           .join(per(documents, "document_count").withColumnRenamed("situation_id", "id"), "id", "left")
           .join(per(alerts, "alert_count").withColumnRenamed("situation_id", "id"), "id", "left"))
    return out.fillna(0, ["source_count", "document_count", "alert_count"])


def latest_situations(df: DataFrame, limit: int = 100) -> DataFrame:
    """L-1: by updated_at desc (id desc breaks ties)."""
    return page(df, [F.col("updated_at").desc(), F.col("id").desc()], limit)


def severity_band(alerts: DataFrame, min_severity: str | None, max_severity: str | None) -> DataFrame:
    """F-17."""
    return alerts.where(sev.in_band(F.col("severity"), F.lit(min_severity), F.lit(max_severity)))


def geography(entities: Column) -> Column:
    """F-18: texts of entities labelled GPE or LOC."""
    return F.transform(F.filter(entities, lambda e: e["label"].isin("GPE", "LOC")), lambda e: e["text"])


def kept_entity_labels(entities: Column) -> Column:
    """F-19: distinct texts of PERSON/ORG/GPE/PRODUCT entities."""
    return F.array_distinct(F.transform(F.filter(entities, lambda e: e["label"].isin("PERSON", "ORG", "GPE", "PRODUCT")),
                                        lambda e: e["text"]))


def fallback_projection(df: DataFrame) -> DataFrame:
    """F-13: title -> 'Untitled'."""
    return df.withColumn("title", F.coalesce(F.col("title"), F.lit("Untitled")))


def entity_day_pivot(timeline: DataFrame, n: int = 10) -> DataFrame:
    """A-9 pivot: one row per (situation, day) with the mention counts of the
    situation's top ``n`` entities as columns e1..en (0 when absent) and their
    names as columns name1..namen. Pivoting on the rank, not the name, keeps
    the column set fixed (no distinct-values job)."""
    totals = timeline.groupBy("situation_id", "entity").agg(F.sum("mentions").alias("_t"))
    w = Window.partitionBy("situation_id").orderBy(F.col("_t").desc(), F.col("entity"))
    top = totals.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_t")
    t = timeline.join(top, ["situation_id", "entity"])
    names = top.groupBy("situation_id").agg(
        *[F.max(F.when(F.col("_r") == i, F.col("entity"))).alias(f"name{i}") for i in range(1, n + 1)])
    days = t.groupBy("situation_id", "day").agg(
        *[F.coalesce(F.sum(F.when(F.col("_r") == i, F.col("mentions"))), F.lit(0)).cast("bigint").alias(f"e{i}")
          for i in range(1, n + 1)])
    return days.join(names, "situation_id")
