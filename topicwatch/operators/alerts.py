"""Alert rules, gates, digests, channels and notification payloads (J-2..J-4,
J-11, J-14, S-16..S-22, W-5, ST-3..ST-7, SNK-11, A-20, A-23).

Rules and channels are configuration: a small table whose size is checked.
They reach the tasks as one scalar-subquery array, and every document or
alert row evaluates that array in a projection (``filter`` + ``explode``):
no cross join, no shuffle of the big side. Where a rule is looked up by its
id (the gate), it is joined instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import severity as SEV
from ..functions.text import explode_values
from ..functions.timecols import hour_start, in_quiet_hours
from .dense_folds import keep_spaced
from .folds import greedy_fold

RULE_SCHEMA = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("min_severity", T.StringType()),
    T.StructField("max_severity", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("source_ids", T.ArrayType(T.StringType())),
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("regex_patterns", T.ArrayType(T.StringType())),
    T.StructField("aggregation_mode", T.StringType()),
    T.StructField("cooldown_seconds", T.IntegerType()),
    T.StructField("max_alerts_per_hour", T.IntegerType()),
    T.StructField("digest_interval_minutes", T.IntegerType()),
    T.StructField("quiet_hours_start", T.IntegerType()),
    T.StructField("quiet_hours_end", T.IntegerType()),
    T.StructField("quiet_hours_severity_exemption", T.StringType()),
])

CHANNEL_SCHEMA = T.StructType([
    T.StructField("channel", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("min_severity", T.StringType()),
    T.StructField("rate_limit_seconds", T.IntegerType()),
    T.StructField("quiet_hours_start", T.IntegerType()),
    T.StructField("quiet_hours_end", T.IntegerType()),
    T.StructField("template", T.StringType()),
])

# Example rule set of the reference configuration (security / error /
# info) — fixed values.
EXAMPLE_RULES = [
    dict(rule_id="security", name="Security Issues", enabled=True, severity="warning",
         keywords=["security", "vulnerability", "exploit"], regex_patterns=[r"CVE-\d{4}-\d+"],
         source_ids=[], cooldown_seconds=3600, aggregation_mode="immediate"),
    dict(rule_id="error", name="Critical Errors", enabled=True, severity="error",
         keywords=["error", "failure", "critical"], regex_patterns=[], source_ids=[],
         cooldown_seconds=1800, aggregation_mode="immediate"),
    dict(rule_id="info", name="Updates", enabled=True, severity="info",
         keywords=["update", "release"], regex_patterns=[], source_ids=[], cooldown_seconds=7200,
         aggregation_mode="digest", digest_interval_minutes=60),
]


def config_array(rows: list[dict], schema: T.StructType) -> Column:
    """Configuration rows from plain dicts (missing fields NULL, missing lists empty) as one literal array."""
    structs = []
    for r in rows:
        fields = []
        for f in schema.fields:
            v = r.get(f.name)
            if v is None and isinstance(f.dataType, T.ArrayType):
                v = []
            if isinstance(f.dataType, T.ArrayType):
                lit = F.array(*[F.lit(x) for x in v]).cast(f.dataType)
            else:
                lit = F.lit(v).cast(f.dataType)
            fields.append(lit.alias(f.name))
        structs.append(F.struct(*fields))
    return F.array(*structs)


def config_frame(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """A configuration table from plain dicts, built as JVM literals (no Python worker, no RDD)."""
    return spark.range(1).select(F.inline(config_array(rows, schema)))


def rules_frame(spark: SparkSession, rules: list[dict] | None = None) -> DataFrame:
    return config_frame(spark, rules if rules is not None else EXAMPLE_RULES, RULE_SCHEMA)


def as_array(config: DataFrame) -> Column:
    """The whole configuration table as one scalar array column. Its size is the
    configuration's (rules and channels that people write), not the data's."""
    return config.select(F.collect_list(F.struct(*config.columns))).scalar()


def _rule_hits(rule: Column, low_text: Column, text: Column, source: Column) -> Column:
    source_ok = (F.size(rule["source_ids"]) == 0) | F.array_contains(rule["source_ids"], source)
    kw = F.exists(rule["keywords"], lambda k: (k != "") & (F.instr(low_text, F.lower(k)) > 0))
    rx = F.exists(rule["regex_patterns"], lambda p: F.regexp_like(text, F.concat(F.lit("(?iu)"), p)))
    return F.coalesce(rule["enabled"], F.lit(False)) & source_ok & (kw | rx)


def match_rules(docs: DataFrame, rules: DataFrame, text_col: str = "content",
                source_col: str = "source_id") -> DataFrame:
    """J-2/J-3/J-4: one alert per (document row, matching rule). A rule matches
    when it is enabled, its source list is empty or holds the document's
    source, and any non-empty keyword is a case-insensitive substring of the text or
    any regex pattern matches (case-insensitive). Title ``Alert: {name}``,
    message ``Keywords matched in {source}: {first 100 chars of the
    lower-cased text}...`` (S-22). One path for rule sets of every size."""
    arr = as_array(rules)
    text = F.col(text_col)
    # The lower-cased text is projected once; lambdas then only reference it.
    with_rules = docs.select("*", F.lower(text).alias("_low"), arr.alias("_rules"))
    low = F.col("_low")
    hits = with_rules.select("*", explode_values(F.filter(
        F.col("_rules"), lambda r: _rule_hits(r, low, text, F.col(source_col)))).alias("_r")).drop("_rules")
    hits = hits.where(F.col("_r").isNotNull())
    return _alert_columns(hits, low, source_col).drop("_low")


def _alert_columns(df: DataFrame, low: Column, source_col: str, rule: str = "_r") -> DataFrame:
    return df.select(
        "*",
        F.col(f"{rule}.rule_id").alias("rule_id"),
        SEV.canonical(F.col(f"{rule}.severity")).alias("severity"),
        F.concat(F.lit("Alert: "), F.col(f"{rule}.name")).alias("alert_title"),
        F.concat(F.lit("Keywords matched in "), F.col(source_col).cast("string"), F.lit(": "),
                 F.substring(low, 1, 100), F.lit("...")).alias("alert_message"),
    ).drop(rule)


def keyword_gate(alerts: DataFrame, rules: DataFrame, keywords: bool = True) -> DataFrame:
    """J-14 + F-17 + J-4 + S-17 as one gate: every alert meets its rule (by
    rule_id, a left join that Spark broadcasts by size); adds ``gate`` = 'pass'
    or the first failing reason, in the order enabled, source, severity,
    keywords, quiet hours. Of rules that share an id the smallest row counts.
    ``keywords=False`` leaves the keywords out, for alerts that a rule's match has made."""
    one = rules.groupBy(F.col("rule_id").alias("_rule_id")).agg(F.min(F.struct(*rules.columns)).alias("_rule"))
    a = alerts.join(one, F.col("rule_id") == F.col("_rule_id"), "left").drop("_rule_id")
    r = F.col("_rule")
    text = F.lower(F.concat_ws(" ", F.col("title"), F.col("message")))
    kw_ok = (F.size(r["keywords"]) == 0) | F.exists(r["keywords"], lambda k: F.instr(text, F.lower(k)) > 0)
    kw_ok = kw_ok if keywords else F.lit(True)
    src_ok = (F.size(r["source_ids"]) == 0) | F.array_contains(r["source_ids"], F.col("source_id"))
    band_ok = SEV.in_band(F.col("severity"), r["min_severity"], r["max_severity"])
    quiet = in_quiet_hours(F.col("ts"), r["quiet_hours_start"], r["quiet_hours_end"]) & ~F.coalesce(
        SEV.rank(F.col("severity")) >= SEV.rank(r["quiet_hours_severity_exemption"]), F.lit(False))
    gate = (F.when(r.isNull(), "no rule").when(~F.coalesce(r["enabled"], F.lit(False)), "disabled")
            .when(~src_ok, "source").when(~band_ok, "severity").when(~kw_ok, "keywords")
            .when(quiet, "quiet hours").otherwise("pass"))
    return a.withColumn("gate", gate)


def hourly_cap(alerts: DataFrame, cap: int, keys: list[str] | None = None) -> DataFrame:
    """W-5 (clock hours): the first ``cap`` alerts per key and clock hour
    by (ts, id); the rest dropped. Spark plans ``row_number() <= cap`` with a
    map-side group limit, so a hot hour is cut down before the shuffle."""
    keys = keys or ["rule_id"]
    a = alerts.withColumn("hour", hour_start(F.col("ts")))
    w = Window.partitionBy(*keys, "hour").orderBy("ts", "id")
    return a.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def cooldown(alerts: DataFrame, keys: list[str], cooldown_s: float, **kw) -> DataFrame:
    """ST-3 / ST-6: greedy cooldown per key; returns kept rows only."""
    return greedy_fold(alerts, keys, cooldown_s=cooldown_s, **kw).where("kept").drop("kept")


def cooldown_dense(alerts: DataFrame, keys: list[str], cooldown_s: float, **kw) -> DataFrame:
    """ST-3 / ST-6 where a key may hold very many rows without a gap: the same rows as ``cooldown``, one key shared
    by many tasks."""
    return keep_spaced(alerts, keys, cooldown_s, **kw)


def throttle(alerts: DataFrame, keys: list[str], cooldown_s: float = 0.0, max_per_hour: int | None = None,
             **kw) -> DataFrame:
    """ST-4: rule cooldown plus sliding one-hour cap; kept rows only."""
    return greedy_fold(alerts, keys, cooldown_s=cooldown_s, cap=max_per_hour, cap_window_s=3600.0,
                       **kw).where("kept").drop("kept")


DEDUP_KEY = ["rule_id", "source_id", "severity", "title", "message"]


def dedup_alerts(alerts: DataFrame, window_s: float, key: list[str] | None = None) -> DataFrame:
    """ST-6: drop an alert when an identical one (same rule, source,
    severity, title, message; id ignored) was passed less than
    ``window_s`` before."""
    return cooldown(alerts, key or DEDUP_KEY, window_s)


def digests(alerts: DataFrame, interval_minutes: int, keys: list[str] | None = None) -> DataFrame:
    """ST-5: one digest row per key and tumbling interval: "N alerts"."""
    keys = keys or ["rule_id"]
    g = alerts.groupBy(*keys, F.window("ts", f"{interval_minutes} minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("alert_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.max(SEV.rank(F.col("severity"))).alias("_rank"))
    return g.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "alert_count", "first_ts", "last_ts",
                    F.element_at(F.array(*[F.lit(s) for s in SEV.SEVERITIES]), F.col("_rank") + 1).alias("severity"),
                    F.concat(F.col("alert_count").cast("string"), F.lit(" alerts")).alias("title"))


def channel_rows(alerts: DataFrame, channels: Column, only: list[str] | None = None) -> DataFrame:
    """One row per (alert, enabled channel) of the array ``channels``; ``pre`` is 'filtered' (below the channel's minimum
    severity), 'quiet hours' or NULL."""
    a = alerts.select("*", channels.alias("_ch"))
    chosen = F.filter(F.col("_ch"), lambda c: F.coalesce(c["enabled"], F.lit(False))
                      & (F.lit(True) if not only else c["channel"].isin(*only)))
    x = a.select("*", explode_values(chosen).alias("_c")).drop("_ch").where(F.col("_c").isNotNull())
    filtered = ~F.coalesce(SEV.rank(F.col("severity")) >= SEV.rank(F.col("_c.min_severity")), F.lit(True))
    quiet = in_quiet_hours(F.col("ts"), F.col("_c.quiet_hours_start"), F.col("_c.quiet_hours_end"))
    return x.withColumn("channel", F.col("_c.channel")).withColumn("kind", F.col("_c.kind")).withColumn(
        "template", F.col("_c.template")).withColumn(
        "rate_limit_seconds", F.coalesce(F.col("_c.rate_limit_seconds"), F.lit(0))).withColumn(
        "pre", F.when(filtered, "filtered").when(quiet, "quiet hours")).drop("_c")


def channel_fanout(alerts: DataFrame, channels: DataFrame, only: list[str] | None = None) -> DataFrame:
    """J-11 + ST-7: one row per (alert, enabled channel) with ``status``:
    'filtered' (below the channel's minimum severity), 'quiet hours',
    'rate limited' (an identical alert passed the channel less than
    rate_limit_seconds before) or 'sent'."""
    x = channel_rows(alerts, as_array(channels), only)
    passing = x.where(F.col("pre").isNull())
    limits = [r[0] for r in channels.select(F.coalesce("rate_limit_seconds", F.lit(0))).distinct().collect()]
    parts = []
    for lim in limits:  # one fold per distinct rate limit (a handful of configured values)
        p = passing.where(F.col("rate_limit_seconds") == lim)
        if lim and lim > 0:
            p = greedy_fold(p, ["channel"] + DEDUP_KEY, cooldown_s=float(lim), out_col="_ok")
        else:
            p = p.withColumn("_ok", F.lit(True))
        parts.append(p.withColumn("status", F.when(F.col("_ok"), "sent").otherwise("rate limited")).drop("_ok"))
    blocked = x.where(F.col("pre").isNotNull()).withColumn("status", F.col("pre"))
    out = blocked
    for p in parts:
        out = out.unionByName(p)
    return out.drop("pre")


def delivery_stats(deliveries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A-20: per alert (attempted, succeeded, any success) and per channel
    (attempted, delivered)."""
    per_alert = deliveries.groupBy("id").agg(F.count(F.lit(1)).alias("attempted"),
                                             F.count_if(F.col("status") == "sent").alias("succeeded"),
                                             F.bool_or(F.col("status") == "sent").alias("success"))
    per_channel = deliveries.groupBy("channel").agg(F.count(F.lit(1)).alias("attempted"),
                                                    F.count_if(F.col("status") == "sent").alias("delivered"))
    return per_alert, per_channel


def json_text(value: Column) -> Column:
    """A value as the inside of a JSON string literal (NULL: empty)."""
    quoted = F.to_json(F.struct(F.coalesce(value, F.lit("")).alias("v")))
    return F.substring(quoted, F.lit(7), F.length(quoted) - 8)


def payload(alert_id: Column, title: Column, message: Column, severity: Column, ts: Column,
            kind: Column, template: Column) -> Column:
    """SNK-11: notification body per channel kind (discord embed, email
    text, console line, slack blocks, webhook template with {{field}}
    placeholders)."""
    color = (F.when(severity == "critical", 15158332).when(severity == "error", 15105570)
             .when(severity == "warning", 16776960).otherwise(3447003))
    discord = F.to_json(F.struct(F.array(F.struct(title.alias("title"), message.alias("description"),
                                                   color.alias("color"),
                                                   F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp")))
                                 .alias("embeds")))
    email = F.format_string("Subject: [%s] %s\n\n%s", F.upper(severity), title, message)
    console = F.format_string("[%s] %s %s: %s", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.upper(severity),
                              title, message)
    slack = F.to_json(F.struct(F.array(
        F.struct(F.lit("header").alias("type"),
                 F.struct(F.lit("plain_text").alias("type"), title.alias("text")).alias("text")),
        F.struct(F.lit("section").alias("type"),
                 F.struct(F.lit("mrkdwn").alias("type"), message.alias("text")).alias("text"))).alias("blocks")))
    tpl = F.coalesce(template, F.lit('{"alert_id": "{{alert_id}}", "title": "{{title}}"}'))
    values = {"alert_id": alert_id.cast("string"), "title": title, "message": message, "severity": severity}

    def filled(part: Column) -> Column:
        out = part
        for name, value in values.items():
            out = F.when(part == f"{{{{{name}}}}}", json_text(value)).otherwise(out)
        return out

    # One pass: the template is cut at its placeholders, so text put in is never read as a placeholder.
    webhook = F.array_join(F.transform(F.split(tpl, r"(?=\{\{)|(?<=\}\})"), filled), "")
    return (F.when(kind == "discord", discord).when(kind == "email", email).when(kind == "slack", slack)
            .when(kind == "webhook", webhook).otherwise(console))


def outbox(deliveries: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """SNK-11: payload rows for the 'sent' deliveries; ``keep`` names further columns to carry."""
    s = deliveries.where(F.col("status") == "sent")
    return s.select(F.col("id").alias("alert_id"), "channel", "kind",
                    payload(F.col("id"), F.col("title"), F.coalesce(F.col("message"), F.lit("")), F.col("severity"),
                            F.col("ts"), F.col("kind"), F.col("template")).alias("payload"), *(keep or []))


def should_alert_simple(sentiment: Column, entity_count: Column) -> Column:
    """S-18 (threshold part; the cooldown is ``cooldown``)."""
    return (F.abs(sentiment) > 0.8) | (entity_count > 5)


def should_alert_analysis(score: Column, change: Column, new_entities: Column, spikes: Column) -> Column:
    """S-19: |change| >= 0.3, any new entity, any keyword spike, or
    score <= -0.8."""
    return (F.coalesce(F.abs(change) >= 0.3, F.lit(False)) | (F.coalesce(new_entities, F.lit(0)) > 0)
            | (F.coalesce(spikes, F.lit(0)) > 0) | F.coalesce(score <= -0.8, F.lit(False)))


def alert_content(change: Column, new_entities: Column, spikes: Column, documents: Column,
                  sources: Column) -> tuple[Column, Column]:
    """S-21: (title, message)."""
    title = (F.when(change <= -0.3, "Sentiment drop detected").when(change >= 0.3, "Sentiment rise detected")
             .when(F.size(new_entities) > 0, "New entities detected")
             .when(F.size(spikes) > 0, "Keyword spikes detected").otherwise("Situation update"))
    parts = F.array(
        F.when(F.size(new_entities) > 0, F.concat(F.lit("New entities: "), F.array_join(new_entities, ", "))),
        F.when(F.size(spikes) > 0, F.concat(F.lit("Keyword spikes: "), F.array_join(spikes, ", "))),
        F.format_string("%d documents from %d sources", documents, sources))
    return title, F.array_join(F.filter(parts, lambda p: p.isNotNull()), ". ")

