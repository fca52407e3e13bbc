"""ST-16: the whole flow from landed pages to the outbox, as one stream with two stateful steps and as its batch twin.

land -> first copy of each content (state per content hash) -> extract -> analyse -> rules -> gate -> cooldown and hourly
cap (state per rule) -> channels -> outbox. Everything between the two states is the same code in both forms.

Both states are ``transformWithStateInPandas`` on RocksDB with event-time timers. The first hands its watermark on by naming the
event-time column, so the second drops its state by the same clock. Within a micro-batch each state takes its rows in (time, id)
order, so a stream whose batches come in time order gives the rows of the batch form, whatever the batches and restarts.

Missing values have defined results: a page without an id, a time or content is left out, a null source is a source like any
other for rules without a source list, a rule without cooldown or cap has none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import severity as SEV
from ..functions.ids import content_hash
from ..operators import alerts as AL
from ..operators import dedup as D
from ..operators import extract as X
from ..operators import textops as TO
from ..operators.folds import greedy_fold
from ..operators.gazetteer import match_many_rules
from ..session import ship_code

HOUR_US = 3_600_000_000
#: Keys of the state of content hashes. A started stream keeps its number.
BUCKETS = 1024
CONSOLE = [dict(channel="console", kind="console", enabled=True)]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class FirstCopy(StatefulProcessor):
    """Emits the first row of a content hash by (time, id); the hash is forgotten ``keep_ms`` of event time later.

    A key is one of ``BUCKETS`` buckets of hashes, so that frames and calls are paid per bucket; the state has a row per hash, and one per
    time at which hashes of the bucket are forgotten."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "hash string", "us long")
        self.ends = handle.getMapState("ends", "ms long", "hashes array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, known = None, {}
        for chunk in rows:  # one row of a hash is kept at a time, however many copies there are
            chunk = chunk.sort_values(["event_us", "id"]).drop_duplicates("content_hash")
            for h in chunk["content_hash"]:
                if h not in known:
                    known[h] = self.seen.containsKey((h,))
            chunk = chunk[~chunk["content_hash"].map(known).astype(bool)]
            first = chunk if first is None else pd.concat([first, chunk]).sort_values(["event_us", "id"]).drop_duplicates("content_hash")
        if first is None or first.empty:
            return
        ends: dict[int, list[str]] = {}
        for h, us in zip(first["content_hash"].tolist(), first["event_us"].tolist()):
            self.seen.updateValue((h,), (us,))
            ends.setdefault(us // 1000 + self.keep_ms, []).append(h)
        for ms, hashes in ends.items():
            if self.ends.containsKey((ms,)):
                hashes = [*self.ends.getValue((ms,))[0], *hashes]
            self.ends.updateValue((ms,), (hashes,))
            self.handle.registerTimer(ms)
        yield first.drop(columns="_bucket", errors="ignore")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        for h in self.ends.getValue((ms,))[0]:
            self.seen.removeKey((h,))
        self.ends.removeKey((ms,))
        return iter([])

    def close(self) -> None:
        pass


class RuleThrottle(StatefulProcessor):
    """Greedy cooldown and sliding hourly cap of one rule. State: the last kept time and the kept times of the last hour; dropped by a
    timer once the next row would pass regardless. A micro-batch's alerts of a rule are sorted in memory: ``maxFilesPerTrigger``
    bounds them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "last long, recent array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        _, cooldown_s, cap = key
        cool_us = int(cooldown_s) * 1_000_000
        last, recent = self.kept.get() if self.kept.exists() else (None, [])
        recent = list(recent or [])
        rows = pd.concat(list(rows)).sort_values(["event_us", "id"])
        keep = []
        for t in rows["event_us"].tolist():
            ok = last is None or t - last >= cool_us
            if ok and cap >= 0:
                recent = [r for r in recent if r > t - HOUR_US]
                ok = len(recent) < cap
            if ok:
                last = t
                if cap >= 0:
                    recent.append(t)
            keep.append(ok)
        if last is not None:  # a cap of 0 keeps nothing
            self.kept.update((last, recent))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last + max(cool_us, HOUR_US if cap >= 0 else 0)) // 1000 + 1)
        yield rows[keep]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter([])

    def close(self) -> None:
        pass


def landed(raw: DataFrame) -> DataFrame:
    """The pages that go on, with their content hash and event time."""
    text, ts = F.col("raw_html"), F.col("fetched_at")
    rows = raw.where(F.col("id").isNotNull() & ts.isNotNull() & (F.coalesce(text, F.lit("")) != ""))
    return rows.select(F.col("id"), F.col("url"), F.col("source_id").cast("string").alias("source_id"), "raw_html",
                       content_hash(text).alias("content_hash"), ts.cast("timestamp_ntz").alias("ts"), ts.cast("timestamp").alias("event_time"),
                       F.unix_micros(ts.cast("timestamp")).alias("event_us"))


def basic_pages(pages: DataFrame) -> DataFrame:
    """Extraction by the basic rules: all text of the page."""
    return pages.select("*", X.H.basic_text(F.col("raw_html")).alias("content")).drop("raw_html")


def article_pages(pages: DataFrame) -> DataFrame:
    """Extraction of the article's text."""
    clean = pages.withColumn("_clean", X.H.without_noise(F.col("raw_html")))
    return clean.select("*", X.H.article_text(F.col("_clean"), cleaned=True).alias("content")).drop("raw_html", "_clean")


def gated_alerts(kept: DataFrame, rules: DataFrame, extract: Callable[[DataFrame], DataFrame] = article_pages) -> DataFrame:
    """Extract, analyse, rules and gate: an alert per page and matching rule that passes the gate, with the rule's limits.

    The severity is the worse of the rule's and the analysis' (S-20), so the gate's band and its exemption from quiet hours follow
    the text's tone too."""
    pages = extract(kept)
    text = F.col("content")
    done = TO.analyze(pages, keep=[c for c in pages.columns if c != "id"], entities=False, keywords=False).where("success")
    hits = match_many_rules(done, rules)
    per_rule = rules.groupBy(F.col("rule_id").alias("_id")).agg(F.min(F.struct(*rules.columns)).alias("_rule"))
    a = hits.join(per_rule, F.col("rule_id") == F.col("_id")).drop("_id")
    worst = F.greatest(SEV.rank(F.col("_rule.severity")), SEV.rank(SEV.from_analysis(F.col("sentiment_score"), F.lit(None), F.lit(None))))
    a = a.select("id", "url", "source_id", "ts", "event_time", "event_us", "sentiment", "sentiment_score", "rule_id",
                 F.element_at(F.array(*[F.lit(s) for s in SEV.SEVERITIES]), worst + 1).alias("severity"),
                 F.concat(F.lit("Alert: "), "name").alias("title"),
                 F.concat(F.lit("Keywords matched in "), F.coalesce("source_id", F.lit("?")), F.lit(": "),
                          F.substring(F.lower(text), 1, 100), F.lit("...")).alias("message"),
                 F.coalesce(F.col("_rule.cooldown_seconds"), F.lit(0)).alias("cooldown_seconds"),
                 F.coalesce(F.col("_rule.max_alerts_per_hour"), F.lit(-1)).alias("cap"))
    return AL.keyword_gate(a, rules, keywords=False).where("gate = 'pass'").drop("gate", "_rule")


def deliveries(alerts: DataFrame, channels: list[dict]) -> DataFrame:
    """Alerts by channel with severity and quiet hours (J-11) and their payload (SNK-11). Without state: a channel's own rate limit
    needs ``channel_fanout`` on the outbox."""
    if any(c.get("rate_limit_seconds") for c in channels):
        raise ValueError("rate limits of channels are applied by alerts.channel_fanout, not in the stream")
    arr = AL.config_array(channels, AL.CHANNEL_SCHEMA)
    sent = AL.channel_rows(alerts, arr).where(F.col("pre").isNull()).withColumn("status", F.lit("sent"))
    return AL.outbox(sent, keep=["rule_id", "source_id", "severity", "ts"])


def monitor(raw: DataFrame, rules: DataFrame, channels: list[dict] = CONSOLE,
            extract: Callable[[DataFrame], DataFrame] = article_pages) -> DataFrame:
    """The flow over a whole table: the rows that the stream writes."""
    rows = landed(raw)
    kept = D.first_copies(rows, "content_hash", ["event_us", "id"]).where("is_first").drop("is_first")
    kept = kept.dropDuplicates(["content_hash", "event_us", "id"])  # a page landed twice
    a = gated_alerts(kept, rules, extract)
    limits = [tuple(r) for r in rules.select(F.coalesce("cooldown_seconds", F.lit(0)), F.coalesce("max_alerts_per_hour", F.lit(-1))).distinct().collect()]
    out = None
    for cooldown_s, cap in limits:  # rules are configuration
        mine = a.where((F.col("cooldown_seconds") == cooldown_s) & (F.col("cap") == cap))
        utc = F.timestamp_add("MICROSECOND", F.col("event_us"), F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")))
        one = greedy_fold(mine.withColumn("utc", utc), ["rule_id"], cooldown_s=cooldown_s, cap=None if cap < 0 else cap, ts="utc")
        one = one.where("kept").drop("kept", "utc")
        out = one if out is None else out.unionByName(one)
    return deliveries(a.limit(0) if out is None else out, channels)


def monitor_stream(raw: DataFrame, rules: DataFrame, channels: list[dict] = CONSOLE,
                   extract: Callable[[DataFrame], DataFrame] = article_pages, lateness: str = "24 hours",
                   keep_ms: int = 30 * 86400 * 1000) -> DataFrame:
    """The flow on a stream. Rows more than ``lateness`` behind are dropped by the watermark; a content hash is known for ``keep_ms`` of
    event time after its first copy. Start it with ``start_monitor``."""
    ship_code(raw.sparkSession)
    rows = landed(raw).withWatermark("event_time", lateness)
    plain = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    bucket = F.pmod(F.xxhash64("content_hash"), F.lit(BUCKETS)).cast("int")
    kept = rows.withColumn("_bucket", bucket).groupBy("_bucket").transformWithStateInPandas(
        FirstCopy(keep_ms), plain, "Append", "EventTime", eventTimeColumnName="event_time")
    a = gated_alerts(kept, rules, extract)
    plain = T.StructType([T.StructField(f.name, f.dataType) for f in a.schema])
    sent = a.groupBy("rule_id", "cooldown_seconds", "cap").transformWithStateInPandas(RuleThrottle(), plain, "Append", "EventTime")
    return deliveries(sent, channels)


def start_monitor(stream: DataFrame, outbox_path: str, checkpoint: str):
    """Starts a ``monitor_stream`` that appends to the JSON outbox exactly once and ends when all landed files are read. The states need
    RocksDB; the session's own state store setting is put back for other streams."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return (stream.writeStream.format("json").option("path", outbox_path).option("checkpointLocation", checkpoint)
                .outputMode("append").trigger(availableNow=True).start())
    finally:
        spark.conf.set(PROVIDER, before)


def outbox_schema() -> T.StructType:
    return T.StructType.fromDDL("alert_id long, channel string, kind string, payload string, rule_id string, source_id string, "
                                "severity string, ts timestamp_ntz")
