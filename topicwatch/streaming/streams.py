"""Structured Streaming versions of the incremental and stateful steps
(ST-1..ST-15, UF-3, UF-4; the whole flow, ST-16, is in ``monitor``).

Every stateful operator is bounded: de-duplication and windows by a
watermark, keyed state by an event-time timeout that drops a key's state
once the watermark has passed the point where it can still matter. Event
time must be ``TIMESTAMP`` for watermarks, so NTZ columns are cast.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.ids import content_hash
from ..session import ship_code

DEFAULT_LATENESS = "5 minutes"  # ST-15: a job's misfire grace of 300 s


def event_time(df: DataFrame, ts: str = "ts", out: str = "event_time") -> DataFrame:
    ship_code(df.sparkSession)
    return df.withColumn(out, F.col(ts).cast("timestamp"))


def dedup_stream(stream: DataFrame, text_col: str = "raw_html", ts: str = "ts",
                 lateness: str = "24 hours") -> DataFrame:
    """ST-1: first copy of each content hash within the watermark; state is
    dropped as the watermark passes (bounded memory, nothing arbitrary
    evicted). ``status`` is 'kept', or 'rejected' for rows without content:
    those pass through (each row its own key), for the reject sink."""
    s = event_time(stream, ts).withColumn("content_hash", F.coalesce(content_hash(F.col(text_col)), F.lit("")))
    empty = F.col("content_hash") == ""
    rest = F.to_json(F.struct(*[F.col(c) for c in stream.columns]))
    s = s.withColumn("_key", F.when(empty, F.concat(F.lit("empty:"), rest)).otherwise(F.col("content_hash")))
    s = s.withColumn("status", F.when(empty, "rejected").otherwise("kept"))
    return s.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


URL_STATE = T.StructType([T.StructField("last_hash", T.StringType()), T.StructField("last_us", T.LongType())])
URL_OUT = T.StructType([T.StructField("id", T.LongType()), T.StructField("url", T.StringType()),
                        T.StructField("event_time", T.TimestampType()), T.StructField("content_hash", T.StringType()),
                        T.StructField("changed", T.BooleanType())])


def url_change_stream(stream: DataFrame, ts: str = "ts", lateness: str = DEFAULT_LATENESS,
                      forget_after_ms: int = 30 * 86400 * 1000) -> DataFrame:
    """ST-2: per-URL last hash in keyed state; a fetch whose hash differs
    (or the first sighting) is a change. A URL unseen for
    ``forget_after_ms`` of event time loses its state."""
    s = event_time(stream, ts).select("id", "url", "event_time", "content_hash").withWatermark("event_time", lateness)

    def step(key, batches, state):
        last_hash, last_us = (state.get if state.exists else (None, None))
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["event_time", "id"])
        changed = []
        for h in rows["content_hash"].tolist():
            changed.append(last_hash is None or h != last_hash)
            last_hash = h
        rows["changed"] = changed
        newest = int(pd.Timestamp(rows["event_time"].max()).value // 1000)
        state.update((last_hash, newest))
        state.setTimeoutTimestamp(newest // 1000 + forget_after_ms)
        yield rows[["id", "url", "event_time", "content_hash", "changed"]]

    return s.groupBy("url").applyInPandasWithState(step, URL_OUT, URL_STATE, "append",
                                                   GroupStateTimeout.EventTimeTimeout)


THROTTLE_STATE = T.StructType([T.StructField("last_us", T.LongType()),
                               T.StructField("recent_us", T.ArrayType(T.LongType()))])


def throttle_stream(stream: DataFrame, keys: list[str], cooldown_s: float = 0.0, cap: int | None = None,
                    cap_window_s: float = 3600.0, ts: str = "ts", lateness: str = DEFAULT_LATENESS) -> DataFrame:
    """ST-3 / ST-4 / ST-6 / UF-4: greedy cooldown and sliding cap per key in
    keyed state (last kept time and the kept times inside the cap window).
    With the alert fields as ``keys`` this is the de-dup stream (ST-6). A
    key's state is removed once the watermark passes the point after which
    the next row would be kept regardless."""
    s = event_time(stream, ts).withWatermark("event_time", lateness)
    out_schema = T.StructType([s.schema[k] for k in keys] + [T.StructField("id", T.LongType()),
                                                            T.StructField("event_time", T.TimestampType())])
    cool_us = int(cooldown_s * 1_000_000)
    win_us = int(cap_window_s * 1_000_000)
    reach_us = max(cool_us, win_us if cap else 0)

    def step(k, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        last, recent = (state.get[0], list(state.get[1] or [])) if state.exists else (None, [])
        rows = pd.concat(list(batches)).sort_values(["event_time", "id"])
        us = (rows["event_time"].astype("int64") // 1000).tolist()
        keep = []
        for t in us:
            ok = last is None or t - last >= cool_us
            if ok and cap is not None:
                recent = [r for r in recent if r > t - win_us]
                ok = len(recent) < cap
            if ok:
                last = t
                if cap is not None:
                    recent.append(t)
            keep.append(ok)
        state.update((last, recent))
        state.setTimeoutTimestamp((last + reach_us) // 1000)
        yield rows[keep][keys + ["id", "event_time"]]

    return s.select(*keys, "id", "event_time").groupBy(*keys).applyInPandasWithState(
        step, out_schema, THROTTLE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def cooldown_stream(stream: DataFrame, key: str, cooldown_s: float, ts: str = "ts",
                    lateness: str = DEFAULT_LATENESS) -> DataFrame:
    """ST-3: greedy cooldown per key (``throttle_stream`` without a cap)."""
    return throttle_stream(stream, [key], cooldown_s=cooldown_s, ts=ts, lateness=lateness)


BREAKER_STREAM_STATE = T.StructType([
    T.StructField("state", T.StringType()), T.StructField("fails", T.LongType()),
    T.StructField("succ", T.LongType()), T.StructField("opened_us", T.LongType()),
    T.StructField("times", T.LongType()), T.StructField("n", T.LongType())])
BREAKER_STREAM_OUT = T.StructType([
    T.StructField("source_id", T.StringType()), T.StructField("state", T.StringType()),
    T.StructField("consecutive_failures", T.LongType()), T.StructField("times_opened", T.LongType()),
    T.StructField("outcomes", T.LongType()), T.StructField("as_of", T.TimestampType())])


def breaker_stream(fetch_log: DataFrame, failure_threshold: int = 5, timeout_s: float = 60.0,
                   half_open_successes: int = 3, ts: str = "ts", lateness: str = DEFAULT_LATENESS,
                   forget_after_s: float = 30 * 86400) -> DataFrame:
    """ST-8 / ST-9: circuit breaker and consecutive failures per source in
    keyed state; emits the state after each micro-batch (update mode). A
    source silent for ``forget_after_s`` of event time loses its state."""
    s = (event_time(fetch_log, ts).select(F.col("source_id").cast("string").alias("source_id"), "id", "ok",
                                           "event_time").withWatermark("event_time", lateness))
    timeout_us = int(timeout_s * 1_000_000)

    def step(k, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        st, fails, succ, opened, times, n = state.get if state.exists else ("closed", 0, 0, None, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["event_time", "id"])
        us = (rows["event_time"].astype("int64") // 1000).tolist()
        for t, good in zip(us, rows["ok"].tolist()):
            n += 1
            if st == "open" and t - opened >= timeout_us:
                st, succ = "half_open", 0
            if st == "closed":
                fails = 0 if good else fails + 1
                if not good and fails >= failure_threshold:
                    st, opened, times = "open", t, times + 1
            elif st == "half_open":
                if good:
                    fails, succ = 0, succ + 1
                    if succ >= half_open_successes:
                        st, succ = "closed", 0
                else:
                    st, opened, times, succ, fails = "open", t, times + 1, 0, fails + 1
        state.update((st, fails, succ, opened, times, n))
        state.setTimeoutTimestamp(us[-1] // 1000 + int(forget_after_s * 1000))
        yield pd.DataFrame([{"source_id": k[0], "state": st, "consecutive_failures": fails, "times_opened": times,
                             "outcomes": n, "as_of": rows["event_time"].max()}])

    return s.groupBy("source_id").applyInPandasWithState(step, BREAKER_STREAM_OUT, BREAKER_STREAM_STATE, "update",
                                                         GroupStateTimeout.EventTimeTimeout)


def digest_stream(alerts: DataFrame, interval_minutes: int = 60, key: str = "rule_id", ts: str = "ts",
                  lateness: str = DEFAULT_LATENESS) -> DataFrame:
    """ST-5: "N alerts" per key and tumbling interval, emitted once the
    watermark closes the window."""
    s = event_time(alerts, ts).withWatermark("event_time", lateness)
    g = s.groupBy(key, F.window("event_time", f"{interval_minutes} minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("alert_count"))
    return g.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "alert_count",
                    F.concat(F.col("alert_count").cast("string"), F.lit(" alerts")).alias("title"))


def hourly_metrics_stream(docs: DataFrame, ts: str = "ts", lateness: str = DEFAULT_LATENESS) -> DataFrame:
    """ST-10: documents and (approximate) distinct sources per situation and
    hour; exact distinct counts are refused on streams."""
    s = event_time(docs, ts).withWatermark("event_time", lateness)
    g = s.groupBy("situation_id", F.window("event_time", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("documents"), F.approx_count_distinct("source_id").alias("sources"))
    return g.select("situation_id", F.col("w.start").alias("hour"), "documents", "sources")


def trend_stream(points: DataFrame, key: str = "keyword", ts: str = "ts", value: str = "value",
                 lateness: str = DEFAULT_LATENESS) -> DataFrame:
    """ST-11: sliding 48 h windows every 24 h. Each window gives its latest day
    (``day``), that day's ``total`` and the day before's ``previous``."""
    s = event_time(points, ts).withWatermark("event_time", lateness)
    s = s.select(key, value, "event_time", F.window("event_time", "48 hours", "24 hours").alias("w"))
    late = F.col("event_time") >= F.col("w.start") + F.expr("INTERVAL 24 HOURS")
    g = s.groupBy(key, "w").agg(F.sum(F.when(late, F.col(value))).alias("total"),
                                F.sum(F.when(~late, F.col(value))).alias("previous"))
    return g.select(key, (F.col("w.start") + F.expr("INTERVAL 24 HOURS")).alias("day"), "total", "previous")


def daily_metrics_stream(docs: DataFrame, ts: str = "ts", lateness: str = DEFAULT_LATENESS) -> DataFrame:
    """ST-10, daily form: documents and (approximate) distinct sources per situation and day."""
    s = event_time(docs, ts).withWatermark("event_time", lateness)
    g = s.groupBy("situation_id", F.window("event_time", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("documents"), F.approx_count_distinct("source_id").alias("sources"))
    return g.select("situation_id", F.col("w.start").alias("day"), "documents", "sources")


def route_failures(stream: DataFrame, good_path: str, dead_path: str, checkpoint: str,
                   ok: Callable[[DataFrame], object] | None = None, trigger_once: bool = True):
    """ST-12: good rows and failures written by one ``foreachBatch``; the
    good rows continue, failures become dead letters. A row whose condition
    is NULL (say, no status) is a failure, never lost. Each batch writes its own
    ``epoch=N`` folder, so a batch that is retried replaces its rows."""
    cond = ok or (lambda df: (F.col("status_code") < 400) & (F.coalesce(F.col("raw_html"), F.lit("")) != ""))

    def write(batch: DataFrame, epoch: int) -> None:
        routed = batch.withColumn("_good", F.coalesce(cond(batch), F.lit(False))).persist()
        try:
            for good, path in ((True, good_path), (False, dead_path)):
                part = routed.where(F.col("_good") == good).drop("_good")
                part.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        finally:
            routed.unpersist()

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if trigger_once else w).start()


def on_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """ST-13 / UF-3: document, error and alert callbacks per micro-batch."""
    w = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
