"""Streams with availableNow must equal their batch twins on the same
ordered input (one file per trigger, in time order)."""

import datetime as dt
import os
import tempfile
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from topicwatch import views as V
from topicwatch.operators import alerts as AL
from topicwatch.operators import dedup as D
from topicwatch.streaming import monitor as M
from topicwatch.streaming import streams as ST


def land(df, n_files, order="ts"):
    """Write ``df`` as ``n_files`` parquet files in time order; return dir."""
    root = tempfile.mkdtemp(prefix="tw-land-")
    ranked = df.withColumn("_part", F.ntile(n_files).over(
        __import__("pyspark.sql", fromlist=["Window"]).Window.orderBy(order, "id")))
    for p in range(1, n_files + 1):
        ranked.where(F.col("_part") == p).drop("_part").coalesce(1).write.parquet(os.path.join(root, f"b{p:03d}"))
    return root


def run_to_memory(stream_df, name, ckpt, mode="append"):
    q = (stream_df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return stream_df.sparkSession.table(name)


def read_dirs(spark, root, schema):
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
            .parquet(root))


def test_cooldown_stream_equals_batch(spark):
    s = V.sent(spark, SF_SMALL).where(F.abs("sentiment") > 0.8).select("id", "situation_id", "ts")
    root = land(s, 6)
    st = read_dirs(spark, root, s.schema)
    out = run_to_memory(ST.cooldown_stream(st, "situation_id", 12 * 3600, lateness="0 seconds"), "cool_out",
                        tempfile.mkdtemp())
    got = {r["id"] for r in out.collect()}
    want = {r["id"] for r in AL.cooldown(s, ["situation_id"], 12 * 3600).collect()}
    assert got == want


def test_url_change_stream_equals_batch(spark):
    v = V.versions(spark, SF_SMALL)
    root = land(v, 5)
    st = read_dirs(spark, root, v.schema)
    out = run_to_memory(ST.url_change_stream(st, lateness="0 seconds"), "url_out", tempfile.mkdtemp())
    got = {(r["id"], r["changed"]) for r in out.collect()}
    want = {(r["id"], r["changed"]) for r in D.url_changes(v).collect()}
    assert got == want


def test_dedup_stream_keeps_first_copies(spark):
    d = V.docs(spark, SF_SMALL).select("id", "ts", F.col("content").alias("raw_html"))
    root = land(d, 4)
    st = read_dirs(spark, root, d.schema)
    out = run_to_memory(ST.dedup_stream(st, "raw_html", lateness="1000 days"), "dedup_out", tempfile.mkdtemp())
    got = {r["id"] for r in out.collect()}
    want = {r["id"] for r in D.content_dedup(d.withColumnRenamed("raw_html", "content").withColumn(
        "source_id", F.lit("s"))).where("status = 'kept'").collect()}
    assert got == want


def test_digest_stream_counts(spark):
    a = V.alerts(spark, SF_SMALL).select("id", "rule_id", "severity", "ts")
    root = land(a, 3)
    st = read_dirs(spark, root, a.schema)
    out = run_to_memory(ST.digest_stream(st, 60, lateness="0 seconds"), "digest_out", tempfile.mkdtemp())
    got = {(r["rule_id"], r["window_start"].replace(tzinfo=None)): r["alert_count"] for r in out.collect()}
    batch = {(r["rule_id"], r["window_start"]): r["alert_count"] for r in AL.digests(a, 60).collect()}
    # windows still open at the end of the input are not emitted in append mode
    assert got and all(batch[k] == v for k, v in got.items())


def test_route_failures_and_callbacks(spark):
    raw = spark.createDataFrame([("a", 200, "<p>x</p>"), ("b", 500, "<p>y</p>"), ("c", 200, ""), ("d", None, "<p>z</p>")],
                                "id string, status_code int, raw_html string")
    root = tempfile.mkdtemp(prefix="tw-raw-")
    raw.write.mode("overwrite").parquet(os.path.join(root, "in"))
    st = spark.readStream.schema(raw.schema).parquet(os.path.join(root, "in"))
    good, dead = os.path.join(root, "good"), os.path.join(root, "dead")
    ST.route_failures(st, good, dead, os.path.join(root, "ck")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(good).collect()) == ["a"]
    assert sorted(r["id"] for r in spark.read.parquet(dead).collect()) == ["b", "c", "d"]
    seen = []
    ST.on_batch(st, lambda b, e: seen.append(b.count()), os.path.join(root, "ck2")).awaitTermination()
    assert sum(seen) == 4


def test_hourly_metrics_stream(spark):
    d = V.docs(spark, SF_SMALL).select("id", "situation_id", "source_id", "ts")
    root = land(d, 3)
    st = read_dirs(spark, root, d.schema)
    out = run_to_memory(ST.hourly_metrics_stream(st, lateness="0 seconds"), "hm_out", tempfile.mkdtemp())
    assert out.count() > 0


MONITOR_RULES = [dict(rule_id="a", name="A", enabled=True, severity="info", keywords=["the"], cooldown_seconds=7200, max_alerts_per_hour=3),
                 dict(rule_id="b", name="B", enabled=True, severity="warning", keywords=["ment"], quiet_hours_start=22, quiet_hours_end=6),
                 dict(rule_id="none", name="None", enabled=True, severity="info", keywords=["a"], max_alerts_per_hour=0)]


def monitor_outbox(spark, raw, loads, rules, channels, **how):
    """The outbox of a stream that is started anew for each load."""
    root = tempfile.mkdtemp(prefix="tw-monitor-")
    for n, load in enumerate(loads):
        load.write.parquet(f"{root}/in/load={n}")
        st = spark.readStream.schema(raw.schema).parquet(f"{root}/in/load=*")
        M.start_monitor(M.monitor_stream(st, rules, channels, **how), f"{root}/out", f"{root}/ck").awaitTermination()
    return spark.read.schema(M.outbox_schema()).json(f"{root}/out")


def test_monitor_stream_equals_batch_over_restarts(spark):
    raw = V.docs(spark, SF_SMALL).select("id", F.lit("u").alias("url"), "source_id", F.col("content").alias("raw_html"),
                                         F.col("ts").alias("fetched_at"))
    odd = spark.createDataFrame([(900001, "u", None, "the null source", dt.datetime(2024, 1, 20, 12)), (900002, "u", "s", None, dt.datetime(2024, 1, 20)),
                                 (900003, "u", "s", "", dt.datetime(2024, 1, 20)), (900004, "u", "s", "the untimed", None),
                                 (None, "u", "s", "the unnamed", dt.datetime(2024, 1, 20))],
                                "id long, url string, source_id string, raw_html string, fetched_at timestamp_ntz")
    again = raw.where("id % 7 = 0").withColumn("fetched_at", F.expr("fetched_at + interval 3 days"))  # copies seen later
    raw = raw.unionByName(odd).unionByName(raw.where("id % 5 = 0")).unionByName(again)
    rules = AL.rules_frame(spark, MONITOR_RULES)
    channels = [dict(channel="console", kind="console", enabled=True),
                dict(channel="hook", kind="webhook", enabled=True, min_severity="warning")]
    cut = F.lit(dt.datetime(2024, 1, 15)).cast("timestamp_ntz")
    loads = [raw.where(F.col("fetched_at") < cut), raw.where(~F.coalesce(F.col("fetched_at") < cut, F.lit(False)))]
    got = monitor_outbox(spark, raw, loads, rules, channels, extract=M.basic_pages)
    want = M.monitor(raw, rules, channels, extract=M.basic_pages)
    order = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert order(got) == order(want) and got.count() > 20
    assert got.where("alert_id in (900002, 900003, 900004) or rule_id = 'none'").count() == 0
    assert got.where("source_id is null").count() >= 1


class HeldState(dict):
    """A map state held in memory."""
    containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.__delitem__


def test_first_copies_of_many_hashes_in_one_key():
    """a key holds many hashes, so frames and calls are not paid per content."""
    states, timers = {}, set()
    handle = SimpleNamespace(getMapState=lambda name, *_: states.setdefault(name, HeldState()), registerTimer=timers.add)
    p = M.FirstCopy(1000)
    p.init(handle)
    frame = lambda *rows: pd.DataFrame(rows, columns=["id", "content_hash", "event_us"])
    run = lambda *frames: sorted(i for f in p.handleInputRows((0,), iter(frames), None) for i in f["id"])
    assert run(frame((3, "a", 5000), (2, "a", 5000), (4, "b", 5000), (5, "c", 9000)), frame((1, "a", 4000), (6, "c", 9000))) == [1, 4, 5]
    assert run(frame((7, "a", 1), (8, "d", 5000)), frame((9, "b", 1))) == [8]
    assert timers == {1004, 1005, 1009} and sorted(states["ends"][(1005,)][0]) == ["b", "d"]
    p.handleExpiredTimer((0,), None, SimpleNamespace(getExpiryTimeInMs=lambda: 1005))
    assert run(frame((10, "b", 6000), (11, "a", 6000), (12, "c", 6000), (13, "d", 7000))) == [10, 13]
    assert run(frame((14, "a", 1))) == []


def test_monitor_extracts_articles(spark):
    pages = V.raw_pages(spark, SF_SMALL).select("id", "url", "raw_html", F.lit("src").alias("source_id"),
                                                F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("fetched_at"))
    rules = AL.rules_frame(spark, [dict(rule_id="any", name="Any", enabled=True, severity="info", keywords=["the"])])
    got = monitor_outbox(spark, pages, [pages], rules, M.CONSOLE)
    assert {r.alert_id for r in got.collect()} == {r.alert_id for r in M.monitor(pages, rules).collect()} and got.count() > 0
    empty = monitor_outbox(spark, pages, [pages.limit(0)], rules, M.CONSOLE)
    assert empty.count() == 0
    with pytest.raises(ValueError):
        M.monitor(pages, rules, [dict(channel="c", kind="console", enabled=True, rate_limit_seconds=60)])


def test_throttle_and_dedup_streams_equal_batch(spark):
    a = V.alerts(spark, SF_SMALL).select("id", "rule_id", "source_id", "severity", "title", "message", "ts")
    root = land(a, 5)
    st = read_dirs(spark, root, a.schema)
    out = run_to_memory(ST.throttle_stream(st, ["rule_id"], cooldown_s=600, cap=4, lateness="0 seconds"),
                        "thr_out", tempfile.mkdtemp())
    assert {r["id"] for r in out.collect()} == {
        r["id"] for r in AL.throttle(a, ["rule_id"], cooldown_s=600, max_per_hour=4).collect()}
    st2 = read_dirs(spark, root, a.schema)
    out2 = run_to_memory(ST.throttle_stream(st2, AL.DEDUP_KEY, cooldown_s=6 * 3600, lateness="0 seconds"),
                         "dedup_alert_out", tempfile.mkdtemp())
    assert {r["id"] for r in out2.collect()} == {r["id"] for r in AL.dedup_alerts(a, 6 * 3600).collect()}


def test_breaker_stream_equals_batch(spark):
    from topicwatch.operators import folds as FO
    fl = V.fetch_log(spark, SF_SMALL)
    root = land(fl, 4)
    st = read_dirs(spark, root, fl.schema)
    q = (ST.breaker_stream(st, 2, 3600.0, 2, lateness="0 seconds").writeStream.format("memory")
         .queryName("breaker_out").outputMode("update").option("checkpointLocation", tempfile.mkdtemp())
         .trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.table("breaker_out").collect()
    final = {}
    for r in rows:  # latest emitted state per source
        if r["source_id"] not in final or r["outcomes"] > final[r["source_id"]]["outcomes"]:
            final[r["source_id"]] = r
    last_ts = max(r["ts"] for r in fl.select("ts").collect())
    batch = {r["source_id"]: r for r in FO.breaker_states(fl, last_ts, 2, 3600.0, 2).collect()}
    for sid, r in final.items():
        b = batch[sid]
        assert r["consecutive_failures"] == b["consecutive_failures"] and r["times_opened"] == b["times_opened"], sid
        assert r["outcomes"] == b["outcomes"]
