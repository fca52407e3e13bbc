"""Operators against the reference's pinned examples and against brute-force
Python loops on the sf0.001 tables."""

import datetime as dt
from collections import deque

from pyspark.sql import functions as F

from conftest import SF_SMALL
from topicwatch import views as V
from topicwatch.operators import alerts as AL
from topicwatch.operators import dedup as D
from topicwatch.operators import folds as FO
from topicwatch.operators import textops as TO
from topicwatch.operators import trends as T

T0 = dt.datetime(2024, 1, 1, 12, 0)


def alerts_df(spark, rows):
    return spark.createDataFrame(rows, "id long, rule_id string, source_id string, severity string, title string, "
                                       "message string, ts timestamp_ntz")


def test_dedup_a_b_a(spark):
    docs = spark.createDataFrame([(1, T0, "Version 1", "s"), (2, T0 + dt.timedelta(hours=1), "Version 2", "s"),
                                  (3, T0 + dt.timedelta(hours=2), "Version 1", "s"), (4, T0, "", "s")],
                                 "id long, ts timestamp_ntz, content string, source_id string")
    got = {r["id"]: r["status"] for r in D.content_dedup(docs).collect()}
    assert got == {1: "kept", 2: "kept", 3: "duplicate", 4: "rejected"}


def test_url_changes_across_buckets(spark):
    rows = [(i, "u", T0 + dt.timedelta(hours=10 * i), h) for i, h in enumerate(["a", "a", "b", "b", "a"])]
    v = spark.createDataFrame(rows, "id long, url string, ts timestamp_ntz, content_hash string")
    got = [r["changed"] for r in D.url_changes(v, bucket="day").orderBy("id").collect()]
    assert got == [True, False, True, False, True]


def python_greedy(rows, cooldown_us, cap=None, win_us=3600 * 10**6):
    """Plain loop: rows = [(key, t_us, id)]."""
    kept = set()
    state = {}
    for key, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        last, recent = state.get(key, (None, deque()))
        ok = last is None or t - last >= cooldown_us
        if ok and cap is not None:
            while recent and recent[0] <= t - win_us:
                recent.popleft()
            ok = len(recent) < cap
        if ok:
            last = t
            if cap is not None:
                recent.append(t)
            kept.add(i)
        state[key] = (last, recent)
    return kept


def _event_rows(spark):
    e = V.table(spark, SF_SMALL, "events").select("event_id", "user_id", "event_type", "ts").collect()
    to_us = lambda ts: (ts - dt.datetime(2000, 1, 1)) // dt.timedelta(microseconds=1)
    return e, to_us


def test_greedy_cooldown_matches_loop(spark):
    e, to_us = _event_rows(spark)
    want = python_greedy([(r["user_id"], to_us(r["ts"]), r["event_id"]) for r in e], 6 * 3600 * 10**6)
    df = V.table(spark, SF_SMALL, "events").select(F.col("event_id").alias("id"), "user_id", "ts")
    got = {r["id"] for r in AL.cooldown(df, ["user_id"], 6 * 3600).collect()}
    assert got == want


def test_throttle_matches_loop(spark):
    e, to_us = _event_rows(spark)
    want = python_greedy([(r["event_type"], to_us(r["ts"]), r["event_id"]) for r in e], 600 * 10**6, cap=4)
    df = V.table(spark, SF_SMALL, "events").select(F.col("event_id").alias("id"), "event_type", "ts")
    got = {r["id"] for r in AL.throttle(df, ["event_type"], cooldown_s=600, max_per_hour=4).collect()}
    assert got == want


def test_hourly_cap_fixture(spark):
    a = alerts_df(spark, [(i, "rate-rule", "test", "warning", f"Alert {i}", "Test", T0 + dt.timedelta(minutes=i))
                          for i in range(3)])
    assert sorted(r["id"] for r in AL.hourly_cap(a, 2).collect()) == [0, 1]
    assert sorted(r["id"] for r in AL.throttle(a, ["rule_id"], max_per_hour=2).collect()) == [0, 1]


def test_dedup_alerts_fixture(spark):
    a = alerts_df(spark, [(1, "dedup-rule", "test", "warning", "Duplicate Alert", "Same content", T0),
                          (2, "dedup-rule", "test", "warning", "Duplicate Alert", "Same content",
                           T0 + dt.timedelta(minutes=1))])
    assert [r["id"] for r in AL.dedup_alerts(a, 3600).collect()] == [1]


def test_digest_three_alerts(spark):
    a = alerts_df(spark, [(i, "digest-rule", "test", "info", f"Alert {i}", "Test", T0 + dt.timedelta(minutes=i))
                          for i in range(3)])
    rows = AL.digests(a, 60).collect()
    assert len(rows) == 1 and "3 alerts" in rows[0]["title"]


def test_rule_gates(spark):
    rules = AL.rules_frame(spark, [
        dict(rule_id="sev", name="s", enabled=True, min_severity="warning"),
        dict(rule_id="src", name="s", enabled=True, source_ids=["allowed-source"]),
        dict(rule_id="kw", name="k", enabled=True, keywords=["important", "urgent"]),
        dict(rule_id="quiet", name="q", enabled=True, quiet_hours_start=0, quiet_hours_end=23,
             quiet_hours_severity_exemption="critical")])
    a = alerts_df(spark, [
        (1, "sev", "x", "info", "t", "m", T0), (2, "sev", "x", "warning", "t", "m", T0),
        (3, "src", "bad-source", "info", "t", "m", T0), (4, "src", "allowed-source", "info", "t", "m", T0),
        (5, "kw", "x", "info", "t", "Nothing special here", T0), (6, "kw", "x", "info", "t", "This is urgent!", T0),
        (7, "quiet", "x", "warning", "t", "m", T0), (8, "quiet", "x", "critical", "t", "m", T0)])
    got = {r["id"]: r["gate"] for r in AL.keyword_gate(a, rules).collect()}
    assert got == {1: "severity", 2: "pass", 3: "source", 4: "pass", 5: "keywords", 6: "pass",
                   7: "quiet hours", 8: "pass"}


def test_rule_matching_e2e_fixture(spark):
    docs = spark.createDataFrame([
        (1, "s1", "Security vulnerability found in popular framework"),
        (2, "s1", "New Python version released with great features"),
        (3, "s1", "Critical system error detected in production"),
        (4, "s1", "Patch for CVE-2024-1234 is out")], "id long, source_id string, content string")
    rules = AL.rules_frame(spark, [
        dict(rule_id="security-rule", name="Security Issues", enabled=True, severity="warning",
             keywords=["security", "vulnerability", "exploit"], regex_patterns=[r"CVE-\d{4}-\d+"]),
        dict(rule_id="critical-rule", name="Critical Errors", enabled=True, severity="critical",
             keywords=["critical", "error", "failure"])])
    got = sorted((r["id"], r["rule_id"]) for r in AL.match_rules(docs, rules).collect())
    assert got == [(1, "security-rule"), (3, "critical-rule"), (4, "security-rule")]
    msg = AL.match_rules(docs, rules).where("id = 3").first()
    assert msg["alert_title"] == "Alert: Critical Errors"
    assert msg["alert_message"].startswith("Keywords matched in s1: critical system")


def test_channel_gate_and_rate_limit(spark):
    ch = AL.config_frame(spark, [dict(channel="err", kind="console", enabled=True, min_severity="error"),
                                 dict(channel="quiet", kind="console", enabled=True, min_severity="info",
                                      quiet_hours_start=0, quiet_hours_end=23),
                                 dict(channel="rl", kind="webhook", enabled=True, min_severity="info",
                                      rate_limit_seconds=3600, template='{"id": "{{alert_id}}"}')],
                         AL.CHANNEL_SCHEMA)
    a = alerts_df(spark, [(1, "r", "s", "info", "t", "m", T0), (2, "r", "s", "info", "t", "m",
                                                                  T0 + dt.timedelta(minutes=5))])
    d = AL.channel_fanout(a, ch)
    got = {(r["id"], r["channel"]): r["status"] for r in d.collect()}
    assert got[(1, "err")] == "filtered" and got[(1, "quiet")] == "quiet hours"
    assert got[(1, "rl")] == "sent" and got[(2, "rl")] == "rate limited"
    out = AL.outbox(d).collect()
    assert out[0]["payload"] == '{"id": "1"}'
    per_alert, per_channel = AL.delivery_stats(d)
    assert {r["id"]: r["success"] for r in per_alert.collect()} == {1: True, 2: False}


def python_breaker(outcomes, now_us, threshold, timeout_us, need):
    st = {}
    for src, t, i, good in sorted(outcomes, key=lambda r: (r[0], r[1], r[2])):
        state, fails, succ, opened = st.get(src, ("closed", 0, 0, None))
        if state == "open" and t - opened >= timeout_us:
            state, succ = "half_open", 0
        if state == "closed":
            fails = 0 if good else fails + 1
            if not good and fails >= threshold:
                state, opened = "open", t
        elif state == "half_open":
            if good:
                fails, succ = 0, succ + 1
                if succ >= need:
                    state, succ = "closed", 0
            else:
                state, opened, succ, fails = "open", t, 0, fails + 1
        st[src] = (state, fails, succ, opened)
    out = {}
    for src, (state, fails, succ, opened) in st.items():
        if state == "open" and now_us - opened >= timeout_us:
            state = "half_open"
        out[src] = state
    return out


def test_breaker_matches_loop(spark):
    fl = V.fetch_log(spark, SF_SMALL)
    rows = [(str(r["source_id"]), (r["ts"] - dt.datetime(2000, 1, 1)) // dt.timedelta(microseconds=1), r["id"], r["ok"])
            for r in fl.collect()]
    now = dt.datetime(2024, 1, 30, 12)
    want = python_breaker(rows, (now - dt.datetime(2000, 1, 1)) // dt.timedelta(microseconds=1), 2, 3600 * 10**6, 2)
    got = {r["source_id"]: r["state"] for r in FO.breaker_states(fl, now, 2, 3600.0, 2).collect()}
    assert got == want
    assert set(got.values()) - {"closed"}, "fixture should exercise open/half-open states"


def test_breaker_fixture_transitions(spark):
    t = [T0 + dt.timedelta(seconds=i) for i in range(6)]
    fl = spark.createDataFrame([(1, "a", t[0], False), (2, "a", t[1], False), (3, "a", t[2], False)],
                               "id long, source_id string, ts timestamp_ntz, ok boolean")
    assert FO.breaker_states(fl, t[2], 3, 60.0, 2).first()["state"] == "open"
    assert FO.breaker_states(fl, t[2], 3, 0.0, 2).first()["state"] == "half_open"
    fl2 = fl.unionByName(spark.createDataFrame([(4, "a", t[4], True), (5, "a", t[5], True)],
                                               "id long, source_id string, ts timestamp_ntz, ok boolean"))
    assert FO.breaker_states(fl2, t[5], 3, 0.0, 2).first()["state"] == "closed"


def test_trend_change_pinned(spark):
    now = dt.datetime(2024, 1, 31)
    pts = [("k", now - dt.timedelta(hours=h), 2.0) for h in (47, 46, 45, 44, 43)]
    pts += [("k", now - dt.timedelta(hours=h), 10.0) for h in (12, 11, 10, 9, 8)]
    pts += [("flat", now - dt.timedelta(hours=h), 5.0) for h in range(10)]
    df = spark.createDataFrame(pts, "keyword string, ts timestamp_ntz, value double")
    rows = {r["keyword"]: r for r in T.trend_change(df, now, hours=24, threshold_pct=50).collect()}
    assert set(rows) == {"k"} and rows["k"]["direction"] == "increasing"
    m = spark.createDataFrame([("metric1", 100.0), ("metric2", 50.0)], "metric string, value double")
    p = spark.createDataFrame([("metric1", 80.0), ("metric2", 50.0)], "metric string, value double")
    got = {r["metric"]: r["pct_change"] for r in T.metric_change(m, p, threshold_pct=10).collect()}
    assert got == {"metric1": 25.0}


def test_sentiment_shift_pinned(spark):
    s = spark.createDataFrame([(1, 1, T0, 0.6), (2, 1, T0 + dt.timedelta(days=1), -0.6)],
                              "id long, situation_id long, ts timestamp_ntz, sentiment double")
    r = T.sentiment_shift(s).collect()
    assert len(r) == 1 and r[0]["severity"] in ("medium", "high") and r[0]["shift"] == -1.2


def test_extractive_summary_and_short_text(spark):
    para = ("Python is a programming language. Python is popular for data science. "
            "Many developers use Python daily. The weather was nice yesterday. "
            "Python has a large ecosystem of libraries. Cats sleep a lot. Python code is readable.")
    docs = spark.createDataFrame([(1, para), (2, "Short text.")], "id long, content string")
    got = {r["id"]: r for r in TO.extractive_summary(docs).collect()}
    assert got[1]["summary"] and len(got[1]["summary"]) < len(para) and got[1]["ratio"] < 1
    assert got[2]["summary"] is None


def test_tfidf_python_paragraph(spark):
    para = ("Python is a great programming language. Python supports many paradigms and Python code is clear. "
            "Developers love python for scripting.")
    other = "Rust is a systems language focused on safety and speed, chosen by many teams for reliable services."
    docs = spark.createDataFrame([(1, para), (2, other), (3, "short")], "id long, content string")
    top = [r["term"] for r in TO.keyword_tfidf(docs, top_n=5).where("id = 1").orderBy("rank").collect()]
    assert "python" in top
    assert TO.keyword_tfidf(docs).where("id = 3").count() == 0


def test_analyze_bad_rows_kept(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "Good news: great success")], "id long, content string")
    got = {r["id"]: r for r in TO.analyze(docs).collect()}
    assert len(got) == 3
    assert got[1]["error"] == "No content" and not got[2]["success"] and got[3]["sentiment"] == "positive"


def test_discovery_operators(spark):
    from topicwatch.operators import discovery as DS
    rows = [(f"news{i}", f"https://news{i}.com", "news", 0.4 + i * 0.05, i % 2 == 0) for i in range(10)]
    rows += [(f"academic{i}", f"https://academic{i}.edu", "academic", 0.9, True) for i in range(5)]
    rows += [("social0", "https://s.com", "social", 0.9, False)]
    s = spark.createDataFrame(rows, "id string, url string, category string, relevance_score double, "
                                    "has_keywords boolean")
    counts = {r["category"]: r["n"] for r in DS.limit_per_category(s, 3).groupBy("category")
              .agg(F.count("*").alias("n")).collect()}
    assert counts == {"news": 3, "academic": 3, "social": 1}
    cats = spark.createDataFrame([("news",), ("academic",)], "category string")
    assert {r["category"] for r in DS.by_preferences(s, cats).collect()} == {"news", "academic"}
    excl = spark.createDataFrame([("social",)], "category string")
    assert "social" not in {r["category"] for r in DS.by_preferences(s, excl, preferred=False).collect()}
    kept = DS.relevant_sources(s).collect()
    assert all(r["relevance_score"] * (1.1 if r["has_keywords"] else 1.0) > 0.5 for r in kept)
    assert [r["relevance_score"] for r in kept] == sorted((r["relevance_score"] for r in kept), reverse=True)
    dedup = D.dedup_sources(spark.createDataFrame([(1, "https://a.com/page"), (2, "https://a.com/page/")],
                                                  "id long, url string"))
    assert [r["id"] for r in dedup.collect()] == [1]


def test_keyset_page_matches_offset(spark):
    from topicwatch.operators import metrics as M
    d = V.docs(spark, SF_SMALL).select("id", "ts")
    order = [F.col("ts").desc(), F.col("id").desc()]
    first = M.page(d, order, limit=7).collect()
    second = M.page(d, order, limit=7, offset=7).collect()
    keyset = M.keyset_page(d, after_ts=first[-1]["ts"], after_id=first[-1]["id"], limit=7).collect()
    assert [r["id"] for r in keyset] == [r["id"] for r in second]


def test_hot_key_fold_spans_many_arrow_batches(spark):
    """One key with 3000 rows (a hot group) folded across 50-row Arrow
    batches must equal the plain loop, for cooldown and for sliding caps."""
    import random
    rnd = random.Random(7)
    t, rows = T0, []
    for i in range(3000):
        t += dt.timedelta(seconds=rnd.choice([5, 30, 90, 400]))
        rows.append((i, "hot" if i % 4 else f"k{i % 7}", t))
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz")
    to_us = lambda x: (x - dt.datetime(2000, 1, 1)) // dt.timedelta(microseconds=1)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for cool, cap in [(300.0, None), (120.0, 3)]:
            want = python_greedy([(k, to_us(ts), i) for i, k, ts in rows], int(cool * 10**6), cap=cap)
            got = {r["id"] for r in FO.greedy_fold(df, ["key"], cooldown_s=cool, cap=cap).where("kept").collect()}
            assert got == want, (cool, cap)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_reuse_if_large_checkpoints_same_result(spark):
    """With the size gate at 0 every narrow intermediate is checkpointed to
    the shared folder; results must not change."""
    from topicwatch.session import MATERIALIZE_CONF
    import __spark_entry__ as E
    q = E.queries()
    names = ["content_dedup", "keyword_tfidf", "extractive_summary", "bm25_search", "new_entities"]
    before = {n: sorted(map(tuple, q[n](spark, SF_SMALL).collect())) for n in names}
    spark.conf.set(MATERIALIZE_CONF, "0")
    try:
        for n in names:
            df = q[n](spark, SF_SMALL)
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert "LogicalRDD" in plan, n
            assert sorted(map(tuple, df.collect())) == before[n], n
    finally:
        spark.conf.unset(MATERIALIZE_CONF)


def test_large_rule_sets_keep_their_meaning(spark):
    """Hundreds of rules: every document row and rule counts, empty keywords match nothing."""
    docs = spark.createDataFrame([(1, "s", "alpha w7 end"), (1, "s", "alpha w7 end"), (2, None, None), (3, "s", "none")],
                                 "id long, source_id string, content string")
    rules = AL.rules_frame(spark, [dict(rule_id=f"r{i}", name=f"n{i}", enabled=True, severity="info",
                                        keywords=[f"w{i} ", ""]) for i in range(600)])
    got = sorted((r["id"], r["rule_id"]) for r in AL.match_rules(docs, rules).collect())
    assert got == [(1, "r7"), (1, "r7")]


def test_folds_keep_null_keys_and_times(spark):
    rows = [(1, None, dt.datetime(2024, 1, 1)), (2, None, dt.datetime(2024, 1, 1, 0, 1)), (3, "a", dt.datetime(2024, 1, 1)),
            (4, "a", None), (5, None, dt.datetime(2024, 1, 2)), (6, "a", dt.datetime(2024, 1, 1, 0, 2))]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz")
    for cap in (None, 1):
        out = FO.greedy_fold(df, ["key"], cooldown_s=600, cap=cap).collect()
        assert {r["id"]: r["kept"] for r in out} == {1: True, 2: False, 3: True, 4: True, 5: True, 6: False}
    numbers = df.withColumn("key", F.when(F.col("key") == "a", F.lit(1)).cast("long"))
    assert {r["id"] for r in FO.greedy_fold(numbers, ["key"], cooldown_s=600).where("kept").collect()} == {1, 3, 4, 5}


def test_null_sources_and_urls_are_kept(spark):
    from topicwatch.operators import health as H
    day = lambda d, h: dt.datetime(2024, 1, d, h)
    log = spark.createDataFrame(
        [(1, None, day(1, 1), False), (2, None, day(1, 2), True), (3, None, day(1, 3), False), (4, None, day(2, 1), False),
         (5, "a", day(1, 1), False), (6, "a", day(3, 1), False), (7, "b", day(1, 1), True), (8, "c", day(1, 5), None)],
        "id long, source_id string, ts timestamp_ntz, ok boolean")
    got = {r["source_id"]: r["consecutive_failures"] for r in H.consecutive_failures(log).collect()}
    assert got == {None: 2, "a": 2, "b": 0, "c": 0}
    src = spark.createDataFrame([(1, None), (2, "http://x/"), (3, "http://x/"), (4, None)], "id long, url string")
    assert sorted(r["id"] for r in D.dedup_sources(src).collect()) == [1, 2]


def test_maintenance_keeps_what_it_knows(spark):
    from topicwatch.operators import quality as Q
    t1, t2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    alerts = spark.createDataFrame([(1, True, t1, "old"), (2, False, None, None), (3, False, None, None), (4, None, None, None)],
                                   "id long, acknowledged boolean, acknowledged_at timestamp_ntz, acknowledged_by string")
    acks = spark.createDataFrame([(1, t2, "new"), (2, t2, "x"), (2, t1, "y"), (4, t1, "z")],
                                 "id long, acknowledged_at timestamp_ntz, acknowledged_by string")
    got = {r["id"]: (r["acknowledged"], r["acknowledged_at"], r["acknowledged_by"]) for r in Q.acknowledge(alerts, acks).collect()}
    assert got == {1: (True, t1, "old"), 2: (True, t1, "y"), 3: (False, None, None), 4: (True, t1, "z")}
    rows = spark.createDataFrame([(1, t1), (2, None), (3, dt.datetime(2020, 1, 1))], "id long, ts timestamp_ntz")
    assert {r["id"]: r["status"] for r in Q.retention_split(rows, "2024-01-03 00:00:00", 30, "t").collect()} == {
        1: "keep", 2: "undated", 3: "expired"}


def test_webhook_payload_is_json(spark):
    import json
    rows = [(1, 'say "hi" {{message}}', "a\nb", "info"), (2, None, None, "error")]
    df = spark.createDataFrame(rows, "id long, title string, message string, severity string")
    out = df.select(AL.payload(F.col("id"), F.col("title"), F.col("message"), F.col("severity"), F.lit(None).cast("timestamp_ntz"),
                               F.lit("webhook"), F.lit('{"i": "{{alert_id}}", "t": "{{title}}", "m": "{{message}}"}')).alias("p"))
    got = [json.loads(r["p"]) for r in out.collect()]
    assert got == [{"i": "1", "t": 'say "hi" {{message}}', "m": "a\nb"}, {"i": "2", "t": "", "m": ""}]


def test_dates_and_nested_blocks(spark):
    from topicwatch.functions import html as H
    dates = {"2024-01-05T03:04:05.123456": dt.datetime(2024, 1, 5, 3, 4, 5, 123456),
             "2024-01-05T03:04:05.5+02:00": dt.datetime(2024, 1, 5, 1, 4, 5, 500000),
             "2024-01-05T03:04:05Z": dt.datetime(2024, 1, 5, 3, 4, 5), "2024-01-05T03:04:05+0100": dt.datetime(2024, 1, 5, 2, 4, 5),
             "2024-01-05": dt.datetime(2024, 1, 5), "January 5, 2024": dt.datetime(2024, 1, 5), "soon": None, "": None}
    df = spark.createDataFrame([(k,) for k in dates], "s string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = {r["s"]: r["d"] for r in df.select("s", H.parse_date(F.col("s")).alias("d")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == dates
    page = ("<body><div class='x'>no</div><div class='content'><div>first part</div><p>second <div>deep<div>er</div></div></p></div>"
            "<div>after</div></body>")
    text = spark.createDataFrame([(page,)], "h string").select(H.article_text(F.col("h")).alias("t")).first()["t"]
    assert "first part" in text and "second" in text and "deep" in text and "after" not in text and "no" not in text.split()


def test_daily_rows_without_cap(spark):
    """The uniqueness check of daily rows sees every day of a situation."""
    from topicwatch.operators import metrics
    from topicwatch.plans import quality
    rows = spark.range(12_000).selectExpr("1L as situation_id", "timestamp_ntz '1990-01-01' + make_dt_interval(cast(id as int)) as ts")
    assert metrics.docs_by_day(rows, newest=None).count() == 12_000
    assert metrics.docs_by_day(rows).count() == 30
    plan = quality.dq_violations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


def test_bm25_tasks_grow_with_the_documents(spark, monkeypatch):
    """More bytes of documents make more tasks, not larger ones, and the same ranks."""
    from topicwatch.operators import search
    docs = spark.range(400).selectExpr("id", "concat_ws(' ', 'w' || id % 7, 'w' || id % 11, 'w' || id % 3, 'w' || id % 3) as content")
    queries = spark.range(3).selectExpr("id as qid", "concat('w', id, ' w', id + 4) as text")
    small = search.bm25(docs, queries)
    monkeypatch.setattr(search, "TASK_BYTES", 512)
    large = search.bm25(docs, queries)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [id" in plan(small)
    tasks = search.estimated_bytes(docs) // 512
    assert tasks > 8 and f", {tasks}" in plan(large) and f", {tasks}" not in plan(small)
    assert sorted(small.collect()) == sorted(large.collect()) and small.count() == 30
