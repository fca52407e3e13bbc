"""Remaining inventory rows that exist as functions and hooks."""

import datetime as dt
import json
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from topicwatch import views as V
from topicwatch.functions import text as TX
from topicwatch.functions import timecols as TC
from topicwatch.operators import extract as X
from topicwatch.operators import metrics as M
from topicwatch.operators import quality as Q
from topicwatch.operators import textops as TO
from topicwatch.sources import readers as R
from topicwatch.streaming import streams as ST

NOW = dt.datetime(2024, 1, 31)


def test_time_presets(spark):
    df = spark.createDataFrame([(NOW - dt.timedelta(hours=h),) for h in (0.5, 5, 23, 24 * 6, 24 * 20, 24 * 40)],
                               "ts timestamp_ntz")
    n = TC.as_ntz(NOW)
    got = {p: df.where(TC.in_preset(F.col("ts"), n, p)).count() for p in ("1h", "6h", "24h", "7d", "30d", "all")}
    assert got == {"1h": 1, "6h": 2, "24h": 3, "7d": 4, "30d": 5, "all": 6}
    days = df.where(TC.in_custom_days(F.col("ts"), "2024-01-30", "2024-01-30")).count()
    assert days == 3


def test_geography_and_entity_labels(spark):
    df = spark.createDataFrame([([("Paris", "GPE"), ("Alps", "LOC"), ("Ann", "PERSON"), ("Ann", "PERSON"),
                                  ("Acme", "ORG"), ("Monday", "DATE")],)],
                               "e array<struct<text:string,label:string>>")
    row = df.select(M.geography(F.col("e")).alias("g"), M.kept_entity_labels(F.col("e")).alias("k")).first()
    assert row["g"] == ["Paris", "Alps"] and row["k"] == ["Paris", "Ann", "Acme"]


def test_situation_name_resolution(spark):
    a = V.alerts(spark, SF_SMALL)
    s = V.situations(spark, SF_SMALL)
    name = s.where("id = 7").first()["name"]
    out = M.alert_page_filter(a, s, situation_name=name)
    assert out.count() == a.where("situation_id = 7").count()
    assert {r["situation_id"] for r in out.collect()} <= {7}


def test_search_query_and_short_summary(spark):
    df = spark.createDataFrame([(["trade", "war"], ["EU"], "tiny")], "k array<string>, e array<string>, t string")
    row = df.select(TX.search_query(F.col("k"), F.col("e")).alias("q"), TO.short_summary(F.col("t")).alias("s")).first()
    assert row["q"] == "trade war EU" and row["s"] == "tiny"


def test_score_text_hook(spark):
    def load():
        return lambda texts: [float(len(t)) for t in texts]
    d = V.docs(spark, SF_SMALL).select("id", "content").limit(20)
    got = TO.score_text(d, "content", load, out_col="n").collect()
    assert all(r["n"] == len(r["content"]) for r in got)


def test_extract_with_user_extractor_and_fallback(spark):
    pages = spark.createDataFrame([(1, "http://a", "<title>T1</title><p>x</p>"), (2, "http://b", "<title>T2</title>")],
                                  "id long, url string, raw_html string")

    def fn(html, url):
        if url == "http://b":
            raise ValueError("broken page")
        return {"title": "custom", "article_text": "body", "links": ["http://a/x"]}

    got = {r["id"]: r for r in X.extract_with(pages, fn).collect()}
    assert got[1]["title"] == "custom" and got[1]["links"] == ["http://a/x"]
    assert got[2]["title"] == "T2" and got[2]["article_text"] == "T2"


def test_flag_bad_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ok")], "id long, content string")
    assert [r["is_valid"] for r in Q.flag_bad_rows(df, ["content"]).orderBy("id").collect()] == [False, False, True]


def test_processed_documents_reader(spark):
    d = tempfile.mkdtemp(prefix="tw-proc-")
    with open(os.path.join(d, "p.json"), "w") as f:
        f.write(json.dumps({"id": "p1", "extracted": {"title": "T", "article_text": "x"}}) + "\n")
        f.write(json.dumps({"id": "p2"}) + "\n")
    rows = {r["id"]: r for r in R.load_processed_documents(spark, d).collect()}
    assert rows["p1"]["extracted"]["links"] == [] and rows["p1"]["extracted"]["title"] == "T"
    assert rows["p2"]["extracted"] is None


def test_stream_documents_and_trend_stream(spark):
    root = tempfile.mkdtemp(prefix="tw-src-")
    for i in range(3):
        with open(os.path.join(root, f"f{i}.json"), "w") as f:
            f.write(json.dumps({"id": f"d{i}", "source_id": "s", "url": f"http://x/{i}", "raw_html": "<p>x</p>"}) + "\n")
    st = R.stream_documents(spark, root, max_files_per_trigger=1)
    batches = []
    q = ST.on_batch(st, lambda b, e: batches.append(b.count()), tempfile.mkdtemp())
    q.awaitTermination()
    assert batches == [1, 1, 1]
    ev = V.table(spark, SF_SMALL, "events").select(F.col("event_type").alias("keyword"), "ts", "value")
    src = tempfile.mkdtemp(prefix="tw-ev-")
    ev.write.parquet(os.path.join(src, "e"))
    s = spark.readStream.schema(ev.schema).parquet(os.path.join(src, "e"))
    out = (ST.trend_stream(s, lateness="0 seconds").writeStream.format("memory").queryName("trend_out")
           .option("checkpointLocation", tempfile.mkdtemp()).outputMode("append").trigger(availableNow=True).start())
    out.awaitTermination()
    assert spark.table("trend_out").count() > 0


def test_read_logs_and_document_by_id(spark, tmpdir_path):
    lg = V.logs(spark, SF_SMALL)
    p = os.path.join(tmpdir_path, "logs")
    lg.write.parquet(p)
    got = R.read_logs(spark, p, level="error", since="2024-01-20 00:00:00", limit=5).collect()
    assert len(got) == 5 and all(r["level"] == "ERROR" for r in got)
    assert [r["ts"] for r in got] == sorted((r["ts"] for r in got), reverse=True)
    d = V.docs(spark, SF_SMALL)
    assert M.document_by_id(d, 3).count() == 1 and M.document_by_id(d, -1).count() == 0


def test_spread_only_widens_narrow_scans(spark):
    target = spark.sparkContext.defaultParallelism
    wide = spark.range(0, 1000, 1, numPartitions=target * 2).withColumnRenamed("id", "k")
    narrow = spark.range(0, 1000, 1, numPartitions=1).withColumnRenamed("id", "k")
    assert V.spread(narrow, "k") is narrow  # off unless asked for
    spark.conf.set(V.SPREAD_CONF, "true")
    try:
        assert V.spread(wide, "k") is wide
        out = V.spread(narrow, "k")
    finally:
        spark.conf.unset(V.SPREAD_CONF)
    assert out.rdd.getNumPartitions() == target and out.count() == 1000
    assert "hashpartitioning(k" in out._jdf.queryExecution().executedPlan().toString()
