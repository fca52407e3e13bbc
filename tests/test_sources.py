"""Readers and sinks: defaults, bad rows kept, config splits, CSV/JSON/
partitioned writes."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from topicwatch import schemas as SC
from topicwatch import views as V
from topicwatch.sources import readers as R
from topicwatch.sources import sinks as K


def write_lines(lines):
    d = tempfile.mkdtemp(prefix="tw-json-")
    with open(os.path.join(d, "part.json"), "w") as f:
        f.write("\n".join(lines) + "\n")
    return d


def test_raw_documents_defaults_and_bad_rows(spark):
    d = write_lines([json.dumps({"source_id": "s", "url": "http://a", "raw_html": "<p>A</p>",
                                 "fetched_at": "2024-01-02T03:04:05"}),
                     "{}", "not json", json.dumps({"source_id": "s", "source_type": "bogus", "raw_html": ""})])
    rows = R.load_raw_documents(spark, d).collect()
    assert len(rows) == 4
    first = [r for r in rows if r["url"] == "http://a"][0]
    assert first["source_type"] == "news" and first["status"] == "pending" and first["status_code"] == 200
    assert len(first["content_hash"]) == 64 and len(first["id"]) == 16 and first["valid"]
    assert sum(1 for r in rows if not r["valid"]) == 2


def test_config_split(spark):
    d = write_lines([json.dumps({"id": "good-1", "name": "Good"}), json.dumps({"id": "bad-1"}),
                     json.dumps({"id": "has space", "name": "x"})])
    valid, invalid = R.load_config(spark, d, SC.SOURCE_CONFIG, ["id", "name"])
    assert [r["id"] for r in valid.collect()] == ["good-1"]
    assert sorted(r["reason"] for r in invalid.collect()) == ["bad id", "missing name"]
    assert R.lookup(valid, "id", "good-1").count() == 1 and R.lookup(valid, "id", "nope").count() == 0


def test_json_decoding(spark):
    df = spark.createDataFrame([('["a","b"]', '{"k": "v"}'), (None, None), ("", "{}")], "j string, m string")
    got = df.select(R.decode_json_list(F.col("j")).alias("l"), R.json_map_value(F.col("m"), "k").alias("v")).collect()
    assert [r["l"] for r in got] == [["a", "b"], [], []]
    assert [r["v"] for r in got] == ["v", None, None]


def test_csv_sinks(spark, tmpdir_path):
    a = V.alerts(spark, SF_SMALL)
    p = os.path.join(tmpdir_path, "alerts")
    assert K.alerts_csv(a, p)
    back = spark.read.option("header", True).csv(p)
    assert back.columns == K.ALERT_CSV_COLUMNS and back.count() == a.count()
    assert not K.write_csv(a.limit(0), os.path.join(tmpdir_path, "empty"))
    assert not os.path.exists(os.path.join(tmpdir_path, "empty"))


def test_json_roundtrip_and_recent(spark, tmpdir_path):
    a = V.alerts(spark, SF_SMALL).select("id", "severity", "ts")
    p = os.path.join(tmpdir_path, "alerts.jsonl")
    K.write_json(a, p)
    recent = K.read_recent_json(spark, p, "id long, severity string, ts timestamp_ntz", limit=5)
    want = [r["id"] for r in a.orderBy(F.col("ts").desc()).limit(5).collect()]
    assert [r["id"] for r in recent.collect()] == want
    assert R.to_json_records(a.limit(1)).first()["json"].startswith('{"id":')


def test_partitioned_writes(spark, tmpdir_path):
    d = V.docs(spark, SF_SMALL).select("id", "situation_id", "ts", "content")
    p = os.path.join(tmpdir_path, "docs")
    K.append_partitioned(d, p)
    assert spark.read.parquet(p).where(F.col("date") == "2024-01-02").count() == d.where(
        F.to_date("ts") == "2024-01-02").count()
    m = d.groupBy("situation_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    q = os.path.join(tmpdir_path, "daily")
    K.overwrite_partitions(m, q, ["day"])
    K.overwrite_partitions(m.where(F.col("day") == "2024-01-02"), q, ["day"])
    assert spark.read.parquet(q).count() == m.count()  # idempotent per partition
    arch = os.path.join(tmpdir_path, "archive")
    K.archive(d, arch, "2024-02-01")
    sizes = K.archive_sizes(spark, arch).first()
    files = [os.path.join(at, f) for at, _, names in os.walk(arch) for f in names if f.endswith(".parquet")]
    assert sizes["documents"] == d.count() and sizes["original_bytes"] > 0 and sizes["files"] == len(files)
    assert sizes["compressed_bytes"] == sum(map(os.path.getsize, files))


def test_dead_letters_sink(spark, tmpdir_path):
    from topicwatch.operators import health as H
    fl = V.fetch_log(spark, SF_SMALL)
    v = V.versions(spark, SF_SMALL).select("id", "url")
    dead = H.dead_letters(fl.where(~F.col("ok")).join(v, "id"), keep_newest=5, over=10)
    assert dead.where("retained").count() == 5
    K.write_dead_letters(dead, os.path.join(tmpdir_path, "dlq"))
    written = spark.read.parquet(os.path.join(tmpdir_path, "dlq"))
    assert written.count() == dead.count() > 5 and written.where("retained").count() == 5
