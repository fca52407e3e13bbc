"""Sinks (SNK-1..SNK-10, MT-2, MT-6). Writes are whole-DataFrame Spark
writes; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALERT_CSV_COLUMNS = ["id", "situation_id", "rule_id", "severity", "title", "message", "ts", "acknowledged"]
DOCUMENT_CSV_COLUMNS = ["id", "title", "source_id", "ts", "sentiment", "url"]
LOG_CSV_COLUMNS = ["ts", "level", "source", "message"]
TREND_CSV_COLUMNS = ["day", "avg_sentiment", "doc_count"]


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> bool:
    """SNK-5: rows to CSV with a header; writes nothing when empty. Returns
    whether anything was written."""
    if df.isEmpty():
        return False
    out = df.select(*(columns or df.columns))
    out.write.mode(mode).option("header", True).csv(path)
    return True


def alerts_csv(alerts: DataFrame, path: str) -> bool:
    """SNK-1."""
    return write_csv(alerts, path, [c for c in ALERT_CSV_COLUMNS if c in alerts.columns])


def documents_csv(docs: DataFrame, path: str) -> bool:
    """SNK-2."""
    return write_csv(docs, path, [c for c in DOCUMENT_CSV_COLUMNS if c in docs.columns])


def logs_csv(logs: DataFrame, path: str) -> bool:
    """SNK-3."""
    return write_csv(logs, path, [c for c in LOG_CSV_COLUMNS if c in logs.columns])


def trend_csv(trend: DataFrame, path: str) -> bool:
    """SNK-4."""
    return write_csv(trend, path, [c for c in TREND_CSV_COLUMNS if c in trend.columns])


def write_json(df: DataFrame, path: str, mode: str = "append") -> None:
    """SNK-6 / SNK-7: JSON lines."""
    df.write.mode(mode).json(path)


def read_recent_json(spark: SparkSession, path: str, schema, limit: int = 50, ts: str = "ts") -> DataFrame:
    """SNK-7 read back: newest ``limit`` rows (top-k, not a full sort)."""
    rows = spark.read.schema(schema).json(path)
    rest = [F.col(c) for c in rows.columns if c != ts and rows.schema[c].dataType.typeName() != "map"]
    return rows.orderBy(F.col(ts).desc(), *rest).limit(limit)


def append_partitioned(df: DataFrame, path: str, ts: str = "ts", partition_col: str = "date") -> None:
    """SNK-8: append partitioned by event date (partition pruning for
    later date filters)."""
    df.withColumn(partition_col, F.to_date(ts)).write.mode("append").partitionBy(partition_col).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition_cols: list[str]) -> None:
    """MT-6 / MT-1: idempotent rewrite of exactly the partitions present in
    ``df`` (dynamic partition overwrite)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_cols).parquet(path))


def write_dead_letters(dead: DataFrame, path: str) -> None:
    """SNK-9: append every dead-letter row with its ``retained`` flag; none is
    dropped. Readers that want the bounded view filter on the flag."""
    dead.write.mode("append").parquet(path)


def archive(docs: DataFrame, path: str, archived_on: str, text_col: str = "content") -> None:
    """SNK-10 / MT-2: zstd-compressed Parquet partitioned by archive date,
    with the original size of each text."""
    out = docs.withColumn("original_size", F.octet_length(F.col(text_col))).withColumn(
        "archived_date", F.to_date(F.lit(archived_on)))
    out.write.mode("append").option("compression", "zstd").partitionBy("archived_date").parquet(path)


def archive_sizes(spark: SparkSession, path: str) -> DataFrame:
    """MT-2 bookkeeping: rows, original bytes, compressed bytes (the sizes of the written files)
    and files per archive date."""
    a = spark.read.parquet(path).select("archived_date", "original_size", "_metadata.file_path", "_metadata.file_size")
    per_file = a.groupBy("archived_date", "file_path").agg(
        F.count(F.lit(1)).alias("n"), F.sum("original_size").alias("bytes"), F.first("file_size").alias("size"))
    return per_file.groupBy("archived_date").agg(
        F.sum("n").alias("documents"), F.sum("bytes").alias("original_bytes"), F.sum("size").alias("compressed_bytes"),
        F.count(F.lit(1)).alias("files"))
