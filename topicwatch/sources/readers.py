"""Readers (SRC-1..SRC-9): explicit schemas, PERMISSIVE parsing, defaults,
enum checks, valid/invalid splits. Bad records are kept and flagged, never
fatal (DQ-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as SC
from ..functions.html import parse_date
from ..functions.ids import content_hash, doc_id

CORRUPT = "_corrupt_record"


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    if fmt == "json":
        s = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
        return (spark.read.schema(s).option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", CORRUPT).json(path))
    return spark.read.schema(schema).format(fmt).load(path)


def with_raw_defaults(df: DataFrame) -> DataFrame:
    """SRC-1 defaults: source_type news, status pending, status_code 200,
    retry_count 0, empty headers/strings; parsed fetched_at; content hash and
    id filled when missing (id from source:url:fetched_at, never the clock);
    ``valid`` = enums known and record parsable."""
    out = df
    for c, v in [("source_type", "news"), ("status", "pending"), ("source_id", ""), ("url", ""),
                 ("raw_html", ""), ("raw_text", "")]:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    out = (out.withColumn("status_code", F.coalesce(F.col("status_code"), F.lit(200)))
           .withColumn("retry_count", F.coalesce(F.col("retry_count"), F.lit(0)))
           .withColumn("headers", F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>")))
           .withColumn("fetched_at", parse_date(F.col("fetched_at")).cast("timestamp_ntz")))
    out = out.withColumn("content_hash", F.when(F.coalesce(F.col("content_hash"), F.lit("")) == "",
                                                content_hash(F.col("raw_html"))).otherwise(F.col("content_hash")))
    out = out.withColumn("id", F.when(F.coalesce(F.col("id"), F.lit("")) == "",
                                      doc_id(F.col("source_id"), F.col("url"), F.col("fetched_at")))
                         .otherwise(F.col("id")))
    valid = F.col("source_type").isin(*SC.SOURCE_TYPES) & F.col("status").isin(*SC.DOCUMENT_STATUS)
    if CORRUPT in df.columns:
        valid = valid & F.col(CORRUPT).isNull()
    return out.withColumn("valid", valid)


def load_raw_documents(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """SRC-1."""
    return with_raw_defaults(_read(spark, path, SC.RAW_DOCUMENT, fmt))


def load_processed_documents(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """SRC-2: nested ``extracted`` struct; lists default to empty."""
    df = _read(spark, path, SC.PROCESSED_DOCUMENT, fmt)
    empty = F.array().cast("array<string>")
    ex = F.col("extracted")
    return df.withColumn("extracted", F.when(ex.isNotNull(), ex.withField("links", F.coalesce(ex["links"], empty))
                                             .withField("images", F.coalesce(ex["images"], empty))
                                             .withField("keywords", F.coalesce(ex["keywords"], empty))))


def to_json_records(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """SRC-3 / SNK-6: one JSON text per row."""
    cols = cols or df.columns
    return df.select(F.to_json(F.struct(*cols)).alias("json"))


def decode_json_list(c: Column, element: T.DataType = T.StringType()) -> Column:
    """SRC-6: JSON array text -> array; NULL, '' or unparsable -> empty."""
    t = T.ArrayType(element)
    parsed = F.from_json(c, t, {"mode": "PERMISSIVE"})
    return F.when((c.isNull()) | (F.trim(c) == ""), F.array().cast(t)).otherwise(F.coalesce(parsed, F.array().cast(t)))


def json_map_value(c: Column, key: str) -> Column:
    """S-31: value of ``key`` in a JSON object text (NULL when absent)."""
    return F.try_element_at(F.from_json(c, T.MapType(T.StringType(), T.StringType())), F.lit(key))


def load_config(spark: SparkSession, path: str, schema: T.StructType, required: list[str],
                id_pattern: str | None = r"^[A-Za-z0-9_-]+$", id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """SRC-8 / DQ-6: (valid, invalid) configuration rows. A bad entry is
    skipped, the rest kept: missing required fields, unparsable records or
    ids with blanks/punctuation go to ``invalid`` with a reason."""
    df = _read(spark, path, schema, "json")
    reason = F.when(F.col(CORRUPT).isNotNull(), F.lit("unparsable"))
    for c in required:
        reason = reason.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(f"missing {c}"))
    if id_pattern:
        reason = reason.when(~F.col(id_col).rlike(id_pattern), F.lit("bad id"))
    df = df.withColumn("reason", reason)
    valid = df.where(F.col("reason").isNull()).drop("reason", CORRUPT)
    invalid = df.where(F.col("reason").isNotNull())
    return valid, invalid


def lookup(config: DataFrame, key: str, value) -> DataFrame:
    """``get_source`` / ``get_rule``: the row with that id, or none."""
    return config.where(F.col(key) == value).limit(1)


def read_logs(spark: SparkSession, path: str, level: str | None = None, since=None, limit: int | None = None,
              fmt: str = "parquet") -> DataFrame:
    """SRC-9 ``get_logs(level, since, limit)``."""
    from ..functions.timecols import as_ntz
    df = spark.read.format(fmt).load(path)
    if level:
        df = df.where(F.upper(F.col("level")) == level.upper())
    if since is not None:
        df = df.where(F.col("ts") >= as_ntz(since))
    # the other columns decide between rows of one time
    df = df.orderBy(F.col("ts").desc(), *[F.col(c) for c in df.columns if c != "ts"])
    return df.limit(limit) if limit else df


def stream_documents(spark: SparkSession, path: str, schema: T.StructType = SC.RAW_DOCUMENT, fmt: str = "json",
                     max_files_per_trigger: int = 100) -> DataFrame:
    """SRC-7 / ST-14: incremental pick-up of newly landed files; back-pressure
    through ``maxFilesPerTrigger`` (nothing is dropped)."""
    return (spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files_per_trigger)
            .load(path))
