"""Explicit schemas of the monitoring data model (never inferred)."""

from pyspark.sql import types as T

S, L, I, D, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType()


def field(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


RAW_DOCUMENT = T.StructType([
    field("id", S), field("source_id", S), field("source_type", S), field("url", S), field("raw_html", S),
    field("raw_text", S), field("headers", T.MapType(S, S)), field("status_code", I), field("fetched_at", S),
    field("content_hash", S), field("status", S), field("retry_count", I), field("error_message", S),
])

EXTRACTED_CONTENT = T.StructType([
    field("title", S), field("author", S), field("publish_date", S), field("article_text", S),
    field("links", T.ArrayType(S)), field("images", T.ArrayType(S)), field("keywords", T.ArrayType(S)),
])

PROCESSED_DOCUMENT = T.StructType([
    field("id", S), field("raw_document_id", S), field("source_id", S), field("url", S),
    field("extracted", EXTRACTED_CONTENT), field("sentiment_score", D), field("relevance_score", D),
    field("category", S), field("entities", T.ArrayType(T.MapType(S, S))), field("processed_at", S),
    field("status", S),
])

SOURCE_CONFIG = T.StructType([
    field("id", S), field("name", S), field("base_url", S), field("source_type", S), field("priority", I),
    field("enabled", B), field("check_interval_minutes", I), field("max_retries", I),
    field("retry_backoff_base", D), field("requests_per_minute", I), field("min_interval_seconds", D),
    field("tags", T.ArrayType(S)),
])

ENTITY = T.StructType([field("text", S), field("label", S), field("start", I), field("end", I),
                       field("confidence", D)])

# Document status, source type enums (fetch side).
DOCUMENT_STATUS = ["pending", "fetching", "extracted", "processed", "failed", "duplicate", "dead_letter"]
SOURCE_TYPES = ["news", "academic", "government", "social", "blog", "rss", "api"]
