"""Registered queries of the operators, each over whole tables, with DuckDB SQL
where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import register
from .common import scratch_path, text_or_empty
from .decontamination import contained_items
from .exact_dedup import content_sort
from .jaccard_join import jaccard_components
from .line_dedup import drop_common_lines
from .packing import pack, token_pieces
from .quality import classify
from .sharding import interleave
from .suffix_dedup import remove_repeats
from .training_order import training_order
from .warc import read_warc, write_warc


def vocabulary() -> str:
    """The public tokenizer file of the contracts."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Shingle containment of every benchmark item in every document, as plain SQL.
DECONTAMINATION_SQL = r"""
WITH it AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE text IS NOT NULL),
its AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
         lambda i: array_to_string(w[i:i+4], ' '))) AS s
  FROM it WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS item_shingles FROM its GROUP BY item_id),
d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL),
ds AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
         lambda i: array_to_string(w[i:i+4], ' '))) AS s
  FROM d WHERE len(w) > 0),
c AS (SELECT doc_id, item_id, count(*) AS shared_shingles FROM ds JOIN its USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, item_shingles, shared_shingles, shared_shingles / item_shingles AS containment
FROM c JOIN n USING (item_id) WHERE shared_shingles >= 0.8 * item_shingles
"""


@register("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's evidence, site rates and posteriors of low quality and of toxicity."""
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.drop("_k1", "_k2")


@register("op2_benchmark_decontamination", DECONTAMINATION_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) with at least 0.8 of the item's five-word shingles in the document."""
    found = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("_k1", "_k2")


@register("op3_exact_dedup", r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER w = 1 AS kept
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY len DESC, doc_id))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM r
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts equal without ASCII white space; the longest, then smallest id stays."""
    return content_sort(table(spark, sf_dir, "documents"), carry=["doc_id"])


@register("op4_warc", r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS uri, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages)
SELECT page_id, uri, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + (((('0x' || substr(h, (i // 4)::INT * 5 + 1, 5))::INT) >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, true AS valid
FROM p
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back: segments joined, chunks decoded."""
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return (read_warc(spark, path, payloads=False)
            .withColumns({c: F.nullif(F.col(c), F.lit("")).cast("long") for c in ("page_id", "refers_to")}))


@register("op5_line_dedup", r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, line, pos,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
common AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, common.key IS NOT NULL AS gone FROM k LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose key is in ten or more documents go from every document."""
    out = drop_common_lines(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op6_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of the corpus mixture; row counts differ by at most one."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text_or_empty("text")) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty("text").cast("binary")).alias("text_crc32"))
    out = interleave(docs, 8, carry=["doc_id", "size", "text_crc32"])
    return out.withColumn("grown_shard", F.lit(None).cast("int"))


@register("op7_ngram_jaccard_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


@register("op8_training_order")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences of 255 ids in keyed random order; ids as read back from the shards."""
    return training_order(table(spark, sf_dir, "documents"), vocabulary(), length=256)


@register("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed best-fit decreasing into sequences of 2048 tokens."""
    return pack(token_pieces(table(spark, sf_dir, "documents"), vocabulary(), 2048), 2048)


@register("op10_suffix_array_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by a 50-byte string that also starts in a document with a smaller id go."""
    out = remove_repeats(table(spark, sf_dir, "documents"), 50, carry=["doc_id"])
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
