"""Duplicate and change detection (W-1, W-2, A-24, J-8, X-2, X-3).

One key (a hash, a URL) may hold a third of all rows. None of these plans
sends a whole key group through one window partition:

* first-copy detection reduces each key to its first (ts, id) with a
  partial/final aggregate (map-side combine) and joins it back on the key and
  the unique order together, so a hot key's rows spread evenly;
* change detection runs ``lag`` inside (key, time bucket) partitions and
  carries the last value of the previous non-empty bucket over from a small
  per-bucket table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import content_hash, normalize_url
from ..functions.timecols import hour_start
from ..session import reuse_if_large


def first_copies(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``is_first``: the row is the first of its key by ``order``
    (which must end in a unique column). The firsts are joined back on the key
    and the whole order, null-safe: the order is unique, so a hot key's
    rows spread evenly, and rows with a NULL key form a group of their own."""
    names = [key, *[c for c in order if c != key]]
    firsts = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    firsts = firsts.select(*[(F.col(c) if c not in order else F.col("_first").getField(c)).alias(f"_of_{c}") for c in names],
                           F.lit(True).alias("is_first"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in names])
    out = df.join(firsts, same, "left").drop(*[f"_of_{c}" for c in names])
    return out.withColumn("is_first", F.coalesce("is_first", F.lit(False)))


def content_dedup(docs: DataFrame, text_col: str = "content", order: list[str] | None = None) -> DataFrame:
    """W-1: the first copy of each content hash is kept, later copies are
    duplicates (A -> B -> A drops the third); empty content is rejected,
    not grouped. Empty rows get a key of their own (never a hot group), so
    one first-copy pass serves every row and the text is hashed once per
    branch, without a separate scan for the rejects."""
    order = order or ["ts", "id"]
    t = F.col(text_col)
    empty = t.isNull() | (t == "")
    h = docs.withColumn("_empty", empty).withColumn(
        "_k", F.when(empty, F.concat(F.lit("\u0000empty:"), F.to_json(F.struct(*order))))
        .otherwise(content_hash(t))).drop(text_col)
    h = reuse_if_large(h, docs)
    ranked = first_copies(h, "_k", order)
    status = F.when(F.col("_empty"), "rejected").when(F.col("is_first"), "kept").otherwise("duplicate")
    return (ranked.withColumn("status", status)
            .withColumn("content_hash", F.when(F.col("_empty"), F.lit("")).otherwise(F.col("_k")))
            .drop("_k", "_empty", "is_first"))


def bucket_of(ts: Column, bucket: str) -> Column:
    if bucket == "day":
        return F.to_date(ts).cast("timestamp_ntz")
    if bucket == "hour":
        return hour_start(ts)
    raise ValueError(bucket)


def previous_value(df: DataFrame, key: str, value: str, order: list[str], ts: str = "ts",
                   bucket: str = "day") -> DataFrame:
    """Adds ``prev_<value>``: the value of the preceding row of the same key
    by ``order``. Lag runs inside (key, bucket); each bucket's first row
    takes the last value of the key's previous non-empty bucket."""
    b = df.withColumn("_bucket", bucket_of(F.col(ts), bucket))
    w = Window.partitionBy(key, "_bucket").orderBy(*order)
    b = b.withColumn("_prev", F.lag(value).over(w)).withColumn("_first", F.lag(F.lit(1)).over(w).isNull())
    last = b.groupBy(key, "_bucket").agg(F.max(F.struct(*order, value)).getField(value).alias("_last"))
    wb = Window.partitionBy(key).orderBy("_bucket")
    carry = last.withColumn("_carry", F.lag("_last").over(wb)).drop("_last")
    out = b.join(carry, [key, "_bucket"], "left")
    prev = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))
    return out.withColumn(f"prev_{value}", prev).drop("_bucket", "_prev", "_first", "_carry")


def url_changes(versions: DataFrame, bucket: str = "day") -> DataFrame:
    """W-2: a fetch is a change when its hash differs from the URL's
    previous fetch; the first sighting counts as changed."""
    p = previous_value(versions, "url", "content_hash", ["ts", "id"], bucket=bucket)
    changed = F.col("prev_content_hash").isNull() | (F.col("prev_content_hash") != F.col("content_hash"))
    return p.withColumn("changed", changed).drop("prev_content_hash")


def story_collapse(docs: DataFrame, text_col: str = "content") -> DataFrame:
    """A-24: one event per content hash: first seen, number of distinct
    sources, number of copies (empty content excluded)."""
    t = F.col(text_col)
    h = docs.where(t.isNotNull() & (t != "")).withColumn("content_hash", content_hash(t))
    return h.groupBy("content_hash").agg(F.min("ts").alias("first_seen"),
                                         F.countDistinct("source_id").alias("source_count"),
                                         F.count(F.lit(1)).alias("copies"))


def unseen(batch: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """J-8 / X-2: rows of ``batch`` whose key is not among ``known``."""
    return batch.join(known.select(key).distinct(), key, "left_anti")


def dedup_sources(sources: DataFrame, url_col: str = "url", order: list[str] | None = None) -> DataFrame:
    """X-3: one source per normalised URL (first by ``order``)."""
    order = order or ["id"]
    n = sources.withColumn("url_norm", normalize_url(F.col(url_col)))
    return first_copies(n, "url_norm", order).where("is_first").drop("is_first")
