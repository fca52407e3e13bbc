"""Data-quality checks and table maintenance (DQ-1..DQ-7, J-13, MT-1..MT-6).

Checks return violation counts (or rows) as DataFrames; maintenance
operators return the new table contents. Writes go through
``sources.sinks`` (dynamic partition overwrite, compressed archive).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecols import as_ntz, minus
from .joins import orphans


def orphan_counts(relations: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """J-13 / DQ-5: one row per relation with its orphan count (0 kept)."""
    parts = [orphans(c, ck, p, pk, name).agg(F.count(F.lit(1)).alias("orphans"))
             .select(F.lit(name).alias("relation"), "orphans") for name, c, ck, p, pk in relations]
    return reduce(DataFrame.unionByName, parts)


def violations(df: DataFrame, checks: dict[str, Column], table: str) -> DataFrame:
    """DQ-1..DQ-3, DQ-6: count rows failing each named predicate in one
    pass (a predicate that is NULL counts as a failure)."""
    agg = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    stack = ", ".join(f"'{n}', `{n}`" for n in checks)
    return agg.selectExpr(f"stack({len(checks)}, {stack}) AS (check, violations)").select(
        F.lit(table).alias("table_name"), "check", "violations")


def duplicate_keys(df: DataFrame, keys: list[str], table: str) -> DataFrame:
    """DQ-4: number of keys that occur more than once."""
    d = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return d.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit("unique(" + ",".join(keys) + ")").alias("check"), "violations")


def flag_bad_rows(df: DataFrame, required: list[str]) -> DataFrame:
    """DQ-7: keep every row, flag the ones missing required values."""
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.col(c).cast("string") == "") for c in required])
    return df.withColumn("is_valid", ~bad)


def retention_split(df: DataFrame, now, keep_days: float, table: str, ts: str = "ts",
                    key: str = "id") -> DataFrame:
    """MT-1: every row tagged keep / expired against ``now - keep_days``; a row
    without a time is ``undated``, never expired."""
    cutoff = minus(as_ntz(now), days=keep_days)
    return df.select(F.lit(table).alias("table_name"), F.col(key).alias("id"),
                     F.when(F.col(ts).isNull(), "undated").when(F.col(ts) >= cutoff, "keep")
                     .otherwise("expired").alias("status"))


def upsert(base: DataFrame, updates: DataFrame, key: str = "id", ts: str = "updated_at") -> DataFrame:
    """MT-4: union + newest row per key (updates win ties; ties within the
    updates go to the largest row, so the result is always the same)."""
    u = base.withColumn("_src", F.lit(0)).unionByName(updates.withColumn("_src", F.lit(1)))
    rest = [F.col(c).desc_nulls_last() for c in base.columns if c not in (key, ts)
            and base.schema[c].dataType.typeName() != "map"]
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col("_src").desc(), *rest)
    return u.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", "_src")


def cascade_delete(situation_ids: DataFrame, documents: DataFrame, alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """MT-3: remove the situations' documents and alerts; remaining alerts
    pointing at a removed document keep their row with document_id NULL."""
    gone = situation_ids.select(F.col("id").alias("situation_id")).distinct()
    docs_left = documents.join(gone, "situation_id", "left_anti")
    removed_docs = documents.join(gone, "situation_id", "left_semi").select(F.col("id").alias("document_id"),
                                                                              F.lit(True).alias("_gone"))
    a = alerts.join(gone, "situation_id", "left_anti").join(removed_docs, "document_id", "left")
    a = a.withColumn("document_id", F.when(F.col("_gone"), F.lit(None).cast("bigint"))
                     .otherwise(F.col("document_id"))).drop("_gone")
    return docs_left, a


def acknowledge(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """MT-5: apply (id, acknowledged_at, acknowledged_by) to open alerts. The
    earliest acknowledgement of an id counts; alerts acknowledged before keep
    their time and person."""
    one = acks.where(F.col("acknowledged_at").isNotNull()).groupBy("id").agg(
        F.min(F.struct("acknowledged_at", "acknowledged_by")).alias("_ack"))
    a = alerts.join(one, "id", "left")
    was = F.coalesce(F.col("acknowledged"), F.lit(False))
    hit = F.col("_ack").isNotNull() & ~was
    for c in ("acknowledged_at", "acknowledged_by"):
        old = F.col(c) if c in alerts.columns else F.lit(None)
        a = a.withColumn(c, F.when(hit, F.col("_ack").getField(c)).otherwise(old))
    return a.withColumn("acknowledged", was | hit).drop("_ack")
