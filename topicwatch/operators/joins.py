"""Join helpers: orphans (J-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, relation: str) -> DataFrame:
    """J-13 / DQ-5: child rows whose non-NULL key has no parent."""
    c = child.where(F.col(child_key).isNotNull()).select(F.col(child_key).alias("_k"))
    p = parent.select(F.col(parent_key).alias("_k"))
    return (c.join(p, "_k", "left_anti")
            .select(F.lit(relation).alias("relation"), F.col("_k").cast("string").alias("key")))
