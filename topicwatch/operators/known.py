"""Store of known content hashes (J-8, X-2, W-1 across loads).

``dedup.unseen`` reads and shuffles all history for every batch. Here the
hashes lie in a Parquet table bucketed by hash: a batch is reduced to its
distinct hashes (map-side combined, so a hot hash is one row), those alone
are shuffled to the table's buckets, and the anti-join reads each bucket
where it lies. New hashes are appended bucket by bucket; the table holds
hashes only, never texts.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage


class KnownContent:
    """Hashes of earlier loads under ``path`` (a folder that driver and executors share). The number of buckets is
    fixed by the first load; a later one opens the table with it, whatever it asks for."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, key: str = "content_hash"):
        self.spark, self.key = spark, key
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        found = [int(n.removeprefix("buckets=")) for n in found if n.startswith("buckets=")]
        self.buckets = found[0] if found else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        folder = f"{path.rstrip('/')}/buckets={self.buckets}"
        self.table = f"known_{hashlib.sha256(folder.encode()).hexdigest()[:24]}"
        quoted = folder.replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (`{key}` STRING) USING parquet "
                  f"CLUSTERED BY (`{key}`) INTO {self.buckets} BUCKETS LOCATION '{quoted}'")

    def hashes(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, batch: DataFrame, order: list[str]) -> DataFrame:
        """First row, by ``order``, of each hash of ``batch`` that no earlier load had: the hash and the columns of
        ``order``. Rows with a null or empty hash are no content and are left out."""
        key = F.col(self.key)
        firsts = batch.where(key.isNotNull() & (key != "")).groupBy(self.key).agg(F.min(F.struct(*order)).alias("_first"))
        new = firsts.join(self.hashes().hint("merge"), self.key, "left_anti")
        return new.select(self.key, *[F.col("_first").getField(c).alias(c) for c in order])

    def load(self, batch: DataFrame, order: list[str]) -> DataFrame:
        """``unseen`` rows of ``batch``, whose hashes are known from then on. The rows are checkpointed before the
        hashes are added, as a plan that reads the store would find them known. A load that failed midway can be
        repeated from the returned rows; hashes added twice change nothing."""
        new = cut_lineage(self.unseen(batch, order))
        new.select(self.key).repartition(self.buckets, self.key).write.insertInto(self.table)
        return new
