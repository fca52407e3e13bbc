"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: ASCII white space, [\x20\x09-\x0D], as the contracts of the queries name it.
WS = " \t\n\x0b\x0c\r"
WS_RUN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_ROOTS: dict[str, tuple] = {}


def _drop_scratch() -> None:
    for spark, root in _ROOTS.values():
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session is gone; the folder is named after the application
            pass


atexit.register(_drop_scratch)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names.
    All paths of an application lie in one folder, which is deleted when the
    driver exits."""
    app = spark.sparkContext.applicationId
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/topicwatch-{app}"
    _ROOTS.setdefault(app, (spark, root))
    return f"{root}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts
    the lineage, survives lost executors, and gives later joins a plain scan
    whose size Spark knows (so it broadcasts by size, or splits a skewed key)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Give back disk between the steps of a long operator: delete the given
    materialised tables, and let Spark's cleaner drop shuffle files whose plans are
    no longer referenced (it only acts on a collection of the driver's garbage)."""
    import gc
    for t in tables:
        for f in t.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    for _ in range(2):  # references from Python reach the driver's JVM a moment after they go
        gc.collect()
        time.sleep(0.3)
        spark._jvm.System.gc()


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take the fast ``lower``."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def row_key(*cols: Column) -> list[Column]:
    """128 hash bits that identify a row by the given columns; never null, so
    joins on it keep rows whose id is null."""
    return [F.xxhash64(*cols).alias("_k1"), F.xxhash64(F.lit("second"), *cols).alias("_k2")]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it, so that it isn't a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def packed(df: DataFrame, carry: list[str] | None) -> Column:
    """The carried columns as one struct ``_row``, so that working columns never
    clash with the caller's names."""
    names = df.columns if carry is None else carry
    return F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")


def unpacked(df: DataFrame, added: list[str]) -> list[Column]:
    """The carried columns again; of equal names, the operator's column stays."""
    low = {a.lower() for a in added}
    fields = [f for f in df.schema["_row"].dataType.names if f.lower() not in low]
    return [F.col("_row").getField(f).alias(f) for f in fields] + [F.col(a) for a in added]
