"""Session helpers: scale-oriented defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults chosen for large clusters; callers (tests, bench) override the
# partition count for local runs.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Explicit broadcasts happen behind a size check only; keep the automatic
    # threshold modest so Catalyst never broadcasts a side that grew.
    "spark.sql.autoBroadcastJoinThreshold": "32m",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "topicwatch") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``. Only when it is unset is ``fallback`` or, on a local
    master (tests), a folder of our own set; a cluster without one is an error,
    since a machine's own folder is not shared."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        local = spark.sparkContext.master.split("[")[0] == "local"
        d = fallback or ("/tmp/topicwatch-checkpoints" if local else None)
        if d is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


_SCRATCH: dict[str, tuple] = {}


def _drop_scratch() -> None:
    for spark, root in _SCRATCH.values():
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session is gone; the folder is named after the application
            pass


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for an application's own tables, under the shared checkpoint folder; deleted when the driver exits."""
    if not _SCRATCH:
        atexit.register(_drop_scratch)
    app = spark.sparkContext.applicationId
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/topicwatch-tables-{app}"
    _SCRATCH.setdefault(app, (spark, root))
    return f"{root}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor
    loss, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that are no longer referenced (it only acts on a collection of the driver's
    garbage), so that the steps of a long operator don't add up on disk."""
    import gc
    import time
    for _ in range(2):  # references from Python reach the driver's JVM a moment after they go
        gc.collect()
        time.sleep(0.3)
        spark._jvm.System.gc()


# Source size above which a narrow intermediate that several branches of a
# plan read is written once (reliable checkpoint) instead of recomputed.
MATERIALIZE_CONF = "topicwatch.materialize.minSourceBytes"
MATERIALIZE_DEFAULT = 64 << 30


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` (plan statistics; no job runs)."""
    v = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(v) if isinstance(v, int) else int(v.toString())


def reuse_if_large(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df`` is derived from ``source`` and read by several branches of one
    plan (DataFrames are not cached, so each branch would rescan and
    recompute ``source``). When ``source`` is estimated above
    ``topicwatch.materialize.minSourceBytes`` the narrow ``df`` is written
    once to the shared checkpoint folder and read back by every branch;
    smaller inputs are recomputed, which is cheaper than a write."""
    spark = df.sparkSession
    limit = int(spark.conf.get(MATERIALIZE_CONF, str(MATERIALIZE_DEFAULT)))
    if estimated_bytes(source) < limit:
        return df
    return cut_lineage(df)


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Make ``topicwatch`` importable on executors (the pandas-backed folds
    and keyed-state streams run Python there): the package is zipped on the
    driver and added with ``addPyFile`` once per SparkContext, the same as
    ``--py-files``; Spark serves the file to the executors."""
    import tempfile
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="topicwatch-code-"), "topicwatch.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(out)
    _SHIPPED.add(key)
