"""Line de-duplication with levelled sorted runs of line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, lower_ascii, materialize, packed, row_key, text_or_empty, unpacked


def line_key(line: Column) -> Column:
    """Hash of a line stripped of ASCII white space at both ends, with A-Z in
    lower case; null for a line that is then empty (those are never dropped)."""
    key = lower_ascii(F.btrim(line, F.lit(WS)))
    return F.when(key != "", F.md5(key))


class LineRuns:
    """Sorted runs of (line hash, documents that hold it), kept as Parquet.

    ``add`` counts a batch of documents, merge-anti-joins the counts with the
    settled run (hashes known to reach ``min_docs``) and adds what is left as
    a run of level 0. ``fanout`` runs of a level are merged into one of the
    next level; hashes that reach ``min_docs`` there move to the settled run.
    Every count is a partial aggregate, so a line that a third of all
    documents hold sends one row per task.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[DataFrame] = []

    def _run(self, counts: DataFrame, name: str) -> DataFrame:
        return materialize(counts.sortWithinPartitions("k"), name)

    def known(self) -> DataFrame:
        """Hashes that have reached ``min_docs`` so far."""
        if not self.settled:
            return self.spark.createDataFrame([], "k string")
        out = self.settled[0]
        for run in self.settled[1:]:
            out = out.unionByName(run)
        return out

    def add(self, keys: DataFrame) -> None:
        """``keys``: column ``k``, each hash once per document of the batch."""
        counts = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        if self.settled:
            counts = counts.join(self.known().hint("merge"), "k", "left_anti")
        self.levels[0].append(self._run(counts, "line-run-0"))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self._merge(self.levels[level], f"line-run-{level + 1}")
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            level += 1

    def _merge(self, runs: list[DataFrame], name: str) -> DataFrame:
        """One run of the given ones; hashes that reach ``min_docs`` settle."""
        union = runs[0]
        for run in runs[1:]:
            union = union.unionByName(run)
        if self.settled:
            union = union.join(self.known().hint("merge"), "k", "left_anti")
        merged = self._run(union.groupBy("k").agg(F.sum("n").alias("n")), name)
        self.settled.append(materialize(merged.where(F.col("n") >= self.min_docs).select("k"), "line-settled"))
        return merged.where(F.col("n") < self.min_docs)

    def finish(self) -> DataFrame:
        """Merge what is left of all levels; returns every hash that reaches ``min_docs``."""
        rest = [run for level in self.levels for run in level]
        self.levels = [[]]
        if rest:
            self.levels[0] = [self._merge(rest, "line-run-last")]
        return self.known()


def drop_common_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10,
                      batches: int = 4, fanout: int = 2, carry: list[str] | None = None) -> DataFrame:
    """Drop every line whose key is in at least ``min_docs`` documents.

    The documents enter the runs in ``batches`` (all of them, dealt by a hash of
    the row). The drop pass joins hashes, not texts: a hot line is either in a
    small, broadcast run or split by the adaptive skew join.

    Returns the ``carry`` columns (default: all) plus ``n_lines`` (before),
    ``n_dropped`` and ``kept_text`` (other lines joined by a line feed). Null
    text is one empty line. Each row is a document, also one that repeats id and
    text. Input columns with the names of the added ones are replaced. An
    empty table gives an empty result.
    """
    spark = df.sparkSession
    text = text_or_empty(text_col)
    rows = df.select(packed(df, carry), *row_key(F.col(f"`{id_col}`"), text), F.split(text, "\n").alias("_lines"))
    keys = rows.select("_k1", "_k2", F.transform("_lines", line_key).alias("ks"))
    runs = LineRuns(spark, min_docs, fanout)
    for b in range(batches):
        batch = keys.where(F.pmod(F.col("_k1"), F.lit(batches)) == b)
        runs.add(batch.select(F.explode_outer(F.array_distinct("ks")).alias("k")).where("k is not null"))
    common = runs.finish()
    hits = (keys.select("_k1", "_k2", F.posexplode_outer("ks").alias("pos", "k")).where("k is not null")
            .join(common, "k", "left_semi")
            .groupBy("_k1", "_k2").agg(F.collect_set("pos").alias("_drop")))
    out = rows.join(hits, ["_k1", "_k2"], "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1),
                            F.coalesce("_drop", F.array().cast("array<int>")))
    out = (out.withColumn("n_lines", F.size("_lines").cast("long"))
           .withColumn("n_dropped", F.coalesce(F.size("_drop"), F.lit(0)).cast("long"))
           .withColumn("kept_text", F.array_join(F.transform(places, lambda i: F.get("_lines", i)), "\n")))
    return out.select(*unpacked(out, ["n_lines", "n_dropped", "kept_text"]))
