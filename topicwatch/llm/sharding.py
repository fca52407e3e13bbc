"""Proportional stratified interleaving of rows into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, packed, parallelism, unpacked

#: Rows that one ranking slice holds at most on average (there are at least as many slices as shuffle
#: partitions), and the most slices of a source.
BUCKET_ROWS, MAX_BUCKETS = 100_000, 65_536


def interleave(df: DataFrame, shards: int = 8, id_col: str = "doc_id", source_col: str = "source", seed: int = 1,
               carry: list[str] | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Place every row in a shard so that each shard has the sources' mixture.

    Rows get a seeded hash; within each source they are ranked by it, and
    (rank - 1/2) / rows of the source is a row's fractional rank. All rows
    sorted by fractional rank are cut into ``shards`` runs whose lengths
    differ by at most one; any run holds each source's share within a row.

    Both ranks are distributed: the hash (and the fractional rank) is uniform,
    so equal slices of its range hold equally many rows, a row's rank is the
    count of the slices before plus its rank in the slice, and a source with a
    third of all rows is ranked by as many tasks as it has slices. Only slice
    counts (at most ``MAX_BUCKETS`` a source) are summed in order.

    Returns the ``carry`` columns (default: all) plus ``law`` ('rows'),
    ``shard`` and ``slot`` (gapless from 0 in each shard). A null source is a
    source of its own. The hash covers the id and the carried columns (of types that
    Spark can hash, so no maps): only rows equal in all of them share it. Ties of the hash go by id, then
    arbitrarily. Input columns with the names of the added ones are replaced.
    An empty table gives an empty result.
    """
    total = df.count()
    buckets = max(1, min(MAX_BUCKETS, max(total // bucket_rows, parallelism(df.sparkSession))))
    step = (1 << 32) / buckets
    source = F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit(""))
    # the carried columns are hashed too, so that null and repeated ids don't share a slice
    rows = df.select(packed(df, carry), F.col(f"`{id_col}`").alias("_id"), source.alias("_source"))
    rows = rows.withColumn("_u", F.xxhash64(F.lit(seed), "_id", "_row")).withColumn(
        # the top 32 bits of the hash as an unsigned number, in equal slices
        "_slice", F.floor((F.shiftright("_u", 32) + F.lit(1 << 31)) / F.lit(step)).cast("int"))
    # equal rows have equal hashes, so a slice is cut the same way in every run
    per_slice = materialize(rows.groupBy("_source", "_slice").agg(F.count(F.lit(1)).alias("_n")), "slice-counts")
    by_source = Window.partitionBy("_source").orderBy("_slice")
    starts = per_slice.select(
        "_source", "_slice",
        (F.sum("_n").over(by_source) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy("_source")).alias("_rows"))
    in_slice = Window.partitionBy("_source", "_slice").orderBy("_u", "_id")
    ranked = rows.withColumn("_r", F.row_number().over(in_slice)).join(starts, ["_source", "_slice"])
    ranked = ranked.select(
        "_row", "_id", "_source", "_u", ((F.col("_before") + F.col("_r") - F.lit(0.5)) / F.col("_rows")).alias("_frac"))
    ranked = materialize(ranked.withColumn("_cut", F.floor(F.col("_frac") * buckets).cast("int")), "ranked")
    cuts = ranked.groupBy("_cut").agg(F.count(F.lit(1)).alias("_n"))
    # one row per slice of the fractional rank: MAX_BUCKETS rows at most
    cuts = cuts.select("_cut", (F.sum("_n").over(Window.orderBy("_cut")) - F.col("_n")).alias("_first"))
    place = F.col("_first") + F.row_number().over(Window.partitionBy("_cut").orderBy("_frac", "_u", "_id", "_source")) - 1
    out = ranked.join(F.broadcast(cuts), "_cut").withColumn("_place", place)
    small, larger = divmod(total, shards)
    edge = larger * (small + 1)  # the first `larger` shards hold one row more
    first = F.col("_place") < edge
    size = max(1, small)
    out = (out.withColumn("law", F.lit("rows"))
           .withColumn("shard", F.when(first, F.floor(F.col("_place") / (small + 1)))
                       .otherwise(larger + F.floor((F.col("_place") - edge) / size)).cast("int"))
           .withColumn("slot", F.when(first, F.col("_place") % (small + 1))
                       .otherwise((F.col("_place") - edge) % size).cast("long")))
    return out.select(*unpacked(out, ["law", "shard", "slot"]))


def write_shards(placed: DataFrame, path: str) -> None:
    """Write the rows of ``interleave`` as one folder per shard, in slot order."""
    (placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
