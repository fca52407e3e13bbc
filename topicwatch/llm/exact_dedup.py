"""Exact de-duplication by content sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS_RUN, packed, parallelism, text_or_empty, unpacked

#: Code points of the normalised text that the sampled splitters see.
SPLITTER_CHARS = 64


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, WS_RUN, "")


def content_sort(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: bool = True,
                 carry: list[str] | None = None) -> DataFrame:
    """Group rows whose texts are equal without ASCII white space.

    Spark samples splitters and range-partitions the rows by normalised text;
    an external sort in each partition places equal texts next to each other,
    and the window compares neighbours by their whole normalised text. The row
    with the smallest id of each group stays (``longest``: of those with the
    most code points). Splitters are sampled from the first 64 code points and
    a hash, never from whole texts, so the sample stays small.

    A text with more rows than a partition's fair share is salted over as many
    partitions as it fills; its parts are joined by a pre-aggregate with one
    row per such text (at most as many as there are partitions, so broadcast).

    Returns the ``carry`` columns (default: all) plus ``keep_id``,
    ``group_size``, ``kept`` and ``text_sha256`` of the normalised text, one row
    per input row. Null text counts as empty. Null ids sort last. Of rows that
    repeat both id and text, exactly one is kept. Input columns with the names
    of the added ones are replaced. An empty table gives an empty result.
    """
    spark = df.sparkSession
    parts = parallelism(spark)
    text = text_or_empty(text_col)
    base = (df.select(packed(df, carry), F.col(f"`{id_col}`").alias("_id"), F.length(text).alias("_len"),
                      without_space(text).alias("_norm"))
            .withColumn("_h", F.xxhash64("_norm")))
    share = max(1, df.count() // parts)
    # more than a share each: at most `parts` texts, however large the table is
    hot = base.groupBy("_h").count().where(F.col("count") > share).select(
        "_h", F.ceil(F.col("count") / share).alias("_salts"))
    hot_rows = hot.collect()
    if hot_rows:
        hot = F.broadcast(spark.createDataFrame(hot_rows, hot.schema))
        base = (base.join(hot, "_h", "left")
                .withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0))
                            .otherwise(F.pmod(F.xxhash64("_id", "_len"), F.col("_salts")).cast("int")))
                .drop("_salts"))
        rank = F.struct((-F.col("_len")).alias("l"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i")) \
            if longest else F.struct(F.lit(0).alias("l"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i"))
        groups = (base.join(hot.drop("_salts"), "_h", "left_semi").groupBy("_norm")
                  .agg(F.min(rank).alias("_best"), F.count(F.lit(1)).alias("_all"))
                  .select(F.sha2("_norm", 256).alias("text_sha256"), "_best", "_all"))
    base = base.withColumn("_front", F.substring("_norm", 1, SPLITTER_CHARS))
    order = ([F.col("_len").desc()] if longest else []) + [F.col("_id").asc_nulls_last()]
    # a constant salt would be folded away, and the range partitioning with it
    splitters = ["_front", "_h", "_salt"] if hot_rows else ["_front", "_h"]
    group = Window.partitionBy(*splitters, "_norm").orderBy(*order)
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = (base.repartitionByRange(parts, *splitters)
           .withColumn("_rn", F.row_number().over(group))
           .withColumn("keep_id", F.first("_id").over(whole))
           .withColumn("_best_len", F.first("_len").over(whole))
           .withColumn("group_size", F.count(F.lit(1)).over(whole))
           .withColumn("text_sha256", F.sha2("_norm", 256))
           .drop("_norm", "_front"))
    kept = F.col("_rn") == 1
    if hot_rows:
        out = (out.join(F.broadcast(groups), "text_sha256", "left")
               .withColumn("group_size", F.coalesce("_all", "group_size"))
               .withColumn("keep_id", F.when(F.col("_best").isNull(), F.col("keep_id")).otherwise(F.col("_best.i"))))
        best = F.col("_best.i").eqNullSafe(F.col("_id"))
        if longest:
            best = best & (F.col("_best.l") == -F.col("_len"))
        kept = kept & F.when(F.col("_best").isNull(), F.lit(True)).otherwise(best)
    out = out.withColumn("kept", kept)
    return out.select(*unpacked(out, ["keep_id", "group_size", "kept", "text_sha256"]))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that ``content_sort`` keeps, with the columns of ``df``."""
    names = df.columns
    marked = content_sort(df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                                    F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body")),
                          "id", "body", carry=["row"])
    return marked.where("kept").select(*[F.col("row").getField(c).alias(c) for c in names])
