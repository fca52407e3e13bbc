"""Benchmark decontamination: containment search for short items in long documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, packed, row_key, text_or_empty


def words_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")


def shingle_rows(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """One row per run of ``size`` words of array column ``w``: the keys, the
    words ``s0..`` and their hash ``h``. Stays in generated code: the shifted
    slices are zipped and inlined, without a lambda."""
    n = F.greatest(F.size("w") - (size - 1), F.lit(0))
    zipped = F.arrays_zip(*[F.slice("w", i + 1, n) for i in range(size)])
    names = [f"s{i}" for i in range(size)]
    out = df.select(*keys, F.inline_outer(zipped)).toDF(*keys, *names).where("s0 is not null")
    return out.withColumn("h", F.xxhash64(*names))


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_id: str = "item_id", item_text: str = "text", shingle: int = 5,
                    threshold: float = 0.8) -> DataFrame:
    """Items of which at least ``threshold`` of the shingles occur in a document.

    An exact prefix filter in place of MinHash and size partitions: an item of n
    shingles is looked up by k = n - ceil(threshold n) + 1 of its hashes, so k grows
    with its size and a document that holds the threshold's share must hold
    at least one of them: the search loses nothing, where sampled signatures would.
    Hashes that fewer items share come first, so the text of a template doesn't draw
    candidates. Items are split only by min(words, ``shingle``), the length of
    their shingles. Documents of any length are looked up
    shingle by shingle; candidate documents alone are read again, and the exact
    distinct shingles (the words, not their hashes) that both hold are counted.
    The signature table grows with the items only; Spark broadcasts it if its
    written size is under the broadcast threshold and shuffles hashes otherwise.

    Returns ``doc_id``, ``item_id`` (under the names given), ``item_shingles``,
    ``shared_shingles``, ``containment`` and the document's key ``_k1``, ``_k2``,
    one row per pair. An item of fewer words than ``shingle`` is one shingle of all its
    words; one without words matches nothing, as does null text. Rows that
    repeat id and text count once. Empty tables give an empty result.
    """
    out_id, out_item = id_col, item_id
    items = (items.select(F.col(f"`{item_id}`").alias("item"), text_or_empty(item_text).alias("t"))
             .withColumn("w", words_of(F.col("t"))).where(F.size("w") > 0)
             .select("item", *[c.alias(n) for c, n in zip(row_key(F.col("item"), F.col("t")), ("i1", "i2"))], "w")
             .dropDuplicates(["i1", "i2"]))
    items = materialize(items.withColumn("m", F.least(F.size("w"), F.lit(shingle))), "items")
    lengths = [r.m for r in items.select("m").distinct().collect()]  # at most `shingle` values
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), text_or_empty(text_col).alias("t"))
    rows = rows.select("doc", *row_key(F.col("doc"), F.col("t")), "t")
    found = None
    for m in sorted(lengths):
        names = [f"s{i}" for i in range(m)]
        own = materialize(
            shingle_rows(items.where(F.col("m") == m), ["item", "i1", "i2"], m).distinct(), "item-shingles")
        per_item = Window.partitionBy("i1", "i2")
        signed = (own.withColumn("n", F.count(F.lit(1)).over(per_item))
                  .withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("h")))
                  .withColumn("rank", F.row_number().over(per_item.orderBy("shared", "h")))
                  .where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1))
        signed = materialize(signed.select("h").distinct(), "item-signatures")
        words = rows.select("_k1", "_k2", words_of(F.col("t")).alias("w"))
        candidates = (shingle_rows(words, ["_k1", "_k2"], m).select("_k1", "_k2", "h")
                      .join(signed, "h", "left_semi").select("_k1", "_k2").distinct())
        candidates = materialize(candidates, "candidates")
        near = rows.join(candidates, ["_k1", "_k2"], "left_semi")
        near = near.select("doc", "_k1", "_k2", words_of(F.col("t")).alias("w"))
        sizes = own.groupBy("i1", "i2").agg(F.count(F.lit(1)).alias("item_shingles"))
        common = (shingle_rows(near, ["doc", "_k1", "_k2"], m).join(own, ["h", *names])
                  .select("doc", "_k1", "_k2", "item", "i1", "i2", "h", *names).distinct()
                  .groupBy("doc", "_k1", "_k2", "item", "i1", "i2").agg(F.count(F.lit(1)).alias("shared_shingles"))
                  .join(sizes, ["i1", "i2"])
                  .where(F.col("shared_shingles") >= F.col("item_shingles") * threshold - 1e-9)
                  .select(F.col("doc").alias(out_id), F.col("item").alias(out_item), "item_shingles",
                          "shared_shingles", (F.col("shared_shingles") / F.col("item_shingles")).alias("containment"),
                          "_k1", "_k2"))
        found = common if found is None else found.unionByName(common)
    if found is None:
        found = rows.where("false").select(F.col("doc").alias(out_id), F.lit(None).cast(items.schema["item"].dataType).alias(out_item),
                             F.lit(0).cast("long").alias("item_shingles"), F.lit(0).cast("long").alias("shared_shingles"),
                             F.lit(0.0).alias("containment"), "_k1", "_k2")
    return found


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` in which no item is contained, with their columns."""
    bad = contained_items(docs, items, id_col, text_col, **how).select("_k1", "_k2").distinct()
    names = docs.columns
    rows = docs.select(packed(docs, None), *row_key(F.col(f"`{id_col}`"), text_or_empty(text_col)))
    return rows.join(bad, ["_k1", "_k2"], "left_anti").select(*[F.col("_row").getField(c).alias(c) for c in names])
