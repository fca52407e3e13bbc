"""Connected components of links between integer ids, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r.n, r.s


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (smallest id reachable) of every id in ``links``
    (columns ``a``, ``b``; loops allowed).

    Alternating large-star and small-star steps: each links a node's neighbours
    to their minimum, until nothing changes (a logarithmic number of rounds).
    The minimum of a node is a partial aggregate that is written and joined as
    a plain table, so a hub's links are split over tasks.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large-star")
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(edges.where("u = v")).distinct())
        large = materialize(large, "links")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        small = large.join(low, "u")
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        # a minimum's loop carries no link, but keeps the node in the table
        edges = materialize(small.where("u >= v"), "links")
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
