"""The corpus pipeline: each stage works on what its predecessor kept.

The classifier, the tokenizer and the link components have no SQL form, so
``ORACLE_SQL`` is None; tests hold every stage against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from topicwatch.llm import decontamination, exact_dedup, jaccard_join, packing, quality
from topicwatch.llm.common import materialize
from topicwatch.llm.queries import table, vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of low quality or of toxicity passes its cut go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts equal without white space stays."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word Jaccard similarity of 0.8 or more stays."""
    return jaccard_join.keep_one(docs, size=5, num=80, den=100)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain 0.8 or more of a benchmark item's five-word shingles go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 2048 tokens."""
    return packing.pack(packing.token_pieces(docs, vocabulary(), 2048), 2048)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_documents),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("best-fit packing", packed_sequences),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
