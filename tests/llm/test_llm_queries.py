"""The registered corpus queries on a small table: SQL, and the stages of the pipeline."""

from __future__ import annotations

import re

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from conftest import SF_SMALL
from tools.oracle_check import digest
from topicwatch import llm
from topicwatch.llm.common import materialize, text_or_empty
from topicwatch.llm.exact_dedup import without_space

llm.load_all()


def test_every_operator_has_one_query():
    names = [q for q in E.queries() if re.match(r"op\d+_", q)]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14))
    assert "pipeline" in E.queries()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_equals_sql(spark, name):
    df = llm.QUERIES[name](spark, SF_SMALL)
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    cur = con.execute(llm.ORACLES[name])
    columns, want = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(columns, want)[0]


def test_pipeline_stages_take_effect(spark):
    """Each stage keeps the columns, removes what it should, and nothing else."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    before, out = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, before, SF_SMALL), "stage")
        out[name] = (before, after)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
            assert after.join(before, "doc_id", "left_anti").isEmpty()
        before = after
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    kept = ids(out["quality classifier"][1])
    clean = [d for d, x in labels.items() if x == (1, 0)]
    assert sum(d in kept for d in clean) >= 0.95 * len(clean)
    assert sum(d in kept for d, x in labels.items() if x != (1, 0)) <= 0.1 * len(labels)
    first, last = out["exact dedup"]
    norm = lambda df: df.select(without_space(text_or_empty("text")).alias("t")).distinct().collect()
    assert last.count() == len(norm(first)) == len(norm(last))
    packed = out["best-fit packing"][1]
    assert ids(packed) == ids(out["benchmark decontamination"][1])
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").isEmpty()
