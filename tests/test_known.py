"""Store of known hashes against a plain set."""

from __future__ import annotations

import random

from topicwatch.operators.known import KnownContent

SCHEMA = "id int, content_hash string, ts int"


def test_loads_equal_a_set(spark, tmpdir_path):
    rnd = random.Random(2)
    known: set = set()
    for n in range(4):
        rows = [(1000 * n + i, rnd.choice(["hot", f"h{rnd.randrange(300)}"]), rnd.randrange(50)) for i in range(200)]
        rows += [(1000 * n + 900, None, 1), (1000 * n + 901, "", 1)]
        want: dict = {}
        for i, h, ts in sorted(rows, key=lambda r: (r[2], r[0])):
            if h and h not in known:
                want.setdefault(h, (h, ts, i))
        store = KnownContent(spark, f"{tmpdir_path}/known", buckets=5 + n)
        assert store.buckets == 5
        got = store.load(spark.createDataFrame(rows, SCHEMA), ["ts", "id"])
        assert sorted(tuple(r) for r in got.collect()) == sorted(want.values())
        known |= set(want)
    assert sorted(r[0] for r in store.hashes().collect()) == sorted(known)
    assert store.load(spark.createDataFrame([], SCHEMA), ["ts", "id"]).collect() == []
    assert store.load(spark.createDataFrame([(1, "hot", 1)], SCHEMA), ["ts", "id"]).collect() == []


def test_history_is_not_shuffled(spark, tmpdir_path):
    store = KnownContent(spark, f"{tmpdir_path}/known", buckets=6)
    store.load(spark.range(500).selectExpr("int(id) id", "string(id) content_hash", "1 ts"), ["ts", "id"])
    batch = spark.range(400, 600).selectExpr("int(id) id", "string(id) content_hash", "1 ts")
    out = store.unseen(batch, ["ts", "id"])
    assert out.count() == 100
    plan = out._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "Scan parquet" in line and "Bucketed: true" in line)
    join = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    path, deep = [], depth(lines[scan])
    for line in reversed(lines[join:scan]):
        if depth(line) < deep:
            path.append(line)
            deep = depth(line)
    assert "SortMergeJoin" in path[-1] and not any("Exchange" in line for line in path), plan
