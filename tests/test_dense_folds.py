"""Cooldown folds that split a dense key, against the plain loop."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest

from topicwatch.operators import alerts as AL
from topicwatch.operators import dense_folds as D

START = dt.datetime(2024, 1, 1)


def loop(rows, cooldown_s):
    last, kept = {}, []
    for key, ts, i in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        if key not in last or (ts - last[key]).total_seconds() >= cooldown_s:
            last[key] = ts
            kept.append((key, ts, i))
    return kept + [r for r in rows if r[1] is None]


def flat(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("cooldown_s, span, parts, fan", [(5, 3000, 40, 3), (60, 3000, 40, 3), (700, 3000, 30, 2), (4000, 3000, 17, 4), (1, 400, 9, 16)])
def test_dense_keys_equal_the_loop(spark, cooldown_s, span, parts, fan):
    rnd = random.Random(cooldown_s)
    hot = [("hot", START + dt.timedelta(seconds=rnd.randrange(span)), i) for i in range(2500)]
    rest = [(rnd.choice([None, "", "a", "z", 'q"', "null"]), START + dt.timedelta(seconds=rnd.randrange(span)), 5000 + i) for i in range(400)]
    rows = hot + rest + [("hot", None, 9000), (None, None, 9001)]
    df = spark.createDataFrame(rows, "user string, ts timestamp_ntz, id int").repartition(7)
    got = D.keep_spaced(df, ["user"], cooldown_s, parts=parts, fan=fan).collect()
    assert flat([tuple(r) for r in got]) == flat(loop(rows, cooldown_s))


def test_equal_rows_no_keys_and_empty_tables(spark):
    rows = [("k", START, 1)] * 50 + [("k", START, None)] * 3 + [("j", START + dt.timedelta(seconds=10), 2)]
    df = spark.createDataFrame(rows, "_key string, ts timestamp_ntz, id int")
    got = D.keep_spaced(df, ["_key"], 10, parts=5, fan=2)
    assert got.columns == df.columns and flat([tuple(r) for r in got.collect()]) == flat([rows[0], rows[-1]])
    assert flat([tuple(r) for r in D.keep_spaced(df, [], 10, parts=5).collect()]) == flat([rows[0], rows[-1]])
    assert [r.id for r in D.keep_spaced(df, [], 11, parts=5).collect()] == [1]
    assert D.keep_spaced(df, ["_key"], 0).count() == len(rows)
    assert D.keep_spaced(df.limit(0), ["_key"], 10).collect() == []


def test_one_key_over_many_tasks_and_as_greedy_fold(spark):
    n = 200_000
    df = spark.range(n).selectExpr("id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id % 90000) AS ts", "'one' AS k")
    out = D.keep_spaced(df, ["k"], 45, parts=32, fan=4)
    plain = AL.cooldown(df, ["k"], 45)
    assert flat([tuple(r) for r in out.collect()]) == flat([tuple(r) for r in plain.select(*df.columns).collect()])
    rows = out.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(1 for r in rows if r) >= 24 and max(rows) < sum(rows) / 10


def test_composition_equals_one_node():
    rnd = np.random.default_rng(1)
    for _ in range(300):
        x = np.unique(rnd.integers(0, 500, rnd.integers(4, 120)))
        c = int(rnd.integers(1, 400))
        cuts = np.sort(rnd.choice(np.arange(1, len(x)), size=min(3, len(x) - 1), replace=False))
        nodes = [D.Node("k", "k", None, *D._steps(p, c)) for p in np.split(x, cuts)]
        whole = nodes[0]
        for node in nodes[1:]:
            whole = whole.then(node, c)
        for t in [None, *range(int(x[0]) - c - 3, int(x[0]))]:
            kept = D._kept(x, t, c)
            assert whole.leaves("k", t, c) == ("k", int(x[kept[-1]]) if kept else t)
