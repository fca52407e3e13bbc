"""Daily top values from hourly counts."""

from __future__ import annotations

import datetime as dt

from topicwatch.operators import trends as T

DAY = dt.datetime(2024, 1, 1)
KINDS = {"keywords": "k", "entities": "e"}


def test_tops_from_hours_and_loads(spark):
    rows = [("s", DAY.replace(hour=1), ["b", "a", "a"], ["X"]), ("s", DAY.replace(hour=23), ["c", "b", None], None),
            ("s", DAY + dt.timedelta(days=1), [], ["Y", "Y", "Z"]), (None, DAY, None, None), (None, DAY, ["n"], [])]
    docs = spark.createDataFrame(rows, "situation_id string, ts timestamp_ntz, k array<string>, e array<string>")
    hourly = T.hourly_values(docs, KINDS)
    assert sum(r.n for r in hourly.collect()) == 10
    got = {(r.situation_id, r.day.day): (r.top_keywords, r.top_entities) for r in T.daily_tops(hourly, list(KINDS), n=2).collect()}
    assert got == {("s", 1): ("a, b", "X"), ("s", 2): ("", "Y, Z"), (None, 1): ("n", "")}
    loads = T.hourly_values(docs.limit(0), KINDS).unionByName(hourly).unionByName(hourly)
    twice = {(r.situation_id, r.day.day): (r.top_keywords, r.top_entities) for r in T.daily_tops(loads, list(KINDS), n=2).collect()}
    assert twice == got
