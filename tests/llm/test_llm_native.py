"""Content sort, line runs, stratified interleaving and containment search against brute force."""

from __future__ import annotations

import collections
import hashlib
import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from helpers import SCHEMA, corpus, frame, odd_rows  # noqa: E402

WS = re.compile("[\x20\x09-\x0d]+")


def no_python(df) -> bool:
    plan = df._jdf.queryExecution().toString()
    return not re.search("Python|Pandas|Arrow", plan)


def brute_groups(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[WS.sub("", r[1] or "")].append((r[0], r[1] or ""))
    out = []
    for norm, own in groups.items():
        best = min(own, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))
        for i, _ in own:
            out.append((i, best[0], len(own), hashlib.sha256(norm.encode()).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("hot", [0, 120])
def test_content_sort(spark, hot):
    """``hot``: a text with a third of all rows, which is salted."""
    from topicwatch.llm.exact_dedup import content_sort, keep_first
    rows = odd_rows(corpus()) + [(1000 + i, "hot  text" + " " * (i % 7), "a", "en", "", 0, "", "") for i in range(hot)]
    df = frame(spark, rows)
    out = content_sort(df)
    assert no_python(out)
    assert out.columns == ["doc_id", "text", "source", "lang", "n", "h", "_k1", "keep_id", "group_size", "kept", "text_sha256"]
    got = out.collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_groups(rows)
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    first = keep_first(df)
    assert first.columns == df.columns and first.count() == len(kept)


def brute_lines(rows, min_docs):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = collections.Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")})
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not key(x) or held[key(x)] < min_docs]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return collections.Counter(out)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (5, 3)])
def test_line_runs(spark, batches, fanout):
    from topicwatch.llm.line_dedup import drop_common_lines
    rows = odd_rows(corpus())
    out = drop_common_lines(frame(spark, rows), min_docs=3, batches=batches, fanout=fanout)
    assert no_python(out)
    got = collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out.collect())
    assert got == brute_lines(rows, 3)
    assert sum(n for (_, _, d, _), n in got.items() if d) > 10


def test_interleave(spark):
    from topicwatch.llm.sharding import interleave, write_shards
    rows = odd_rows(corpus(n=300))
    for bucket_rows in (100_000, 10):  # one ranking slice, and many
        out = interleave(frame(spark, rows), 8, bucket_rows=bucket_rows)
        assert no_python(out)
        got = out.collect()
        assert len(got) == len(rows)
        shards = collections.defaultdict(list)
        for r in got:
            shards[r.shard].append(r.slot)
        assert set(shards) == set(range(8))
        assert all(sorted(s) == list(range(len(s))) for s in shards.values())
        sizes = [len(s) for s in shards.values()]
        assert max(sizes) - min(sizes) <= 1
        for source, n in collections.Counter(r.source for r in got).items():
            mix = collections.Counter(r.shard for r in got if r.source == source)
            assert all(abs(mix[k] - n / 8) <= 2 for k in range(8)), (source, mix)
        assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in rows)
    from topicwatch.llm.common import scratch_path
    path = scratch_path(spark, "shards")
    write_shards(out, path)
    assert spark.read.parquet(path).count() == len(rows)


def test_interleave_small_and_stable(spark):
    from topicwatch.llm.sharding import interleave
    rows = corpus()[:5]
    got = interleave(frame(spark, rows), 8).collect()
    assert sorted(r.shard for r in got) == [0, 1, 2, 3, 4] and {r.slot for r in got} == {0}
    rows = corpus(n=100)
    place = lambda n: {r.doc_id: (r.shard, r.slot) for r in interleave(frame(spark, rows).repartition(n), 8).collect()}
    assert place(1) == place(5)


def brute_contained(docs, items, size=5, threshold=0.8):
    def words(t):
        return re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for i, t in items:
        w = words(t)
        if not w:
            continue
        m = min(size, len(w))
        own = {tuple(w[k:k + m]) for k in range(len(w) - m + 1)}
        for r in docs:
            d = words(r[1])
            both = own & {tuple(d[k:k + m]) for k in range(len(d) - m + 1)}
            if len(both) >= threshold * len(own):
                out[r[0], i] = (len(own), len(both))
    return out


def test_containment(spark):
    from topicwatch.llm.decontamination import contained_items, decontaminate
    rows = odd_rows(corpus())
    long = next(r[1] for r in rows if r[1] and len(r[1]) > 20_000).split(" ")
    items = [(0, " ".join(long[4000:4030]).upper()), (1, " ".join(long[100:112]) + "!"), (2, "changed"), (3, ""), (4, None),
             (5, "of the"), (6, rows[70][1]), (None, " ".join(long[7:40])), (8, "not in any text of these at all"),
             (9, " ".join(long[200:220] + ["other"] + long[220:240])), (10, " ".join(long[200:205])), (0, " ".join(long[4000:4030]).upper())]
    found = contained_items(frame(spark, rows), frame(spark, items, "item_id long, text string"))
    assert no_python(found)
    got = {(r.doc_id, r.item_id): (r.item_shingles, r.shared_shingles) for r in found.collect()}
    assert got == brute_contained(rows, items)
    assert len(got) > 10
    bad = {d for d, _ in got}
    kept = decontaminate(frame(spark, rows), frame(spark, items, "item_id long, text string"))
    assert kept.columns == frame(spark, rows).columns
    # a null id is matched by its text
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(
        r[0] for r in rows if r[0] not in bad or (r[0] is None and not brute_contained([r], items)))


def test_empty_tables(spark):
    from topicwatch.llm.decontamination import contained_items, decontaminate
    from topicwatch.llm.exact_dedup import content_sort, keep_first
    from topicwatch.llm.line_dedup import drop_common_lines
    from topicwatch.llm.sharding import interleave
    none, items = frame(spark, []), frame(spark, [], "item_id long, text string")
    some = frame(spark, corpus()[:4])
    for out in (content_sort(none), keep_first(none), drop_common_lines(none), interleave(none),
                contained_items(none, items), contained_items(some, items), decontaminate(none, items)):
        assert out.count() == 0
    assert decontaminate(some, items).count() == 4
    assert keep_first(none).schema == none.schema
    assert SCHEMA.split(",")[0] == "doc_id long"
