"""Repeated and null ids, clashing names and other odd tables; brute force for site rates and shard ranks."""

from __future__ import annotations

import json
import math
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from helpers import corpus, frame
from topicwatch import llm
from topicwatch.llm import jaccard_join, packing, quality, queries, sharding, tokens, training_order, warc

llm.load_all()
A, B = "one two three four five six seven eight", "an entirely different text with some other words in it"
NEAR = A + " nine"


def test_keep_one_tells_rows_apart_by_id_and_text(spark):
    schema = "doc_id string, text string, _gone string, component string, own int, _k1 string"
    rows = [("3", A), ("5", A), ("5", B), ("7", NEAR), ("2", B), ("2", B + " x y z a b c d e f g h i j k l m n o p q r s t u v w"),
            (None, A), (None, A), ("9", None), ("9", ""), ("8", "alone in the world here"), ("8", "alone in the world here")]
    df = frame(spark, [(*r, "g", "c", 1, "k") for r in rows], schema)
    kept = jaccard_join.keep_one(df, size=3, num=70)
    assert kept.columns == df.columns
    got = sorted([(r.doc_id, r.text) for r in kept.collect()], key=str)
    # 3 stays for A and NEAR, 2 for B though 5 has A and B, one of the two equal rows 8, all empty and null ids
    want = [("3", A), ("2", B), rows[5][:2], (None, A), (None, A), ("9", None), ("9", ""), ("8", "alone in the world here")]
    assert got == sorted([tuple(w[:2]) for w in want], key=str)


def test_components_of_rows_that_share_an_id(spark):
    rows = [(1, B), (4, A), (4, B), (6, NEAR)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(df, size=3, num=70).collect())
    assert got == sorted([(1, 8, 1), (4, 6, 4), (4, 8, 1), (6, 7, 4)])


def test_pages_with_odd_ids(spark, tmpdir_path):
    rows = [("a\nb%0A", "u", "<p>x</p>"), ("z\r\n", "u\nv", "<p>x</p>"), (None, None, None), ("", "", "y" * 70_000), ("a:b", "k", "q")]
    warc.write_warc(spark.createDataFrame(rows, "page_id string, url string, html string"), tmpdir_path + "/w")
    got = {r.page_id: r for r in warc.read_warc(spark, tmpdir_path + "/w").collect()}
    assert set(got) == {"a\nb%0A", "z\r\n", "", "a:b"} and all(r.valid for r in got.values())
    assert got["z\r\n"].record_type == "revisit" and got["z\r\n"].refers_to == "a\nb%0A"


def test_records_of_other_writers():
    head = b"WARC/1.0\r\nwarc-type:%b\r\nWARC-RECORD-ID: <x>\r\nContent-length:%d\r\n\r\n%b\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\n\r\nbody"
    data = b"".join(head % (k, len(block), block) for k in (b"warcinfo", b"request", b"Response"))
    rows = list(warc.parse_records(memoryview(data), False))
    assert [(r[2], r[-1]) for r in rows] == [("response", block)]


def test_pages_query_takes_null_ids(spark, tmpdir_path):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").limit(5)
    pages.unionByName(spark.createDataFrame([(None, None, "n"), (None, "u", None)], pages.schema)).write.parquet(tmpdir_path + "/pages.parquet")
    got = llm.QUERIES["op4_warc"](spark, tmpdir_path).collect()
    assert len(got) == 7 and sum(r.page_id is None for r in got) == 2


def test_equal_pieces_spread_over_groups(spark):
    rows = [(1, 0, 0, 30, 7, 5, "x", "y")] * 400
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                         "Sequence_id long, _group string, _place string").repartition(4)
    out = packing.pack(pieces, 100, group_pieces=20)
    assert sorted(out.columns) == sorted([c for c in pieces.columns if c != "Sequence_id"] + ["sequence_id", "offset"])
    got = out.collect()
    assert len(got) == 400 and {(r._group, r._place) for r in got} == {("x", "y")}
    groups: dict = {}
    for r in got:
        groups.setdefault(r.sequence_id >> 40, []).append(r)
    assert len(groups) > 12 and max(map(len, groups.values())) < 60
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r.offset)
    assert all(sorted(o) in ([0, 30, 60], [0, 30], [0]) for o in sequences.values())
    assert sum(len(o) < 3 for o in sequences.values()) <= len(groups)


def test_slotted_keeps_the_callers_columns(spark):
    df = spark.createDataFrame([(i, "t", "a", "b", 9) for i in range(50)], "id int, _task string, _at string, _before string, Slot int")
    out = training_order.slotted(df, 3)
    assert sorted(out.columns) == sorted(["id", "_task", "_at", "_before", "slot"])
    got = out.collect()
    assert sorted(r.slot for r in got) == list(range(50)) and {(r._task, r._at, r._before) for r in got} == {("t", "a", "b")}


def test_tokenizer_file_decides_its_own_path(spark):
    import public_tokenizers
    words, whole = (tokens.read_model(public_tokenizers.path(f)) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    assert tokens.splits_words(words) and not tokens.splits_words(whole)
    assert tokens.id_width(words) == tokens.id_width(whole) == 2
    larger = json.loads(words)
    larger["added_tokens"] = [{"id": 70_000}]
    assert tokens.id_width(json.dumps(larger)) == 4
    other = json.loads(words)
    other["normalizer"] = None
    assert not tokens.splits_words(json.dumps(other))
    text = "It's The  END, of_2024\n\nÀ l'été"
    from tokenizers import Tokenizer
    for model in (words, whole):
        ids = memoryview(tokens.TextTokenizer(model).ids(text)).cast("I").tolist()
        assert ids == Tokenizer.from_str(model).encode(text, add_special_tokens=False).ids
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.token_pieces(spark.createDataFrame([(1, text)], "doc_id long, text string"), path, end_id=None).collect()
    assert [r.length for r in got] == [len(Tokenizer.from_str(whole).encode(text, add_special_tokens=False).ids)]
    with pytest.raises(ValueError, match="2 bytes"):
        packing.token_pieces(spark.createDataFrame([(1, text)], "doc_id long, text string"), path, end_id=70_000, id_bytes=2)


def test_shards_of_null_and_repeated_ids(spark):
    rows = [(None if i % 2 else 7, f"t{i}", "a" if i % 3 else "b") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sharding.interleave(df, 8, bucket_rows=100).collect()
    assert sorted((r.text, r.doc_id) for r in got) == sorted([(t, i) for i, t, _ in rows], key=lambda x: x[0])
    for s in range(8):
        own = [r for r in got if r.shard == s]
        assert len(own) == 250 and sorted(r.slot for r in own) == list(range(250))
        assert abs(sum(r.source == "b" for r in own) - 667 / 8) <= 1.5


def test_shards_equal_fractional_ranks(spark):
    """Shard and slot recomputed from the hash alone."""
    df = frame(spark, corpus()).select("doc_id", "source", "n")
    hashed = df.select("doc_id", "source", F.xxhash64(F.lit(1), "doc_id", F.struct("doc_id", "n")).alias("u")).collect()
    by_source: dict = {}
    for r in hashed:
        by_source.setdefault(r.source, []).append((r.u, r.doc_id))
    ranked = []
    for source, own in by_source.items():
        ranked += [((k + 0.5) / len(own), u, i, "" if source is None else "=" + source) for k, (u, i) in enumerate(sorted(own))]
    want, at, n = {}, 0, len(ranked)
    order = [i for _, _, i, _ in sorted(ranked)]
    for s in range(8):
        size = n // 8 + (s < n % 8)
        want |= {i: (s, k) for k, i in enumerate(order[at:at + size])}
        at += size
    got = sharding.interleave(df, 8, carry=["doc_id", "n"]).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == want


def test_site_rates_equal_brute_force(spark):
    """Rates, fitted prior strengths and posteriors of ``site_posteriors`` in plain Python."""
    rows = [(f"h{i % 7 if i % 4 else 0}", f"p{i % 5 if i % 3 else 0}", math.sin(i) * 3 + (2 if i % 7 == 3 else 0)) for i in range(300)]
    rows.append(("single", "one", 1.5))
    got = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, evidence double")).collect()
    p = [1 / (1 + math.exp(-e)) for *_, e in rows]
    hosts, paths = {}, {}
    for (h, q, _), x in zip(rows, p):
        for d, k in ((hosts, h), (paths, (h, q))):
            b, n = d.get(k, (0.0, 0))
            d[k] = (b + x, n + 1)
    mu = sum(p) / len(p)

    def strength(groups):  # (bad, n, center)
        big = [(b / n, n, c) for b, n, c in groups if n > 1]
        v = sum(n * (r - c) ** 2 for r, n, c in big)
        within, m = sum(c * (1 - c) for _, _, c in big), sum((n - 1) * c * (1 - c) for _, n, c in big)
        between = (v - within) / m
        return min(1e6, max(1.0, 1 / between - 1)) if between > 0 else 1e6
    kh = strength([(b, n, mu) for b, n in hosts.values()])
    kp = strength([(b, n, (hosts[h][0] + kh * mu) / (hosts[h][1] + kh)) for (h, _), (b, n) in paths.items()])
    clip = lambda x: min(1 - 1e-6, max(1e-6, x))
    want = []
    for (h, q, e), x in zip(rows, p):
        host = clip((hosts[h][0] - x + kh * mu) / (hosts[h][1] - 1 + kh))
        path = clip((paths[h, q][0] - x + kp * host) / (paths[h, q][1] - 1 + kp))
        want.append((h, q, e, host, path, 1 / (1 + math.exp(-(e + math.log(path / (1 - path)) - math.log(mu / (1 - mu)))))))
    got = sorted((r.host, r.path, r.evidence, r.host_rate, r.path_rate, r.posterior) for r in got)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-9)


@pytest.mark.parametrize("name", sorted(set(llm.QUERIES) - set(llm.ORACLES), key=lambda q: int(re.match(r"op(\d+)", q)[1])))
def test_query_without_sql_runs(spark, name):
    """Every document comes back, with the columns of the contract."""
    out = llm.QUERIES[name](spark, SF_SMALL)
    docs = queries.table(spark, SF_SMALL, "documents")
    want = {"op1": ["doc_id", "posterior", "kept"], "op6": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
            "op7": ["doc_id", "n_shingles", "component_id"], "op8": ["doc_id", "slot", "shard", "byte_offset", "ids_crc32"],
            "op9": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            "op10": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]}[name.split("_")[0]]
    assert set(want) <= set(out.columns)
    got = [r.doc_id for r in out.select("doc_id").distinct().collect()]
    texts = docs.where("length(text) > 0") if name.startswith("op8") else docs
    assert sorted(got) == sorted(r.doc_id for r in texts.select("doc_id").collect())
