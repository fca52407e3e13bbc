"""Tokens, packing, training order, WARC, classifier, joins, repeats: brute force and round trips."""

from __future__ import annotations

import collections
import hashlib
import os
import random
import re
import struct
import sys
import zlib

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

from helpers import corpus, frame, odd_rows  # noqa: E402


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer(vocabulary):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary)


ODD_TEXTS = ["", " ", "It's we'll ST'S 12 345 ¼² a_b __ x!!! naïve Ångström Straße İstanbul ſ Ωμ nb é \x1c\x85 日本語 😀",
             "<|endoftext|> <|startoftext|>", "ΑΣ ΣΑΣ", "ǅ ǆ ͅ", "tab\tnew\nline\r\x0b\x0c", "\x00\x01 ﻿"]


def test_word_lookup_equals_tokenizer(vocabulary, tokenizer):
    from topicwatch.llm.tokens import TextTokenizer, read_model
    fast = TextTokenizer(read_model(vocabulary), limit=20)  # the cache empties often
    rnd = random.Random(3)
    letters = "abcxyzABCÀÉßñœŠžĲƀǅ'’.,;-_ 019²¼\n\t "
    texts = ODD_TEXTS + [t for _, t, *_ in corpus() if t] + [
        "".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(400)]
    for t in texts:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert fast.ids(t) == struct.pack(f"<{len(ids)}I", *ids), t


def brute_pieces(rows, tokenizer, length):
    out = collections.Counter()
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), length)):
            part = ids[at:at + length]
            out[r[0], n, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    return out


@pytest.mark.parametrize("group_pieces", [50_000, 20])
def test_packing(spark, vocabulary, tokenizer, group_pieces):
    from topicwatch.llm.packing import pack, token_pieces
    rows = odd_rows(corpus() + [(500 + i, t, "a", "en", "", 0, "", "") for i, t in enumerate(ODD_TEXTS)])
    got = pack(token_pieces(frame(spark, rows), vocabulary, 128), 128, group_pieces).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == brute_pieces(rows, tokenizer, 128)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():  # gapless, within the length
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 128
    total = sum(r.length for r in got)
    if group_pieces > 1000:
        assert len(bins) <= -(-total // 128) * 11 / 9 + 1


def test_best_fit_is_best_fit():
    """Each piece goes to the fullest bin that has room."""
    from topicwatch.llm.packing import BestFit
    rnd = random.Random(5)
    for capacity in (1, 7, 64, 2048):
        bins, rooms = BestFit(capacity), []
        for _ in range(600):
            size = rnd.randint(1, capacity)
            fitting = [x for x in rooms if x >= size]
            number, offset = bins.place(size)
            if fitting:
                assert rooms[number] == min(fitting) and offset == capacity - rooms[number]
                rooms[number] -= size
            else:
                assert (number, offset) == (len(rooms), 0)
                rooms.append(capacity - size)


def test_feistel_is_a_permutation():
    import numpy as np
    from topicwatch.llm.training_order import Feistel
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        slots = Feistel(n, 7)(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n))
        assert n < 16 or slots.tolist() != list(range(n))
        assert Feistel(n, 7)(np.arange(n)).tolist() == slots.tolist()
        assert n < 100 or Feistel(n, 8)(np.arange(n)).tolist() != slots.tolist()


def test_training_order_round_trip(spark, vocabulary, tokenizer):
    from topicwatch.llm.common import scratch_path
    from topicwatch.llm.training_order import training_order
    rows = odd_rows(corpus())
    path, length, shard_rows = scratch_path(spark, "t"), 32, 50
    got = training_order(frame(spark, rows), vocabulary, length, shard_rows=shard_rows, path=path).collect()
    want = collections.Counter()
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids
        for n, at in enumerate(range(0, len(ids), length - 1)):
            part = ids[at:at + length - 1]
            want[r[0], n, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert all(r.shard == r.slot // shard_rows and r.byte_offset == r.slot % shard_rows * length * 2 for r in got)
    local = path.removeprefix("file:")
    for shard in range(-(-len(got) // shard_rows)):  # each shard is one file of whole records
        files = [f for f in os.listdir(f"{local}/shard={shard}") if f.startswith("part-")]
        assert len(files) == 1
        n = min(shard_rows, len(got) - shard * shard_rows)
        assert os.path.getsize(f"{local}/shard={shard}/{files[0]}") == n * length * 2
    assert training_order(frame(spark, []), vocabulary).count() == 0


def test_training_shards_resume(spark, vocabulary):
    """A read that starts or stops in mid-shard is that part of the full read; other shards aren't opened."""
    from topicwatch.llm.common import scratch_path
    from topicwatch.llm.training_order import read_training_shards, training_order
    path, length, shard_rows = scratch_path(spark, "t"), 32, 50
    n = training_order(frame(spark, corpus()), vocabulary, length, shard_rows=shard_rows, path=path).count()
    assert n > 3 * shard_rows
    read = lambda *part: [(r.slot, bytes(r.record)) for r in read_training_shards(spark, path, length, shard_rows, 2, *part)
                          .orderBy("slot").collect()]
    whole = read()
    assert [s for s, _ in whole] == list(range(n)) and all(len(x) == 2 * length for _, x in whole)
    for first, count in [(0, None), (70, None), (50, 50), (70, 5), (70, 60), (49, 2), (n - 1, 10), (n, None), (3, 0)]:
        assert read(first, count) == whole[first:None if count is None else first + count], (first, count)
    some = read_training_shards(spark, path, length, shard_rows, 2, 70, 60)
    assert {f.split("shard=")[1].split("/")[0] for f in some.inputFiles()} >= {"1", "2"}
    assert some._jdf.queryExecution().executedPlan().toString().count("PartitionFilters: [isnotnull(shard") == 1


PAGES = "page_id long, url string, html string, valid string"


def test_warc_round_trip(spark):
    from topicwatch.llm.common import scratch_path
    from topicwatch.llm.warc import read_warc, write_warc
    rnd = random.Random(2)
    html = ["", None, "x", "é" * 5000, "\r\n\r\nWARC/1.1\r\n\r\n0\r\n\r\n", "".join(rnd.choice("abc \r\n") for _ in range(70_000))]
    rows = [(i, rnd.choice(["http://a/é", None, "b\r\nc"]), h, "v") for i, h in enumerate(html * 3)]
    rnd.shuffle(rows)
    rows += [rows[0], (None, None, "null id", None), (None, None, "x", None)]
    path = scratch_path(spark, "w")
    write_warc(frame(spark, rows, PAGES), path, segment_bytes=1000, chunk_bytes=300, records_per_file=7)
    got = read_warc(spark, path).collect()
    body = lambda r: (r[2] or "").encode()
    first: dict[bytes, int] = {}
    for r in rows:
        if r[0] is not None:
            first[body(r)] = min(first.get(body(r), r[0]), r[0])
    import base64
    want = collections.Counter()
    for r in rows:
        one = first.get(body(r), r[0]) if r[0] is not None else None
        revisit = r[0] is not None and one != r[0]
        want["" if r[0] is None else str(r[0]), len(body(r)), base64.b32encode(hashlib.sha1(body(r)).digest()).decode(),
             "revisit" if revisit else "response", str(one) if revisit else None] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(r.valid for r in got)
    assert all(r.payload is None if r.record_type == "revisit" else len(r.payload) == r.payload_bytes for r in got)
    empty = scratch_path(spark, "w")
    write_warc(frame(spark, [], PAGES), empty)
    assert read_warc(spark, empty).count() == 0


def test_warc_incomplete_record_is_reported(spark):
    from topicwatch.llm.common import scratch_path
    from topicwatch.llm.warc import archive_records, reassembled, unchunked, write_warc
    path = scratch_path(spark, "w")
    write_warc(frame(spark, [(1, "u", "y" * 5000, "")], PAGES), path, segment_bytes=1000)
    parts = archive_records(spark, path, True)
    assert parts.count() == 6 and reassembled(parts).first().block is not None
    assert reassembled(parts.where("segment <> 3")).first().block is None
    assert reassembled(parts.where("segment <> 6")).first().block is None
    assert unchunked(b"3;x=1\r\nabc\r\n2\r\nde\r\n0\r\nT: 1\r\n\r\n") == b"abcde"
    with pytest.raises(ValueError):
        unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def brute_components(rows, k, num, den):
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        m = min(k, len(w))
        sets[r[0]] = {tuple(w[j:j + m]) for j in range(len(w) - m + 1)} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and both and den * both >= num * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((top(x), top(y)))
                up[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("k,num,frequent", [(3, 90, 256), (5, 80, 256), (3, 50, 2)])
def test_jaccard_components(spark, monkeypatch, k, num, frequent):
    """``frequent``: with a low bound most shared shingles go last in the prefixes."""
    from topicwatch.llm import jaccard_join
    monkeypatch.setattr(jaccard_join, "FREQUENT_ROWS", frequent)
    rows = corpus(n=50)
    rnd = random.Random(9)
    base = next(r[1] for r in rows if r[1] and 60 < len(r[1].split()) < 300).split()
    for i in range(30):  # a group of near copies
        words = list(base)
        for _ in range(1 + i % 3):
            words[rnd.randrange(len(words))] = f"w{i}"
        rows.append((2000 + i, " ".join(words), "a", "en", "", 0, "", ""))
    want = brute_components(rows, k, num, 100)
    got = jaccard_join.jaccard_components(frame(spark, [*rows, rows[3], (None, base[0], None, None, None, None, None, None)]),
                                          size=k, num=num).collect()
    assert len(got) == len(rows) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert any(c != i for i, (_, c) in want.items())
    kept = jaccard_join.keep_one(frame(spark, rows), size=k, num=num)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i)


@pytest.mark.parametrize("k,num,frequent", [(3, 90, 256), (5, 60, 2)])
def test_jaccard_links(spark, monkeypatch, k, num, frequent):
    """Every linked pair of classes, those inside one component too, and every row's class."""
    from topicwatch.llm import jaccard_join
    monkeypatch.setattr(jaccard_join, "FREQUENT_ROWS", frequent)
    rows = corpus(n=40)
    rnd = random.Random(9)
    base = next(r[1] for r in rows if r[1] and 60 < len(r[1].split()) < 300).split()
    for i in range(12):
        words = list(base)
        words[rnd.randrange(len(words))] = f"w{i}"
        rows.append((2000 + i, " ".join(words), "a", "en", "", 0, "", ""))
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    sets = {}
    for r in rows:
        w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", lower(r[1])) if x]
        sets[r[0]] = frozenset(tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    first: dict[frozenset, int] = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    reps = sorted(i for s, i in first.items() if s)
    want = {(a, b) for a in reps for b in reps if a < b
            and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}
    links, members = jaccard_join.jaccard_links(frame(spark, [*rows, (None, base[0], None, None, None, None, None, None)]), size=k, num=num)
    assert sorted(tuple(r) for r in links.collect()) == sorted(want) and len(want) > 12
    got = members.collect()
    assert len(got) == len(rows) + 1
    assert {r.doc_id: (r.n_shingles, r.class_id) for r in got} == {
        **{i: (len(s), first[s] if s else None) for i, s in sets.items()}, None: (1, None)}


def test_jaccard_without_links(spark):
    from topicwatch.llm.jaccard_join import jaccard_components, keep_one
    assert jaccard_components(frame(spark, [])).count() == 0
    assert keep_one(frame(spark, [])).count() == 0
    rows = [(1, "a b c d e", "", "", "", 0, "", ""), (2, "f g h i j", "", "", "", 0, "", ""), (3, None, "", "", "", 0, "", "")]
    assert {tuple(r) for r in jaccard_components(frame(spark, rows)).collect()} == {(1, 3, 1), (2, 3, 2), (3, 0, 3)}


def test_components(spark):
    from topicwatch.llm.components import components
    rnd = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(90), rnd.randrange(90)) for _ in range(50)] + [(7, 7), (200, 300), (300, 250)]
    up = {x: x for e in links for x in e}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == {i: top(i) for i in up}


def brute_repeats(rows, length):
    first: dict[bytes, int] = {}
    key = lambda i: (1 << 63) - 1 if i is None else i
    for r in rows:
        raw = (r[1] or "").encode()
        for j in range(len(raw) - length + 1):
            s = raw[j:j + length]
            first[s] = min(first.get(s, key(r[0])), key(r[0]))
    out = collections.Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        gone = [False] * len(raw)
        for j in range(len(raw) - length + 1):
            if first[raw[j:j + length]] < key(r[0]):
                gone[j:j + length] = [True] * length
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out[r[0], len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g)] += 1
    return out


@pytest.mark.parametrize("length,key_segments", [(50, 20_000), (50, 1), (12, 20_000), (5, 20_000)])
def test_repeats_removed(spark, length, key_segments):
    """``key_segments`` 1: keys with several segments are grouped window by window."""
    from topicwatch.llm.suffix_dedup import remove_repeats
    rows = odd_rows([r for r in corpus(seed=length, n=40) if len(r[1] or "") < 5000])
    out = remove_repeats(frame(spark, rows), length, key_segments=key_segments, bucket_bytes=5_000)
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in out.collect())
    assert got == brute_repeats(rows, length)
    assert sum(1 for g in got if g[2]) > 10
    assert remove_repeats(frame(spark, [])).count() == 0


def test_interval_expansion_marks_every_shorter_prefix():
    import numpy as np
    from topicwatch.llm.suffix_dedup import repeats
    rnd = random.Random(8)
    for length in (1, 3, 8, 9, 20, 50):
        for letters in (b"a", b"ab", bytes(range(97, 123))):
            parts = [bytes(rnd.choice(letters) for _ in range(rnd.randrange(1, 120))) for _ in range(30)]
            parts += parts[:5] + [parts[0] + parts[1]]
            raw = b"".join(p + b"\xff" for p in parts)
            order, first = repeats(np.frombuffer(raw, np.uint8), length)
            assert sorted(order.tolist()) == list(range(len(raw)))
            groups, group = {}, -1
            for at, new in zip(order.tolist(), first):
                group += new
                s = raw[at:at + length]
                if len(s) == length and b"\xff" not in s:
                    assert groups.setdefault(s, group) == group
            assert len(set(groups.values())) == len(groups)


@pytest.mark.parametrize("length", [3, 12, 50])
def test_segments_of_many_texts(length, monkeypatch):
    """Texts that are hashed together have the windows and keys they have alone."""
    from topicwatch.llm import suffix_dedup as S
    rnd = random.Random(length)
    raws = [bytes(rnd.choice(b"abc") for _ in range(rnd.choice([0, 1, length - 1, length, rnd.randrange(300)]))) for _ in range(60)]
    raws += [b"a" * 1000, b"", raws[0]]
    for most in (1, 200, 1 << 17):
        monkeypatch.setattr(S, "HASH_BYTES", most)
        number, key, start, size = S.segments_of_all(raws, length)
        keys = [S.window_keys(r, length) for r in raws]
        covered = collections.Counter()
        for i, k, a, n in zip(number.tolist(), key, start.tolist(), size.tolist()):
            assert 0 < n <= S.SEGMENT_WINDOWS and (keys[i][a:a + n] == k).all()
            covered.update((i, j) for j in range(a, a + n))
        assert covered == collections.Counter((i, j) for i, k in enumerate(keys) for j in range(len(k)))
        assert number.tolist() == sorted(number.tolist())


@pytest.mark.parametrize("hosts", [1, 40])
def test_site_posteriors(spark, hosts):
    """Against the formulas; a site of one document falls back to its host and the corpus."""
    import math
    from topicwatch.llm.quality import site_posteriors
    rnd = random.Random(6)
    rows = [(i, f"h{rnd.randrange(hosts)}", f"p{rnd.randrange(3)}", rnd.gauss(-2, 2)) for i in range(500)] + [(500, "alone", "p", -1.0)]
    got = {r.id: r for r in site_posteriors(spark.createDataFrame(rows, "id long, host string, path string, evidence double")).collect()}
    assert len(got) == 501
    p = {i: 1 / (1 + math.exp(-e)) for i, _, _, e in rows}
    mu = sum(p.values()) / len(p)
    assert abs(got[500].host_rate - mu) < 1e-9 and abs(got[500].path_rate - mu) < 1e-9
    for r in got.values():
        assert 0 < r.path_rate < 1
        logit = lambda x: math.log(x / (1 - x))
        assert abs(logit(r.posterior) - (r.evidence + logit(r.path_rate) - logit(mu))) < 1e-6


def test_classifier_held_out(spark):
    """Fitted on four fifths of the labels, held against the rest."""
    from topicwatch.llm.quality import classify
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = classify(docs, labels.where("doc_id % 5 <> 0"))
    assert scored.count() == docs.count()
    rest = scored.join(labels.where("doc_id % 5 = 0"), "doc_id").selectExpr(
        "kept", "quality = 0 as low", "toxic = 1 as toxic").collect()
    good = [r for r in rest if not r.low and not r.toxic]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    for kind in ("low", "toxic"):
        bad = [r for r in rest if r[kind]]
        assert len(bad) > 50 and sum(not r.kept for r in bad) >= 0.9 * len(bad), kind


def test_classifier_every_language(spark):
    """Fitted on four fifths of the labels: toxic documents go in small languages too."""
    from topicwatch.llm.quality import classify, recall
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rest = labels.where("doc_id % 5 = 1")
    out = classify(docs, labels.where("doc_id % 5 <> 1"))
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    kept = {r.doc_id: r.kept for r in out.select("doc_id", "kept").collect()}
    want = collections.Counter()
    for r in rest.collect():
        kinds = ["low"] * (r.quality == 0) + ["toxic"] * (r.toxic == 1) or ["clean"]
        want.update((lang[r.doc_id], k, x) for k in kinds for x in ["labelled"] + ["rejected"] * (not kept[r.doc_id]))
    got = {(r.lang, r.kind): (r.labelled, r.rejected) for r in recall(out, docs, rest).collect()}
    assert got == {(g, k): (want[g, k, "labelled"], want[g, k, "rejected"]) for g, k, _ in want}
    for g in set(lang.values()):
        n, rejected = got[g, "toxic"]
        assert rejected >= 0.85 * n, (g, n, rejected)
    # four times the limit that the cuts keep on the fitted rows: 617 clean ones here, 3 expected
    assert sum(got[g, "clean"][1] for g in set(lang.values())) <= 0.02 * sum(got[g, "clean"][0] for g in set(lang.values()))


def test_held_out_cuts():
    """At most the stated share of clean rows goes, and no more bad rows stay than that asks for."""
    from topicwatch.llm.quality import KINDS, held_out_cuts
    rnd = random.Random(8)
    rows = [(0, 0, rnd.gauss(-4, 1.5), rnd.gauss(-4, 1.5)) for _ in range(2000)]
    rows += [(1, 0, rnd.gauss(4, 2), rnd.gauss(-4, 1)) for _ in range(200)] + [(None, 1, rnd.gauss(-4, 1), rnd.gauss(1, 2)) for _ in range(200)]
    cuts = held_out_cuts(rows, KINDS, 0.01)
    gone = [r for r in rows if r[2] >= cuts["low"] or r[3] >= cuts["toxic"]]
    lost = [r for r in gone if r[:2] == (0, 0)]
    assert 10 <= len(lost) <= 20
    caught = sum(r[1] == 1 for r in gone)
    assert caught > sum(r[1] == 1 and r[3] >= 0 for r in rows)
    apart = [(0, 0, -9.0, -3.0), (0, 1, -9.0, -1.0), (1, 0, 2.0, -8.0)]
    assert held_out_cuts(apart, KINDS) == {"low": -3.5, "toxic": -2.0}
    assert held_out_cuts([], ("low",)) == {"low": 0.0, "toxic": float("inf")}
    assert held_out_cuts([(0, 0, None, None), (1, 0, None, None)], ("low",)) == {"low": 0.0, "toxic": float("inf")}


def test_classifier_edges(spark):
    from topicwatch.llm.quality import classify, keep_good
    rows = odd_rows(corpus())
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)] + [(None, 0, 0), (3, None, None), (5, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    out = classify(frame(spark, rows), labels)
    assert collections.Counter(r.doc_id for r in out.collect()) == collections.Counter(r[0] for r in rows)
    kept = keep_good(frame(spark, rows), labels)
    assert kept.columns == frame(spark, rows).columns and kept.count() == out.where("kept").count()
    none = labels.where("false")
    assert classify(frame(spark, rows), none).where("kept").count() == len(rows)
    assert classify(frame(spark, []), labels).count() == 0
    assert keep_good(frame(spark, []), none).count() == 0


def test_word_cache_of_the_classifier_is_small():
    """A task's cache of words stays below 12 MB, however many words its texts have."""
    import tracemalloc

    from topicwatch.llm.quality import STATS, Model
    score = Model({"a": (0.1, 0.1)}, [(0.0, 0.0)] * len(STATS), [0.0] * len(STATS), [1.0] * len(STATS), (0.0, 0.0), ("low",)).scorer()
    tracemalloc.start()
    for at in range(0, 150_000, 1000):
        score(" ".join(f"word{i}" for i in range(at, at + 1000)))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 12e6, held


def test_features_are_counted_in_blocks(monkeypatch):
    """Features of a large batch are counted a block of rows at a time, with the rows' labels, and scored as by their names."""
    import pyarrow as pa

    from topicwatch.llm import quality
    monkeypatch.setattr(quality, "FIT_BLOCK", 16)
    rows = [(r[1] or "", (1, 0, None)[i % 3], i % 2, i % 5) for i, r in enumerate(corpus())]
    names = lambda w: [w, *[f"{w[:n]}~" for n in quality.PREFIXES if len(w) > n]] if w else []
    own = [{f for w in text.lower().split() for f in names(w.strip(quality.STRIPPED))} for text, *_ in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["text", "low", "toxic", "fold"])
    out = list(quality.counted_features(iter([batch])))
    assert len(out) >= len(rows) // 16 and max(b.num_rows for b in out) <= max(sum(map(len, own[i:i + 16])) for i in range(0, len(rows), 16))
    found = collections.Counter()
    for b in out:
        found.update({tuple(r.values())[:4]: 0 for r in b.to_pylist()})
        for r in b.to_pylist():
            found[tuple(r.values())[:4]] += r["n"]
    assert found == collections.Counter((f, *labels) for fs, (_, *labels) in zip(own, rows) for f in fs)
    weights = {f: (1.0, 2.0) for f in sorted(set().union(*own))[::3]}
    zeros = [0.0] * len(quality.STATS)
    score = quality.Model(weights, [(0.0, 0.0)] * len(zeros), zeros, [1.0] * len(zeros), (0.0, 0.0), quality.KINDS).scorer()
    assert [score(r[0]) for r in rows] == [(float(n), 2.0 * n) for n in (len(fs & weights.keys()) for fs in own)]


def test_forgotten_tokenizer_frees_memory():
    """A worker that drops its tokenizer gives the memory of freed texts back to the system."""
    import subprocess
    import sys
    code = """
from topicwatch.llm import tokens
rss = lambda: int([x for x in open("/proc/self/status") if x.startswith("VmRSS")][0].split()[1]) >> 10
tokens._LOADED[1] = None
texts = [chr(65 + i % 26) * 2000 for i in range(100_000)]
held, last = rss(), texts[-1]
del texts
tokens.forget()
assert not tokens._LOADED and rss() < held - 150, (held, rss())
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def test_classifier_uses_every_label(spark):
    """Toxic documents whose ids have the largest hashes, past the 20,000 that a fit once saw, are learnt from."""
    from topicwatch.llm.quality import classify
    n = 20_400
    ids = spark.range(n).selectExpr("id", "row_number() over (order by xxhash64(id) desc) <= 200 as bad")
    docs = ids.selectExpr("id as doc_id", "concat('plain text number ', id % 50, if(bad, ' vile scum', ' kind words')) as text", "'en' as lang", "'a' as source")
    labels = ids.selectExpr("id as doc_id", "1 as quality", "int(bad) as toxic")
    out = classify(docs, labels).join(ids, F.col("doc_id") == F.col("id"))
    assert {(r.bad, r.kept): r["count"] for r in out.groupBy("bad", "kept").count().collect()} == {(True, False): 200, (False, True): n - 200}


@pytest.mark.parametrize("ranked,digits", [(50, 9), (20, 1)])
def test_cuts_of_a_table(spark, monkeypatch, ranked, digits):
    """The cuts of a table equal those of the rows in memory, equal scores too."""
    from topicwatch.llm import quality
    monkeypatch.setattr(quality, "RANKED_ROWS", ranked)
    rnd = random.Random(5)
    rows = [(0, 0, rnd.gauss(-4, 1.5), rnd.gauss(-4, 1.5)) for _ in range(900)]
    rows += [(1, 0, rnd.gauss(2, 2), rnd.gauss(-4, 1)) for _ in range(80)] + [(None, 1, rnd.gauss(-4, 1), rnd.gauss(1, 2)) for _ in range(80)]
    rows = [(a, b, round(x, digits), round(y, digits)) for a, b, x, y in rows]
    schema = "_low int, _toxic int, low double, toxic double"
    for some, lost in ((rows, 0.4), (rows[:900], 0.01), (rows[900:], 0.01), ([], 0.01), ([*rows, (0, 0, None, 0.0)], 0.01)):
        got = quality.spread_cuts(spark.createDataFrame(some, schema), quality.KINDS, lost)
        assert got == pytest.approx(quality.held_out_cuts(some, quality.KINDS, lost)), (len(some), lost)


def test_sparse_groups_cost_their_size(spark, monkeypatch):
    """800 texts, each with one word of 100 changed, link only if the words lie within two places: their pairs are not all compared."""
    from topicwatch.llm import jaccard_join
    compared = []
    linked = jaccard_join.linked
    monkeypatch.setattr(jaccard_join, "linked", lambda pairs, *a: compared.append(pairs.count()) or linked(pairs, *a))
    rows = []
    for i in range(800):
        words = [f"word{j}" for j in range(100)]
        words[i * 7 % 100] = f"own{i}"
        rows.append((i, " ".join(words)))
    out = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), size=3, num=90)
    assert {(r.n_shingles, r.component_id) for r in out.collect()} == {(98, 0)} and out.count() == 800
    assert sum(compared) < 30_000, compared  # all links are over 50,000
