"""Merkle manifest, vector codes and URL filter against brute force, with every edge case."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import corpus, frame, odd_rows
from topicwatch.llm import merkle, url_filter, vector_codes

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def reduced(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([H(*low[i:i + 2]) for i in range(0, len(low), 2)])
    return levels


def walked(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    out = []
    for row in levels[:-1]:
        j = i ^ 1
        out.append(("-", "") if j >= len(row) else ("L" if j < i else "R", row[j]))
        i >>= 1
    return out


def brute_manifest(rows: list[dict], fields: list[str], changed, change) -> list[tuple]:
    """(id, leaf, subroot, root, proof, folded_root, verified) of every row."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*[enc(r[f]) for f in fields])
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    first = lambda x: (x is not None, x.encode() if isinstance(x, str) else x or 0)
    names = sorted(groups, key=first)
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (first(r["doc_id"]), leaf(r)))
        trees[g] = reduced([leaf(r) for r in groups[g]])
    top = reduced([trees[g][-1][0] for g in names])
    root, out = top[-1][0], []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = walked(trees[g], i) + walked(top, k)
            h = leaf(change(r)) if changed(r) else leaf(r)
            for side, other in path:
                h = H(h) if side == "-" else H(other, h) if side == "L" else H(h, other)
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], root, "".join(o for _, o in path), h, h == root))
    return out


SCHEMA = "doc_id long, text string, lang string, n long, g string, i string, h string, block string, m long"


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest_equals_brute_force(spark, levels):
    rnd = random.Random(3)
    rows = [(None if k % 29 == 0 else k // 2 if k % 7 == 0 else k, rnd.choice([None, "", "x" * 5000, f"té{k}"]),
             rnd.choice(["en", "en", "en", "de", None, "", "é", f"only{k}"]), rnd.choice([None, k]), "g", "i", "h", "b", 1)
            for k in range(120)]
    rows += [rows[5], rows[5], rows[9]]
    df = frame(spark, rows, SCHEMA).repartition(5)
    fields = ["doc_id", "lang", "n", "text"]
    got = merkle.merkle_manifest(df, fields, "doc_id", "lang", {"n": F.col("n") + 1}, F.col("doc_id") % 7 == 0, levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof", "sides", "folded_root", "verified"]
    named = [dict(zip(["doc_id", "text", "lang", "n"], r)) for r in rows]
    want = brute_manifest(named, fields, lambda r: r["doc_id"] is not None and r["doc_id"] % 7 == 0,
                          lambda r: {**r, "n": None if r["n"] is None else r["n"] + 1})
    key = lambda r: str(r)
    assert sorted([tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified")) for r in got.collect()],
                  key=key) == sorted(want, key=key)
    assert {r[-1] for r in want} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):
    one = frame(spark, [(1, "t", None, 2, "", "", "", "", 1)], SCHEMA)
    r = merkle.merkle_manifest(one, ["doc_id"], "doc_id", "lang").collect()
    assert len(r) == 1 and r[0].leaf == r[0].subroot == r[0].root == H("1:1") and r[0].proof == "" and r[0].verified
    assert merkle.merkle_manifest(one.limit(0), ["doc_id"], "doc_id", "lang").collect() == []


def test_versions_share_untouched_nodes():
    old = merkle.Tree([H(str(i)) for i in range(13)], 4)
    new = old.with_node(12, H("new"))
    assert new.levels is old.levels and len(new.own) == 5 and old.own == {}
    assert new.root == merkle.Tree([H(str(i)) for i in range(12)] + [H("new")], 4).root != old.root
    both = new.with_node(0, H("zero"))
    assert both.root == merkle.Tree([H("zero"), *[H(str(i)) for i in range(1, 12)], H("new")], 4).root
    assert len(both.own) == 9 and both.own[0, 12] == new.own[0, 12] and new.node(0, 0) == H("0")
    sides, siblings = new.path(12)
    assert merkle.folded(H("new"), sides, siblings) == new.root


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, lab, [math.floor(1024 * x) for x in v]) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], "<i4").tobytes()))
    width = len(kept[0][2]) // parts
    part = [[r[2][p * width:(p + 1) * width] for r in kept] for p in range(parts)]
    books = [[list(x) for x in part[p][:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own: dict[int, list] = {}
            for x in part[p]:
                own.setdefault(near(x, books[p])[1], []).append(x)
            for j, xs in own.items():
                books[p][j] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for k, (i, lab, _) in enumerate(kept):
        found = [near(part[p][k], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
    return out, books


VECTORS = "vec_id long, embedding array<float>, label int, id long, q string, code string"


def vectors(n=150, dim=8, seed=5):
    rnd = random.Random(seed)
    rows = [(k, [float(np.float32(rnd.gauss(k % 5, 0.3))) for _ in range(dim)], rnd.choice([0, 1, None])) for k in range(n)]
    rows += [(k + n, list(rows[k % 7][1]), 2) for k in range(40)]  # copies, so ties
    rows += [(5, rows[3][1], 1), (5, rows[3][1], 1), (None, rows[1][1], None), (None, [-0.5] * dim, 4)]
    bad = [(901, None, 1), (902, [1.0] * (dim - 1) + [None], 1), (903, [float("nan")] * dim, 0), (904, [float("inf")] * dim, None)]
    return rows, bad


@pytest.mark.parametrize("entries", [1, 7, 256])
def test_codes_equal_brute_force(spark, entries):
    rows, bad = vectors()
    df = frame(spark, [(*r, 1, "q", "c") for r in rows + bad], VECTORS).repartition(3)
    got, books = vector_codes.vector_codes(df, entries=entries)
    want, want_books = brute_codes(rows, entries=entries)
    assert books == want_books
    assert got.columns == ["vec_id", "label", "code", "error"]
    assert sorted(map(str, [tuple(r) for r in got.collect()])) == sorted(map(str, want))
    sums: dict = {}
    for _, lab, _, e in want:
        sums[lab] = sums.get(lab, 0) + e
    labelled = vector_codes.with_label_error(got).collect()
    assert len(labelled) == len(want) and {(r.label, r.label_error) for r in labelled} == set(sums.items())


def test_codes_of_odd_vectors(spark):
    rows, _ = vectors(20)
    odd = [(800, [1.0, 2.0], 1), (801, [], 1), (802, [1e30] * 8, 3)]
    df = lambda r: frame(spark, [(*x, 1, "q", "c") for x in r], VECTORS)
    got, books = vector_codes.vector_codes(df(rows + odd))
    found = {r.vec_id: r for r in got.collect()}
    assert all(found[i].code is None and found[i].error is None for i in (800, 801, 802))
    assert books == brute_codes(rows)[1]
    got, books = vector_codes.vector_codes(df(rows).limit(0))
    assert got.collect() == [] and books == [[]] * 4
    got, books = vector_codes.vector_codes(df([(1, [1.0, 2.0, 3.0], 1)]))  # 4 doesn't divide 3
    assert [r.code for r in got.collect()] == [None] and books == [[]] * 4


def test_cover_tree_covers_and_assigns_subtrees():
    rnd = np.random.default_rng(1)
    centers = rnd.integers(-4000, 4000, (9, 6))
    points = (centers[rnd.integers(0, 9, 1500)] + rnd.integers(-40, 40, (1500, 6))).astype(np.int32)
    points[:60] = points[0]
    tree = vector_codes.CoverTree.from_bytes(vector_codes.cover_tree(points).to_bytes())
    assert sorted(tree.order.tolist()) == list(range(1500))
    away = lambda a, b: np.sqrt(((a.astype(float) - b) ** 2).sum(-1))
    for i in range(len(tree.center)):
        own = points[tree.order[tree.start[i]:tree.end[i]]]
        assert away(own, points[tree.center[i]]).max() <= tree.radius[i] + 1e-6
        kids = np.arange(tree.child[i], tree.child[i + 1])
        if len(kids):
            assert tree.start[kids[0]] == tree.start[i] and tree.end[kids[-1]] == tree.end[i]
            assert tree.center[kids[0]] == tree.center[i]
            c = points[tree.center[kids]].astype(float)
            apart = away(c[:, None], c[None])[np.triu_indices(len(kids), 1)]
            assert (apart > tree.radius[i] / vector_codes.BASE - 1e-6).all()
            assert (tree.radius[kids] <= tree.radius[i] / vector_codes.BASE + 1e-6).all()
    for entries in (centers, points[rnd.integers(0, 1500, 256)]):
        start, end, entry = vector_codes.nearest(tree, points, entries.astype(np.int64))
        found = np.empty(1500, int)
        for a, b, e in zip(start, end, entry):
            found[tree.order[a:b]] = e
        assert (found == vector_codes.square_distances(points, entries).argmin(1)).all()
        assert (end - start).sum() == 1500
    # well-separated groups are assigned as whole subtrees
    assert len(vector_codes.nearest(tree, points, centers.astype(np.int64))[0]) < 100


def test_large_components_are_exact():
    points = np.array([[(1 << 26) - 1, -(1 << 26) + 1], [0, 1]], np.int32)
    entries = np.array([[-(1 << 26) + 1, (1 << 26) - 1], [3, 4]])
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, e)) for e in entries] for x in points]
    assert vector_codes.square_distances(points, entries).tolist() == want


URLS = "page_id long, url string, host string, path string, rate double, _row string, template string, bad int"


def urls(spark, rows):
    return frame(spark, [(i, u, "h", "p", 1.0, "r", "t", b) for i, (u, b) in enumerate(rows)], URLS)


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("b.org", "/x", "allow"), ("org", "/xyz", "block"), ("org", "/xyzz", "block"), ("dup.io", "/", "allow"), ("dup.io", "/", "block"), (None, "/", "block")]


def rules(spark):
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


JUDGED = [
    ("http://A.Example.COM/en/1?q=/es/", "a.example.com", "/en/1", "example.com/en/", "block"),
    ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://x.www.example.com/en/9#t", "x.www.example.com", "/en/9", "www.example.com/en/", "allow"),
    ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://example.com?x=/y", "example.com", "", None, "allow"),
    ("ftp://k.net/es/a\nb", "k.net", "/es/a\nb", "net/es/", "block"),
    ("http://k.net/es", "k.net", "/es", None, "allow"),
    ("http://b.org/xyzz", "b.org", "/xyzz", "org/xyzz", "block"),
    ("http://b.org/xyz", "b.org", "/xyz", "b.org/x", "allow"),  # as long as org/xyz, of a longer host
    ("http://b.org/xy", "b.org", "/xy", "b.org/x", "allow"),
    ("http://dup.io/", "dup.io", "/", "dup.io/", "block"),
    ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("://", "", "", None, "allow"),
    ("http://ÄB.de/É", "Äb.de", "/É", None, "allow"),
    ("http://a.com/" + "s/" * 5000, "a.com", "/" + "s/" * 5000, "com/", "allow"),
]


def test_rules(spark):
    r = url_filter.filter_urls(urls(spark, [(u, None) for u, *_ in JUDGED]), rules(spark), bad=F.col("bad")).collect()
    assert sorted([(x.url, x.host, x.path, x.rule, x.verdict) for x in r], key=str) == sorted(JUDGED, key=str)


def test_templates(spark):
    rows = [(f"http://s.org/news/{i}", 0) for i in range(60)] + [(f"http://s.org/spam/{i}.html", 1) for i in range(60)]
    rows += [(f"http://s.org/blog/{i}", 0) for i in range(60)]  # like news: merged with the rest
    rows += [(f"http://s.org/spam/new{i}", None) for i in range(5)] + [(f"http://s.org/news/new{i}", None) for i in range(5)]
    rows += [("http://s.org/rare/1/2/3/4/5/6", None), ("http://s.org/*/1", None), ("http://s.org", 0)]
    rows += [(f"http://all.org/same/{i}", None) for i in range(9)] + [("http://bad.org/a", 1), ("http://bad.org/b", 1)]
    df = urls(spark, rows)
    got = url_filter.filter_urls(df, rules(spark), bad=F.col("bad"))
    assert got.columns == ["page_id", "url", "bad", "host", "path", "rule", "template", "rate", "verdict"] or set(
        ["host", "path", "rule", "template", "rate", "verdict", "_row", "page_id", "url", "bad"]) <= set(got.columns)
    found = {r.url: r for r in got.collect()}
    assert len(found) == len({u for u, _ in rows})
    spam, news = found["http://s.org/spam/new1"], found["http://s.org/news/new1"]
    assert spam.template == "/spam/*" and spam.verdict == "block" and spam.rate > 0.8
    assert news.template.endswith("/*") and news.verdict == "allow" and news.rate < 0.1
    assert found["http://s.org/*/1"].template == "/*/*" and found["http://s.org/rare/1/2/3/4/5/6"].template.endswith("/**") is False
    assert found["http://all.org/same/3"].template == "/same/*"
    assert found["http://s.org"].template == ""
    assert found["http://bad.org/a"].rate < 0.6  # two rows hardly move a host
    assert url_filter.filter_urls(df.limit(0), rules(spark), bad=F.col("bad")).collect() == []
    none = url_filter.filter_urls(df, rules(spark).limit(0))
    assert {r.verdict for r in none.collect()} == {"allow"}


def test_manifest_takes_clashing_columns(spark):
    df = frame(spark, odd_rows(corpus()))
    got = merkle.merkle_manifest(df, ["doc_id", "text"], "doc_id", "lang")
    assert got.count() == df.count() and got.where("not verified").isEmpty()
