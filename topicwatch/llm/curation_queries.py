"""Registered queries of the Merkle manifest, the vector codes and the URL filter, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import register
from .merkle import merkle_manifest
from .queries import table
from .url_filter import DEPTH, DEVIATIONS, MIN_LABELLED, MIN_ROWS, REJECTED, STRENGTH, filter_urls, path_of
from .vector_codes import codebooks_digest, vector_codes, with_label_error

#: Unsigned CRC-32 of the decimal id: a byte is put in, then eight shifts (marked -1) follow.
CRC32 = """xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split(doc_id::VARCHAR, ''),
  lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda r, b: CASE WHEN b >= 0 THEN xor(r, b) WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END))"""


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


_LEAF = "sha256({})".format(" || ".join(_field(c) for c in ("doc_id", "source", "lang", "{n}", "text")))

MERKLE_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, {_LEAF.format(n='n_chars')} AS leaf,
         CASE WHEN {CRC32} % 7 = 0 THEN {_LEAF.format(n='(n_chars + 1)')} ELSE {_LEAF.format(n='n_chars')} END AS changed
  FROM documents),
up AS (
  SELECT lang, 0 AS lvl, i, count(*) OVER (PARTITION BY lang) AS m, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, any_value(lvl) + 1, i // 2, (any_value(m) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE m > 1 GROUP BY lang, i // 2),
sub AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, h FROM up WHERE m = 1),
top AS (
  SELECT 0 AS lvl, g AS i, count(*) OVER () AS m, h FROM sub
  UNION ALL
  SELECT any_value(lvl) + 1, i // 2, (any_value(m) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE m > 1 GROUP BY i // 2),
sib AS (
  SELECT l.doc_id, u.lvl, u.h FROM leaves l JOIN up u ON u.lang IS NOT DISTINCT FROM l.lang AND u.m > 1 AND u.i = xor(l.i >> u.lvl, 1)
  UNION ALL
  SELECT l.doc_id, 1000 + t.lvl, t.h FROM leaves l JOIN sub s ON s.lang IS NOT DISTINCT FROM l.lang
  JOIN top t ON t.m > 1 AND t.i = xor(s.g >> t.lvl, 1)),
proof AS (SELECT doc_id, string_agg(h, '' ORDER BY lvl) AS p FROM sib GROUP BY doc_id),
fold AS (
  SELECT l.doc_id, l.lang, 0 AS lvl, l.i, u.m, l.changed AS h FROM leaves l JOIN up u ON u.lvl = 0 AND u.lang IS NOT DISTINCT FROM l.lang AND u.i = l.i
  UNION ALL
  SELECT f.doc_id, f.lang, f.lvl + 1, f.i // 2, (f.m + 1) // 2,
         sha256(CASE WHEN u.h IS NULL THEN f.h WHEN f.i % 2 = 0 THEN f.h || u.h ELSE u.h || f.h END)
  FROM fold f LEFT JOIN up u ON u.lang IS NOT DISTINCT FROM f.lang AND u.lvl = f.lvl AND u.i = xor(f.i, 1) WHERE f.m > 1),
rise AS (
  SELECT f.doc_id, 0 AS lvl, s.g AS i, (SELECT count(*) FROM sub) AS m, f.h FROM fold f JOIN sub s ON s.lang IS NOT DISTINCT FROM f.lang WHERE f.m = 1
  UNION ALL
  SELECT f.doc_id, f.lvl + 1, f.i // 2, (f.m + 1) // 2,
         sha256(CASE WHEN t.h IS NULL THEN f.h WHEN f.i % 2 = 0 THEN f.h || t.h ELSE t.h || f.h END)
  FROM rise f LEFT JOIN top t ON t.lvl = f.lvl AND t.i = xor(f.i, 1) WHERE f.m > 1),
root AS (SELECT h FROM top WHERE m = 1)
SELECT l.doc_id, l.leaf, s.h AS subroot, root.h AS root, sha256(coalesce(p.p, '')) AS proof_sha256, r.h AS folded_root, r.h = root.h AS verified
FROM leaves l JOIN sub s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN root JOIN rise r ON r.doc_id = l.doc_id AND r.m = 1
LEFT JOIN proof p ON p.doc_id = l.doc_id
"""


@register("op11_merkle_manifest", MERKLE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof under the root over languages, and the root that a seventh of the leaves, tampered, would give."""
    docs = table(spark, sf_dir, "documents")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = merkle_manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang",
                          {"n_chars": F.col("n_chars") + 1}, changed)
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def codes_sql(rounds: int = 4, entries: int = 256, parts: int = 4) -> str:
    away = "list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, e.x) + list_inner_product(e.x, e.x)"
    assign = ("a{r} AS (SELECT v.vec_id, v.p, arg_min(e.entry, ({d}) * 256 + e.entry) AS entry, min({d}) AS d "
              "FROM part v JOIN e{r} e ON e.p = v.p GROUP BY v.vec_id, v.p)")
    update = ("n{s} AS (SELECT p, entry, list(m ORDER BY pos) AS x FROM (SELECT a.p, a.entry, pos, floor(sum(c) / count(*)) AS m FROM ("
              "SELECT vec_id, p, unnest(x) AS c, generate_subscripts(x, 1) AS pos FROM part) v JOIN a{r} a USING (vec_id, p) "
              "GROUP BY a.p, a.entry, pos) GROUP BY p, entry),\n"
              "e{s} AS MATERIALIZED (SELECT e.p, e.entry, coalesce(n.x, e.x) AS x FROM e{r} e LEFT JOIN n{s} n ON n.p = e.p AND n.entry = e.entry)")
    steps = []
    for r in range(rounds):
        steps += [assign.format(r=r, d=away), update.format(r=r, s=r + 1)]
    steps.append(assign.format(r=rounds, d=away))
    body = ",\n".join(steps)
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (
  SELECT vec_id, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) t(p)),
e0 AS MATERIALIZED (
  SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, x FROM part
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})),
{body},
books AS (
  SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY p, entry, pos)) AS codebooks_sha256
  FROM (SELECT p, entry, unnest(x) AS c, generate_subscripts(x, 1) AS pos FROM e{rounds})),
code AS (
  SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM code JOIN kept USING (vec_id) CROSS JOIN books
"""


@register("op12_vector_codes", codes_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code of four bytes, its error, its label's error and the codebooks' digest."""
    codes, codebooks = vector_codes(table(spark, sf_dir, "embeddings"))
    out = with_label_error(codes).withColumn("codebooks_sha256", F.lit(codebooks_digest(codebooks)))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


#: The query's rules.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


def urls_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    steps, last = [], "r0"
    for level in range(1, DEPTH + 2):
        def differs(a: str, x: str) -> str:
            b, y = f"(all_{a} - {a})", f"(all_{x} - {x})"
            gap = f"({a} * {y} - {b} * {x})"
            return f"{gap} * {gap} * all_{x} > {DEVIATIONS * DEVIATIONS} * all_{a} * (all_{x} - all_{a}) * {x} * {y}"
        apart = (f"n >= {MIN_ROWS} AND (n = all_n OR (lab >= {MIN_LABELLED} AND all_lab - lab >= {MIN_LABELLED} AND {differs('bad', 'lab')}) "
                 f"OR {differs('ends', 'n')})")
        steps.append(f"""
c{level} AS (
  SELECT host, template, segs[{level}] AS s, count(*)::DOUBLE AS n, (count(*) FILTER (len(segs) = {level}))::DOUBLE AS ends,
         count(bad)::DOUBLE AS lab, coalesce(sum(bad), 0)::DOUBLE AS bad, any_value(rate) AS rate
  FROM {last} WHERE len(segs) >= {level} GROUP BY ALL),
p{level} AS (
  SELECT *, sum(n) OVER w AS all_n, sum(ends) OVER w AS all_ends, sum(lab) OVER w AS all_lab, sum(bad) OVER w AS all_bad
  FROM c{level} WINDOW w AS (PARTITION BY host, template)),
k{level} AS (SELECT *, {apart} AS apart FROM p{level}),
m{level} AS (
  SELECT host, template, (sum(bad) + {STRENGTH} * any_value(rate)) / (sum(lab) + {STRENGTH}) AS rate
  FROM k{level} WHERE NOT apart GROUP BY host, template),
r{level} AS (
  SELECT r.* REPLACE (
    CASE WHEN len(segs) < {level} THEN r.template ELSE r.template || '/' || CASE WHEN k.apart THEN replace(k.s, '*', '%2A') ELSE '*' END END AS template,
    CASE WHEN len(segs) < {level} THEN r.rate WHEN k.apart THEN (k.bad + {STRENGTH} * k.rate) / (k.lab + {STRENGTH}) ELSE m.rate END AS rate)
  FROM {last} r LEFT JOIN k{level} k ON k.host = r.host AND k.template = r.template AND k.s = r.segs[{level}]
  LEFT JOIN m{level} m ON m.host = r.host AND m.template = r.template)""")
        last = f"r{level}"
    body = ",".join(steps)
    return rf"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT doc_id, max(greatest((quality = 0)::INT, (toxic = 1)::INT)) AS bad FROM labels GROUP BY doc_id),
rules(h, p, v) AS (VALUES {rules}),
best AS (
  SELECT page_id, arg_max(h || p, length(h || p) * 1000 + length(h)) AS rule, arg_max(v, length(h || p) * 1000 + length(h)) AS ruled
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
s AS (
  SELECT u.*, l.bad, rule, ruled, list_filter(string_split(path, '/'), lambda x: x <> '') AS whole FROM u
  LEFT JOIN l ON l.doc_id = TRY_CAST(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS BIGINT) LEFT JOIN best USING (page_id)),
g AS (SELECT sum(bad)::DOUBLE / count(bad) AS overall FROM s),
r0 AS (
  SELECT s.* EXCLUDE (whole), CASE WHEN len(whole) > {DEPTH} THEN whole[1:{DEPTH}] || ['**'] ELSE whole END AS segs, '' AS template,
         (coalesce(sum(bad) OVER w, 0)::DOUBLE + {STRENGTH} * coalesce(overall, 0)) / (count(bad) OVER w + {STRENGTH}) AS rate
  FROM s CROSS JOIN g WINDOW w AS (PARTITION BY host)),{body}
SELECT page_id, host, path, rule, CASE WHEN ruled IS NOT NULL THEN ruled WHEN rate >= {REJECTED} THEN 'block' ELSE 'allow' END AS verdict, template
FROM {last}
"""


@register("op13_url_filter", urls_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by rule or path template. The number that ends a page's path is its document's id, whose label is the page's."""
    number = F.regexp_extract(path_of(F.col("url")), "([0-9]+)[^0-9]*$", 1).try_cast("long")
    bad = F.greatest((F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", number.alias("number"))
    pages = pages.join(labels, pages["number"] == labels["doc_id"], "left")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = filter_urls(pages, rules, bad=F.col("bad"), carry=["page_id"])
    return out.select("page_id", "host", "path", "rule", "verdict", "template")
