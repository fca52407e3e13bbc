"""Search (SR-1..SR-4): inverted index + BM25, LIKE search with snippets,
exact cosine top-k.

BM25 joins query terms with the postings on ``term``. The query side is
broadcast only after its row count is checked against a bound. Corpus
constants (N, average length) are scalar subqueries over the same postings.
Top-k per query is a ``row_number() <= k`` filter (map-side group limit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as TX
from ..session import estimated_bytes, reuse_if_large, ship_code

#: Sides of the largest matrix of similarities that a task holds.
QUERIES_AT_ONCE, ROWS_AT_ONCE = 512, 2048
#: Bytes of documents, by the plan's estimate, whose tokens and scores a task of ``bm25`` holds.
TASK_BYTES = 16 << 20


def query_terms(queries: DataFrame, qid: str = "qid", text_col: str = "text") -> DataFrame:
    return queries.select(F.col(qid).alias("qid"),
                          TX.explode_values(F.array_distinct(TX.words(F.col(text_col)))).alias("term")).where(
        F.col("term").isNotNull())


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75,
         text_col: str = "content", qid: str = "qid", qtext: str = "text", digits: int = 6,
         max_broadcast_rows: int = 2_000_000) -> DataFrame:
    """Top-k documents per query by Okapi BM25 with
    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); ties: id asc.

    One tokenisation pass yields (id, dl, term), cut down to the query
    vocabulary (a semi join with the size-checked distinct query terms) plus
    one marker row per document, so N and the average length come out of the same
    pass. The tokens are partitioned by id: term frequencies, the scores of
    (query, document) and the top k of a partition need no further shuffle;
    k rows per query and partition move for the final ranks. The partitions grow in
    number with the documents (``TASK_BYTES`` each), so a task's scores do not."""
    marker = "\u0000"  # not a word
    qt = query_terms(queries, qid, qtext)
    # Size check on the query side only (cheap); every query-side table below
    # has at most this many rows, so the bound holds for all of them.
    small = qt.count() <= max_broadcast_rows
    hint = F.broadcast if small else (lambda d: d)
    vocab = hint(qt.select("term").union(qt.sparkSession.range(1).select(F.lit(marker))).distinct())
    toks = docs.select("id", TX.words(F.col(text_col)).alias("_w"))
    exploded = toks.select("id", F.size("_w").alias("dl"), TX.explode_values(
        F.concat(F.array(F.lit(marker)), F.col("_w"))).alias("term"))
    tasks = estimated_bytes(docs) // TASK_BYTES
    by_id = [tasks, "id"] if tasks > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else ["id"]
    post = (exploded.join(vocab, "term", "left_semi").repartition(*by_id)
            .groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl")))
    post = reuse_if_large(post, docs)
    is_doc = F.col("term") == marker
    n_docs = post.select(F.count_if(is_doc)).scalar()
    avgdl = post.select(F.avg(F.when(is_doc, F.col("dl")))).scalar()
    # Aggregating without a filter keeps this branch's copy of ``post``
    # identical to the main one's, so Spark reuses its shuffle.
    df = post.groupBy("term").agg(F.sum(F.when((F.col("tf") > 0) | F.col("dl").isNull(), 1)).alias("df"))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = hint(qt.join(df, "term").select("qid", "term", idf.alias("idf")))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    scores = post.join(terms, "term").groupBy("qid", "id").agg(F.round(F.sum(part), digits).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("id"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def like_search(docs: DataFrame, q: str, k: int = 20, text_col: str = "content", before: int = 40,
                width: int = 120) -> DataFrame:
    """SR-2: documents containing ``q`` (case-insensitive), ranked by number
    of occurrences then id, with a snippet around the first hit. An empty
    query finds nothing."""
    if not q:
        docs, q = docs.where("false"), " "
    low = F.lower(F.col(text_col))
    ql = q.lower()
    pos = F.instr(low, ql)
    hits = ((F.length(low) - F.length(F.replace(low, F.lit(ql), F.lit("")))) / len(ql)).cast("bigint")
    m = docs.where(pos > 0).select("id", hits.alias("hits"),
                                   F.substring(F.col(text_col), F.greatest(pos - before, F.lit(1)), width)
                                   .alias("snippet"))
    w = Window.orderBy(F.col("hits").desc(), F.col("id"))
    top = m.orderBy(F.col("hits").desc(), F.col("id")).limit(k)
    return top.withColumn("rank", F.row_number().over(w))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def centroids(vectors: DataFrame, key: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean vector per key: positional explode + partial aggregation, then
    reassembled in position order."""
    e = vectors.select(key, F.posexplode(vec).alias("pos", "x"))
    m = e.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return m.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))),
                                          lambda s: s["x"]).alias("centroid"))


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, vec: str = "embedding",
                qid: str = "qid", qvec: str = "qvec", digits: int = 6, block_rows: int = 4096) -> DataFrame:
    """SR-3 exact k nearest by cosine similarity (a zero vector has none).

    Queries go to the tasks in blocks of ``block_rows`` normalised vectors, read
    from an iterator, so the driver holds one block at a time. A task takes
    matrix products of ``QUERIES_AT_ONCE`` queries and ``ROWS_AT_ONCE`` rows, holds the k best rows of
    each query so far and emits those at its end; those few rows are ranked in the end."""
    ship_code(vectors.sparkSession)
    v = vectors.select("vec_id", F.col(vec).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    q_field = queries.schema[qid]

    def block(ids: list, rows: list) -> DataFrame:
        import numpy as np
        q = np.array(rows, dtype="float64")
        with np.errstate(invalid="ignore", divide="ignore"):
            q = q / np.linalg.norm(q, axis=1, keepdims=True)

        def best(batches):
            import pyarrow as pa
            # the k best of each query so far: similarity (-inf: none) and row number in ``keys``
            top, at = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
            keys, key_type = np.empty(0, "object"), None
            for whole in batches:
                for part in (whole.slice(i, ROWS_AT_ONCE) for i in range(0, whole.num_rows, ROWS_AT_ONCE)):
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    own = part.column(0).to_numpy(zero_copy_only=False)
                    keys, key_type = np.concatenate([keys.astype(own.dtype) if not len(keys) else keys, own]), part.schema.field(0).type
                    new = np.arange(len(keys) - len(own), len(keys))
                    for i in range(0, len(q), QUERIES_AT_ONCE):
                        sim = np.round(q[i:i + QUERIES_AT_ONCE] @ x.T, digits)
                        sim[np.isnan(sim)] = -np.inf
                        old = top[i:i + QUERIES_AT_ONCE]
                        for j in np.flatnonzero(sim.max(1) >= old.min(1)):
                            floor = np.partition(sim[j], -k)[-k] if sim.shape[1] > k else -np.inf
                            near = np.flatnonzero((sim[j] >= max(floor, old[j].min())) & (sim[j] > -np.inf))
                            s = np.concatenate([old[j], sim[j, near]])
                            who = np.concatenate([at[i + j], new[near]])
                            s, who = s[who >= 0], who[who >= 0]
                            first = np.lexsort((keys[who], -s))[:k]
                            old[j, :len(first)], at[i + j, :len(first)] = s[first], who[first]
                    # keys of rows that no query holds are let go
                    held = np.unique(at[at >= 0])
                    keys = keys[held]
                    at = np.where(at >= 0, np.searchsorted(held, at), -1)
            if key_type is not None:
                who, n = np.nonzero(at >= 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[j] for j in who], qid_type), pa.array(keys[at[who, n]]).cast(key_type),
                     pa.array(top[who, n])], ["qid", "vec_id", "similarity"])

        from pyspark.sql.pandas.types import to_arrow_type
        qid_type = to_arrow_type(q_field.dataType)
        return v.mapInArrow(best, f"qid {q_field.dataType.simpleString()}, vec_id {id_type}, similarity double")

    scored, ids, rows = None, [], []
    add = lambda done, part: part if done is None else done.unionByName(part)
    for r in queries.where(F.col(qvec).isNotNull()).select(qid, F.col(qvec).cast("array<double>")).toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == block_rows:
            scored, ids, rows = add(scored, block(ids, rows)), [], []
    if ids:
        scored = add(scored, block(ids, rows))
    if scored is None:
        scored = v.select(F.lit(None).cast(q_field.dataType).alias("qid"), "vec_id", F.lit(0.0).alias("similarity")).where("false")
    w = Window.partitionBy("qid").orderBy(F.col("similarity").desc(), F.col("vec_id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def missing_embeddings(docs: DataFrame, embeddings: DataFrame, doc_key: str = "id",
                       emb_key: str = "vec_id") -> DataFrame:
    """SR-4: documents without an embedding row."""
    return docs.join(embeddings.select(F.col(emb_key).alias(doc_key)), doc_key, "left_anti")
