"""Stored vector index (SR-3): inverted lists, codes of the residuals, exact re-ranking.

``cosine_topk`` scores every vector for every query. Here the vectors are dealt into lists around centroids, and a query
scores the lists whose centroids are nearest to it. The centroids, the code book and the number of lists to probe come from a
sample of at most ``FIT_ROWS`` rows (those with the smallest hashes of their ids) and ``FIT_BYTES`` bytes, fitted on the
driver; every row is indexed. How many lists a query needs depends on the data: the number is the smallest that holds
``recall`` of the true neighbours in the sample, so vectors without clusters cost more lists, not recall.

Tables under the index's folder, all of one row size however the corpus grows:
* ``blocks``, by list: slices of about ``SLICE_ROWS`` ids and codes (a code has a byte per two dimensions). A list that holds a third of all
  rows has as many slices as it needs, and each slice is scored by itself;
* ``vectors``, by list: the vectors, read for the candidates only;
* ``fit``: centroids and code book, written last: a folder without it is an unfinished build.

Queries are rows too: they meet the slices of their lists in blocks by an equi-join on (list, slice), never through the driver. Null,
zero, non-finite vectors and those of another length than most of the sample have no cosine to the others and are left out on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_folder, ship_code

FIT_ROWS = 20_000
FIT_BYTES = 64 << 20
MAX_LISTS = 1024
SLICE_ROWS = 32_768
QUERY_ROWS = 256
ENTRIES = 256  # of a part's code book: a byte


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres ** 2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i:i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)])


def _means(x: np.ndarray, entries: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows of the (hash-ordered) sample; an unused centre stays where it is."""
    centres = x[np.linspace(0, len(x) - 1, entries).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        count = np.bincount(near, minlength=entries)
        total = np.stack([np.bincount(near, weights=x[:, d], minlength=entries) for d in range(x.shape[1])], axis=1)
        centres[count > 0] = (total[count > 0] / count[count > 0, None]).astype(x.dtype)
    return centres


def _parts(dims: int) -> list[tuple[int, int]]:
    return [(d, min(d + 2, dims)) for d in range(0, dims, 2)]


def _encode(residual: np.ndarray, book: list[np.ndarray]) -> np.ndarray:
    return np.stack([_nearest(residual[:, a:b], book[p]) for p, (a, b) in enumerate(_parts(residual.shape[1]))], axis=1).astype(np.uint8)


def _decode(codes: np.ndarray, book: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([book[p][codes[:, p]] for p in range(len(book))], axis=1)


def _probes(unit: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """Lists to probe so that ``recall`` of the ``k`` nearest rows of up to 500 rows of the sample lie in them."""
    asked = unit[:: max(1, len(unit) // 500)]
    of = _nearest(unit, centres)
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)  # a list's place in each query's order
    sim = asked @ unit.T
    best = np.argsort(-sim, axis=1)[:, 1:k + 1]  # the first is the row itself
    need = np.sort(np.take_along_axis(place, of[best], axis=1).ravel())
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) + 1 if len(need) else 1


class VectorIndex:
    """An index in ``path``, a folder that driver and executors share. The id may be of any type that can be ordered."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- build ------------------------------------------------------------------------------------------------

    def build(self, vectors: DataFrame, vec: str = "embedding", key: str = "vec_id", lists: int | None = None, k: int = 10,
              recall: float = 0.97) -> None:
        """Indexes every row of ``vectors`` in a new folder. ``lists`` is a twentieth of the sample's rows, at most ``MAX_LISTS``, unless
        given. Equal rows are indexed each."""
        ship_code(self.spark)
        rows = vectors.select(F.col(key).alias("vec_id"), F.col(vec).cast("array<float>").alias("v")).where(F.size("v") > 0)
        sample = rows.orderBy(F.xxhash64("vec_id"), F.xxhash64("v")).limit(FIT_ROWS).select("v")
        width = [r[0] for r in sample.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()]
        dims = width[0] if width else 1
        sample = sample.where(F.size("v") == dims).limit(max(ENTRIES, FIT_BYTES // (4 * dims)))
        fit = np.array([r[0] for r in sample.toLocalIterator()], dtype="float32").reshape(-1, dims)
        fit = fit[np.isfinite(fit).all(axis=1) & (np.abs(fit).max(axis=1, initial=0) > 0)]
        unit = (fit / np.linalg.norm(fit.astype("float64"), axis=1, keepdims=True)).astype("float32")
        if not len(unit):
            unit = np.ones((1, dims), "float32") / np.float32(np.sqrt(dims))
        centres = _means(unit, max(1, min(lists or max(1, len(unit) // 20), MAX_LISTS, len(unit))))
        residual = unit - centres[_nearest(unit, centres)]
        book = [_means(residual[:, a:b], min(ENTRIES, len(unit))) for a, b in _parts(dims)]
        self.centres, self.book, self.dims = centres, book, dims
        self.probes = _probes(unit, centres, k, recall)
        self._write(rows)
        self.id_type = rows.schema["vec_id"].dataType.simpleString()
        table = [("centre", 0, i, c.tolist(), self.probes, self.id_type) for i, c in enumerate(centres)]
        table += [("book", p, i, e.tolist(), self.probes, self.id_type) for p, b in enumerate(book) for i, e in enumerate(b)]
        schema = "kind string, part int, entry int, v array<float>, probes int, id_type string"
        self.spark.createDataFrame(table, schema).coalesce(1).write.parquet(f"{self.path}/fit")

    def _write(self, rows: DataFrame) -> None:
        dims, centres, book = self.dims, self.centres, self.book
        schema = T.StructType([rows.schema["vec_id"], T.StructField("v", T.ArrayType(T.FloatType())), T.StructField("list", T.IntegerType()),
                               T.StructField("code", T.BinaryType())])

        def place(batches: Iterator) -> Iterator:
            import pyarrow as pa
            for batch in batches:
                keep, unit = _unit(batch.column(1), dims)
                near = _nearest(unit, centres) if len(unit) else np.zeros(0, int)
                codes = _encode(unit - centres[near], book) if len(unit) else np.zeros((0, len(book)), np.uint8)
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(keep)).columns, pa.array(near, pa.int32()),
                                                  pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "v", "list", "code"])

        folder = scratch_folder(self.spark, "placed")
        rows.mapInArrow(place, schema).write.parquet(folder)
        placed = self.spark.read.schema(schema).parquet(folder)
        # written rows are numbered by their place, so equal rows and equal ids spread too
        numbered = placed.withColumn("_n", F.xxhash64(F.monotonically_increasing_id()))
        sizes = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / SLICE_ROWS).alias("slices"))  # a row per list
        dealt = numbered.join(F.broadcast(sizes), "list").withColumn("slice", F.pmod("_n", "slices").cast("int"))
        blocks = dealt.groupBy("list", "slice").agg(F.collect_list(F.struct("vec_id", "code")).alias("held"))
        blocks.select("list", "slice", "held.vec_id", "held.code").write.partitionBy("list").parquet(f"{self.path}/blocks")
        dealt.repartition("list", "slice").select("list", "vec_id", "v").write.partitionBy("list").parquet(f"{self.path}/vectors")

    def open(self) -> "VectorIndex":
        """Reads the fit of a finished index."""
        rows = self.spark.read.parquet(f"{self.path}/fit").orderBy("part", "entry").collect()  # at most lists and 256 entries a part
        self.centres = np.array([r.v for r in rows if r.kind == "centre"], "float32")
        self.dims, self.probes, self.id_type = self.centres.shape[1], rows[0].probes, rows[0].id_type
        self.book = [np.array([r.v for r in rows if r.kind == "book" and r.part == p], "float32") for p in range(len(_parts(self.dims)))]
        return self

    # -- search -----------------------------------------------------------------------------------------------

    def search(self, queries: DataFrame, k: int = 10, qid: str = "qid", qvec: str = "qvec", probes: int | None = None,
               depth: int | None = None, digits: int = 6) -> DataFrame:
        """The ``k`` indexed rows nearest to each query by cosine, as ``qid, vec_id, similarity, rank`` (ties: smaller id). ``probes`` lists
        are scored by codes, the ``depth`` best (twenty times ``k``) by their vectors, so the similarity given is exact; a neighbour in a
        list that is not probed is missed. With ``probes`` at the number of lists only the codes can miss one. ``qid`` is unique."""
        ship_code(self.spark)
        probes = min(probes or self.probes, len(self.centres))
        depth = depth or 20 * k
        dims, centres, book = self.dims, self.centres, self.book
        q = queries.select(F.col(qid).alias("qid"), F.col(qvec).cast("array<float>").alias("q")).where(F.size("q") == dims)
        q_type = q.schema["qid"].dataType.simpleString()
        share = F.ceil(F.count(F.lit(1)) * probes / len(centres) / QUERY_ROWS)
        parts = F.greatest(q.select(share).scalar(), F.lit(1))

        def probe(batches: Iterator) -> Iterator:
            import pyarrow as pa
            for batch in batches:
                keep, unit = _unit(batch.column(1), dims)
                near = np.argsort(-(unit @ centres.T), axis=1, kind="stable")[:, :probes]
                at = np.repeat(np.arange(len(keep)), near.shape[1])
                packed = [u.tobytes() for u in unit]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(keep[at])), pa.array(near.ravel(), pa.int32()),
                     pa.array([packed[i] for i in at], pa.binary())], ["qid", "list", "q"])

        asked = q.mapInArrow(probe, f"qid {q_type}, list int, q binary").withColumn("part", F.pmod(F.xxhash64("qid"), parts))
        asked = asked.groupBy("list", "part").agg(F.collect_list(F.struct("qid", "q")).alias("asked"))
        id_type = self.id_type
        blocks = self.spark.read.schema(f"slice int, vec_id array<{id_type}>, code array<binary>, list int").parquet(f"{self.path}/blocks")
        slices = blocks.groupBy("list").agg(F.max("slice").alias("last"))  # a row per list
        asked = asked.join(F.broadcast(slices), "list").select("list", F.explode(F.sequence(F.lit(0), "last")).alias("slice"), "asked.qid", "asked.q")
        met = asked.join(blocks, ["list", "slice"]).select("qid", "q", "list", "vec_id", "code")

        def score(batches: Iterator) -> Iterator:
            import pyarrow as pa
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    ids, held = row.column(3).flatten(), row.column(2)[0].as_py()
                    codes = np.frombuffer(b"".join(row.column(4).flatten().to_pylist()), np.uint8).reshape(len(ids), len(book))
                    near = _decode(codes, book) + centres[held]
                    who = row.column(0).flatten()
                    unit = np.frombuffer(b"".join(row.column(1).flatten().to_pylist()), "float32").reshape(len(who), dims)
                    for a in range(0, len(who), QUERY_ROWS):
                        sim = unit[a:a + QUERY_ROWS] @ near.T
                        n = min(depth, len(ids))
                        best = np.argpartition(-sim, n - 1, axis=1)[:, :n]
                        asker = np.repeat(np.arange(a, a + len(sim)), n)
                        yield pa.RecordBatch.from_arrays(
                            [who.take(pa.array(asker)), ids.take(pa.array(best.ravel())), pa.array(np.full(best.size, held), pa.int32()),
                             pa.array(np.take_along_axis(sim, best, axis=1).ravel(), pa.float32())], ["qid", "vec_id", "list", "near"])

        found = met.mapInArrow(score, f"qid {q_type}, vec_id {id_type}, list int, near float")
        first = Window.partitionBy("qid").orderBy(F.desc("near"), "vec_id")
        found = found.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= depth).select("qid", "vec_id", "list").distinct()
        vectors = self.spark.read.schema(f"vec_id {id_type}, v array<float>, list int").parquet(f"{self.path}/vectors")
        exact = found.join(vectors, ["list", "vec_id"]).join(q, "qid")
        exact = exact.select("qid", "vec_id", _cosine(F.col("v"), F.col("q"), digits).alias("similarity"))
        last = Window.partitionBy("qid").orderBy(F.desc("similarity"), "vec_id")
        return exact.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)


def _cosine(a, b, digits: int):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s.cast("double") * t), F.lit(0.0), lambda acc, s: acc + s)
    return F.round(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), digits)


def _unit(column, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and unit vectors of the usable rows of an Arrow list column."""
    import pyarrow as pa
    import pyarrow.compute as pc
    sized = pc.equal(pc.list_value_length(column), dims).fill_null(False)
    keep = np.flatnonzero(sized.to_numpy(zero_copy_only=False))
    x = column.take(pa.array(keep)).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, dims)  # a null is not finite
    long = np.linalg.norm(x, axis=1)
    fine = np.isfinite(long) & (long > 0)
    return keep[fine], (x[fine] / long[fine, None]).astype("float32")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, their true neighbours, how many of them were found, and the share."""
    both = exact.select("qid", "vec_id").join(found.select("qid", "vec_id", F.lit(1).alias("hit")), ["qid", "vec_id"], "left")
    return both.agg(F.count_distinct("qid").alias("queries"), F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("found")).withColumn(
        "recall", F.try_divide(F.col("found"), F.col("neighbours")))
