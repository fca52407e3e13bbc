"""Training-order materialisation: fixed-stride binary shards in a keyed random order."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_code
from .common import free_name, materialize, release, scratch_path
from .packing import token_pieces
from .tokens import forget, id_width, read_model


class Feistel:
    """Keyed permutation of 0..n-1: a four-round Feistel network over the smallest
    even-bit domain that holds n, walked along its cycle until it is below n."""

    ROUNDS = 4

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, ((n - 1).bit_length() + 1) // 2) if n > 1 else 1
        self.mask = (1 << self.half) - 1
        self.keys = [(key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & (2**64 - 1) for r in range(self.ROUNDS)]

    def _round(self, x, key: int):
        import numpy as np
        with np.errstate(over="ignore"):
            x = (x + np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(32)
        return x & np.uint64(self.mask)

    def _once(self, x):
        import numpy as np
        half = np.uint64(self.half)
        left, right = x >> half, x & np.uint64(self.mask)
        for key in self.keys:
            left, right = right, left ^ self._round(right, key)
        return (left << half) | right

    def __call__(self, x):
        import numpy as np
        x = self._once(np.asarray(x, np.uint64))
        while (far := x >= self.n).any():  # the domain is under 4n, so each pass settles over a quarter
            x[far] = self._once(x[far])
        return x.astype(np.int64)


def slotted(sequences: DataFrame, key: int) -> DataFrame:
    """``sequences`` with ``slot``: a keyed permutation of 0..N-1 over all rows.

    The rows are written once, with their task's number and their place in it;
    a row's index is the rows of the tasks before plus its place, so no text or id
    moves for it (one row per task is summed in order). The Feistel network
    turns the index into the slot. An input column ``slot`` is replaced, others
    may have any names. Without rows the result is empty.
    """
    ship_code(sequences.sparkSession)
    sequences = sequences.drop(*[c for c in sequences.columns if c.lower() == "slot"])
    at, task, ahead = (free_name(sequences, c) for c in ("_at", "_task", "_before"))
    numbered = sequences.withColumn(at, F.monotonically_increasing_id())
    # the high bits of monotonically_increasing_id are the task, the low 33 its row
    numbered = materialize(numbered.withColumn(task, F.shiftright(at, 33).cast("int"))
                           .withColumn(at, F.col(at).bitwiseAND((1 << 33) - 1)), "sequences")
    counts = numbered.groupBy(task).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(task, (F.sum("_n").over(Window.orderBy(task)) - F.col("_n")).alias(ahead))
    order = Feistel(max(1, numbered.count()), key)

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        forget()
        return pd.Series(order(index.to_numpy()))

    return (numbered.join(F.broadcast(before), task)  # one row per writing task
            .withColumn("slot", slot(F.col(ahead) + F.col(at))).drop(task, at, ahead))


def write_training_shards(sequences: DataFrame, path: str, length: int, shard_rows: int = 8192, key: int = 1,
                          width: int = 2, waves: int = 2) -> DataFrame:
    """Write ``sequences`` (column ``ids``: at most ``length`` - 1 little-endian
    ids of ``width`` bytes) in training order and return where each lies.

    Slot s is record s % ``shard_rows`` of shard s // ``shard_rows``; a record is
    ``length`` ids of ``width`` bytes (2 for vocabularies up to 65,536, else 4), padded with
    id 0, so the byte offset of any slot is known and a run resumes at
    any slot (``read_training_shards``). Rows are range-partitioned by shard and sorted by slot, so a shard
    is one file written by one task and committed as a whole. The shards are written in
    ``waves`` (every ``waves``-th shard), so that only a part of the ids lies in
    shuffle files at a time. The files hold
    nothing but ids: the last id of a record is the closing id 0, which Spark's
    text writer puts as its line separator. Returns the other columns plus
    ``slot``, ``shard``, ``byte_offset``.
    """
    placed = slotted(sequences, key).withColumn("shard", F.floor(F.col("slot") / shard_rows).cast("int"))
    body = (length - 1) * width

    # padded after the shuffle, so that it carries no padding
    padding = F.lit("\0" * body)
    record = F.substring(F.concat(F.col("ids").cast("string"), padding).cast("binary"), 1, body).cast("string")
    for wave in range(waves):
        rows = placed.where(F.col("shard") % waves == wave).select("shard", "slot", "ids")
        rows = rows.repartitionByRange("shard").sortWithinPartitions("shard", "slot")
        (rows.select("shard", record.alias("value"))
         .write.mode("append").partitionBy("shard").option("lineSep", "\0" * width).text(path))
        del rows
        release(placed.sparkSession)
    return placed.drop("ids").withColumn("byte_offset", F.col("slot") % shard_rows * (length * width))


def read_training_shards(spark: SparkSession, path: str, length: int, shard_rows: int, width: int = 2,
                         first: int = 0, count: int | None = None) -> DataFrame:
    """``slot`` and ``record`` (``length`` ids of ``width`` bytes) of ``count`` records under ``path``
    from slot ``first`` on (all that follow without a ``count``).

    Only the shards that hold such slots are opened; in the first and the last of them
    the records are cut out by their byte offsets. A shard that is opened is read as one
    value, so a resumed read costs at most one shard more than its records.
    """
    ship_code(spark)
    stride, end = length * width, None if count is None else first + count

    def split(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            for shard, data in zip(batch.column(0), batch.column(1)):
                view, start = data.as_buffer(), shard.as_py() * shard_rows
                n = len(view) // stride
                own = range(max(0, first - start), n if end is None else min(n, end - start))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([start + i for i in own], pa.int64()),
                     pa.array([view[i * stride:(i + 1) * stride].to_pybytes() for i in own], pa.binary())],
                    ["slot", "record"])

    files = spark.read.format("binaryFile").load(path).where(F.col("shard") >= first // shard_rows)
    if end is not None:
        files = files.where(F.col("shard") * shard_rows < end)
    return files.select("shard", "content").mapInArrow(split, "slot long, record binary")


def shard_digests(spark: SparkSession, path: str, length: int, shard_rows: int, width: int = 2) -> DataFrame:
    """``slot``, ``_size`` (ids up to the last that isn't 0) and ``_crc`` (of those ids as
    little-endian unsigned 32-bit numbers) of every record under ``path``."""
    ship_code(spark)

    def digest(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        forget()
        for batch in batches:
            for shard, data in zip(batch.column(0), batch.column(1)):
                ids = np.frombuffer(data.as_buffer(), f"<u{width}").reshape(-1, length)
                used = ids != 0
                size = np.where(used.any(1), length - used[:, ::-1].argmax(1), 0)
                wide = memoryview(ids.astype("<u4").tobytes())
                stride = 4 * length
                crcs = [zlib.crc32(wide[i * stride:i * stride + 4 * n]) for i, n in enumerate(size.tolist())]
                first = shard.as_py() * shard_rows
                yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(ids)), pa.int64()),
                                                  pa.array(size, pa.int64()), pa.array(crcs, pa.int64())], ["slot", "_size", "_crc"])

    files = spark.read.format("binaryFile").load(path)
    return files.select("shard", "content").mapInArrow(digest, "slot long, _size long, _crc long")


def training_order(docs: DataFrame, tokenizer_path: str, length: int = 256, key: int = 1, shard_rows: int = 8192,
                   id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Tokenise ``docs``, cut each text into sequences of ``length`` - 1 ids (plus
    the closing id 0), write them in training order to ``path`` (default: a
    folder of the shared scratch), read the shards back and return one row per
    sequence: the id, ``piece``, ``start``, ``length``, ``slot``, ``shard``,
    ``byte_offset`` and ``ids_crc32`` of the ids as read back (the record's first
    ``length`` ids, as little-endian unsigned 32-bit numbers).

    Null or empty text gives no sequence. Rows that repeat an id each give
    their sequences. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "training-shards")
    width = id_width(read_model(tokenizer_path))
    pieces = token_pieces(docs, tokenizer_path, length - 1, id_col, text_col, end_id=None, id_bytes=width, cache_bytes=128 << 20)
    placed = write_training_shards(pieces.drop("ids_crc32"), path, length, shard_rows, key, width)
    if placed.isEmpty():
        return placed.withColumn("ids_crc32", F.lit(None).cast("long"))

    @F.pandas_udf("long")
    def with_zeros(crc: pd.Series, size: pd.Series, length: pd.Series) -> pd.Series:
        # ids of 0 at a sequence's end look like padding in the file: they are counted in again
        forget()
        return pd.Series([zlib.crc32(b"\0" * (4 * (n - k)), c) for c, k, n in zip(crc, size, length)], dtype="int64")

    # digests move to the join, not records
    written = shard_digests(spark, path, length, shard_rows, width)
    return (placed.join(written, "slot").withColumn("ids_crc32", with_zeros("_crc", "_size", "length"))
            .drop("_size", "_crc"))
