"""Best-fit packing of documents into fixed-length training sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_code
from .common import free_name, materialize, text_or_empty
from .tokens import id_width, loaded, read_model

#: Pieces that one packing group holds on average; texts that a task tokenises at a time.
GROUP_PIECES, BATCH_TEXTS = 50_000, 1_000


def token_pieces(df: DataFrame, tokenizer_path: str, length: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text", end_id: int | None = 0, id_bytes: int = 0,
                 cache_bytes: int = 256 << 20) -> DataFrame:
    """Token ids of every row, cut into pieces of at most ``length``.

    Returns the id column, ``piece`` (from 0), ``start``, ``length`` and
    ``ids_crc32`` (unsigned CRC-32 of the ids as little-endian unsigned 32-bit
    numbers); with ``id_bytes`` (2 or 4; an error if the tokenizer has ids that 2 bytes can't hold)
    also ``ids``, the ids as unsigned numbers of that many bytes. ``end_id`` (if any) is appended to
    each document. Null text is empty: one piece of the end id alone, or
    none without an end id. Rows that repeat an id each give their pieces. The
    tokenizer file is read on the driver and travels with the task. A worker caches words
    and their ids in ``cache_bytes`` at most.
    """
    ship_code(df.sparkSession)
    model, size = read_model(tokenizer_path), 4 * length
    if id_bytes and id_bytes < max(id_width(model), 4 if (end_id or 0) >= 1 << 16 else 2):
        raise ValueError(f"the tokenizer has ids that {id_bytes} bytes can't hold")
    end = b"" if end_id is None else end_id.to_bytes(4, "little")
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), text_or_empty(text_col).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {id_type}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if id_bytes else "")

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        tokenizer = loaded(model, cache_bytes)
        for batch in (b.slice(at, BATCH_TEXTS) for b in batches for at in range(0, b.num_rows, BATCH_TEXTS)):
            ids, pieces, starts, lengths, crcs, bodies = [], [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = tokenizer.ids(text) + end
                if id_bytes:
                    wide = id_bytes * length
                    own = body if id_bytes == 4 else np.frombuffer(body, "<u4").astype(f"<u{id_bytes}").tobytes()
                    bodies += [own[at:at + wide] for at in range(0, len(own), wide)]
                for n, at in enumerate(range(0, len(body), size)):
                    part = body[at:at + size]
                    ids.append(doc)
                    pieces.append(n)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
            columns = [pa.array(ids, batch.schema.field(0).type), pa.array(pieces, pa.int32()),
                       pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
            names = ["_id", "piece", "start", "length", "ids_crc32"]
            if id_bytes:
                columns.append(pa.array(bodies, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(cut, schema).withColumnRenamed("_id", id_col)


class BestFit:
    """Open bins by remaining capacity, with a segment tree over the capacities.

    A leaf counts the open bins that have exactly that much room; an inner node
    is the sum of its children, so the tightest bin with room for a piece is
    found, and the tree kept up to date, in log2(capacity) steps.
    """

    def __init__(self, capacity: int):
        self.capacity, self.leaves = capacity, 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bins = 0

    def _add(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.tree[node] += by
            node >>= 1

    def _tightest(self, need: int) -> int | None:
        """The smallest room of at least ``need`` that an open bin has."""
        tree, node = self.tree, self.leaves + need
        if not tree[node]:
            # up to the first right sibling that holds a bin, then down its left edge
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not tree[2 * node])
        return node - self.leaves

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) for a piece of ``size``: the tightest open bin or a new one."""
        room = self._tightest(size)
        if room is None:
            number, offset, left = self.bins, 0, self.capacity - size
            self.bins += 1
        else:
            number = self.open[room].pop()
            self._add(room, -1)
            offset, left = self.capacity - room, room - size
        if left:
            self.open[left].append(number)
            self._add(left, 1)
        return number, offset


def pack(pieces: DataFrame, length: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Best-fit decreasing: adds ``sequence_id`` (long) and ``offset`` (long) to
    rows with a ``length`` of 1 to ``length``.

    Pieces are written once with their task and place and dealt by a hash of these into groups of
    about ``group_pieces``, so rows that repeat spread like any others. Each group is packed by itself,
    longest first; it leaves at most a few sequences part-filled, so the loss against one global
    packing is of the order of one sequence in ten thousand. The number of groups grows with the
    input, a group never does. Input columns ``sequence_id`` and ``offset`` are replaced; other columns
    may have any names. An empty table gives an empty result.
    """
    ship_code(pieces.sparkSession)
    pieces = pieces.drop(*[c for c in pieces.columns if c.lower() in ("sequence_id", "offset")])
    names = pieces.columns
    place, group = free_name(pieces, "_place"), free_name(pieces, "_group")
    pieces = materialize(pieces.withColumn(place, F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    schema = pieces.drop(place).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    at = names.index("length")

    def fit(key, table):
        import pyarrow as pa
        bins = BestFit(length)
        base = key[0].as_py() << 40
        table = table.select(names)
        sizes = table.column(at).to_pylist()
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
        sequence, offset = [0] * len(sizes), [0] * len(sizes)
        for i in order:
            number, offset[i] = bins.place(sizes[i])
            sequence[i] = base + number
        return table.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column(
            "offset", pa.array(offset, pa.int64()))

    keyed = pieces.withColumn(group, F.pmod(F.xxhash64(place), F.lit(groups))).drop(place)
    return keyed.groupBy(group).applyInArrow(fit, schema)
