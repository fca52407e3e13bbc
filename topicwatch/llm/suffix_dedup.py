"""Removal of repeated byte strings, by interval expansion on Burrows-Wheeler transforms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_code
from .common import materialize, packed, parallelism, release, row_key, text_or_empty, unpacked

#: Bytes of a gram; most windows of a segment; bytes that one transform holds on
#: average; segments with one key beyond which windows are grouped singly.
GRAM, SEGMENT_WINDOWS, BUCKET_BYTES, KEY_SEGMENTS = 16, 64, 2 << 20, 20_000
#: Keys that one task compares at a time, on average; buckets that one task transforms one after the other.
PART_KEYS, TASK_BUCKETS = 2_000_000, 8
#: Bytes of texts whose windows are hashed at once.
HASH_BYTES = 1 << 17
#: A byte that UTF-8 never holds ends each segment in a transform.
END = 0xFF
LAST_ID = (1 << 63) - 1


def window_keys(raw: bytes, length: int):
    """For each window of ``length`` bytes the smallest hash of its grams: equal
    windows have equal keys, and neighbouring windows mostly share theirs."""
    import numpy as np
    n, gram = len(raw), min(GRAM, length)
    if n < length:
        return np.empty(0, np.uint64)
    data = raw + b"\0" * 8
    word = np.ndarray((n,), "<u8", data, strides=(1,)).astype(np.uint64)
    with np.errstate(over="ignore"):
        if gram >= 8:  # two overlapping words cover a gram
            tail = word[gram - 8:n - 7]
            h = (word[:n - gram + 1] * np.uint64(0x9E3779B97F4A7C15)) ^ ((tail + np.uint64(0x7F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9))
        else:
            h = (word[:n - gram + 1] & np.uint64((1 << 8 * gram) - 1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    width, step = length - gram + 1, 1
    while step * 2 <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    if step < width:
        h = np.minimum(h[:len(h) - (width - step)], h[width - step:])
    return h


def segments_of(raw: bytes, length: int):
    """Runs of neighbouring windows with one key: (key, first window, windows) arrays.
    Long runs are cut every ``SEGMENT_WINDOWS``."""
    return segments_of_all([raw], length)[1:]


def segments_of_all(raws: list[bytes], length: int):
    """The segments of several texts: (number of the text, key, first window, windows) arrays, in the texts' order. About
    ``HASH_BYTES`` of texts are hashed at once; no segment goes from one text to the next."""
    import numpy as np
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    found = [(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
    block = (np.cumsum(sizes) - sizes) // HASH_BYTES
    edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(raws)]
    for x, y in zip(edges, edges[1:]):
        keys = window_keys(b"".join(raws[x:y]), length)
        if not len(keys):
            continue
        begin = np.cumsum(sizes[x:y]) - sizes[x:y]
        windows = np.maximum(sizes[x:y] - length + 1, 0)
        of = np.flatnonzero(windows)  # texts with a window; what lies between the windows of two texts belongs to none
        new = np.empty(len(keys) + 1, bool)
        new[0] = True
        np.not_equal(keys[1:], keys[:-1], out=new[1:-1])
        new[begin[of]] = True
        new[begin[of] + windows[of]] = True
        start = np.flatnonzero(new[:-1])
        size = np.diff(np.append(start, len(keys)))
        text = of[np.maximum(np.searchsorted(begin[of], start, "right") - 1, 0)] if len(of) else start
        own = (start >= begin[text]) & (start < begin[text] + windows[text]) if len(of) else np.zeros(len(start), bool)
        start, size, text = start[own], size[own], text[own]
        if len(size) and size.max() > SEGMENT_WINDOWS:
            cuts = -(-size // SEGMENT_WINDOWS)
            first, end = np.repeat(np.cumsum(cuts) - cuts, cuts), np.repeat(start + size, cuts)
            start = np.repeat(start, cuts) + (np.arange(cuts.sum()) - first) * SEGMENT_WINDOWS
            size, text = np.minimum(end - start, SEGMENT_WINDOWS), np.repeat(text, cuts)
        found.append((text + x, keys[start], start - begin[text], size))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(4))


def repeats(text, length: int):
    """Groups of equal ``length``-byte strings in ``text`` (a uint8 array).

    Returns (order, first): positions ordered by their next ``length`` bytes, and
    for each place in the order whether its string differs from the one before.
    The Burrows-Wheeler transform is taken from that order, which tells strings apart up to their segment's end; each
    round of the sort only moves strings that are still equal to another. Starting with the
    intervals of all strings of 10 bytes (told apart by the sort's first rounds; their ends
    are the common prefixes under 10), each round extends the strings of all open
    intervals by one byte to the left (by the last-to-first mapping) and so
    meets the common prefixes of length 10, 11, ... of neighbours in
    increasing order: the end of an interval that no shorter string has marked
    gets the round's value and the interval stays open, any other closes. At ``length`` it stops: exactly
    the neighbours with a common prefix of ``length`` or more are unmarked.
    """
    import numpy as np
    n = len(text)
    data = np.concatenate([text, np.full(length + 8, END, np.uint8)])

    bits = np.uint64(n.bit_length())

    def in_order(key, width, at):
        """``key`` (of ``width`` bits) sorted, and the places ``at`` in that order."""
        if width + int(bits) > 64:
            by_key = np.argsort(key)
            return key[by_key], at[by_key]
        both = np.sort((key << bits) | at.astype(np.uint64))
        return both >> bits, (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)

    covered = min(5, length)
    word = np.ndarray((n,), ">u8", data.tobytes(), strides=(1,)).astype(np.uint64) >> np.uint64(8 * (8 - covered))
    key, order = in_order(word, 8 * covered, np.arange(n))  # places of equal strings may come in any order
    new = np.empty(n + 1, bool)
    new[[0, n]] = True
    np.not_equal(key[1:], key[:-1], out=new[1:n])
    # the rank of a string is the first place of those equal to it, so it stays when other strings are told apart
    rank = np.full(n + length, n, np.uint32)
    rank[order] = np.maximum.accumulate(np.where(new[:n], np.arange(n, dtype=np.uint32), np.uint32(0)))
    ends = np.append(np.flatnonzero(text == END), n)
    left = np.repeat(ends, np.diff(ends, prepend=-1))[:n] - np.arange(n)  # bytes before the segment's end
    rows = np.flatnonzero(~(new[:n] & new[1:]))
    at, start = order[rows], 0
    while covered < length:  # prefix doubling up to `length` bytes, of strings that are not yet told apart and have not ended
        going = left[at] >= covered
        rows, at = rows[going], at[going]
        if not len(rows):
            break
        step = min(covered, length - covered)
        key, at = in_order((rank[at].astype(np.uint64) << bits) | rank[at + step], 2 * int(bits), at)
        order[rows] = at
        first = np.empty(len(rows) + 1, bool)
        first[[0, -1]] = True
        np.not_equal(key[1:], key[:-1], out=first[1:-1])
        rank[at] = np.maximum.accumulate(np.where(first[:-1], rows, 0)).astype(np.uint32)
        if not start:  # the expansion starts with the strings of the first round
            new[rows[first[:-1]]] = True
            start = covered + step
        still = ~(first[:-1] & first[1:])
        rows, at = rows[still], at[still]
        covered += step
    start = start or covered
    transform = data[order - 1]
    transform[order == 0] = END
    by_byte = np.argsort(transform, kind="stable")
    last_to_first = np.empty(n, np.int32)
    last_to_first[by_byte] = np.arange(n, dtype=np.int32)
    byte_start = np.zeros(n + 1, bool)
    byte_start[np.cumsum(np.bincount(transform, minlength=256))[:-1]] = True

    marked = np.zeros(n + 1, bool)
    marked[[0, n]] = True
    marked[1:n] = new[1:n]
    bounds = np.flatnonzero(marked).astype(np.int32)
    low, high = bounds[:-1], bounds[1:]
    owner = np.empty(n, np.int32)
    for _ in range(start, length):
        if not len(low):
            break
        size = high - low
        total = int(size.sum())
        before = np.cumsum(size, dtype=np.int32) - size
        at = np.arange(total, dtype=np.int32) + np.repeat(low - before, size)
        keep = transform[at] != END
        target = last_to_first[at[keep]]
        interval = np.repeat(np.arange(len(low), dtype=np.int32), size)[keep]
        if not len(target):
            break
        # rows of an interval with the same byte before them go to neighbouring places
        if total * 8 > n:
            owner.fill(-1)
            owner[target] = interval
            target = np.flatnonzero(owner >= 0).astype(np.int32)
            interval = owner[target]
        else:
            both = np.sort((target.astype(np.int64) << 32) | interval)
            target, interval = (both >> 32).astype(np.int32), both.astype(np.int32)
        cut = np.empty(len(target), bool)
        cut[0] = True
        cut[1:] = (target[1:] != target[:-1] + 1) | (interval[1:] != interval[:-1]) | byte_start[target[1:]]
        low = target[cut]
        high = target[np.append(np.flatnonzero(cut)[1:], len(target)) - 1] + 1
        fresh = ~marked[high]
        low, high = low[fresh], high[fresh]
        marked[high] = True
    return order, marked[:n]


def smallest_per_window(parts: list[bytes], owners, length: int):
    """For each window of each part, the smallest owner of an equal window in any
    part: (part, first window, last window, smallest owner) arrays of runs."""
    import numpy as np
    sizes = np.array([len(p) for p in parts], np.int64)
    text = np.frombuffer(b"".join([p + bytes([END]) for p in parts]), np.uint8)
    part = np.repeat(np.arange(len(parts)), sizes + 1)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    place = np.arange(len(text)) - begin[part]
    valid = place + length <= sizes[part]
    order, first = repeats(text, length)
    group = np.cumsum(first) - 1
    good = valid[order]
    at, group = order[good], group[good]
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    low = np.minimum.reduceat(owners[part[at]], start)
    smallest = np.empty(len(text), np.int64)
    smallest[at] = np.repeat(low, np.diff(np.append(start, len(at))))
    at = np.flatnonzero(valid)
    cut = np.flatnonzero(np.concatenate([[True], (part[at[1:]] != part[at[:-1]]) | (smallest[at[1:]] != smallest[at[:-1]])]))
    end = np.append(cut[1:], len(at)) - 1
    return part[at[cut]], place[at[cut]], place[at[end]], smallest[at[cut]]


def shared_keys(texts: DataFrame, length: int, parts: int) -> DataFrame:
    """``c`` (class of a text) and ``key`` of every window key that texts of two or
    more classes have. Keys are cut to 32 bits within ``parts`` parts: a chance
    match only costs work.

    Each batch sends a key once: keys that two classes of the batch share are known, so
    only the key itself goes to its part, and a passage that a third of all
    texts hold sends one entry per batch.
    """
    def send(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        # a key within its part, the part and the place of the class fit into 64 bits
        most = 1 << (32 - int(parts).bit_length())
        for batch in (b.slice(at, most) for b in batches for at in range(0, b.num_rows, most)):
            own = batch.column(0).to_numpy()
            by_class = np.argsort(own, kind="stable")
            raws = [x.encode() for x in batch.column(1).take(pa.array(by_class)).to_pylist()]
            number, key, _, _ = segments_of_all(raws, length)
            if not len(key):
                continue
            own, place = np.unique(own[by_class], return_inverse=True)
            bits = np.uint64(32 - int(parts).bit_length())
            packed = np.sort(((((key % np.uint64(parts)) << np.uint64(32)) | (key >> np.uint64(32))) << bits) | place.astype(np.uint64)[number])
            packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]
            key, c = packed >> bits, own[(packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            known = c[start] != c[start + size - 1]
            every = np.repeat(known, size)
            # entries for the parts: each key once; entries known to be shared go by class
            to = np.concatenate([(key[start] >> np.uint64(32)).astype(np.int64),
                                 parts + (c[every] % parts)])
            out_key = np.concatenate([key[start], key[every]]).astype(np.int64)
            out_c = np.concatenate([c[start], c[every]])
            out_known = np.concatenate([known, np.ones(int(every.sum()), bool)])
            order = np.lexsort((out_c, to))  # runs of one class compress well
            to, out_key, out_c, out_known = to[order], out_key[order], out_c[order], out_known[order]
            cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            ends = np.append(cut[1:], len(to))
            low = out_key.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(to[cut].astype(np.int32)),
                 pa.array([(out_key if t >= parts else low)[a:b].tobytes() for t, a, b in zip(to[cut], cut, ends)], pa.binary()),
                 pa.array([out_c[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
                 pa.array([np.packbits(out_known[a:b]).tobytes() for a, b in zip(cut, ends)], pa.binary())],
                ["part", "keys", "classes", "known"])

    def meet(group, table):
        import numpy as np
        import pyarrow as pa
        part = group[0].as_py()
        kind = np.int64 if part >= parts else np.uint32
        keys = [np.frombuffer(x.as_buffer(), kind) for x in table.column("keys")]
        key = np.concatenate(keys).astype(np.int64)
        c = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("classes")])
        if part < parts:
            known = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8))[:len(k)].astype(bool)
                                    for x, k in zip(table.column("known"), keys)])
            order = np.argsort(key, kind="stable")
            key, c, known = key[order], c[order], known[order]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            shared = (np.minimum.reduceat(c, start) != np.maximum.reduceat(c, start)) | np.logical_or.reduceat(known, start)
            # known entries have been sent by class
            keep = np.repeat(shared, size) & ~known
            key, c = key[keep] + (part << 32), c[keep]
        return pa.table({"c": pa.array(c, pa.int64()), "key": pa.array(key, pa.int64())})

    sent = texts.mapInArrow(send, "part int, keys binary, classes binary, known binary")
    return sent.groupBy("part").applyInArrow(meet, "c long, key long")


def shared_segments(texts: DataFrame, length: int, parts: int) -> DataFrame:
    """The segments of each text (``c``, ``id``, ``text``, ``keys``: its shared keys)
    that have a shared key: ``c``, ``id``, ``pos``, ``key``, bytes ``s`` and their hash."""
    def cut(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa
        most = 1 << (32 - int(parts).bit_length())  # as in shared_keys
        for batch in (b.slice(at, most) for b in batches for at in range(0, b.num_rows, most)):
            raws = [x.encode() for x in batch.column(2).to_pylist()]
            number, key, start, size = segments_of_all(raws, length)
            bits = np.uint64(32 - int(parts).bit_length())
            shared = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
            has = np.repeat(np.arange(len(raws), dtype=np.uint64), batch.column(3).value_lengths().to_numpy(zero_copy_only=False))
            short = (key >> np.uint64(32)) | ((key % np.uint64(parts)) << np.uint64(32))
            found = np.isin((short << bits) | number.astype(np.uint64), (shared << bits) | has)
            number, key, start, size = number[found], key[found], start[found], size[found]
            out = [raws[i][x:y] for i, x, y in zip(number.tolist(), start.tolist(), (start + size + length - 1).tolist())]
            h = np.frombuffer(b"".join([hashlib.blake2b(p, digest_size=16).digest() for p in out]), np.int64).reshape(-1, 2)
            at = pa.array(number)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(start), pa.array(key.astype(np.int64)), pa.array(h[:, 0]),
                 pa.array(h[:, 1]), pa.array(out, pa.binary())], ["c", "id", "pos", "key", "h1", "h2", "s"])
    return texts.mapInArrow(cut, "c long, id long, pos long, key long, h1 long, h2 long, s binary")


def covered_windows(segments: DataFrame, length: int, key_segments: int = KEY_SEGMENTS,
                    bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``segments``: distinct ``s`` with hash ``h1``, ``h2``, ``key``, smallest ``id`` and
    ``count``. Returns ``h1``, ``h2``, ``j0``, ``j1``, ``smallest``: the smallest id that has the
    windows j0..j1 of the segment, where that may be another document's.

    Equal windows have equal keys, so segments are dealt by key into buckets of about
    ``bucket_bytes``, one transform each. A key with one segment alone needs none: all places of its
    windows are that segment's. Buckets go to tasks in bounded numbers. Of a key with more than ``key_segments``
    different segments the windows are grouped singly, by Spark.
    """
    spark = segments.sparkSession
    total = segments.agg(F.sum(F.octet_length("s"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    hot = materialize(segments.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
                      .where(F.col("n") > key_segments).select("key"), "hot-keys")

    def expand(group, table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        owners, count = table.column("id").to_numpy(), table.column("count").to_numpy()
        _, key_of, held = np.unique(table.column("key").to_numpy(), return_inverse=True, return_counts=True)
        alone = held[key_of] == 1
        # a segment alone with its key has its own smallest owner in all of its windows
        one = np.flatnonzero(alone & (count > 1))
        size = pc.binary_length(table.column("s")).to_numpy()
        found = [(one, np.zeros(len(one), np.int64), size[one].astype(np.int64) - length, owners[one])]
        rest = np.flatnonzero(~alone)
        if len(rest):
            part, j0, j1, low = smallest_per_window(table.column("s").take(pa.array(rest)).to_pylist(), owners[rest], length)
            part = rest[part]
            keep = (low < owners[part]) | (count[part] > 1)
            found.append((part[keep], j0[keep], j1[keep], low[keep]))
        part, j0, j1, low = (np.concatenate([f[i] for f in found]) for i in range(4))
        return pa.table({"h1": pa.array(table.column("h1").to_numpy()[part]), "h2": pa.array(table.column("h2").to_numpy()[part]),
                         "j0": pa.array(j0, pa.int64()), "j1": pa.array(j1, pa.int64()), "smallest": pa.array(low, pa.int64())})

    schema = "h1 long, h2 long, j0 long, j1 long, smallest long"
    if hot.isEmpty():
        rest = segments
    else:
        rest = segments.join(hot, "key", "left_anti")
    out = (rest.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
           .repartition(max(parallelism(spark), -(-buckets // TASK_BUCKETS)), "bucket").groupBy("bucket").applyInArrow(expand, schema))
    if hot.isEmpty():
        return out
    single = segments.join(hot, "key", "left_semi").select(
        "h1", "h2", "id", "s", F.explode(F.sequence(F.lit(0), F.octet_length("s") - length)).alias("j"))
    single = materialize(single.select("h1", "h2", "id", F.col("j").cast("long").alias("j"),
                                       F.substring("s", F.col("j") + 1, F.lit(length)).alias("w")), "single-windows")
    low = materialize(single.groupBy("w").agg(F.min("id").alias("smallest")), "smallest-single")
    return out.unionByName(single.join(low, "w").select("h1", "h2", F.col("j").alias("j0"), F.col("j").alias("j1"), "smallest"))


def remove_repeats(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text",
                   carry: list[str] | None = None, key_segments: int = KEY_SEGMENTS,
                   bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Remove each byte that a ``length``-byte string covers which also starts in a
    row with a smaller id. Strings are judged on the input; matches stay inside a row.

    1. Rows with equal texts are one class with its smallest id (partial aggregate); the
       others of the class lose everything.
    2. Every window of ``length`` bytes has a key (a minimum over its grams' hashes);
       keys that two classes share are found.
    3. Runs of windows with a shared key are cut out as segments. Distinct segments are dealt
       by key to transforms whose interval expansion finds the equal windows and
       the smallest id that has each.
    4. The runs are joined back to all their places, merged per text and removed.

    Returns the ``carry`` columns (default: all) plus ``n_bytes``, ``n_removed``,
    ``n_spans`` (maximal removed runs) and ``kept_bytes`` (the rest, UTF-8 bytes
    concatenated). Null text is empty. A null id counts as larger than
    every id. Rows of one id don't remove from each other; rows that repeat
    id and text get the same result. An empty table gives an empty result.
    """
    spark = df.sparkSession
    ship_code(spark)
    text = text_or_empty(text_col)
    ids = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID))
    rows = df.select(packed(df, carry), ids.alias("_id"), text.alias("_text"), *row_key(text))
    classes = materialize(rows.groupBy("_k1", "_k2").agg(F.min("_id").alias("_first"), F.max(F.octet_length("_text")).alias("_n")), "classes")
    total = classes.agg(F.sum("_n")).first()[0] or 0
    parts = max(1, total // (18 * PART_KEYS))  # a text has a key per 18 bytes or so
    texts = rows.where(F.octet_length("_text") >= length)

    keys = shared_keys(texts.select("_k1", "_text"), length, parts)
    own_keys = materialize(keys.groupBy("c").agg(F.collect_set("key").alias("keys")), "shared-keys")
    del keys
    release(spark)
    lists = own_keys.join(classes.select(F.col("_k1").alias("c"), F.col("_first").alias("_id")), "c")
    near = (texts.select(F.col("_k1").alias("c"), "_id", "_text").join(lists, ["c", "_id"])
            .select("c", F.col("_id").alias("id"), "_text", "keys"))
    found = materialize(shared_segments(near, length, parts), "segments")
    release(spark, own_keys)
    # one class has one id here, so the smallest id of a segment is that of its first text
    distinct = materialize(found.groupBy("h1", "h2").agg(
        F.min("s").alias("s"), F.min("key").alias("key"), F.min("id").alias("id"), F.count(F.lit(1)).alias("count")), "distinct-segments")
    release(spark)
    covered = materialize(covered_windows(distinct, length, key_segments, bucket_bytes), "covered")
    release(spark, distinct)
    spans = (found.select("h1", "h2", "c", "id", "pos").join(covered, ["h1", "h2"]).where("id > smallest")
             .groupBy("c", "id").agg(F.collect_set(F.struct(
                 (F.col("pos") + F.col("j0")).alias("a"), (F.col("pos") + F.col("j1") + length).alias("b"))).alias("spans")))
    spans = materialize(spans, "spans")
    release(spark, found, covered)

    known = classes.join(spans, (classes["_k1"] == spans["c"]) & (classes["_first"] == spans["id"]), "left")
    known = materialize(known.select("_k1", "_k2", "_first", "spans"), "class-spans")
    joined = rows.join(known, ["_k1", "_k2"])
    whole = (F.col("_id") > F.col("_first")) & (F.octet_length("_text") >= length)
    spans_of = F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("a"), F.octet_length("_text").cast("long").alias("b")))) \
        .when(F.col("_id") == F.col("_first"), F.col("spans"))

    @F.pandas_udf("n_removed long, n_spans long, kept_bytes binary")
    def cut(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        import numpy as np
        out = []
        for t, a, b in zip(text, starts, ends):
            raw = t.encode()
            if a is None or not len(a):
                out.append((0, 0, raw))
                continue
            order = np.argsort(a, kind="stable")
            a, b = np.asarray(a)[order], np.maximum.accumulate(np.asarray(b)[order])
            new = np.concatenate([[True], a[1:] > b[:-1]])
            first, last = a[new], np.append(b[np.flatnonzero(new)[1:] - 1], b[-1])
            kept = b"".join([raw[x:y] for x, y in zip([0, *last.tolist()], [*first.tolist(), len(raw)])])
            out.append((len(raw) - len(kept), len(first), kept))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_bytes"])

    joined = joined.withColumn("_spans", spans_of)
    joined = joined.withColumn("_cut", cut("_text", F.col("_spans.a"), F.col("_spans.b")))
    out = joined.select("_row", F.octet_length("_text").cast("long").alias("n_bytes"), "_cut.*")
    return out.select(*unpacked(out, ["n_bytes", "n_removed", "n_spans", "kept_bytes"]))
