"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_code
from .common import materialize, packed, release, row_key, text_or_empty
from .components import components

#: 64-bit words of the bitmap that the joins compare; words cached in a task; orders by which tiles pick leaders.
BITMAP_WORDS, CACHED_WORDS, LEADER_ORDERS = 8, 300_000, 4
#: A tile hash with more rows than this (and than one row in RARE_SHARE) counts as frequent.
FREQUENT_ROWS, RARE_SHARE = 256, 100_000
#: Rounds that compare with a leader; rounds at most that compare the rows of a large tile in parts of about PART_ROWS, and the
#: share (one in SETTLED) of its rows that must still find links for another such round.
LEADER_ROUNDS, PART_ROUNDS, PART_ROWS, SETTLED = 1, 4, 64, 10
#: Hashes that a signature holds beyond one and a half prefixes.
SPARE = 8
BITS = [f"b{i}" for i in range(BITMAP_WORDS)]


class ShingleSets:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, size: int):
        self.size, self.cache = size, {}

    def _hash(self, word: bytes) -> int:
        if len(self.cache) >= CACHED_WORDS:
            self.cache.clear()
        out = self.cache[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return out

    def of(self, text: str):
        """A-Z in lower case; words are runs of anything but ASCII white space; a text of fewer
        words than a shingle has is one shingle, one without words has none."""
        import numpy as np
        words = text.encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        get = self.cache.get
        h = np.fromiter([get(w) or self._hash(w) for w in words], np.uint64, len(words))
        size = min(self.size, len(h))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - size + 1, size, np.uint64)
            for i in range(size):
                out = (out ^ h[i:len(h) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(32)
        return np.unique(out)


def prefix_length(n: int, num: int, den: int) -> int:
    """So many smallest hashes of a set of ``n`` that any two linked sets share one."""
    return n - -(-num * n // den) + 1


def folded(bitmap, size: int):
    """The bitmap (bytes, as an array) folded to ``size`` bytes."""
    while len(bitmap) > size:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def signatures(docs: DataFrame, size: int, num: int, den: int, frequent=None) -> DataFrame:
    """``id``, ``n``, class hash ``c1``, ``c2``, bitmap ``b0..``, ``wide`` and ``prefix`` of each row (``id``, ``text`` and
    other columns, which are carried).

    A bit of the bitmap is the parity of the shingles hashed to it, so the bits
    in which two bitmaps differ are at most the shingles in which the sets
    differ. ``wide`` has a bit for each shingle or more (null if ``b0..`` has);
    its halves xor-ed are the bitmap of half the width, down to ``b0..``.
    The prefix holds the smallest hashes, those in ``frequent`` last; without
    ``frequent`` half as many again, to fill up from (see ``reordered``).
    """
    def sign(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        sets, least = ShingleSets(size), 64 * BITMAP_WORDS
        for batch in batches:
            n, keys, maps, wide, prefixes = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                a = sets.of(text)
                n.append(len(a))
                keys.append(np.frombuffer(hashlib.blake2b(a.tobytes(), digest_size=16).digest(), np.int64))
                bits = max(least, 1 << (len(a) - 1).bit_length()) if len(a) else least
                odd = np.bincount((a & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                odd = np.packbits(odd.astype(np.uint8))
                wide.append(odd.tobytes() if bits > least else None)
                maps.append(folded(odd, least // 8).view(np.int64))
                p = prefix_length(len(a), num, den) if len(a) else 0
                if frequent is None:
                    p += p // 2 + SPARE
                else:
                    rare = ~np.isin(a, frequent, assume_unique=True)
                    a = np.concatenate([a[rare][:p], a[~rare][:p]])
                prefixes.append(a[:p].view(np.int64))
            keys, maps = np.array(keys).reshape(-1, 2), np.array(maps).reshape(-1, BITMAP_WORDS)
            ends = np.cumsum([0, *map(len, prefixes)])
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                              pa.array(np.concatenate([*prefixes, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                 *[pa.array(maps[:, i]) for i in range(BITMAP_WORDS)], pa.array(wide, pa.binary()), prefix, *batch.columns[2:]],
                ["id", "n", "c1", "c2", *BITS, "wide", "prefix", *carried])

    schema = "id long, n long, c1 long, c2 long, " + "".join(f"{b} long, " for b in BITS) + "wide binary, prefix array<long>"
    carried = docs.columns[2:]
    schema += "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.schema[2:])
    return docs.mapInArrow(sign, schema)


def reordered(classes: DataFrame, num: int, den: int, frequent) -> DataFrame:
    """``id``, ``n`` and ``prefix`` with the hashes in ``frequent`` last; ``prefix`` is
    null where too few other hashes are known, so the text must be read again."""
    def fill(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            out = []
            for n, known in zip(batch.column(1).to_pylist(), batch.column(2)):
                a, p = known.values.to_numpy(zero_copy_only=False).view(np.uint64), prefix_length(n, num, den)
                at = np.minimum(np.searchsorted(frequent, a), len(frequent) - 1)
                rare = frequent[at] != a
                if rare.sum() >= p or len(a) == n:
                    out.append(np.concatenate([a[rare], a[~rare]])[:p].view(np.int64))
                else:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))],
                                             ["id", "n", "prefix"])
    return classes.select("id", "n", "prefix").mapInArrow(fill, "id long, n long, prefix array<long>")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """``id`` and the sorted set (``shingles``, 8 bytes each) of each row (``id``, ``text``); of equal
    rows in a task the first."""
    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa
        sets, seen = ShingleSets(size), set()
        for batch in batches:
            ids, out = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i not in seen:
                    seen.add(i)
                    ids.append(i)
                    out.append(sets.of(t).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "shingles"])
    return docs.mapInArrow(build, "id long, shingles binary")


def sizes_fit(n: Column, m: Column, num: int, den: int) -> Column:
    return F.least(n, m) * den >= F.greatest(n, m) * num


def bitmaps_fit(n: Column, m: Column, a: list[Column], b: list[Column], num: int, den: int) -> Column:
    """False only if the bit counts prove the overlap too small: at least ``differ``
    shingles are in one set alone, so the overlap is at most (n + m - differ) / 2."""
    differ = reduce(lambda x, y: x + y, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)])
    return (n + m - differ) * den >= (n + m + differ) * num


def wide_bitmaps_fit(pairs: DataFrame, wide: DataFrame, num: int, den: int) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) that pass the bit-count bound of their wide bitmaps
    too; pairs in which one text is too short to have one pass."""
    side = lambda s: wide.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("wide").alias(f"w{s}"))

    def fit(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            keep = []
            for n, x, m, y in zip(*[batch.column(i) for i in range(2, 6)]):
                if not x.is_valid or not y.is_valid:
                    keep.append(True)
                    continue
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                size, total = min(len(x), len(y)), n.as_py() + m.as_py()
                differ = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
                keep.append((total - differ) * den >= (total + differ) * num)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "wa", "nb", "wb")
    return both.mapInArrow(fit, "a long, b long")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id`` and ``text`` of the ``wanted`` rows (``id`` and key)."""
    return docs.join(wanted, ["_k1", "_k2"]).select("id", "text")


def linked(pairs: DataFrame, docs: DataFrame, keys: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) whose sets link, by exact intersection of sorted arrays, written.
    Sets are made of the documents in ``pairs`` alone, found by their ``keys``."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    ids = materialize(ids.join(keys, "id"), "candidates")
    sets = materialize(shingle_sets(texts_of(docs, ids), size), "shingle-sets")
    release(docs.sparkSession, ids)
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb"))

    def verify(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                common = int((large[at] == small).sum())
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = materialize(both.mapInArrow(verify, "a long, b long").distinct(), "found")
    release(docs.sparkSession, sets)
    return found


def tile_pairs(rows: DataFrame, num: int, den: int, among: Column, tile: tuple[str, ...] = ("h", "band")) -> DataFrame:
    """The pairs (``a`` < ``b``) of ids in one tile for which ``among`` holds and that
    pass the size and the bit-count bound."""
    x, y = rows.alias("x"), rows.alias("y")
    col = lambda s, c: F.col(f"{s}.{c}")
    pairs = x.join(y, reduce(lambda c, d: c & d, [col("x", c) == col("y", c) for c in tile])
                   & (col("x", "id") < col("y", "id")) & among
                   & sizes_fit(col("x", "n"), col("y", "n"), num, den)
                   & bitmaps_fit(col("x", "n"), col("y", "n"), [col("x", b) for b in BITS],
                                 [col("y", b) for b in BITS], num, den))
    return pairs.select(col("x", "id").alias("a"), col("y", "id").alias("b")).distinct()


def tiled(df: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int) -> tuple[DataFrame, ...]:
    """Steps 1 and 2 of ``linked_rows``: the texts by key, every row (number ``id``, ``own`` id, key, ``n`` and class),
    the classes of equal sets (``id``: the smallest number stands for the class; ``own``: the smallest id), the rows
    of the tiles, and the classes' bitmaps and wide bitmaps."""
    spark = df.sparkSession
    ship_code(spark)
    own = F.col(f"`{id_col}`")
    docs = df.select(text_or_empty(text_col).alias("text"), own.alias("own"), *row_key(own, text_or_empty(text_col)))
    numbers = F.monotonically_increasing_id().alias("id")
    signed = materialize(signatures(docs.select(numbers, "text", "own", "_k1", "_k2"), size, num, den), "signatures")
    first = lambda c: F.first(c).alias(c)  # noqa: E731  equal in a class
    classes = materialize(signed.where("n > 0 and own is not null").groupBy("c1", "c2").agg(
        F.min(F.struct("id", "_k1", "_k2")).alias("_rep"), F.min("own").alias("own"),
        *[first(c) for c in ("n", *BITS, "wide", "prefix")]).select("c1", "c2", "_rep.*", "own", "n", *BITS, "wide", "prefix"), "classes")
    rows = materialize(signed.select("id", "own", "_k1", "_k2", "n", "c1", "c2"), "rows")
    release(spark, signed)
    docs = docs.drop("own")

    length = (F.col("n") - F.floor((F.col("n") * num + (den - 1)) / den) + 1).cast("int")
    prefixes = classes.select("id", "n", F.explode_outer(F.slice("prefix", F.lit(1), length)).alias("h"))
    counts = materialize(prefixes.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "tile-counts")
    release(spark)
    total = classes.agg(F.sum(length.cast("long"))).first()[0] or 0
    often = [r.h for r in counts.where(F.col("k") > max(FREQUENT_ROWS, total // RARE_SHARE)).select("h").collect()]
    if often:
        import numpy as np
        frequent = np.sort(np.array(often, np.int64).view(np.uint64))
        filled = materialize(reordered(classes, num, den, frequent), "prefixes")
        short = materialize(filled.where("prefix is null").select("id").join(classes.select("id", "_k1", "_k2"), "id"), "short-prefixes")
        again = signatures(texts_of(docs, short), size, num, den, frequent).select("id", "n", "prefix").dropDuplicates(["id"])
        prefixes = filled.where("prefix is not null").unionByName(again)
        prefixes = prefixes.select("id", "n", F.explode_outer("prefix").alias("h"))
        release(spark, counts)
        counts = materialize(prefixes.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "tile-counts")
        release(spark)
    # a hair wider than the size bound, so that rounding never puts linked sets two bands apart
    band = F.floor(F.log(F.col("n").cast("double")) / (F.log(F.lit(den / num)) * (1 + 1e-9))).cast("int")
    tiles = prefixes.join(counts.select("h"), "h", "left_semi").select(
        "h", "id", "n", F.explode(F.array(band, band + 1)).alias("band"))
    tiles = materialize(tiles.withColumn("comp", F.col("id")), "tiles")
    slim = materialize(classes.drop("prefix"), "classes")
    release(spark, classes, counts, *([filled, short] if often else []))
    return docs, rows, slim, tiles, slim.select("id", "n", *BITS), slim.select("id", "n", "wide")


def linked_rows(df: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int) -> DataFrame:
    """One row per row of ``df``: its id ``own``, its key, ``n`` (size of its set) and ``component``, the smallest id
    reachable by links (its own id if its set is empty, null if its id is), and ``group``, which tells apart components
    whose smallest ids are equal (null for both). See ``jaccard_components``."""
    spark = df.sparkSession
    docs, rows, classes, tiles, bitmaps, wide = tiled(df, id_col, text_col, size, num, den)
    keys = classes.select("id", "_k1", "_k2")
    links: DataFrame | None = None
    labels: DataFrame | None = None
    turn, last, done = 0, LEADER_ROUNDS + PART_ROUNDS, 0
    while turn <= last:
        open_tiles = tiles.groupBy("h", "band").agg(
            F.count(F.lit(1)).alias("k"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
            F.min(F.struct(F.col("id").bitwiseXOR(F.xxhash64(F.lit(turn), F.pmod("h", F.lit(LEADER_ORDERS)))).alias("o"),
                           "id", "comp", "n")).alias("leader")).where("lo < hi").where(F.col("k") > done)
        open_tiles = materialize(open_tiles.select("h", "band", "k", F.col("leader.id").alias("leader"), F.col("leader.n").alias("leader_n"),
                                                   F.col("leader.comp").alias("leader_comp")), "open-tiles")
        if turn < LEADER_ROUNDS:
            pairs = (tiles.join(open_tiles, ["h", "band"]).where("comp <> leader_comp")
                     .where(sizes_fit(F.col("n"), F.col("leader_n"), num, den))
                     .select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct())
            for side in "ab":
                one = bitmaps.toDF(*[f"{side}_{c}" for c in bitmaps.columns])
                pairs = pairs.join(one, F.col(side) == F.col(f"{side}_id"))
            pairs = pairs.where(bitmaps_fit(
                F.col("a_n"), F.col("b_n"), [F.col(f"a_{b}") for b in BITS], [F.col(f"b_{b}") for b in BITS], num, den))
        else:
            if open_tiles.isEmpty():
                break
            # a tile of up to PART_ROWS rows is one part: all its pairs are compared, and it is done
            parts = F.ceil(F.col("k") / PART_ROWS) if turn < last else F.lit(1)
            part = F.pmod(F.xxhash64("id", F.lit(turn), F.pmod("h", F.lit(LEADER_ORDERS))), parts).alias("part")
            rest = materialize(tiles.join(open_tiles.select("h", "band", "k"), ["h", "band"]).select("h", "band", "k", part, "id", "n", "comp")
                               .join(bitmaps.drop("n"), "id"), "open-rows")
            pairs = tile_pairs(rest, num, den, F.col("x.comp") != F.col("y.comp"), ("h", "band", "part"))
            done = PART_ROWS
        pairs = materialize(wide_bitmaps_fit(pairs.select("a", "b"), wide, num, den), "pairs")
        release(spark, open_tiles)
        if pairs.isEmpty():
            if turn == last:
                break
            turn = turn + 1 if turn < LEADER_ROUNDS else last
            continue
        found = linked(pairs, docs, keys, size, num, den)
        links = found if links is None else links.unionByName(found)
        labels = materialize(components(links), "labels")
        release(spark, pairs)
        if turn == last:
            break
        before = tiles
        tiles = materialize(tiles.drop("comp").join(labels.withColumnRenamed("component", "comp"), "id", "left")
                            .withColumn("comp", F.coalesce("comp", "id")), "tiles")
        release(spark, before)
        large = None if turn < LEADER_ROUNDS else rest.where(F.col("k") > PART_ROWS).agg(F.count_distinct("id")).first()[0]
        turn = turn + 1 if large is None or found.count() * SETTLED >= large else last
    named = classes.select("c1", "c2", "id", "own")
    if labels is not None:
        # components are named by numbers of rows; a result names them by their smallest id
        member = materialize(labels.join(named.select("id", "own"), "id"), "members")
        least = materialize(member.groupBy("component").agg(F.min("own").alias("least")), "smallest-ids")
        named = named.join(member.select("id", "component").join(least, "component"), "id", "left").select(
            "c1", "c2", F.coalesce("least", "own").alias("component"), F.coalesce("component", "id").alias("group"))
    else:
        named = named.select("c1", "c2", F.col("own").alias("component"), F.col("id").alias("group"))
    named = materialize(named, "class-components")
    release(spark, tiles, classes)
    out = rows.join(named, ["c1", "c2"], "left")
    component = F.when(F.col("own").isNotNull(), F.coalesce("component", "own"))
    return out.select("own", "_k1", "_k2", "n", component.alias("component"), "group")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3,
                       num: int = 90, den: int = 100) -> DataFrame:
    """Documents linked by ``den`` * intersection >= ``num`` * union of their word-shingle sets.

    1. One pass over the texts makes set sizes, class hashes, bitmaps and
       prefixes. Documents with equal sets are one class, by a partial aggregate.
    2. Classes that share a hash of their prefixes fall into tiles of that hash and
       a band of set sizes (each band reaches to the next, so linked sets share a
       tile); the prefix filter loses no link. Hashes in many prefixes
       (at most 100,000 of them) come last in the order of the prefix.
    3. A first round compares each member of a tile with a leader only. The next
       compares all pairs of small tiles, and those within parts of about 64 rows of large
       ones, dealt anew as long as that links many. Members of
       one component by then are not compared again, so a group of near copies
       costs its size, not its square, whether or not they all link to each other.
       The last round compares every pair left in a large tile. Each pair passes the size bound, the bit-count bound and the
       exact intersection of the sorted arrays.

    Returns one row per input row: the id, ``n_shingles`` and ``component_id``
    (smallest id reachable, itself included). Null text is empty; an empty set is
    linked with nothing. Equal rows and ids repeat in the result; rows that share an id
    but not their text are linked each by its own text; a row
    with a null id links nothing and has a null component. Ids may be of any type that can
    be ordered. An empty table gives an empty result.
    """
    out = linked_rows(df, id_col, text_col, size, num, den)
    return out.select(F.col("own").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def jaccard_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3,
                  num: int = 90, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """The whole join in general form: all linked pairs of classes, and who belongs to a class.

    Documents with equal shingle sets are one class, named by its smallest id. Returns the links
    (``a`` < ``b``: every two classes with ``den`` * intersection >= ``num`` * union) and the
    members (the id, ``n_shingles`` and ``class_id``, one row per input row; null for an
    empty set or a null id). Two documents link if their classes are equal or linked.
    Unlike ``jaccard_components`` every pair of a tile that passes the bounds is compared, so
    a group of near copies costs the square of its size, as its list of links does.
    """
    docs, rows, classes, tiles, bitmaps, wide = tiled(df, id_col, text_col, size, num, den)
    tile_rows = materialize(tiles.join(bitmaps.drop("n"), "id"), "tile-rows")
    pairs = materialize(wide_bitmaps_fit(tile_pairs(tile_rows, num, den, F.lit(True)), wide, num, den), "pairs")
    found = linked(pairs, docs, classes.select("id", "_k1", "_k2"), size, num, den)
    name = lambda c: classes.select(F.col("id").alias(c), F.col("own").alias(f"{c}_own"))
    links = found.join(name("a"), "a").join(name("b"), "b").select(
        F.least("a_own", "b_own").alias("a"), F.greatest("a_own", "b_own").alias("b"))
    members = rows.join(classes.select("c1", "c2", F.col("own").alias("class_id")), ["c1", "c2"], "left")
    own = F.when(F.col("own").isNotNull() & (F.col("n") > 0), F.col("class_id"))
    return links, members.select(F.col("own").alias(id_col), F.col("n").alias("n_shingles"), own.alias("class_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80,
             den: int = 100) -> DataFrame:
    """The rows of ``df`` without those that links join to a row of smaller id; one of each group stays.

    Rows are told apart by id and text: rows that share an id but not their text are
    separate documents (of two in one group with the same smallest id, one stays), and of whole copies of a row one stays.
    Rows with a null id or an empty set stay, all of them. Ids may be of any type that can be ordered; input columns may have any names.
    """
    found = linked_rows(df, id_col, text_col, size, num, den).where("own is not null and n > 0")
    found = materialize(found.groupBy("group", "own", "_k1", "_k2").agg(F.count(F.lit(1)).alias("copies")), "grouped")
    best = found.groupBy("group").agg(F.min(F.struct("own", "_k1", "_k2")).alias("best"), F.sum("copies").alias("rows"))
    best = materialize(best.where("rows > 1"), "kept-of-groups")
    found = found.join(best, "group").withColumn("kept", F.struct("_k1", "_k2") == F.struct("best._k1", "best._k2"))
    found = materialize(found.where("not kept or copies > 1").select("_k1", "_k2", "kept"), "copies")
    rows = df.select(packed(df, None), *row_key(F.col(f"`{id_col}`"), text_or_empty(text_col)))
    columns = [F.col("_row").getField(c).alias(c) for c in df.columns]
    again = found.where("kept").select("_k1", "_k2")
    if again.isEmpty():
        return rows.join(found.select("_k1", "_k2"), ["_k1", "_k2"], "left_anti").select(*columns)
    once = rows.join(found.select("_k1", "_k2"), ["_k1", "_k2"], "left_anti")
    return once.unionByName(rows.join(again, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])).select(*columns)
