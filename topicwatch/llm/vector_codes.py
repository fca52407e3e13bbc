"""Vector code compression: product codebooks by Lloyd's rounds over partition-local cover trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_code
from .common import materialize

#: Integer components per unit, most components of a code (absolute value) and rows that one cover tree holds.
SCALE, LIMIT, CHUNK = 1024, 1 << 26, 2048
#: Shrinkage of a cover tree's radius from one level to the next, and points of a node that is not split.
BASE, LEAF = 1.4, 4


def square_distances(points, entries):
    """Exact squared Euclidean distances of integer rows: in doubles while all sums stay
    below 2**53, else in 64-bit integers."""
    import numpy as np
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * max(1, points.shape[1]) < 1 << 53:
        x, e = points.astype(np.float64), entries.astype(np.float64)
        out = x @ (-2.0 * e.T)
        out += (x * x).sum(1)[:, None]
        out += (e * e).sum(1)[None, :]
        return out
    out = np.empty((len(points), len(entries)), np.int64)
    for j, e in enumerate(entries.astype(np.int64)):
        difference = points.astype(np.int64) - e
        out[:, j] = (difference * difference).sum(1)
    return out


@dataclass
class CoverTree:
    """A cover tree of a set of points, as arrays.

    ``order`` lists the points so that each subtree is a run. Node i has a ``center`` (a point), its
    subtree's points ``order[start:end]``, all within ``radius`` of the center, and the children
    ``child[i]`` to ``child[i + 1]``, whose centers cover the node's points within its radius / ``BASE`` and
    lie further apart than that; the node's own center is its first child's.
    """
    order: object
    center: object
    start: object
    end: object
    radius: object
    child: object

    def to_bytes(self) -> bytes:
        import numpy as np
        numbers = [self.order, self.center, self.start, self.end, self.child]
        head = np.array([len(self.order), len(self.center)], np.int32)
        return head.tobytes() + b"".join([a.astype(np.int32).tobytes() for a in numbers]) + self.radius.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CoverTree:
        import numpy as np
        n, nodes = np.frombuffer(raw, np.int32, 2).tolist()
        parts, at = [], 8
        for size in (n, nodes, nodes, nodes, nodes + 1):
            parts.append(np.frombuffer(raw, np.int32, size, at))
            at += 4 * size
        order, center, start, end, child = parts
        return cls(order, center, start, end, np.frombuffer(raw, np.float64, nodes, at), child)


def cover_tree(points) -> CoverTree:
    """The cover tree of integer ``points`` (one at least)."""
    import numpy as np
    away = square_distances(points, points)
    order = np.arange(len(points))
    center, start, end, first = [0], [0], [len(points)], []
    radius = [float(np.sqrt(away[0].max()))]
    node = 0
    while node < len(center):  # breadth first, so children are neighbours
        first.append(len(center))
        a, b, c, r = start[node], end[node], center[node], radius[node]
        if b - a > LEAF and r > 0:
            own, reach = order[a:b], (r / BASE) ** 2
            to, child = np.full(b - a, -1), 0
            open_, pick, reached = np.arange(b - a), c, []
            while True:
                near = away[pick, own[open_]]
                covered = near <= reach
                to[open_[covered]] = child
                center.append(int(pick))
                reached.append(float(near[covered].max()))
                open_ = open_[~covered]
                if not len(open_):
                    break
                pick, child = own[open_[0]], child + 1
            by_child = np.argsort(to, kind="stable")
            order[a:b] = own[by_child]
            bounds = a + np.concatenate([[0], np.cumsum(np.bincount(to, minlength=child + 1))])
            start += bounds[:-1].tolist()
            end += bounds[1:].tolist()
            radius += np.sqrt(reached).tolist()
        node += 1
    return CoverTree(order, np.array(center), np.array(start), np.array(end), np.array(radius), np.array([*first, len(center)]))


def nearest(tree: CoverTree, points, entries):
    """For each place in ``tree.order`` the nearest entry (ties to the lower index), and the runs
    (start, end, entry) that make it up.

    Level by level: with d1 and d2 the distances of a node's center from its two nearest entries, no point of
    the subtree is nearer to another entry than the first if d1 + 2 * radius < d2, so the run is assigned as a whole. Nodes that
    this leaves open descend to their children, points of open leaves are compared exactly.
    """
    import numpy as np
    runs = []
    level, loose = np.array([0]), []
    while len(level):
        away = square_distances(points[tree.center[level]], entries)
        best = away.argmin(1)
        least = np.sqrt(away[np.arange(len(level)), best].astype(np.float64))
        radius = tree.radius[level]
        if len(entries) > 1:
            away[np.arange(len(level)), best] = away.max() + 1
            second = np.sqrt(away.min(1).astype(np.float64))
            # the margin covers the rounding of the roots; a radius of 0 is a run of equal points
            sure = (radius == 0) | ((least + 2 * radius) * (1 + 1e-9) < second)
        else:
            sure = np.ones(len(level), bool)
        done = level[sure]
        runs.append((tree.start[done], tree.end[done], best[sure]))
        level = level[~sure]
        n = tree.child[level + 1] - tree.child[level]
        leaves = level[n == 0]
        loose += [np.arange(a, b) for a, b in zip(tree.start[leaves], tree.end[leaves])]
        level, n = level[n > 0], n[n > 0]
        level = np.repeat(tree.child[level] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    if loose:
        at = np.concatenate(loose)
        best = square_distances(points[tree.order[at]], entries).argmin(1)
        runs.append((at, at + 1, best))
    start, end, entry = (np.concatenate([r[i] for r in runs]) for i in range(3))
    return start, end, entry


def quantised(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """``id``, ``label`` and ``q`` (components floor(``scale`` * x) as 32-bit integers) of every row whose
    vector and components are not null and finite; ``q`` is null if a component reaches ``LIMIT``."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"),
                     F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def floors(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            rows = batch.filter(batch.column(2).is_valid())
            vectors = rows.column(2)
            ends = vectors.offsets.to_numpy().astype(np.int64)
            x = vectors.values.to_numpy(zero_copy_only=False)
            odd = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.floor(x * scale)
                large = np.concatenate([[0], np.cumsum(~(np.abs(whole) < LIMIT))])
            good = odd[ends[1:]] == odd[ends[:-1]]
            fits = large[ends[1:]] == large[ends[:-1]]
            codes = np.where(np.abs(whole) < LIMIT, whole, 0).astype("<i4").tobytes()
            q = [codes[4 * a:4 * b] if f else None for a, b, g, f in zip(ends[:-1], ends[1:], good, fits) if g]
            rows = rows.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(q, pa.binary())], ["id", "label", "q"])

    return rows.mapInArrow(floors, f"id {types['id']}, label {types['label']}, q binary")


def planted_trees(rows: DataFrame, parts: int, width: int) -> DataFrame:
    """One row per chunk of a partition's ``rows``: ``ids``, ``labels``, the ``points`` and a
    cover tree of each of the ``parts`` parts of ``width`` components."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def plant(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                rows = batch.slice(at, CHUNK)
                raw = b"".join(rows.column(2).to_pylist())
                points = np.frombuffer(raw, "<i4").reshape(rows.num_rows, parts, width)
                trees = [cover_tree(points[:, p]).to_bytes() for p in range(parts)]
                one = [pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(i)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*one, pa.array([raw], pa.binary()), pa.array([trees], pa.list_(pa.binary()))],
                                                 ["ids", "labels", "points", "trees"])

    return rows.mapInArrow(plant, f"ids array<{types['id']}>, labels array<{types['label']}>, points binary, trees array<binary>")


def lloyd_round(chunks: DataFrame, codebooks, parts: int, width: int):
    """The codebooks after one round: each entry is the floor of its parts' mean, unused ones stay.

    A task returns one row per entry it used: a count and sums, those of whole subtrees taken from cumulative
    sums along the tree's order. The driver gets one row per entry.
    """
    def sums(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        size = codebooks.shape[1]
        count, total = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64)
        for batch in batches:
            for raw, trees in zip(batch.column("points").to_pylist(), batch.column("trees").to_pylist()):
                points = np.frombuffer(raw, "<i4").reshape(-1, parts, width)
                for p in range(parts):
                    own, tree = points[:, p], CoverTree.from_bytes(trees[p])
                    start, end, entry = nearest(tree, own, codebooks[p])
                    running = np.concatenate([np.zeros((1, width), np.int64), np.cumsum(own[tree.order], 0, dtype=np.int64)])
                    np.add.at(count[p], entry, end - start)
                    np.add.at(total[p], entry, running[end] - running[start])
        p, e = np.nonzero(count)
        columns = [p.astype(np.int32), e.astype(np.int32), count[p, e], *total[p, e].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)

    names = ["part", "entry", "n", *[f"s{i}" for i in range(width)]]
    schema = "part int, entry int, " + ", ".join(f"{n} long" for n in names[2:])
    rows = chunks.select("points", "trees").mapInArrow(sums, schema)
    new = codebooks.copy()
    for r in rows.groupBy("part", "entry").agg(*[F.sum(n).alias(n) for n in names[2:]]).collect():
        new[r.part, r.entry] = [s // r.n for s in r[3:]]
    return new


def coded(chunks: DataFrame, codebooks, parts: int, width: int) -> DataFrame:
    """``id``, ``label``, ``code`` (two hex digits per part) and ``error`` of every row of ``chunks``."""
    types = {f.name: f.dataType.elementType.simpleString() for f in chunks.schema if f.name in ("ids", "labels")}

    def assign(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for i, (raw, trees) in enumerate(zip(batch.column("points").to_pylist(), batch.column("trees").to_pylist())):
                points = np.frombuffer(raw, "<i4").reshape(-1, parts, width)
                code, error = np.empty((len(points), parts), np.uint8), np.zeros(len(points), np.int64)
                for p in range(parts):
                    own, tree = points[:, p], CoverTree.from_bytes(trees[p])
                    start, end, entry = nearest(tree, own, codebooks[p])
                    by_start = np.argsort(start)
                    found = np.empty(len(own), np.int64)
                    found[tree.order] = np.repeat(entry[by_start], (end - start)[by_start])
                    code[:, p] = found
                    away = own.astype(np.int64) - codebooks[p][found]
                    error += (away * away).sum(1)
                text = code.tobytes().hex()
                ids, labels = (batch.column(c).slice(i, 1).flatten() for c in ("ids", "labels"))
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array([text[j:j + 2 * parts] for j in range(0, len(text), 2 * parts)] if parts else [], pa.string()),
                     pa.array(error)], ["id", "label", "code", "error"])

    return chunks.mapInArrow(assign, f"id {types['ids']}, label {types['labels']}, code string, error long")


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4,
                 entries: int = 256, rounds: int = 4, scale: int = SCALE) -> tuple[DataFrame, list]:
    """Codes of all vectors by ``parts`` product codebooks of ``entries`` (at most 256) entries, and the codebooks.

    Components become integers floor(``scale`` * x), so all sums and distances are exact and no result depends on the
    partitioning. A part's codebook starts as that part of the ``entries`` vectors of smallest id and takes
    ``rounds`` of Lloyd's algorithm: every part to its nearest entry (squared Euclidean distance, ties to the lower
    index), every entry to the floor of its parts' mean; unused entries stay.

    Each partition's rows are planted once as cover trees of up to ``CHUNK`` points per part and written with the rows; a round
    reads them and returns one row of sums per task and entry. A subtree that the triangle inequality proves to have one
    nearest entry goes there as a whole, with its sum from cumulative sums; only ambiguous nodes
    descend, down to exact comparisons. The driver holds the codebooks, whose size is fixed.

    Returns the rows (the id, ``label_col``, ``code``, ``error``: squared distance over all parts) and the codebooks
    as lists of integers by part, entry and place. Rows whose vector is null or has a null or non-finite component are left
    out. Kept rows whose vector has another length than that of the smallest id, a length that ``parts`` doesn't divide, or a component
    of ``LIMIT`` or more take no part and have a null code and error. Null ids come last, rows that repeat an id go by their components. An
    empty table gives no rows and empty codebooks.
    """
    import numpy as np
    ship_code(df.sparkSession)
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits per part: 1 to 256 entries")
    rows = materialize(quantised(df, id_col, vector_col, label_col, scale), "quantised")
    order = [F.asc_nulls_last("id"), F.asc("q")]
    lead = rows.where("q is not null").orderBy(*order).select("q").first()
    names = {"id": id_col, "label": label_col}
    uncoded = lambda df: df.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if lead is None or len(lead.q) // 4 % parts:
        return uncoded(rows).withColumnsRenamed(names), [[] for _ in range(parts)]
    fit = F.coalesce(F.octet_length("q") == len(lead.q), F.lit(False))
    width = len(lead.q) // 4 // parts
    seeds = rows.where(fit).orderBy(*order).select("q").limit(entries).collect()
    codebooks = np.stack([np.frombuffer(r.q, "<i4").astype(np.int64).reshape(parts, width) for r in seeds], 1)
    chunks = materialize(planted_trees(rows.where(fit), parts, width), "cover-trees")
    for _ in range(rounds):
        codebooks = lloyd_round(chunks, codebooks, parts, width)
    out = coded(chunks, codebooks, parts, width).unionByName(uncoded(rows.where(~fit)))
    return out.withColumnsRenamed(names), codebooks.tolist()


def codebooks_digest(codebooks: list) -> str:
    """Hex SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return sha256(",".join(str(x) for part in codebooks for entry in part for x in entry).encode()).hexdigest()


def with_label_error(codes: DataFrame, label_col: str = "label") -> DataFrame:
    """Adds ``label_error``: ``error`` summed over the rows of the same label (null labels are one).
    The sums are written and joined back as a plain table, so a label with a third of all rows is
    broadcast to or split."""
    codes = materialize(codes, "codes")
    label = F.col(f"`{label_col}`")
    sums = materialize(codes.groupBy(label.alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return codes.join(sums, label.eqNullSafe(F.col("_label"))).drop("_label")
