"""Merkle manifest of a dataset: a persistent, path-copying hash tree in distributed blocks."""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_code
from .common import materialize

#: Levels of the tree that one block spans: a block holds 2 ** LEVELS nodes.
LEVELS = 10
#: Where a node's sibling stands; a node without one is hashed alone.
LEFT, RIGHT, ALONE = "L", "R", "-"


def joined(*digests: str) -> str:
    """The digest of digests given as hex text."""
    return sha256("".join(digests).encode()).hexdigest()


def folded(digest: str, sides: str, siblings: str) -> str:
    """The digest at the end of a path: ``siblings`` are concatenated digests, one for each
    side that isn't ``ALONE``, from the bottom to the top."""
    at = 0
    for side in sides:
        if side == ALONE:
            digest = joined(digest)
            continue
        other = siblings[at:at + 64]
        at += 64
        digest = joined(other, digest) if side == LEFT else joined(digest, other)
    return digest


class Tree:
    """One version of a block of the tree, which is never changed.

    ``with_node`` makes a new version: it copies the ancestors of one node and shares all
    other nodes with the version it comes from.
    """

    def __init__(self, nodes: list[str], height: int):
        """``height`` levels above ``nodes``; a last node without a sibling is hashed alone."""
        self.levels, self.own = [nodes], {}
        for _ in range(height):
            low = self.levels[-1]
            self.levels.append([joined(*low[i:i + 2]) for i in range(0, len(low), 2)])

    def node(self, level: int, i: int) -> str:
        own = self.own.get((level, i))
        return self.levels[level][i] if own is None else own

    @property
    def root(self) -> str:
        return self.node(len(self.levels) - 1, 0)

    def path(self, i: int) -> tuple[str, str]:
        """Sides and concatenated siblings of node ``i`` from the bottom up to the root."""
        sides, siblings = "", []
        for level, row in enumerate(self.levels[:-1]):
            other = i ^ 1
            if other < len(row):
                sides += LEFT if other < i else RIGHT
                siblings.append(self.node(level, other))
            else:
                sides += ALONE
            i >>= 1
        return sides, "".join(siblings)

    def with_node(self, i: int, digest: str) -> Tree:
        new = object.__new__(Tree)
        new.levels, new.own = self.levels, {**self.own, (0, i): digest}
        for level in range(1, len(self.levels)):
            i >>= 1
            below = [new.node(level - 1, j) for j in (2 * i, 2 * i + 1) if j < len(self.levels[level - 1])]
            new.own[level, i] = joined(*below)
        return new


def block_tree(nodes: list[str], in_group: int, levels: int) -> Tree:
    """The tree over one block of a group that has ``in_group`` nodes: up to the group's last
    node if the block is all of it, ``levels`` high if others stand beside it."""
    return Tree(nodes, min(levels, (in_group - 1).bit_length()))


def field(value: Column) -> Column:
    """A value as the manifest hashes it: ``-`` if null, else its length in bytes, ``:`` and itself."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Iterable[Column]) -> Column:
    """Hex SHA-256 of a row's values, made in the JVM."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``i`` (from 0 in each group, in ``order``) and ``m`` (rows of the group).

    The rows are range-partitioned and written once with their task and their place in it,
    so a hot group has as many tasks as its rows fill; only one row per task and group is summed in order.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    ranged = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    task = F.shiftright("_at", 33).alias("_task")
    starts = ranged.groupBy(group, task).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    whole = Window.partitionBy(group)
    starts = materialize(starts.select(
        F.col(group).alias("_g"), "_task", "_from", (F.sum("_n").over(whole.orderBy("_task")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(whole).alias("m")), "task-counts")
    at = (F.col(group) == F.col("_g")) & (F.shiftright("_at", 33) == F.col("_task"))
    return ranged.join(starts, at).withColumn("i", F.col("_before") + F.col("_at") - F.col("_from")).drop(
        "_g", "_task", "_from", "_before", "_at")


def blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("i", levels))


def raised(nodes: DataFrame, levels: int) -> DataFrame:
    """The roots of all blocks of ``nodes`` (``g``, ``i``, ``m``, ``h``) as nodes of the next tier."""
    def roots(key, table):
        import pyarrow as pa
        table = table.sort_by("i")
        m = table.column("m")[0].as_py()
        root = block_tree(table.column("h").to_pylist(), m, levels).root
        return pa.table({"g": [key[0].as_py()], "i": pa.array([key[1].as_py()], pa.int64()),
                         "m": pa.array([-(-m >> levels)], pa.int64()), "h": [root]})
    rows = blocks(nodes.select("g", "i", "m", "h"), levels)
    return rows.groupBy("g", "block").applyInArrow(roots, "g string, i long, m long, h string")


def tiers_of(nodes: DataFrame, levels: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The tiers above ``nodes``, each with the blocks of groups that the tier below has not
    joined to one node, and that last node of every group (``g``, ``h``)."""
    tiers, tops = [nodes], []
    while True:
        up = materialize(raised(tiers[-1], levels), name)
        tops.append(up.where("m = 1").select("g", "h"))
        rest = up.where("m > 1")
        if rest.isEmpty():
            break
        tiers.append(rest)
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return tiers, top


PATH = "sides string, siblings string, subroot string, root string"


def lowered(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """The path from each of ``nodes`` to the root (``g``, ``i`` and ``PATH``), given the path
    ``above`` each block (``g``, ``i``: the block's number)."""
    def paths(key, table, over):
        import pyarrow as pa
        table, top = table.sort_by("i"), over.to_pylist()[0]
        tree = block_tree(table.column("h").to_pylist(), table.column("m")[0].as_py(), levels)
        own = [tree.path(j) for j in range(table.num_rows)]
        n = table.num_rows
        return pa.table({"g": table.column("g"), "i": table.column("i"), "sides": [s + top["sides"] for s, _ in own],
                         "siblings": [s + top["siblings"] for _, s in own],
                         "subroot": [top["subroot"]] * n, "root": [top["root"]] * n})
    rows = blocks(nodes.select("g", "i", "m", "h"), levels).groupBy("g", "block")
    over = above.withColumnRenamed("i", "block").groupBy("g", "block")
    return rows.cogroup(over).applyInArrow(paths, f"g string, i long, {PATH}")


def merkle_manifest(df: DataFrame, fields: list[str], id_col: str, group_col: str, changes: dict[str, Column] | None = None,
                    changed: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """A manifest of ``df`` with an inclusion proof for every row, and what became of tampered rows.

    A row's leaf is the hex SHA-256 of its ``fields`` (``field``). In each group leaves ascend by id; every two
    consecutive nodes (a last one alone) become the digest of their hex texts until one remains, the
    group's ``subroot``; the subroots in order of the group (null first, bytewise) give the
    ``root`` in the same way.

    1. Leaves are hashed in the JVM, so texts never move. Their places in the group come from a
       range partitioning by (group, id) of ids and digests.
    2. Upwards, tier by tier: blocks of 2 ** ``levels`` neighbouring nodes, aligned to that size,
       each become one node of the next tier. A block is one task's work, however hot its group is.
    3. Downwards: each block gets the path above it, one row per block.
    4. In its block each tampered row (``changed``; its fields then have the values of ``changes``)
       makes a version of the persistent tree: the block's ancestors of the leaf are copied, all other nodes are
       shared. The version goes on above the block along the block's path, whose nodes the tampering doesn't reach.

    Returns per row: the id, ``leaf``, ``subroot``, ``root``, ``proof`` (concatenated siblings, left to right as
    met from the bottom), ``sides`` (where they stand), ``folded_root`` (from the tampered leaf if any, else the original) and
    ``verified`` (it equals ``root``). Rows that repeat an id are leaves in order of their digests;
    null ids come first, a null group is a group of its own. Other columns, with any names, are
    ignored. An empty table gives an empty result.
    """
    ship_code(df.sparkSession)
    value = {f: F.col(f"`{f}`") for f in fields}
    group = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit(""))
    tampered = F.lit(None).cast("string")
    if changed is not None:
        tampered = F.when(changed, leaf({**value, **(changes or {})}.values()))
    rows = df.select(group.alias("g"), F.col(f"`{id_col}`").alias("id"), leaf(value.values()).alias("h"),
                     tampered.alias("tampered"), F.monotonically_increasing_id().alias("nr"))
    rows = materialize(rows, "leaves")
    leaves = materialize(numbered(rows, "g", ["id", "h", "nr"]).drop("nr"), "numbered-leaves")
    tiers, subroots = tiers_of(leaves, levels, "tier")

    # the subroots are the leaves of one more tree
    tops = numbered(subroots.select(F.lit("").alias("all"), "g", "h"), "all", ["g"])
    tops = materialize(tops.select(F.col("g").alias("own"), F.lit("").alias("g"), "i", "m", "h"), "subroots")
    root_tiers, root = tiers_of(tops, levels, "root-tier")
    above = root.select("g", F.lit(0).cast("long").alias("i"), F.lit("").alias("sides"), F.lit("").alias("siblings"),
                        F.lit("").alias("subroot"), F.col("h").alias("root"))
    for tier in reversed(root_tiers):
        above = materialize(lowered(tier, above, levels), "root-paths")
    start = above.withColumnRenamed("g", "_g").join(tops.select("own", "i", "h"), "i").select(
        F.col("own").alias("g"), F.lit(0).cast("long").alias("i"), "sides", "siblings", F.col("h").alias("subroot"), "root")
    start = materialize(start, "group-paths")

    above = None
    for tier in reversed(tiers[1:]):
        ended = tier.where(f"m <= {1 << levels}").select("g").distinct()
        own = start.join(ended, "g", "left_semi")
        above = materialize(lowered(tier, own if above is None else above.unionByName(own), levels), "paths")
    own = start if above is None else start.join(above.select("g").distinct(), "g", "left_anti")
    above = own if above is None else above.unionByName(own)

    id_type = leaves.schema["id"].dataType.simpleString()

    def proofs(key, table, over):
        import pyarrow as pa
        table, top = table.sort_by("i"), over.to_pylist()[0]
        own = table.column("h").to_pylist()
        tree = block_tree(own, table.column("m")[0].as_py(), levels)
        proof, sides, ends = [], [], []
        for j, new in enumerate(table.column("tampered").to_pylist()):
            turn, siblings = tree.path(j)
            version = tree if new is None else tree.with_node(j, new)
            proof.append(siblings + top["siblings"])
            sides.append(turn + top["sides"])
            ends.append(version.root)
        end = {h: folded(h, top["sides"], top["siblings"]) for h in set(ends)}
        n = table.num_rows
        return pa.table({"id": table.column("id"), "leaf": own, "subroot": [top["subroot"]] * n, "root": [top["root"]] * n,
                         "proof": proof, "sides": sides, "folded_root": [end[h] for h in ends],
                         "verified": [end[h] == top["root"] for h in ends]})

    out = blocks(leaves, levels).groupBy("g", "block").cogroup(above.withColumnRenamed("i", "block").groupBy("g", "block"))
    out = out.applyInArrow(proofs, f"id {id_type}, leaf string, subroot string, root string, proof string, sides string, "
                                   "folded_root string, verified boolean")
    return out.withColumnRenamed("id", id_col)
