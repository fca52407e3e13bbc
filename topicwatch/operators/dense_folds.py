"""Greedy cooldown of keys whose rows never leave a gap (ST-3, ST-6): one key
is folded by many tasks.

``folds.greedy_fold`` cuts a key at gaps as long as the cooldown; a key
without such gaps is one task there. Here rows are range-partitioned by
(key, time) instead, and what a partition does to its first key is written
down as a function of the only thing it does not know, the time of the key's
last kept row before it:

1. of rows with equal key and time at most one is kept, so they are reduced
   to the first by ``order`` (map-side combined), range-partitioned, sorted
   and checkpointed: a checkpoint keeps partitions and their order;
2. each partition emits a step function ``last kept before -> last kept
   after`` for its first key (pointer doubling over "next row a cooldown
   later"; entries that meet again share a step), and the last kept row of
   its last key;
3. ``FAN`` neighbouring functions are composed to one, level by level, until
   at most ``FAN`` are left; a composed function has no more steps than its
   key has times within two cooldowns;
4. walking down again, every partition learns the time it starts from (one
   number per partition on the driver, bounded by the partition count) and
   filters its rows as a stream.

A task holds the times of one partition's first key or the steps of two
nodes, never a whole key. The sliding cap (ST-4) has no such function of one
number: its state is the last ``cap`` kept times (``folds.greedy_fold``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, ship_code
from .folds import _micros

#: Functions composed into one per level.
FAN = 16

#: One row per step; ``first_key``, ``last_key`` and ``tail`` stand on the first step of a node only.
NODES = T.StructType([
    T.StructField("node", T.LongType()), T.StructField("upto", T.LongType()), T.StructField("last", T.LongType()),
    T.StructField("first_key", T.StringType()), T.StructField("last_key", T.StringType()), T.StructField("tail", T.LongType())])


class Node:
    """A run of partitions: the step function of its first key and, where its last key is another, that key's last
    kept time (``tail``). A row needed at or after ``r`` (last kept + cooldown) finds the first step with
    ``upto >= r``; beyond the last step nothing is kept and the time stays."""

    def __init__(self, first_key, last_key, tail, upto, last):
        self.first_key, self.last_key, self.tail, self.upto, self.last = first_key, last_key, tail, upto, last

    def after(self, times, cooldown: int):
        """Last kept times after the first key's rows, for an array of last kept times before them."""
        i = np.searchsorted(self.upto, times + cooldown, "left")
        return np.where(i < len(self.upto), self.last[np.minimum(i, len(self.last) - 1)], times)

    def leaves(self, key, time, cooldown: int):
        """(key, time) of the last kept row behind this node, entered with that of the row before it."""
        if self.first_key != self.last_key:
            return self.last_key, self.tail
        if key != self.first_key or time is None:
            return self.last_key, int(self.last[0])
        return self.last_key, int(self.after(np.array([time]), cooldown)[0])

    def then(self, nxt: Node, cooldown: int) -> Node:
        """This node and the next one as one."""
        if self.first_key != self.last_key:
            key, tail = nxt.leaves(self.last_key, self.tail, cooldown)
            return Node(self.first_key, key, tail, self.upto, self.last)
        if nxt.first_key != self.last_key:
            key, tail = nxt.leaves(None, None, cooldown)
            return Node(self.first_key, key, tail, self.upto, self.last)
        # a time that keeps nothing in this node meets the next one's steps unchanged; a node longer than a cooldown
        # keeps something for any time from before it
        upto, last = self.upto, nxt.after(self.last, cooldown)
        if upto[-1] < upto[0] + cooldown:
            upto, last = np.concatenate([upto, nxt.upto]), np.concatenate([last, nxt.last])
        return Node(self.first_key, nxt.last_key, nxt.tail, *_merged(upto, last))

    def batch(self, node: int):
        import pyarrow as pa

        n = len(self.upto)
        head = lambda v, t: pa.array([v] + [None] * (n - 1), t)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, node)), pa.array(self.upto), pa.array(self.last), head(self.first_key, pa.string()),
             head(self.last_key, pa.string()), head(self.tail, pa.int64())], names=NODES.names)


def _merged(upto: np.ndarray, last: np.ndarray):
    """Neighbouring steps with equal results as one."""
    end = np.append(last[1:] != last[:-1], True)
    return upto[end], last[end]


def _steps(x: np.ndarray, cooldown: int):
    """Steps of a run of ascending distinct times. A time from before the run enters it at the first row a cooldown
    after the run's first one at the latest."""
    m = len(x)
    nxt = np.searchsorted(x, x + cooldown, "left")
    end = np.where(nxt < m, nxt, np.arange(m))
    while ((far := end[end]) != end).any():
        end = far
    hi = min(int(nxt[0]) + 1, m)
    return _merged(x[:hi], x[end[:hi]])


def _kept(x: np.ndarray, last, cooldown: int) -> list[int]:
    """Places kept of ascending distinct times, given the last kept time before them."""
    out = []
    i = 0 if last is None else int(np.searchsorted(x, last + cooldown, "left"))
    while i < len(x):
        out.append(i)
        i = int(np.searchsorted(x, x[i] + cooldown, "left"))
    return out


def _runs(keys) -> list[int]:
    """Starts of runs of equal keys in an Arrow string column, and its length."""
    import pyarrow.compute as pc

    n = len(keys)
    change = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(change) + 1).tolist(), n]


def _nodes(batches) -> Iterator[tuple[int, int, Node]]:
    """(group, id, node) of sorted step rows, one node in memory at a time."""
    def made(g, i, head, parts):
        upto, last = (np.concatenate(c) for c in zip(*parts))
        return g, i, Node(*head, upto, last)

    current, head, parts = None, None, []
    for b in batches:
        ids, groups = b["node"].to_numpy(), b["grp"].to_numpy()
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else [0]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if current != (groups[s], ids[s]):
                if current is not None:
                    yield made(*current, head, parts)
                current, parts = (groups[s], ids[s]), []
                head = [b[c][s].as_py() for c in ("first_key", "last_key", "tail")]
            parts.append((b["upto"].slice(s, e - s).to_numpy(), b["last"].slice(s, e - s).to_numpy()))
    if current is not None:
        yield made(*current, head, parts)


def _by_group(nodes: DataFrame, fan: int) -> DataFrame:
    g = nodes.withColumn("grp", F.floor(F.col("node") / F.lit(fan)).cast("long"))
    return g.repartition("grp").sortWithinPartitions("grp", "node", "upto")


def keep_spaced(df: DataFrame, keys: list[str], cooldown_s: float, ts: str = "ts", order: str = "id",
                parts: int | None = None, fan: int = FAN) -> DataFrame:
    """The rows that a greedy cooldown keeps: the first of a key, then each at least ``cooldown_s`` after the last kept
    one, in (ts, order) order; of rows equal in key, time and order, one. Same rows as ``folds.greedy_fold`` without a
    cap. ``keys`` are columns of atomic types; NULL is a key value like any other. Rows without a time are kept and
    move no state. ``parts`` (the session's shuffle partitions) are the tasks that share the rows, whatever the keys.
    A function has at most as many steps as its key has distinct times within two cooldowns."""
    spark = df.sparkSession
    cool = int(round(cooldown_s * 1_000_000))
    if cool <= 0:
        return df
    ship_code(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.to_json(F.array(*[F.col(k).cast("string") for k in keys]).cast("array<string>"))
    row = F.struct(*[F.col(c) for c in df.columns])
    times = df.where(F.col(ts).isNotNull()).select(key.alias("_key"), _micros(ts).alias("_us"), row.alias("_row"))
    # without an order a row comes last among its equals, but it still counts
    first = F.min_by("_row", F.struct(F.col(f"_row.{order}").isNull(), F.col(f"_row.{order}")))
    times = times.groupBy("_key", "_us").agg(first.alias("_row"))
    times = times.repartitionByRange(parts, "_key", "_us").sortWithinPartitions("_key", "_us")
    times = cut_lineage(times.withColumn("_part", F.spark_partition_id()))

    def describe(batches):
        node = first_key = key = last = None
        mine: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            us, cuts = b["_us"].to_numpy(), _runs(b["_key"])
            for s, e in zip(cuts[:-1], cuts[1:]):
                k, x = b["_key"][s].as_py(), us[s:e]
                if node is None:
                    node, first_key, key = b["_part"][0].as_py(), k, k
                if k != key:
                    key, last = k, None
                if k == first_key:
                    mine.append(x)
                elif at := _kept(x, last, cool):
                    last = int(x[at[-1]])
        if node is not None:
            yield Node(first_key, key, last, *_steps(np.concatenate(mine), cool)).batch(node)

    def compose(batches):
        group = whole = None
        for g, _, n in _nodes(batches):
            if g == group:
                whole = whole.then(n, cool)
                continue
            if whole is not None:
                yield whole.batch(group)
            group, whole = g, n
        if whole is not None:
            yield whole.batch(group)

    def walker(entries: dict):
        """Tells each node of a group the (key, time) of the last kept row before it."""
        def walk(batches):
            import pyarrow as pa

            group = state = None
            for g, i, n in _nodes(batches):
                if g != group:
                    group, state = g, entries.get(int(g), (None, None))
                yield pa.RecordBatch.from_pylist([{"node": int(i), "key": state[0], "time": state[1]}], schema=pa.schema(
                    [("node", pa.int64()), ("key", pa.string()), ("time", pa.int64())]))
                state = n.leaves(*state, cool)
        return walk

    narrow = times.select("_key", "_us", "_part")
    levels, count = [cut_lineage(narrow.mapInArrow(describe, NODES))], parts
    while count > fan:
        levels.append(cut_lineage(_by_group(levels[-1], fan).mapInArrow(compose, NODES)))
        count = -(-count // fan)
    entries: dict = {}
    for level in reversed(levels):
        rows = _by_group(level, fan).mapInArrow(walker(entries), "node long, key string, time long").collect()
        entries = {r["node"]: (r["key"], r["time"]) for r in rows}

    def keep(batches):
        import pyarrow as pa

        key = last = None
        begun = False
        for b in batches:
            if not b.num_rows:
                yield b
                continue
            if not begun:
                begun, (key, last) = True, entries[b["_part"][0].as_py()]
            us, cuts, kept = b["_us"].to_numpy(), _runs(b["_key"]), np.zeros(b.num_rows, dtype=bool)
            for s, e in zip(cuts[:-1], cuts[1:]):
                k = b["_key"][s].as_py()
                if k != key:
                    key, last = k, None
                if at := _kept(us[s:e], last, cool):
                    kept[s + np.array(at)] = True
                    last = int(us[s + at[-1]])
            yield b.filter(pa.array(kept))

    out = times.mapInArrow(keep, times.schema).select("_row.*")
    return out.unionByName(df.where(F.col(ts).isNull()))
