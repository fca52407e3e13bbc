"""Order-dependent folds: greedy cooldown / sliding cap (ST-3, ST-4, ST-6,
ST-7 rate limit) and the source circuit breaker (ST-8).

A greedy cooldown is not a window function: whether a row is kept depends on
which earlier rows were kept. The fold is still split as far as the
semantics allow:

1. time is cut into buckets as wide as the longest reach of the state
   (``max(cooldown, cap window)``); per (key, bucket) the first and last
   timestamps are aggregated (map-side combined);
2. a gap of at least that reach between two consecutive rows of a key resets
   the state, so it starts a new *segment*; segment ids are a running sum
   over the small per-bucket table;
3. rows are hash-partitioned by (key, segment), sorted within partitions and
   folded by ``mapInPandas`` as a stream: memory per task is one Arrow batch
   plus the state of one segment (a timestamp and at most ``cap`` recent
   sends), never the whole group.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_code

ORIGIN = "2000-01-01 00:00:00"


def _micros(ts: str):
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit(ORIGIN)), F.col(ts))


def segment(df: DataFrame, keys: list[str], reach_us: int, ts: str = "ts") -> DataFrame:
    """Adds ``_us`` (event time in microseconds) and ``_seg``: rows of a key
    separated by a gap >= ``reach_us`` fall into different segments."""
    d = df.withColumn("_us", _micros(ts)).withColumn("_b", F.floor(F.col("_us") / F.lit(reach_us)))
    b = d.groupBy(*keys, "_b").agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi"))
    w = Window.partitionBy(*keys).orderBy("_b")
    prev_hi = F.lag("_hi").over(w)
    b = b.withColumn("_start", (prev_hi.isNull() | ((F.col("_lo") - prev_hi) >= reach_us)).cast("int"))
    b = b.withColumn("_seg", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # null-safe: a row whose key holds a NULL belongs to the NULL key, it is not lost
    b = b.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_b").alias("_of_b"), "_seg")
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return d.join(b, (F.col("_b") == F.col("_of_b")) & same).drop("_b", "_of_b", *[f"_of_{k}" for k in keys])


def greedy_fold(df: DataFrame, keys: list[str], cooldown_s: float = 0.0, cap: int | None = None,
                cap_window_s: float = 3600.0, ts: str = "ts", order: str = "id",
                out_col: str = "kept") -> DataFrame:
    """Adds boolean ``out_col``. A row is kept when (a) at least
    ``cooldown_s`` passed since the key's last kept row and (b) fewer than
    ``cap`` kept rows of the key lie in (ts - cap_window_s, ts]. Rows are
    taken in (ts, order) order; suppressed rows never move the state. NULL is a
    key value like any other; rows without a time are kept and move no
    state."""
    ship_code(df.sparkSession)
    reach_s = max(cooldown_s, cap_window_s if cap else 0.0, 1e-6)
    reach_us = int(round(reach_s * 1_000_000))
    cool_us = int(round(cooldown_s * 1_000_000))
    win_us = int(round(cap_window_s * 1_000_000))
    untimed = df.where(F.col(ts).isNull()).withColumn(out_col, F.lit(True))
    seg = segment(df.where(F.col(ts).isNotNull()), keys, reach_us, ts)
    ready = seg.repartition(*keys, "_seg").sortWithinPartitions(*keys, "_seg", "_us", order)
    out_schema = T.StructType(ready.schema.fields + [T.StructField(out_col, T.BooleanType(), False)])
    group_cols = keys + ["_seg"]

    def fold(batches):
        import numpy as np
        import pandas as pd

        current = None          # group key of the run continuing from the previous batch
        last = None             # last kept time of that group
        recent: deque = deque()
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                pdf[out_col] = pd_bool(pdf)
                yield pdf
                continue
            times = pdf["_us"].to_numpy(dtype="int64")
            change = np.zeros(n, dtype=bool)
            change[0] = True
            for c in group_cols:
                col, none = pdf[c].to_numpy(), pdf[c].isna().to_numpy()
                change[1:] |= (col[1:] != col[:-1]) & ~(none[1:] & none[:-1])
            starts = np.flatnonzero(change).tolist() + [n]
            kept = np.zeros(n, dtype=bool)
            for s0, e0 in zip(starts[:-1], starts[1:]):
                g = tuple(None if pd.isna(v := pdf[c].iat[s0]) else v for c in group_cols)
                if g != current:
                    current, last, recent = g, None, deque()
                t = times[s0:e0]
                if cap is None:
                    # Cooldown only: jump straight to the next row at or after
                    # last + cooldown (work proportional to kept rows).
                    if cool_us <= 0:
                        kept[s0:e0] = True
                        last = int(t[-1])
                        continue
                    i = 0 if last is None else int(np.searchsorted(t, last + cool_us, "left"))
                    while i < len(t):
                        kept[s0 + i] = True
                        last = int(t[i])
                        i = int(np.searchsorted(t, last + cool_us, "left"))
                else:
                    for j, tj in enumerate(t.tolist()):
                        ok = last is None or (tj - last) >= cool_us
                        if ok:
                            while recent and recent[0] <= tj - win_us:
                                recent.popleft()
                            ok = len(recent) < cap
                        if ok:
                            last = tj
                            recent.append(tj)
                            kept[s0 + j] = True
            pdf[out_col] = kept
            yield pdf

    return ready.mapInPandas(fold, out_schema).drop("_us", "_seg").unionByName(untimed)


def pd_bool(pdf):
    import pandas as pd
    return pd.Series([], dtype=bool, index=pdf.index)


BREAKER_STATE = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("consecutive_failures", T.LongType()),
    T.StructField("half_open_successes", T.LongType()),
    T.StructField("opened_at_us", T.LongType()),
    T.StructField("times_opened", T.LongType()),
    T.StructField("outcomes", T.LongType()),
])


def breaker_states(fetch_log: DataFrame, now, failure_threshold: int = 5, timeout_s: float = 60.0,
                   half_open_successes: int = 3, ts: str = "ts", ok: str = "ok", key: str = "source_id",
                   order: str = "id") -> DataFrame:
    """ST-8: circuit breaker per source over its fetch outcomes, reported as
    of ``now``. closed -> open after ``failure_threshold`` failures in a
    row; open -> half-open once ``timeout_s`` passed since opening (checked
    at each outcome's own time, before applying it); half-open -> closed
    after ``half_open_successes`` successes; a half-open failure re-opens.
    Outcomes while open are ignored (no call would have been made)."""
    import datetime as dt

    ship_code(fetch_log.sparkSession)
    now_dt = now if isinstance(now, dt.datetime) else dt.datetime.fromisoformat(str(now))
    now_us = (now_dt - dt.datetime.fromisoformat(ORIGIN)) // dt.timedelta(microseconds=1)
    timeout_us = int(round(timeout_s * 1_000_000))
    d = fetch_log.select(F.col(key).cast("string").alias("source_id"), _micros(ts).alias("_us"),
                         F.col(ok).alias("ok"), F.col(order).alias("_o"))
    ready = d.repartition("source_id").sortWithinPartitions("source_id", "_us", "_o")

    def emit(src, st):
        state, fails, succ, opened, times, n = st
        if state == "open" and now_us - opened >= timeout_us:
            state, succ = "half_open", 0
        return {"source_id": src, "state": state, "consecutive_failures": fails, "half_open_successes": succ,
                "opened_at_us": opened, "times_opened": times, "outcomes": n}

    def fold(batches):
        import pandas as pd
        src, st = None, None
        for pdf in batches:
            out = []
            for s, t, good in zip(pdf["source_id"].tolist(), pdf["_us"].tolist(), pdf["ok"].tolist()):
                if s != src:
                    if src is not None:
                        out.append(emit(src, st))
                    src, st = s, ["closed", 0, 0, None, 0, 0]
                state, fails, succ, opened, times, n = st
                n += 1
                if state == "open" and t - opened >= timeout_us:
                    state, succ = "half_open", 0
                if state == "closed":
                    if good:
                        fails = 0
                    else:
                        fails += 1
                        if fails >= failure_threshold:
                            state, opened, times = "open", t, times + 1
                elif state == "half_open":
                    if good:
                        fails = 0
                        succ += 1
                        if succ >= half_open_successes:
                            state, fails, succ = "closed", 0, 0
                    else:
                        state, opened, times, succ = "open", t, times + 1, 0
                        fails += 1
                st = [state, fails, succ, opened, times, n]
            if out:
                yield pd.DataFrame(out, columns=[f.name for f in BREAKER_STATE.fields])
        if src is not None:
            yield pd.DataFrame([emit(src, st)], columns=[f.name for f in BREAKER_STATE.fields])

    out = ready.mapInPandas(fold, BREAKER_STATE)
    opened = F.when(F.col("opened_at_us").isNotNull(), F.to_timestamp_ntz(F.lit(ORIGIN)) + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (F.col("opened_at_us") / 1_000_000).cast("decimal(18,6)")))
    return out.withColumn("opened_at", opened).drop("opened_at_us")
