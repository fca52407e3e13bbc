"""Source health and freshness (W-6, W-7, W-8, W-14, L-6, S-13, A-17, A-18,
A-19, A-22, A-26, SNK-9).

Per-source facts come from partial/final aggregates over the fetch log; the
only join back to row level (consecutive failures) is on (source, day), so a
hot source's rows spread over its days. The breaker state machine is the fold in
``folds.breaker_states``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import dead_letter_id
from ..functions.timecols import as_ntz

# Default check interval (minutes) by priority
# 1 critical, 2 high, 3 medium, 4 low.
PRIORITY_INTERVAL_MINUTES = {1: 5, 2: 15, 3: 60, 4: 360}
PRIORITY_NAMES = {1: "CRITICAL", 2: "HIGH", 3: "MEDIUM", 4: "LOW"}
MAX_BACKOFF_MINUTES = 360
MIN_REQUEST_SPACING_S = 6.0


def consecutive_failures(fetch_log: DataFrame, base: float = 2.0, key: str = "source_id") -> DataFrame:
    """W-14 / ST-9: failures after the last success (by ts, id), and the
    backoff ``base ** min(n, 6)`` seconds (0 without failures)."""
    # One row per (source, day); a NULL source is a source of its own, an
    # outcome that is NULL counts as neither.
    day = F.to_date("ts")
    days = fetch_log.groupBy(F.col(key).alias("_src"), day.alias("_day")).agg(
        F.max(F.when(F.col("ok"), F.struct("ts", "id"))).alias("_lo"), F.count_if(~F.col("ok")).alias("_bad"))
    last = days.groupBy("_src").agg(F.max("_lo").alias("_last"))
    d, s = days.alias("d"), last.alias("s")
    whole = d.join(s, F.col("d._src").eqNullSafe(F.col("s._src"))).groupBy("d._src").agg(F.sum(F.when(
        F.col("_last").isNull() | (F.col("_day") > F.to_date(F.col("_last.ts"))), F.col("_bad")).otherwise(0)).alias("n"))
    # Rows are compared one by one only on the day of the last success.
    edge = last.where("_last is not null").withColumn("_day", F.to_date(F.col("_last.ts")))
    same_day = fetch_log.where(~F.col("ok")).select(F.col(key).alias("_k"), "ts", "id", day.alias("_d")).join(
        edge, F.col("_k").eqNullSafe(F.col("_src")) & (F.col("_d") == F.col("_day")))
    same_day = same_day.where(F.struct("ts", "id") > F.col("_last")).groupBy("_src").agg(F.count(F.lit(1)).alias("n"))
    n = whole.unionByName(same_day).groupBy(F.col("_src").alias(key)).agg(F.sum("n").alias("consecutive_failures"))
    return n.withColumn("backoff_seconds", F.when(F.col("consecutive_failures") == 0, F.lit(0.0)).otherwise(
        F.pow(F.lit(base), F.least(F.col("consecutive_failures"), F.lit(6)))))


def check_interval(priority: Column, own_minutes: Column) -> Column:
    """Own interval, else the priority default (medium when unknown)."""
    m = F.create_map(*[x for k, v in PRIORITY_INTERVAL_MINUTES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(own_minutes, F.try_element_at(m, priority), F.lit(PRIORITY_INTERVAL_MINUTES[3]))


def min_request_spacing(rpm: Column) -> Column:
    """S-13: max(6 s, 60 / requests per minute)."""
    return F.greatest(F.lit(MIN_REQUEST_SPACING_S), F.try_divide(F.lit(60.0), rpm.cast("double")))


def source_freshness(sources: DataFrame, fetch_log: DataFrame, now, key: str = "source_id") -> DataFrame:
    """L-6: sources due for a check at ``now``: next = last check + interval
    + min(2^fails, 360) minutes (no backoff without failures); due rows
    ranked by priority, then longest overdue, then id."""
    last = fetch_log.groupBy(key).agg(F.max("ts").alias("last_check"))
    fails = consecutive_failures(fetch_log, key=key).select(key, "consecutive_failures")
    s = sources.join(last, key, "left").join(fails, key, "left").fillna(0, ["consecutive_failures"])
    backoff = F.when(F.col("consecutive_failures") == 0, F.lit(0)).otherwise(
        F.least(F.pow(F.lit(2), F.col("consecutive_failures")), F.lit(MAX_BACKOFF_MINUTES))).cast("bigint")
    interval = check_interval(F.col("priority"), F.col("check_interval_minutes")).cast("bigint")
    s = s.withColumn("interval_minutes", interval).withColumn("backoff_minutes", backoff)
    nxt = F.col("last_check") + F.make_dt_interval(F.lit(0), F.lit(0),
                                                   (F.col("interval_minutes") + F.col("backoff_minutes")).cast("int"))
    n = as_ntz(now)
    s = s.withColumn("next_check", nxt)
    due = s.where(F.col("last_check").isNull() | (F.col("next_check") <= n))
    due = due.withColumn("overdue_seconds", F.coalesce(F.timestamp_diff("SECOND", F.col("next_check"), n),
                                                       F.lit(None).cast("bigint")))
    # A global sort (range-partitioned), not an unpartitioned window.
    return due.orderBy("priority", F.col("overdue_seconds").desc_nulls_first(), key)


def recent_errors(fetch_log: DataFrame, n: int = 10, key: str = "source_id") -> DataFrame:
    """W-7: the last ``n`` error messages per source."""
    e = fetch_log.where(~F.col("ok"))
    w = Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col("id").desc())
    return e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def pipeline_health(fetch_log: DataFrame, key: str = "source_id", recent: int = 10) -> DataFrame:
    """A-18 per source: failed ratio > .5 or > 5 recent errors -> unhealthy;
    > .2 or > 2 -> degraded; else healthy. Recent errors = the retained
    errors, at most ``recent``."""
    g = fetch_log.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("ok")).alias("failed"))
    ratio = F.try_divide(F.col("failed").cast("double"), F.col("total").cast("double"))
    g = g.withColumn("failed_ratio", F.round(ratio, 6)).withColumn("recent_errors",
                                                                   F.least(F.col("failed"), F.lit(recent)))
    return g.withColumn("status", F.when((F.col("failed_ratio") > 0.5) | (F.col("recent_errors") > 5), "unhealthy")
                        .when((F.col("failed_ratio") > 0.2) | (F.col("recent_errors") > 2), "degraded")
                        .otherwise("healthy"))


def source_counters(fetch_log: DataFrame, key: str = "source_id") -> DataFrame:
    """A-22: fetch_count, error_count, last_fetched (last success),
    last_error (message of the newest failure)."""
    return fetch_log.groupBy(key).agg(
        F.count(F.lit(1)).alias("fetch_count"), F.count_if(~F.col("ok")).alias("error_count"),
        F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_fetched"),
        F.max(F.when(~F.col("ok"), F.struct("ts", "id", "error_message"))).getField("error_message")
         .alias("last_error"))


def scheduler_totals(fetch_log: DataFrame, key: str = "source_id") -> DataFrame:
    """A-26: scheduled / executed / failed checks and distinct sources."""
    return fetch_log.agg(F.count(F.lit(1)).alias("scheduled"), F.count_if(F.col("ok")).alias("executed"),
                         F.count_if(~F.col("ok")).alias("failed"), F.countDistinct(key).alias("sources"))


def collection_counters(outcomes: DataFrame, status_col: str = "status") -> DataFrame:
    """A-17: fetched / deduplicated / failed / dead_letter from tagged
    document outcomes (kept, duplicate, rejected)."""
    s = F.col(status_col)
    return outcomes.agg(F.count(F.lit(1)).alias("fetched"), F.count_if(s == "duplicate").alias("deduplicated"),
                        F.count_if(s == "rejected").alias("failed"), F.count_if(s == "rejected").alias("dead_letter"))


def dead_letters(failures: DataFrame, keep_newest: int = 500, over: int = 1000) -> DataFrame:
    """SNK-9 + W-8: dead-letter rows with id ``source_id:`` + 8 hex of
    sha256(url); ``retained`` marks the newest ``keep_newest`` once more
    than ``over`` exist (no row is dropped here)."""
    total = failures.select(F.count(F.lit(1))).scalar()
    # (ts, id) of the keep_newest-th newest failure: a top-k (per-partition
    # top-k, then merge), never a global window.
    cutoff = (failures.select(F.struct("ts", "id").alias("k")).orderBy(F.col("k").desc()).limit(keep_newest)
              .agg(F.min("k")).scalar())
    d = failures.select("id", "source_id", "url", "ts", "error_message",
                        dead_letter_id(F.col("source_id").cast("string"), F.col("url")).alias("document_id"))
    return d.withColumn("retained", (total <= over) | (F.struct("ts", "id") >= cutoff))


def last_executions(fetch_log: DataFrame, keep: int = 100, key: str = "source_id") -> DataFrame:
    """W-6: the last ``keep`` successful executions per source as rows (a
    ``row_number() <= keep`` that Spark cuts down before the shuffle)."""
    w = Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col("id").desc())
    ok = fetch_log.where(F.col("ok")).select(key, "id", "ts")
    return ok.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def executions_kept(fetch_log: DataFrame, keep: int = 100, key: str = "source_id") -> DataFrame:
    """W-6: successful executions per source, at most the last ``keep``."""
    return fetch_log.groupBy(key).agg(F.least(F.count_if(F.col("ok")), F.lit(keep)).alias("last_execution_times"))
