"""Rollups, trends, shifts, spikes and new entities (A-15, A-16, A-21, W-9,
W-10, W-11, W-15, J-10, J-12, P-15).

Period comparisons are conditional sums in one aggregation (one pass, map-side
combined) rather than two scans joined. Series windows run on already
aggregated rows (one per key and hour/day), so their partitions are bounded
by the time span, not by the data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import explode_values
from ..session import reuse_if_large
from ..functions.timecols import as_ntz, hour_start, minus


def _periods(ts: Column, now, hours: float) -> tuple[Column, Column]:
    n = as_ntz(now)
    cur = (ts > minus(n, hours=hours)) & (ts <= n)
    prev = (ts > minus(n, hours=2 * hours)) & (ts <= minus(n, hours=hours))
    return cur, prev


def trend_change(points: DataFrame, now, hours: float = 24, threshold_pct: float = 25.0,
                 keys: list[str] | None = None, value: str = "value", digits: int = 6) -> DataFrame:
    """W-9: sum of ``value`` in (now-h, now] vs (now-2h, now-h] per key;
    rows only where the previous sum is positive and |change| >= threshold."""
    keys = keys or ["keyword"]
    cur, prev = _periods(F.col("ts"), now, hours)
    p = points.where(cur | prev)
    agg = p.groupBy(*keys).agg(F.sum(F.when(cur, F.col(value))).alias("current"),
                               F.sum(F.when(prev, F.col(value))).alias("previous"))
    pct = F.round((F.col("current") - F.col("previous")) / F.col("previous") * 100, digits)
    out = (agg.where(F.col("previous") > 0).withColumn("current", F.coalesce("current", F.lit(0.0)))
           .withColumn("pct_change", pct))
    out = out.where(F.abs(F.col("pct_change")) >= threshold_pct)
    return (out.withColumn("direction", F.when(F.col("pct_change") > 0, "increasing").otherwise("decreasing"))
            .withColumn("current", F.round("current", digits)).withColumn("previous", F.round("previous", digits)))


def metric_change(current: DataFrame, previous: DataFrame, key: str = "metric",
                  threshold_pct: float | None = None, digits: int = 6) -> DataFrame:
    """J-10: current x previous metrics by name (full outer join);
    percent change (NULL without a positive previous value)."""
    j = current.select(key, F.col("value").alias("current")).join(
        previous.select(key, F.col("value").alias("previous")), key, "full_outer")
    pct = F.when(F.col("previous") > 0,
                 F.round((F.col("current") - F.col("previous")) / F.col("previous") * 100, digits))
    out = j.withColumn("pct_change", pct)
    if threshold_pct is not None:
        out = out.where(F.abs(F.col("pct_change")) >= threshold_pct)
    return out


def hourly_series(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Counts per key and clock hour, with hours without rows filled with 0
    between each key's first and last hour."""
    counts = df.groupBy(*keys, hour_start(F.col(ts)).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    span = counts.groupBy(*keys).agg(F.min("hour").alias("_lo"), F.max("hour").alias("_hi"))
    cal = span.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    return cal.join(counts, keys + ["hour"], "left").fillna(0, ["n"])


def volume_spikes(df: DataFrame, keys: list[str], lookback: int = 24, z_threshold: float = 3.0,
                  ts: str = "ts", digits: int = 6) -> DataFrame:
    """W-10: hourly count against the mean and sample stddev of the previous
    ``lookback`` hours; rows with z >= threshold."""
    s = hourly_series(df, keys, ts)
    w = Window.partitionBy(*keys).orderBy("hour").rowsBetween(-lookback, -1)
    s = (s.withColumn("baseline", F.avg("n").over(w)).withColumn("sd", F.stddev_samp("n").over(w))
         .withColumn("_cnt", F.count(F.lit(1)).over(w)))
    z = (F.col("n") - F.col("baseline")) / F.col("sd")
    out = s.where((F.col("_cnt") == lookback) & (F.col("sd") > 0)).withColumn("z_score", F.round(z, digits))
    return (out.where(F.col("z_score") >= z_threshold)
            .select(*keys, "hour", F.col("n").alias("doc_count"), F.round("baseline", digits).alias("baseline"),
                    "z_score"))


def daily_mean(df: DataFrame, keys: list[str], value: str, ts: str = "ts", digits: int = 6) -> DataFrame:
    return (df.where(F.col(value).isNotNull())
            .groupBy(*keys, F.to_date(ts).alias("day"))
            .agg(F.round(F.avg(value), digits).alias("avg_value"), F.count(F.lit(1)).alias("n")))


def sentiment_shift(sent: DataFrame, threshold: float = 0.3, high: float = 0.5, digits: int = 6) -> DataFrame:
    """W-11: daily average sentiment vs the previous day present;
    |shift| >= threshold raises a shift, 'high' from ``high`` up."""
    d = daily_mean(sent, ["situation_id"], "sentiment", digits=digits)
    w = Window.partitionBy("situation_id").orderBy("day")
    d = d.withColumn("prev_avg", F.lag("avg_value").over(w)).withColumn(
        "shift", F.round(F.col("avg_value") - F.col("prev_avg"), digits))
    out = d.where(F.abs(F.col("shift")) >= threshold)
    return out.select("situation_id", "day", F.col("avg_value").alias("avg_sentiment"), "prev_avg", "shift",
                      F.when(F.abs(F.col("shift")) >= high, "high").otherwise("medium").alias("severity"))


def trend_direction(daily: DataFrame, keys: list[str], value: str = "n", day: str = "day",
                    origin: str = "2024-01-01", min_points: int = 3, strength_cut: float = 0.3,
                    digits: int = 6) -> DataFrame:
    """W-15: least-squares slope of a daily series and strength |corr| in
    [0, 1]; increasing / decreasing when strong enough, else stable."""
    x = F.datediff(F.col(day), F.to_date(F.lit(origin))).cast("double")
    y = F.col(value).cast("double")
    g = daily.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), F.regr_slope(y, x).alias("_slope"),
        F.corr(y, x).alias("_corr"), F.var_samp(y).alias("_vy"))
    g = g.where(F.col("points") >= min_points)
    strength = F.when(F.col("_vy") == 0, F.lit(0.0)).otherwise(F.round(F.abs(F.col("_corr")), digits))
    slope = F.round(F.col("_slope"), digits)
    out = g.select(*keys, "points", slope.alias("slope"), strength.alias("strength"))
    return out.withColumn("direction", F.when((F.col("strength") >= strength_cut) & (F.col("slope") > 0), "increasing")
                          .when((F.col("strength") >= strength_cut) & (F.col("slope") < 0), "decreasing")
                          .otherwise("stable"))


def entity_mentions(docs: DataFrame, entities: Column) -> DataFrame:
    """(situation_id, id, ts, entity) rows, one per distinct entity of a
    document."""
    m = docs.select("situation_id", "id", "ts", explode_values(F.array_distinct(entities)).alias("entity")).where(
        F.col("entity").isNotNull())
    return reuse_if_large(m, docs)


def new_entities(mentions: DataFrame, now, days: float = 7) -> DataFrame:
    """J-12: entities mentioned in (now-days, now] that the situation never
    mentioned before."""
    n = as_ntz(now)
    start = minus(n, days=days)
    inside = (F.col("ts") > start) & (F.col("ts") <= n)
    # One aggregate over period and history together: no second scan, no join.
    g = mentions.where(F.col("ts") <= n).groupBy("situation_id", "entity").agg(
        F.count_if(inside).alias("mentions"), F.min(F.when(inside, F.col("ts"))).alias("first_seen"),
        F.count_if(~inside).alias("_before"))
    return g.where((F.col("_before") == 0) & (F.col("mentions") > 0)).drop("_before")


def entity_history(mentions: DataFrame) -> DataFrame:
    """A-21: documents mentioning each entity, first and last time."""
    return mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("mentions"), F.min("ts").alias("first_seen"),
                                          F.max("ts").alias("last_seen"))


def keyword_spikes(doc_keywords: DataFrame, now, days: float = 7, factor: float = 2.0,
                   min_new: int = 3, keywords_col: str = "keywords") -> DataFrame:
    """P-15: keyword count in the period >= factor x the previous period's
    (or >= min_new when the keyword is new)."""
    cur, prev = _periods(F.col("ts"), now, days * 24)
    k = doc_keywords.where(cur | prev).select("situation_id", cur.alias("_cur"),
                                             explode_values(F.col(keywords_col)).alias("keyword")).where(
        F.col("keyword").isNotNull())
    g = k.groupBy("situation_id", "keyword").agg(F.count_if(F.col("_cur")).alias("current"),
                                                 F.count_if(~F.col("_cur")).alias("previous"))
    spike = (((F.col("previous") > 0) & (F.col("current") >= F.col("previous") * factor))
             | ((F.col("previous") == 0) & (F.col("current") >= min_new)))
    return g.where(spike)


def daily_metrics(docs: DataFrame, sent: DataFrame, alerts: DataFrame, digits: int = 6) -> DataFrame:
    """A-15: one row per (situation, date) over three facts, full outer
    joined after each is reduced to that grain."""
    d = docs.groupBy("situation_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("documents"), F.countDistinct("source_id").alias("sources"))
    s = sent.where(F.col("sentiment").isNotNull()).groupBy("situation_id", F.to_date("ts").alias("day")).agg(
        F.round(F.avg("sentiment"), digits).alias("avg_sentiment"),
        F.count_if(F.col("sentiment") > 0.1).alias("positive"),
        F.count_if(F.col("sentiment") < -0.1).alias("negative"),
        F.count_if(F.col("sentiment").between(-0.1, 0.1)).alias("neutral"))
    a = alerts.groupBy("situation_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("alerts"))
    out = d.join(s, ["situation_id", "day"], "full_outer").join(a, ["situation_id", "day"], "full_outer")
    return out.fillna(0, ["documents", "sources", "alerts", "positive", "negative", "neutral"])


def hourly_values(docs: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Counts of each value per (situation, hour, kind) in one pass over the documents; ``kinds`` names the array column
    of each kind. Counts of disjoint loads and of hours add up, so days and months need no second scan."""
    def tagged(kind: str, c: str) -> Column:
        return F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    lists = [tagged(kind, c) for kind, c in kinds.items()]
    ex = docs.select("situation_id", hour_start(F.col("ts")).alias("hour"), explode_values(F.concat(*lists)).alias("v"))
    ex = ex.select("situation_id", "hour", "v.kind", "v.value").where(F.col("value").isNotNull())
    return ex.groupBy("situation_id", "hour", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


def daily_tops(hourly: DataFrame, kinds: list[str], n: int = 5) -> DataFrame:
    """Exact ``top_<kind>`` texts per (situation, day) from ``hourly_values``: the ``n`` most frequent values, ties by
    value, joined by ", "; a group holds at most ``n`` rows of a kind when it is gathered."""
    day = hourly.groupBy("situation_id", F.to_date("hour").alias("day"), "kind", "value").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("situation_id", "day", "kind").orderBy(F.col("n").desc(), F.col("value"))
    top = day.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    listed = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("rank", "value"))))
    return top.groupBy("situation_id", "day").agg(
        *[F.array_join(F.transform(listed(k), lambda x: x["value"]), ", ").alias(f"top_{k}") for k in kinds])


def hourly_metrics(docs: DataFrame, alerts: DataFrame, now, keep_days: float = 30) -> DataFrame:
    """A-16: documents, sources and alerts per (situation, hour), hours
    within the retention window only."""
    since = minus(as_ntz(now), days=keep_days)
    d = docs.where(F.col("ts") >= since).groupBy("situation_id", hour_start(F.col("ts")).alias("hour")).agg(
        F.count(F.lit(1)).alias("documents"), F.countDistinct("source_id").alias("sources"))
    a = alerts.where(F.col("ts") >= since).groupBy("situation_id", hour_start(F.col("ts")).alias("hour")).agg(
        F.count(F.lit(1)).alias("alerts"))
    return d.join(a, ["situation_id", "hour"], "full_outer").fillna(0, ["documents", "sources", "alerts"])
