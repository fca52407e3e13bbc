"""URL filter: explicit rules, and a path-template tree per host judged by labelled purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, packed, unpacked

#: Levels of a template (what follows is one segment ``**``), rows that a literal segment needs, labelled rows that a test of
#: its purity needs, the test's limit in standard deviations, rows' worth of the parent's rate, and the rate from which a template is rejected.
DEPTH, MIN_ROWS, MIN_LABELLED, DEVIATIONS, STRENGTH, REJECTED = 4, 8, 5, 3, 8, 0.5
WILD, TAIL = "*", "**"
ALLOW, BLOCK = "allow", "block"
#: Host and path of a url: between the first ``://`` and ``/``, ``?``, ``#`` or the end, and on to ``?``, ``#`` or the end.
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """The host with A-Z lower-cased; empty for null or without ``://``."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and the domains it lies in (``a.b.c``: ``a.b.c``, ``b.c``, ``c``)."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``rule`` and ``ruled`` (``allow`` or ``block``) to rows with ``host`` and ``path``; null where no rule fits.

    ``rules`` (``host``, ``path``, ``verdict``): a rule fits its host and all subdomains if the path starts with the
    rule's; the longest wins, of equally long ones that with the longer host, then ``block``. Each distinct host
    meets the rules of the domains it lies in by a join, and carries them as one array to its rows,
    so neither the rows nor the rules are multiplied by each other. A rule with a null field fits nothing.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null").distinct()
    hosts = urls.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("domain"))
    text = F.concat("r.host", "r.path")
    own = hosts.join(rules.alias("r"), F.col("domain") == F.col("r.host")).groupBy(hosts["host"].alias("_host")).agg(
        F.collect_list(F.struct(F.length(text).alias("long"), F.length("r.host").alias("host_long"),
                                F.col("r.verdict").alias("verdict"), text.alias("text"), F.col("r.path").alias("start"))).alias("_rules"))
    own = materialize(own, "host-rules")
    fits = F.filter("_rules", lambda r: F.col("path").startswith(r["start"]))
    best = F.array_max(fits)  # by length, host length, verdict ("block" > "allow"), text
    out = urls.join(own, F.col("host") == F.col("_host"), "left").withColumn("_best", best)
    return out.withColumns({"rule": F.col("_best.text"), "ruled": F.col("_best.verdict")}).drop("_host", "_rules", "_best")


def differs(hits: str, n: str) -> Column:
    """Two-sided test of two shares: a branch (``hits`` of ``n``) against the rest of its parent (``all_`` columns)."""
    a, x = F.col(hits).cast("double"), F.col(n).cast("double")
    b, y = F.col(f"all_{hits}") - a, F.col(f"all_{n}") - x
    gap = a * y - b * x
    # (a/x - b/y)^2 > DEVIATIONS^2 s (1 - s) (1/x + 1/y) with s = (a + b)/(x + y), times (xy)^2 (x + y): no division by a count of 0
    return gap * gap * (x + y) > DEVIATIONS * DEVIATIONS * (a + b) * (x + y - a - b) * x * y


def template_tree(urls: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Adds ``template`` and ``rate`` (smoothed share of bad rows among the template's labelled ones) to rows
    with ``host``, ``path`` and ``bad`` (1, 0 or null).

    Per host the tree grows level by level, by the segments between slashes. Below a node a segment seen in fewer than ``MIN_ROWS``
    rows is variable and becomes ``*``. So does a branch that is statistically like its siblings: neither its share of bad
    rows nor its share of paths that end there differs from the rest by more than ``DEVIATIONS``
    standard deviations. A segment that all rows of the node share stays. Each node's rate is its bad share, shrunk
    to its parent's rate by ``STRENGTH`` rows, the host's to that of all rows. Beyond ``depth`` segments the rest is one segment ``**``.

    Every level counts rows by (host, template, segment), partially before the shuffle. The counts are written and
    joined back as plain tables, so a host or segment with a third of all rows is broadcast to or split.
    """
    lab, bad = F.count("bad"), F.coalesce(F.sum("bad"), F.lit(0))
    whole = urls.agg(lab.alias("lab"), bad.alias("bad")).first()
    overall = whole.bad / whole.lab if whole.lab else 0.0
    smooth = lambda b, n, rate: (b + STRENGTH * rate) / (n + STRENGTH)
    hosts = materialize(urls.groupBy(F.col("host").alias("_host")).agg(lab.alias("_lab"), bad.alias("_bad")), "host-labels")
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    cut = F.when(F.size(segments) > depth, F.concat(F.slice(segments, 1, depth), F.array(F.lit(TAIL)))).otherwise(segments)
    rows = urls.withColumn("_segments", cut).join(hosts, F.col("host") == F.col("_host")).withColumns({
        "template": F.lit(""), "rate": smooth(F.col("_bad"), F.col("_lab"), F.lit(overall))}).drop("_host", "_lab", "_bad")
    rows = materialize(rows, "templates")
    for level in range(1, depth + 2):
        rows = rows.withColumn("_segment", F.get("_segments", F.lit(level - 1)))
        child = rows.where("_segment is not null").groupBy("host", "template", "_segment").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.size("_segments") == level).alias("ends"), lab.alias("lab"), bad.alias("bad"),
            F.first("rate").alias("rate"))
        child = materialize(child, "branches")
        if child.isEmpty():
            break
        parent = materialize(child.groupBy(F.col("host").alias("_h"), F.col("template").alias("_t")).agg(
            *[F.sum(c).alias(f"all_{c}") for c in ("n", "ends", "lab", "bad")]), "nodes")
        tested = (F.col("lab") >= MIN_LABELLED) & (F.col("all_lab") - F.col("lab") >= MIN_LABELLED)
        apart = (F.col("n") >= MIN_ROWS) & ((F.col("n") == F.col("all_n")) | (tested & differs("bad", "lab")) | differs("ends", "n"))
        kept = child.join(parent, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t"))).where(apart)
        kept = materialize(kept.select(F.col("host").alias("_h"), F.col("template").alias("_t"), F.col("_segment").alias("_s"),
                                       smooth(F.col("bad"), F.col("lab"), F.col("rate")).alias("_kept_rate")), "kept-branches")
        own = (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")) & (F.col("_segment") == F.col("_s"))
        merged = child.join(kept, own, "left_anti").groupBy("host", "template").agg(
            smooth(F.sum("bad"), F.sum("lab"), F.first("rate")).alias("_wild_rate"))
        merged = materialize(merged.withColumnsRenamed({"host": "_wh", "template": "_wt"}), "merged-branches")
        rows = rows.join(kept, own, "left").join(merged, (F.col("host") == F.col("_wh")) & (F.col("template") == F.col("_wt")), "left")
        named = F.coalesce(F.replace("_s", F.lit(WILD), F.lit("%2A")), F.when(F.col("_segment").isNotNull(), F.lit(WILD)))
        rows = rows.withColumns({
            "template": F.when(F.col("_segment").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), named)),
            "rate": F.when(F.col("_segment").isNull(), F.col("rate")).otherwise(F.coalesce("_kept_rate", "_wild_rate"))})
        rows = materialize(rows.drop("_h", "_t", "_s", "_kept_rate", "_wh", "_wt", "_wild_rate", "_segment"), "templates")
    return rows.drop("_segments", "_segment")


def filter_urls(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", bad: Column | None = None,
                carry: list[str] | None = None, depth: int = DEPTH, rejected: float = REJECTED) -> DataFrame:
    """Judges every url: by the longest rule that fits, else by its path template.

    ``bad`` (a column of ``df``: 1, 0 or null) labels rows; templates of a host are made and rated from all rows
    (``template_tree``), and one whose smoothed share of bad rows is ``rejected`` or more is blocked, for
    labelled and other rows alike.

    Returns the ``carry`` columns (default: all) plus ``host``, ``path``, ``rule`` (null if none fits), ``template``, ``rate``
    and ``verdict`` (``allow`` or ``block``). A null url or one without ``://`` has an empty host and path, which are a
    site like any other. Repeated rows and null ids each give a row; input columns with the names of
    the added ones are replaced. An empty table gives an empty result.
    """
    label = F.lit(None).cast("int") if bad is None else bad.cast("int")
    url = F.col(f"`{url_col}`")
    rows = df.select(packed(df, carry), host_of(url).alias("host"), path_of(url).alias("path"), label.alias("bad"))
    rows = materialize(ruled(rows, rules), "ruled")
    rows = template_tree(rows, depth)
    judged = F.coalesce("ruled", F.when(F.col("rate") >= rejected, F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    rows = rows.withColumn("verdict", judged)
    return rows.select(*unpacked(rows, ["host", "path", "rule", "template", "rate", "verdict"]))
