"""Quality classifier: document evidence shrunk through host and path posteriors."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_code
from .common import materialize, packed, release, row_key, text_or_empty
from .tokens import forget

#: Bounds of the fit: word features, rows that a task expands at a time, and numbers that a row of the fit's sums holds.
FIT_FEATURES, FIT_BLOCK, SUM_PIECE = 400, 1_024, 16_384
#: Scores of the labelled rows that the driver may hold to pick one by its rank.
RANKED_ROWS = 4_096
#: Ways of being bad, each with its own model and cut.
KINDS = ("low", "toxic")
#: Folds of the fit that set the cuts, and the share of clean rows that these may reject together.
FOLDS, LOST_CLEAN = 5, 0.005
STATS = ("upper", "digit", "mark", "symbol", "bar", "line", "distinct", "most_common", "word_bytes", "log_words")
#: Punctuation of prose; other ASCII symbols count as ``symbol``.
PROSE_MARKS, STRIPPED = b".,;:'\"-?!()", ".,;:'\"-?!()*#%$&|<>[]{}/=+~_^`@"
PREFIXES = (4, 5, 6)


def word_parts(words) -> list[set[str]]:
    """The features of a text's words: the words themselves, and for each of ``PREFIXES`` the first
    letters of longer ones (inflected forms share them), which are named with a ``~`` after them."""
    whole = {w.strip(STRIPPED) for w in words}
    whole.discard("")
    return [whole, *[{w[:n] for w in whole if len(w) > n} for n in PREFIXES]]


def feature_names(words) -> list[str]:
    whole, *starts = word_parts(words)
    return [*whole, *[f"{x}~" for part in starts for x in part]]


def named_parts(names) -> list[dict[str, str]]:
    """Feature names by the place of their part in ``word_parts``; no stripped word ends with ``~``."""
    parts: list[dict[str, str]] = [{} for _ in (0, *PREFIXES)]
    for f in names:
        parts[PREFIXES.index(len(f) - 1) + 1 if f.endswith("~") else 0][f.removesuffix("~")] = f
    return parts


def text_stats(text: str, seen: dict[str, int]) -> list[float]:
    """``STATS`` of a text, given the counts of its words: shares of byte classes and of repeated words."""
    import numpy as np
    raw, words = text.encode(), sum(seen.values())
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=128).tolist() if raw else [0] * 128
    n, w = max(1, len(raw)), max(1, words)
    upper, digit = sum(count[65:91]), sum(count[48:58])
    marks = sum([count[b] for b in PROSE_MARKS])
    symbols = sum(count[33:48]) + sum(count[58:65]) + sum(count[91:97]) + sum(count[123:127]) - marks
    return [upper / n, digit / n, marks / n, symbols / n, count[124] / n, count[10] / n, len(seen) / w,
            max(seen.values(), default=0) / w, len(raw) / w / 10, float(np.log1p(words) / 10)]


@dataclass
class Model:
    """Logistic weights of every kind: ``words`` (feature to a weight per kind), statistics
    standardised by ``mean`` and ``scale``, ``base``. A score is the log odds that a document
    is bad in that way; 0 for a kind that is not in ``fitted``."""
    words: dict[str, tuple[float, ...]]
    stats: list[tuple[float, ...]]
    mean: list[float]
    scale: list[float]
    base: tuple[float, ...]
    fitted: tuple[str, ...]

    def scorer(self):
        weights = [{x: self.words[f] for x, f in part.items()} for part in named_parts(self.words)]
        known = [frozenset(of) for of in weights]

        def score(text: str) -> tuple[float, ...]:
            seen = Counter(text.lower().split())
            hits = [of[x] for of, own, part in zip(weights, known, word_parts(seen)) for x in part & own]
            low, toxic = self.base
            for a, b in hits:
                low, toxic = low + a, toxic + b
            for x, (a, b), m, d in zip(text_stats(text, seen), self.stats, self.mean, self.scale):
                z = min(4.0, max(-4.0, (x - m) / d))
                low, toxic = low + a * z, toxic + b * z
            return low, toxic
        return score


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text``, ``low`` and ``toxic`` (1, 0 or null), ``fold`` and the row's key of every
    labelled document. Equal texts share a fold. Rows whose labels are both null are left out."""
    picked = (labels.select("doc_id", (F.col("quality") == 0).cast("int").alias("low"), (F.col("toxic") == 1).cast("int").alias("toxic"))
              .where("doc_id is not null and coalesce(low, toxic) is not null")
              .groupBy("doc_id").agg(F.max("low").alias("low"), F.max("toxic").alias("toxic")))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(FOLDS)).cast("int").alias("fold")
    return (docs.select("doc_id", text_or_empty("text").alias("text"), *row_key(F.col("doc_id"), text_or_empty("text")))
            .join(picked, "doc_id").select("text", "low", "toxic", fold, "_k1", "_k2"))


def numbers_of(batch, own: list[int], mean, scale):
    """The rows of numbers that a fit sees: a bit per word feature of ``own``, the standardised statistics and a 1 for the base."""
    import numpy as np
    n, own = batch.num_rows, np.array(own, np.int64)
    bits = np.frombuffer(b"".join(batch.column("hits").to_pylist()), np.uint8).reshape(n, -1)
    stats = np.frombuffer(b"".join(batch.column("stats").to_pylist()), "<f8").reshape(n, len(STATS))
    hits = (bits[:, own >> 3] >> (7 - (own & 7)).astype(np.uint8)) & 1
    stats = np.clip((stats - mean) / scale, -4, 4)
    return np.concatenate([hits.astype(np.float32), stats.astype(np.float32), np.ones((n, 1), np.float32)], 1)


def blocks(batches: Iterator) -> Iterator:
    for batch in batches:
        yield from (batch.slice(at, FIT_BLOCK) for at in range(0, batch.num_rows, FIT_BLOCK))


def counted_features(batches: Iterator) -> Iterator:
    """Rows of ``text``, ``low``, ``toxic`` and ``fold`` as documents (``n``) by feature and these labels, a block of rows at a time."""
    import pyarrow as pa
    forget()
    for batch in blocks(batches):
        out, at = [], []
        for i, text in enumerate(batch.column(0).to_pylist()):
            own = feature_names(text.lower().split())
            out += own
            at += [i] * len(own)
        rows = [batch.column(c).take(pa.array(at, pa.int32())) for c in (1, 2, 3)]
        counted = pa.table([pa.array(out, pa.string()), *rows], ["f", "low", "toxic", "fold"]).group_by(
            ["f", "low", "toxic", "fold"], use_threads=False).aggregate([([], "count_all")])
        yield from counted.select(["f", "low", "toxic", "fold", "count_all"]).rename_columns(["f", "low", "toxic", "fold", "n"]).to_batches()


def newton(rows: DataFrame, fits: list[tuple], columns: list[list[int]], mean, scale, ridge: float) -> list:
    """Weights of the penalised logistic likelihood of each of ``fits`` (kind and the fold left out, or None) over all
    ``rows``. A step of all fits is one job: tasks add up curvature and slope of their own rows, Spark adds up the
    tasks' sums, and the driver gets one sum per fit, whose size follows the features alone."""
    import numpy as np
    sizes = [len(own) + len(STATS) + 1 for own in columns]
    weights = [np.zeros(n) for n in sizes]
    moving = list(range(len(fits)))
    for _ in range(12):
        now = {i: (*fits[i], columns[i], weights[i]) for i in moving}

        def sums(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa
            total: dict = {}
            for part in blocks(batches):
                fold = part.column("fold").to_numpy(zero_copy_only=False)
                for i, (kind, out, own, w) in now.items():
                    y = part.column(kind).to_numpy(zero_copy_only=False).astype(float)
                    seen = np.flatnonzero(~np.isnan(y) & (fold != (-1 if out is None else out)))
                    if not len(seen):
                        continue
                    x = numbers_of(part.take(pa.array(seen)), own, mean, scale)
                    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                    h, slope = total.setdefault(i, (np.zeros((len(w), len(w))), np.zeros(len(w))))
                    h += x.T @ (x * (p * (1 - p)).astype(np.float32)[:, None])
                    slope += x.T @ (y[seen] - p)
            for i, (h, slope) in total.items():
                flat = np.concatenate([h[np.triu_indices(len(slope))], slope])
                at = range(0, len(flat), SUM_PIECE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(at), pa.int32()), pa.array(at, pa.int32()),
                     pa.array([flat[j:j + SUM_PIECE].tobytes() for j in at], pa.binary())], ["fit", "at", "sums"])

        def added(table):
            import numpy as np
            import pyarrow as pa
            whole = sum(np.frombuffer(x.as_buffer(), "<f8") for x in table.column("sums"))
            return pa.table([table.column("fit").slice(0, 1), table.column("at").slice(0, 1), pa.array([whole.tobytes()], pa.binary())],
                            ["fit", "at", "sums"])

        schema = "fit int, at int, sums binary"
        flat = {i: np.zeros(sizes[i] * (sizes[i] + 3) // 2) for i in moving}
        parts = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)  # as many sums as cores, however many files
        for r in parts.mapInArrow(sums, schema).groupBy("fit", "at").applyInArrow(added, schema).collect():
            piece = np.frombuffer(r.sums, "<f8")
            flat[r.fit][r["at"]:r["at"] + len(piece)] = piece
        release(rows.sparkSession)
        for i in list(moving):
            n = sizes[i]
            penalty = np.full(n, ridge)
            penalty[-1] = 1e-6
            h = np.zeros((n, n))
            h[np.triu_indices(n)] = flat[i][:-n]
            h = h + np.triu(h, 1).T + np.diag(penalty)
            step = np.linalg.solve(h, flat[i][-n:] - penalty * weights[i])
            weights[i] = weights[i] + step
            if abs(step).max() < 1e-3:
                moving.remove(i)
        if not moving:
            break
    return weights


def moments(rows: DataFrame) -> tuple:
    """Mean and standard deviation of each of ``STATS`` over all ``rows``."""
    import numpy as np

    def unpack(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            stats = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<f8").reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in stats.T.copy()], list(STATS))

    flat = rows.select("stats").mapInArrow(unpack, ", ".join(f"{c} double" for c in STATS))
    out = np.array(flat.agg(*[f(c) for f in (F.avg, F.stddev_pop) for c in STATS]).first(), float)
    return out[:len(STATS)], out[len(STATS):] + 1e-6


def fit(sample: DataFrame, features: int = FIT_FEATURES, ridge: float = 1.0) -> tuple:
    """Fit each of ``KINDS`` on all rows of ``sample`` (``labelled_rows``),
    and once more without each fold. Feature counts and the fits' sums are aggregated by Spark; the driver gets
    the ``features`` words most associated with the label (log-likelihood ratio) in each
    fit and, a step, one sum per fit. A kind without both classes
    is not fitted; the model is None without any. Returns the model and a written table with one row per labelled
    document: key, ``_low``, ``_toxic`` and for each kind the log odds from the fit that did not
    see its fold (null where some fold leaves one class only)."""
    import numpy as np
    sample = materialize(sample, "labelled")
    sums = [(k, v, j) for k in KINDS for v in (1, 0) for j in range(FOLDS)]
    sizes = sample.agg(*[F.count_if((F.col(k) == v) & (F.col("fold") == j)) for k, v, j in sums]).first()
    n = {s: float(x) for s, x in zip(sums, sizes)}
    total = lambda k, v, out: sum(n[k, v, j] for j in range(FOLDS) if j != out)
    both = lambda k, out: total(k, 1, out) > 0 and total(k, 0, out) > 0
    fits = [(k, None) for k in KINDS if both(k, None)]
    fits += [(k, j) for k in KINDS if all(both(k, i) for i in range(FOLDS)) for j in range(FOLDS)]
    if not fits:
        return None, None

    # a task counts the documents of a block by label and fold
    counts = sample.select("text", "low", "toxic", "fold").mapInArrow(counted_features, "f string, low int, toxic int, fold int, n long").groupBy("f").agg(
        *[F.coalesce(F.sum(F.when((F.col(k) == v) & (F.col("fold") == j), F.col("n"))), F.lit(0)).alias(f"{k}{v}_{j}") for k, v, j in sums])

    def ratio(kind: str, out: int | None) -> Column:
        n1, n0 = total(kind, 1, out), total(kind, 0, out)
        a, b = (sum((F.col(f"{kind}{v}_{j}") for j in range(FOLDS) if j != out), F.lit(0.0)) for v in (1, 0))
        share = (a + b) / (n1 + n0)

        def term(x: Column, n: float) -> Column:
            return (F.when(x > 0, x * F.log(x / (share * n))).otherwise(0.0)
                    + F.when(x < n, (n - x) * F.log((n - x) / (n * (1 - share)))).otherwise(0.0))
        return F.when(a + b >= 3, term(a, n1) + term(b, n0))

    best = Window.partitionBy("at").orderBy(F.desc("g"), "f")
    chosen = (counts.select("f", F.posexplode_outer(F.array(*[ratio(*x) for x in fits])).alias("at", "g")).where("g > 4")
              .withColumn("r", F.row_number().over(best)).where(F.col("r") <= features).select("at", "r", "f").collect())
    index = {f: i for i, f in enumerate(sorted({r.f for r in chosen}))}
    columns = [[index[r.f] for r in sorted(chosen, key=lambda r: r.r) if r.at == i] for i in range(len(fits))]

    width = -(-len(index) // 8)

    def numbers(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        place = [{x: index[f] for x, f in part.items()} for part in named_parts(index)]
        known = [frozenset(of) for of in place]
        for batch in blocks(batches):
            hits, stats = [], []
            for text in batch.column(0).to_pylist():
                seen = Counter(text.lower().split())
                own = np.zeros(8 * width, bool)
                own[[of[x] for of, names, part in zip(place, known, word_parts(seen)) for x in part & names]] = True
                hits.append(np.packbits(own).tobytes())
                stats.append(np.array(text_stats(text, seen), "<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.binary()), pa.array(stats, pa.binary()), *batch.columns[1:]],
                                             ["hits", "stats", *batch.schema.names[1:]])

    # one bit per feature
    rows = materialize(sample.select("text", "low", "toxic", "fold", "_k1", "_k2").mapInArrow(
        numbers, "hits binary, stats binary, low int, toxic int, fold int, _k1 long, _k2 long"), "labelled-numbers")
    release(sample.sparkSession, sample)
    mean, scale = moments(rows)
    fitted = newton(rows, fits, columns, mean, scale, ridge)
    final = {kind: (columns[i], fitted[i]) for i, (kind, out) in enumerate(fits) if out is None}
    unseen_by = {(kind, out): (columns[i], fitted[i]) for i, (kind, out) in enumerate(fits) if out is not None}

    def held_out(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for part in blocks(batches):
            fold = part.column("fold").to_numpy(zero_copy_only=False)
            held = {k: np.full(part.num_rows, np.nan) for k in KINDS}
            for (kind, out), (own, weights) in unseen_by.items():
                unseen = np.flatnonzero(fold == out)
                if len(unseen):
                    held[kind][unseen] = numbers_of(part.take(pa.array(unseen)), own, mean, scale) @ weights
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in ("_k1", "_k2", *KINDS)] + [pa.array(held[k], from_pandas=True) for k in KINDS],  # nan: no such score
                ["_k1", "_k2", *[f"_{k}" for k in KINDS], *[f"_{k}_held" for k in KINDS]])

    scores = materialize(rows.mapInArrow(held_out, "_k1 long, _k2 long, " + ", ".join(
        [f"_{k} int" for k in KINDS] + [f"_{k}_held double" for k in KINDS])), "held-out")
    release(sample.sparkSession, rows)
    names = list(index)
    words: dict[str, list[float]] = {}
    tail = np.zeros((len(STATS) + 1, len(KINDS)))
    for i, kind in enumerate(KINDS):
        own, weights = final.get(kind, ([], np.zeros(len(STATS) + 1)))
        for c, w in zip(own, weights.tolist()):
            words.setdefault(names[c], [0.0] * len(KINDS))[i] = w
        tail[:, i] = weights[len(own):]
    model = Model({f: tuple(w) for f, w in words.items()}, [tuple(w) for w in tail[:-1].tolist()], mean.tolist(),
                  scale.tolist(), tuple(tail[-1].tolist()), tuple(final))
    return model, scores


def held_out_cuts(scored: list[tuple], fitted: tuple[str, ...], lost: float = LOST_CLEAN) -> dict[str, float]:
    """For each kind the log odds from which a document goes, set on rows of ``low``, ``toxic`` and
    the log odds of each kind from a fit that did not see the row.

    Both cuts together reject at most ``lost`` of the clean rows (no bad label): ``low`` may take
    half, ``toxic`` what is left. At least one row each is allowed, as a small sample cannot
    show such a share. Within that a cut rejects as many bad rows as can be and
    lies midway between the last of them and the next clean row. A fitted kind without such
    scores is cut at log odds of 0; a kind that is not fitted rejects nothing."""
    import numpy as np
    cuts = {k: 0.0 if k in fitted else float("inf") for k in KINDS}
    label = {k: np.array([r[i] == 1 for r in scored], bool) for i, k in enumerate(KINDS)}
    clean = ~label["low"] & ~label["toxic"]
    left = int(lost * clean.sum())
    for i, kind in enumerate(KINDS):
        score = np.array([np.nan if r[len(KINDS) + i] is None else r[len(KINDS) + i] for r in scored], float)
        if kind not in fitted or not len(score) or np.isnan(score).any():
            continue
        share = max(1, left // (len(KINDS) - i))
        fair = np.sort(score[clean])[::-1]
        reached = score[label[kind] & (score > (fair[share] if len(fair) > share else -np.inf))]
        if not len(reached):
            cuts[kind] = float("inf")
            continue
        last, below = reached.min(), fair[fair < reached.min()]
        cuts[kind] = float((last + below[0]) / 2 if len(below) else last)
        gone = clean & (score >= cuts[kind])
        left -= int(gone.sum())
        clean = clean & ~gone
    return cuts


def nth_largest(rows: DataFrame, score: str, n: int) -> float:
    """The value of rank ``n`` (from 0, largest first) among ``rows``, which are counted in ever narrower
    ranges until the driver may hold what is left. There are more than ``n`` rows, none null."""
    x = F.col(score)
    low, high, size = rows.agg(F.min(x), F.max(x), F.count(x)).first()
    while size > RANKED_ROWS and low < high:
        width = (high - low) / 1024 or 5e-324
        part = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(1023))
        counts = rows.where(x.between(low, high)).groupBy(part.alias("at")).agg(
            F.min(x).alias("low"), F.max(x).alias("high"), F.count(x).alias("n")).orderBy(F.desc("at")).collect()
        for r in counts:
            if n < r.n:
                low, high, size = r.low, r.high, r.n
                break
            n -= r.n
    if low == high:
        return low
    return sorted((r[0] for r in rows.where(x.between(low, high)).select(x).collect()), reverse=True)[n]


def spread_cuts(scored: DataFrame, fitted: tuple[str, ...], lost: float = LOST_CLEAN) -> dict[str, float]:
    """``held_out_cuts`` of a table of any size: columns ``_low``, ``_toxic`` and the log odds ``low`` and ``toxic``.
    The driver gets counts and single scores."""
    cuts = {k: 0.0 if k in fitted else float("inf") for k in KINDS}
    clean = scored.where(" and ".join(f"not _{k} <=> 1" for k in KINDS))
    n = clean.count()
    left = int(lost * n)
    for i, kind in enumerate(KINDS):
        score = F.col(kind)
        if kind not in fitted or scored.isEmpty() or not scored.where(score.isNull() | F.isnan(score)).isEmpty():
            continue
        share = max(1, left // (len(KINDS) - i))
        floor = nth_largest(clean, kind, share) if n > share else float("-inf")
        last = scored.where((F.col(f"_{kind}") == 1) & (score > F.lit(floor))).agg(F.min(score)).first()[0]
        if last is None:
            cuts[kind] = float("inf")
            continue
        below = clean.where(score < F.lit(last)).agg(F.max(score)).first()[0]
        cuts[kind] = last if below is None else (last + below) / 2
        gone = clean.where(score >= F.lit(cuts[kind])).count()
        clean, left, n = clean.where(score < F.lit(cuts[kind])), left - gone, n - gone
    return cuts


def evidence(docs: DataFrame, model: Model | None, text_col: str = "text") -> Column:
    """Log odds that a document is ``low`` and ``toxic``, from its whole text; 0 without a model."""
    if model is None:
        return F.struct(*[F.lit(0.0).alias(k) for k in KINDS])

    @F.pandas_udf(", ".join(f"{k} double" for k in KINDS))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forget()
        one = model.scorer()
        for batch in batches:
            yield pd.DataFrame([one(x) for x in batch], columns=list(KINDS), dtype="float64")

    return score(text_or_empty(text_col))


def site_priors(scored: DataFrame, kinds: tuple[str, ...] = ("",)) -> Callable[[DataFrame], DataFrame]:
    """The site rates of ``scored`` as a function on rows of it: for each of ``kinds`` (a prefix
    of column names) it adds ``host_rate``, ``path_rate``, ``prior`` and ``posterior``, see
    ``site_posteriors``."""
    def share(kind: str) -> Column:
        return 1 / (1 + F.exp(-F.col(f"{kind}evidence")))

    paths = materialize(scored.groupBy("host", "path").agg(
        *[F.sum(share(k)).alias(f"{k}path_bad") for k in kinds], F.count(F.lit(1)).alias("path_n")), "paths")
    hosts = paths.groupBy("host").agg(*[F.sum(f"{k}path_bad").alias(f"{k}host_bad") for k in kinds], F.sum("path_n").alias("host_n"))
    hosts = materialize(hosts, "hosts")
    whole = hosts.agg(*[F.sum(f"{k}host_bad").alias(f"{k}bad") for k in kinds], F.sum("host_n").alias("n")).first()
    fitted = {}
    for kind in kinds if whole.n else ():
        mu = min(1 - 1e-6, max(1e-6, whole[f"{kind}bad"] / whole.n))

        def strength(groups: DataFrame, bad: str, n: str, around: Column) -> float:
            # moments: variance of a group's share = m(1-m) (1/n + (1-1/n) / (k+1))
            rate = F.col(bad) / F.col(n)
            r = groups.where(F.col(n) > 1).agg(
                F.sum(F.col(n) * (rate - around) ** 2).alias("v"), F.sum(around * (1 - around)).alias("within"),
                F.sum((F.col(n) - 1) * around * (1 - around)).alias("m")).first()
            between = ((r.v or 0.0) - (r.within or 0.0)) / r.m if r.m else 0.0
            return min(1e6, max(1.0, 1 / between - 1)) if between > 0 else 1e6

        k_host = strength(hosts, f"{kind}host_bad", "host_n", F.lit(mu))
        shrunk = (F.col(f"{kind}host_bad") + k_host * mu) / (F.col("host_n") + k_host)
        fitted[kind] = (mu, k_host, strength(paths.join(hosts, "host"), f"{kind}path_bad", "path_n", shrunk))
    sites = materialize(paths.join(hosts, "host"), "sites")
    inside = lambda c: F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), c))

    def add(rows: DataFrame) -> DataFrame:
        out = rows.join(sites, ["host", "path"])
        for kind in kinds:
            mu, k_host, k_path = fitted.get(kind, (0.5, 1.0, 1.0))
            p, rate = share(kind), F.col(f"{kind}path_rate")
            host = (F.col(f"{kind}host_bad") - p + k_host * mu) / (F.col("host_n") - 1 + k_host)
            path = (F.col(f"{kind}path_bad") - p + k_path * F.col(f"{kind}host_rate")) / (F.col("path_n") - 1 + k_path)
            out = out.withColumn(f"{kind}host_rate", inside(host)).withColumn(f"{kind}path_rate", inside(path))
            out = (out.withColumn(f"{kind}prior", F.log(rate / (1 - rate)) - F.log(F.lit(mu / (1 - mu))))
                   .withColumn(f"{kind}posterior", 1 / (1 + F.exp(-(F.col(f"{kind}evidence") + F.col(f"{kind}prior")))))
                   .drop(f"{kind}path_bad", f"{kind}host_bad"))
        return out.drop("path_n", "host_n")
    return add


def site_posteriors(scored: DataFrame) -> DataFrame:
    """Adds ``host_rate``, ``path_rate`` and ``posterior`` to rows with ``host``,
    ``path`` (never null) and ``evidence``.

    The bad share of a host is beta-binomial around the global share and that of a path
    around its host's; both prior strengths are fitted from the spread of the groups by
    moments. A document's own evidence is left out of its groups, so a site of
    one document falls back to its host's rate and a host of one to the
    global rate. posterior = sigmoid(evidence + logit(path_rate) - logit(global)).
    """
    return site_priors(scored)(scored).drop("prior")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", host_col: str = "source", path_col: str = "lang",
             text_col: str = "text", threshold: float | None = None, lost: float = LOST_CLEAN) -> DataFrame:
    """One row per document: the id, for low quality (``low_``) and toxicity (``toxic_``) each
    ``evidence``, ``host_rate``, ``path_rate`` and ``posterior``, the larger ``posterior``,
    ``kept`` and the row's key.

    A document goes if either posterior passes its own cut. Without a ``threshold`` for both the
    cuts are set on held-out folds of the labelled rows, their site priors included, so that
    at most ``lost`` of the clean ones go (``spread_cuts``).

    The models, statistics and cuts come from all labelled rows. All documents are
    scored over their whole text, once, and only ids, sites and scores move.
    The site table is written and joined as a plain table, so a host with a third of
    all rows is broadcast to or split. Null host or path is a site of its own; null
    text counts as empty; rows that repeat an id are scored each. A kind without labels
    of both classes rejects nothing. An empty table gives an empty result.
    """
    ship_code(docs.sparkSession)
    model, held = fit(labelled_rows(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), labels))
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit(""))
    scored = docs.select(F.col(f"`{id_col}`").alias("_id"), *row_key(F.col(f"`{id_col}`"), text_or_empty(text_col)),
                         name(host_col).alias("host"), name(path_col).alias("path"),
                         evidence(docs, model, text_col).alias("_e"))
    scored = materialize(scored, "scored").select("*", *[F.col("_e").getField(k).alias(f"{k}_evidence") for k in KINDS]).drop("_e")
    priors = site_priors(scored, tuple(f"{k}_" for k in KINDS))
    fitted = model.fitted if model else ()
    if threshold is None:
        # the full fit's share of a labelled row is left out of its site, its held-out log odds are put in
        cuts = held_out_cuts([], fitted, lost)
        if held is not None:
            unseen = held.dropDuplicates(["_k1", "_k2"])
            rows = materialize(priors(scored.join(unseen, ["_k1", "_k2"])).select(
                *[f"_{k}" for k in KINDS], *[(F.col(f"_{k}_held") + F.col(f"{k}_prior")).alias(k) for k in KINDS]), "held-out-scores")
            cuts = spread_cuts(rows, fitted, lost)
            release(docs.sparkSession, held, rows)
    else:
        cuts = {k: math.log(threshold / (1 - threshold)) if k in fitted else math.inf for k in KINDS}
    keep = F.lit(True)
    for k in KINDS:
        keep = keep & (F.col(f"{k}_evidence") + F.col(f"{k}_prior") < F.lit(cuts[k]))
    return priors(scored).select(
        F.col("_id").alias(id_col), *[f"{k}_{c}" for k in KINDS for c in ("evidence", "host_rate", "path_rate", "posterior")],
        F.greatest(*[f"{k}_posterior" for k in KINDS]).alias("posterior"), keep.alias("kept"), "_k1", "_k2")


def recall(classified: DataFrame, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", by: str = "lang") -> DataFrame:
    """``by``, ``kind`` (clean, low, toxic), ``labelled`` and ``rejected`` rows of ``classified``.
    Give labels that the fit did not see."""
    kinds = F.array(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean"), F.when(F.col("quality") == 0, "low"),
                    F.when(F.col("toxic") == 1, "toxic"))
    marked = labels.select(F.col("doc_id").alias(id_col), F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))
    rows = classified.select(id_col, "kept").join(marked, id_col).join(docs.select(id_col, by), id_col)
    return rows.groupBy(by, "kind").agg(F.count(F.lit(1)).alias("labelled"), F.count_if(~F.col("kept")).alias("rejected"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns."""
    # equal rows (id and text) differ at most in their site: the row goes if any is rejected
    bad = classify(docs, labels, id_col, text_col=text_col, **how).where("not kept").select("_k1", "_k2").distinct()
    rows = docs.select(packed(docs, None), *row_key(F.col(f"`{id_col}`"), text_or_empty(text_col)))
    return rows.join(bad, ["_k1", "_k2"], "left_anti").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
