"""Severity vocabulary (canonical info < warning < error < critical)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical severity order, and the mapping of the other two
# vocabularies onto it.
SEVERITIES = ["info", "warning", "error", "critical"]
SEVERITY_ALIASES = {"low": "info", "medium": "warning", "high": "error"}


def canonical(sev: Column) -> Column:
    low = F.lower(sev)
    expr = None
    for k, v in SEVERITY_ALIASES.items():
        expr = F.when(low == k, v) if expr is None else expr.when(low == k, v)
    return expr.otherwise(low)


def rank(sev: Column) -> Column:
    """S-16: 0..3, NULL for unknown values."""
    pos = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), canonical(sev))
    return F.when(pos > 0, (pos - 1).cast("int"))


def in_band(sev: Column, min_sev: Column, max_sev: Column) -> Column:
    """F-17: min <= sev <= max on rank; NULL bounds are open."""
    r = rank(sev)
    return (F.coalesce(r >= rank(min_sev), F.lit(True)) & F.coalesce(r <= rank(max_sev), F.lit(True))
            & r.isNotNull())


def from_analysis(score: Column, change: Column, new_entities: Column) -> Column:
    """S-20: critical if score <= -0.8 or |change| >= 0.5; warning if
    score <= -0.5 or |change| >= 0.3 or new entities >= 3; else info."""
    ch = F.abs(F.coalesce(change, F.lit(0.0)))
    sc = F.coalesce(score, F.lit(0.0))
    n = F.coalesce(new_entities, F.lit(0))
    return (F.when((sc <= -0.8) | (ch >= 0.5), "critical")
            .when((sc <= -0.5) | (ch >= 0.3) | (n >= 3), "warning")
            .otherwise("info"))
