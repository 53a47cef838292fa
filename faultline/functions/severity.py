"""Severity, category and penalty expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline import seeds

# One penalty unit is 1/10000 of a score point, so sums are exact integers.
UNITS = 10_000


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def lookup(values: dict, key: Column) -> Column:
    """Value of ``key`` in a small fixed table, null when absent."""
    return F.try_element_at(literal_map(values), key)


def severity_rank(severity: Column) -> Column:
    """0 for the worst severity up to 3, 4 for anything unknown."""
    ranks = {name: rank for rank, name in enumerate(seeds.SEVERITIES)}
    return F.coalesce(lookup(ranks, severity), F.lit(len(ranks)))


def scored_severity(severity: Column) -> Column:
    """Unknown severities are scored and counted as MEDIUM."""
    return F.when(severity.isin(*seeds.SEVERITIES), severity).otherwise("MEDIUM")


def line_bucket(line: Column) -> Column:
    return F.floor(line / 2)


def canonical_category(category: Column, aliases: dict | None = None) -> Column:
    aliases = seeds.CATEGORY_ALIASES if aliases is None else aliases
    return F.coalesce(
        lookup(aliases, category), lookup(aliases, F.upper(category)), F.lower(category))


def penalty_units(severity: Column, confidence: Column, category: Column) -> Column:
    """Penalty of one finding in integer units."""
    scored = scored_severity(severity)
    share = F.greatest(F.lit(30), F.least(F.lit(100), confidence))
    factor = (
        F.when(category == "hardcoded-secrets", 115)
        .when((category == seeds.DEPENDENCY_CATEGORY) & (scored == "CRITICAL"), 110)
        .otherwise(100))
    return (lookup(seeds.SEVERITY_WEIGHTS, scored) * share * factor).cast("long")


def score_from_units(penalty: Column, worst_rank: Column) -> Column:
    """0..100 from a penalty sum: half-even rounding, then the cap of the worst severity."""
    left = F.greatest(F.lit(0).cast("long"), F.lit(100 * UNITS) - penalty)
    rounded = F.bround(left / F.lit(UNITS), 0).cast("int")
    caps = {rank: seeds.SCORE_CAPS[name] for rank, name in enumerate(seeds.SEVERITIES)}
    return F.least(rounded, F.coalesce(lookup(caps, worst_rank), F.lit(100)))


def banded(value: Column, bands, field: int = 1) -> Column:
    """Label of the first band whose lower bound ``value`` reaches."""
    label = F.lit(bands[-1][field])
    for band in reversed(bands[:-1]):
        label = F.when(value >= band[0], band[field]).otherwise(label)
    return label


def posture(score: Column) -> Column:
    return banded(score, seeds.POSTURE_BANDS)


def graph_rank(severity: Column) -> Column:
    return F.coalesce(lookup(seeds.GRAPH_RANKS, F.upper(severity)), F.lit(0))
