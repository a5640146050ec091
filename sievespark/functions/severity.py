"""Severity as an order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from the least to the greatest.
ORDER = ("low", "medium", "high", "critical")


def rank(severity: Column | str) -> Column:
    """0 for low to 3 for critical; null for anything else."""
    name = F.col(severity) if isinstance(severity, str) else severity
    return F.when(name.isin(*ORDER), F.array_position(F.array(*map(F.lit, ORDER)), name) - 1).cast("int")


def at_least(severity: Column | str, least: Column | str) -> Column:
    """True where the severity is at or above ``least``; a null ``least`` asks for nothing."""
    floor = F.col(least) if isinstance(least, str) else least
    return floor.isNull() | F.coalesce(rank(severity) >= rank(floor), F.lit(False))


def highest(severity: Column | str) -> Column:
    """Aggregate: the greatest severity by rank."""
    name = F.col(severity) if isinstance(severity, str) else severity
    return F.max_by(name, rank(name))
