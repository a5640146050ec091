"""What every source must keep to, as DataFrames of the rows that break it; an empty one is a pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("connector_type", "resource_id", "sub_resource", "origin")


def _counted(rows: DataFrame, name: str) -> DataFrame:
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(c) for c in KEYS]
    return rows.select(*shown, F.xxhash64("text").alias("text_hash")).groupBy(*KEYS, "text_hash").agg(F.count(F.lit(1)).alias(name))


def undetermined(read: Callable[[], DataFrame]) -> DataFrame:
    """Units that two reads of the same source don't give equally often."""
    a, b = _counted(read(), "first"), _counted(read(), "second")
    return a.join(b, [*KEYS, "text_hash"], "full_outer").where(~F.col("first").eqNullSafe(F.col("second")))


def beyond(part: DataFrame, whole: DataFrame) -> DataFrame:
    """Units of an incremental read that the full one doesn't have."""
    a, b = _counted(part, "n"), _counted(whole, "m")
    return a.join(b, [*KEYS, "text_hash"], "left").where(F.col("m").isNull() | (F.col("n") > F.col("m")))


def repeated(units: DataFrame) -> DataFrame:
    """Identities that more than one unit has."""
    return _counted(units, "n").groupBy(*KEYS).agg(F.sum("n").alias("n")).where("n > 1")


def lost(before: DataFrame, after: DataFrame, whole: DataFrame) -> DataFrame:
    """Units that neither a read that stopped nor the one that resumed it gave."""
    seen = _counted(before.select(*KEYS, "text").unionByName(after.select(*KEYS, "text")), "n")
    return _counted(whole, "m").join(seen, [*KEYS, "text_hash"], "left_anti")


def leaking(rows: DataFrame, columns: list[str], sentinel: str) -> DataFrame:
    """Rows that show a planted value in a column that must never hold one."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).cast("string").contains(sentinel), F.lit(False))
    return rows.where(hit)
