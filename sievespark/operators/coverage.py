"""What scans have and have not read: reports merged into manifests, their differences, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_GAPS = 10_000
COUNTS = ("requested", "discovered", "scanned", "skipped", "failed")
#: Which reasons a disposition may have.
REASONS = {
    "skipped": ("unsupported_type", "empty_content", "binary_content"),
    "failed": ("permission_denied", "rate_limited", "size_limit", "output_limit", "connector_error", "missing_resource", "invalid_metadata", "invalid_response", "parse_error", "timeout"),
    "scope_gap": ("permission_denied", "rate_limited", "connector_error", "missing_resource", "invalid_metadata", "invalid_response", "timeout", "cancelled", "unreported"),
}


def or_null(column: str) -> Column:
    """Sum that is null if any value is."""
    return F.when(F.count(column) == F.count(F.lit(1)), F.sum(column))


def merged(reports: DataFrame, key: str = "scan_id") -> DataFrame:
    """A row per scan from its tasks' reports: counts added, ``requested`` null if one report lacks it."""
    sums = [or_null(c).alias(c) if c == "requested" else F.sum(c).alias(c) for c in COUNTS]
    return reports.groupBy(key).agg(*sums, F.count(F.lit(1)).alias("reports"))


def merged_reasons(reports: DataFrame, key: str = "scan_id") -> DataFrame:
    """A row per scan, disposition and reason with its count; maps of reports are added key by key."""
    rows = reports.select(key, F.explode("reasons").alias("r"))
    return rows.groupBy(key, F.col("r.disposition").alias("disposition"), F.col("r.reason").alias("reason")).agg(F.sum("r.count").alias("n"))


def merged_gaps(gaps: DataFrame, key: str = "scan_id", most: int = MOST_GAPS) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` gaps of each scan by reference, and per scan how many more there are."""
    ranked = gaps.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("reference")))
    omitted = gaps.groupBy(key).agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("gaps_omitted"))
    return ranked.where(F.col("n") <= most).drop("n"), omitted


def lawful(reports: DataFrame) -> DataFrame:
    """Reports that break a law of counting: discovered is what was scanned, skipped and failed."""
    return reports.where(F.coalesce(F.col("discovered") != F.col("scanned") + F.col("skipped") + F.col("failed"), F.lit(True)))


def illegal_reasons(reasons: DataFrame) -> DataFrame:
    """Rows whose reason doesn't go with their disposition."""
    spark = reasons.sparkSession
    legal = spark.createDataFrame([(d, r) for d, rs in REASONS.items() for r in rs], "disposition string, reason string")
    return reasons.join(F.broadcast(legal), ["disposition", "reason"], "left_anti")


def delta(current: DataFrame, sent: DataFrame, key: str = "scan_id") -> DataFrame:
    """What current counts add to those sent before."""
    old = sent.select(key, *[F.col(c).alias(f"_{c}") for c in COUNTS])
    rows = current.join(old, key, "left")
    return rows.select(key, *[(F.col(c) - F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in COUNTS])


def scan_status() -> Column:
    """Aggregate over a scan's tasks: cancelled if any is, completed if all are, partial if some are, else failed."""
    done = F.count_if(F.col("status") == "completed")
    return F.when(F.bool_or(F.col("status") == "cancelled"), "cancelled").when(done == F.count(F.lit(1)), "completed").when(done > 0, "partial").otherwise("failed")


def first_error() -> Column:
    """Aggregate: the error of the first failed task by (created_at, id)."""
    failed = (F.col("status") == "failed") & F.col("error").isNotNull()
    return F.min_by(F.when(failed, F.col("error")), F.when(failed, F.struct("created_at", "id")))


def in_order(tasks: DataFrame) -> DataFrame:
    """Tasks numbered within their scan by (created_at, id), the order in which reports and errors are read."""
    return tasks.withColumn("n", F.row_number().over(Window.partitionBy("scan_id").orderBy("created_at", "id")))


def manifest(tasks: DataFrame, reports: DataFrame) -> DataFrame:
    """A row per scan: status, coverage state, counts and what is unreported.

    Coverage follows a status other than completed; else it is partial if anything was skipped, failed or not
    reported, or is a gap in scope, and complete otherwise.
    """
    status = tasks.groupBy("scan_id").agg(scan_status().alias("status"), F.count(F.lit(1)).alias("tasks"), first_error().alias("error"))
    rows = status.join(merged(reports), "scan_id", "left")
    unreported = F.col("tasks") - F.coalesce("reports", F.lit(0))
    open_ends = (F.coalesce("skipped", F.lit(0)) > 0) | (F.coalesce("failed", F.lit(0)) > 0) | (unreported > 0)
    state = F.when(F.col("status") != "completed", F.col("status")).when(open_ends, "partial").otherwise("complete")
    return rows.select("scan_id", "status", state.alias("coverage"), "tasks", unreported.alias("unreported"), *[F.coalesce(c, F.lit(0)).alias(c) if c != "requested" else F.col(c) for c in COUNTS], "error")


def task_outcome(status: Column, failed: Column, scope_gaps: Column, truncated: Column) -> Column:
    """A task that says completed has failed if anything in it failed, is missing or was cut short."""
    bad = (F.coalesce(failed, F.lit(0)) > 0) | (F.coalesce(scope_gaps, F.lit(0)) > 0) | (F.coalesce(truncated, F.lit(0)) > 0)
    return F.when((status == "completed") & bad, "failed").otherwise(status)
