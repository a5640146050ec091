"""Reads over findings, scans and their neighbours: filters, pages, clusters, workloads, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.severity import at_least, highest, rank
from .route import actionable, overdue

PAGE, MOST_PAGE = 50, 200
#: Fixed values.
ACTIVE_SCANS = ("queued", "discovering", "running")
TERMINAL_SCANS = ("completed", "partial", "failed", "cancelled")


def filtered(findings: DataFrame, as_of: Column, **want) -> DataFrame:
    """Findings that meet every given condition; one that is None asks for nothing.

    ``source_id, state, rule_id, severity, assignee_id, owner_group_id, correlation_id`` compare for equality;
    ``unowned, overdue, suppressed`` are True or False; ``min_severity`` compares by rank.
    """
    tests = {
        "unowned": F.col("owner_group_id").isNull(),
        "overdue": overdue(as_of),
        "suppressed": F.col("suppressed_at").isNotNull(),
    }
    for name, value in want.items():
        if value is None:
            continue
        if name in tests:
            findings = findings.where(tests[name] if value else ~tests[name])
        elif name == "min_severity":
            findings = findings.where(at_least(F.col("severity"), F.lit(value)))
        else:
            findings = findings.where(F.col(name) == value)
    return findings


def page(rows: DataFrame, keys: list[str], after: tuple | None = None, size: int = PAGE) -> DataFrame:
    """The next ``size`` rows by ``keys`` strictly after ``after``, and one more that tells of a further page."""
    if after is not None:
        rows = rows.where(F.struct(*keys) > F.struct(*[F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(keys, after)]))
    return rows.orderBy(*keys).limit(min(size, MOST_PAGE) + 1)


def clusters(findings: DataFrame, least: int = 1, source_id: str | None = None) -> DataFrame:
    """A row per correlation id: members, sources, open ones, greatest severity, first and last times.

    ``source_id`` keeps clusters with a member in that source, counted over all their members. Distinct sources
    are counted from per-source sums, so a large cluster is combined before it is shuffled.
    """
    rows = findings.where(F.col("correlation_id").isNotNull())
    if source_id is not None:
        rows = rows.join(rows.where(F.col("source_id") == source_id).select("correlation_id").distinct(), "correlation_id", "left_semi")
    return footprint(rows).groupBy("correlation_id").agg(
        F.sum("findings").alias("findings"),
        F.count(F.lit(1)).alias("sources"),
        F.sum("open_findings").alias("open_findings"),
        highest("severity").alias("severity"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
    ).where(F.col("findings") >= least)


def footprint(findings: DataFrame) -> DataFrame:
    """A row per correlation id and source."""
    return findings.groupBy("correlation_id", "source_id").agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(F.col("state") == "open").alias("open_findings"),
        highest("severity").alias("severity"),
        F.min("created_at").alias("first_at"),
        F.max("updated_at").alias("last_at"),
    )


def members(findings: DataFrame, sources: DataFrame, correlation_id: str, most: int = 25_000) -> DataFrame:
    """A cluster's findings with their source's name, for export; more than ``most`` are refused by the caller's count."""
    rows = findings.where(F.col("correlation_id") == correlation_id)
    return rows.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id").orderBy("created_at", "id").limit(most + 1)


def workload(findings: DataFrame, as_of: Column) -> DataFrame:
    """A row per owner group, null for unowned: actionable findings and how many are overdue."""
    return findings.where(actionable()).groupBy("owner_group_id").agg(F.count(F.lit(1)).alias("open_findings"), F.count_if(overdue(as_of)).alias("overdue_findings"))


def overview(findings: DataFrame, as_of: Column, me: str) -> DataFrame:
    """One row with the counts of a dashboard, from one pass."""
    return findings.agg(
        F.count_if(actionable()).alias("open_findings"),
        F.count_if(actionable() & (F.col("severity") == "critical")).alias("critical_findings"),
        F.count_if(actionable() & (F.col("assignee_id") == me)).alias("mine"),
        F.count_if(overdue(as_of)).alias("overdue_findings"),
        F.count_if(actionable() & F.col("owner_group_id").isNull()).alias("unowned"),
    )


def scan_counts(findings: DataFrame) -> DataFrame:
    """A row per scan: findings first seen and last seen in it."""
    both = F.explode(F.array(F.struct(F.col("first_seen_scan_id").alias("scan_id"), F.lit(1).alias("new"), F.lit(0).alias("seen")), F.struct(F.col("last_seen_scan_id").alias("scan_id"), F.lit(0).alias("new"), F.lit(1).alias("seen"))))
    return findings.select(both.alias("x")).groupBy("x.scan_id").agg(F.sum("x.new").alias("new_findings"), F.sum("x.seen").alias("seen_findings"))


def newly_open(findings: DataFrame, events: DataFrame, scan_id: str) -> DataFrame:
    """Findings first seen in the scan or re-opened by it, each once."""
    reopened = events.where((F.col("kind") == "reopened") & (F.col("scan_id") == scan_id)).select("source_id", "fingerprint").distinct()
    again = findings.join(reopened, ["source_id", "fingerprint"], "left_semi")
    return findings.where(F.col("first_seen_scan_id") == scan_id).unionByName(again).dropDuplicates(["source_id", "fingerprint"])


def latest_terminal(scans: DataFrame) -> DataFrame:
    """Each source's last finished scan."""
    order = F.struct("finished_at", "created_at", "id")
    return scans.where(F.col("status").isin(*TERMINAL_SCANS)).groupBy("source_id").agg(F.max_by(F.struct(*[c for c in scans.columns if c != "source_id"]), order).alias("s")).select("source_id", "s.*")


def rules_in_force(engines: DataFrame) -> DataFrame:
    """A row per rule that engines run: its first description and the pack versions it is in, in order."""
    rows = engines.where("rulepack is not null").select(F.col("rulepack.version").alias("version"), F.explode("rulepack.rules").alias("r"))
    return rows.groupBy(F.col("r.id").alias("rule_id")).agg(F.min_by("r.description", F.struct("version", "r.description")).alias("description"), F.sort_array(F.collect_set("version")).alias("versions"))


def consensus(engines: DataFrame) -> DataFrame:
    """One row: the pack version that all active engines run, null unless they agree."""
    live = engines.where(F.col("status") == "active").agg(F.count_distinct("rulepack.version").alias("n"), F.max("rulepack.version").alias("v"))
    return live.select(F.when(F.col("n") == 1, F.col("v")).alias("version"))


def most_severe(findings: DataFrame, by: list[str], most: int) -> DataFrame:
    """At most ``most`` rows per ``by``, by severity, confidence, then place."""
    w = Window.partitionBy(*by).orderBy(rank("severity").desc(), F.desc("confidence"), "start", "fingerprint")
    return findings.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def for_role(findings: DataFrame, role: str) -> DataFrame:
    """What a role may see: secret hashes never, correlation and notes only for analysts and admins."""
    shown = findings.drop("secret_hash")
    if role in ("analyst", "admin"):
        return shown
    return shown.withColumns({c: F.lit(None).cast(shown.schema[c].dataType) for c in ("correlation_id", "notes") if c in shown.columns})


def reconciliation(before: DataFrame, after: DataFrame, scan_id: str) -> DataFrame:
    """One row on what a scan did: findings new, seen, resolved by absence and opened again, told by their ids."""
    a = before.select("id", F.col("state").alias("_was"))
    b = after.select("id", "state", "resolution", "first_seen_scan_id", "last_seen_scan_id")
    rows = b.join(a, "id", "left")
    return rows.agg(
        F.count_if(F.col("first_seen_scan_id") == scan_id).alias("new_findings"),
        F.count_if(F.col("last_seen_scan_id") == scan_id).alias("seen_findings"),
        F.count_if((F.col("_was") == "open") & (F.col("state") == "resolved") & (F.col("resolution") == "auto")).alias("resolved_findings"),
        F.count_if((F.col("_was") == "resolved") & (F.col("state") == "open")).alias("reopened_findings"),
    )


def audit_trail(events: DataFrame, target_type: str, target_id: str) -> DataFrame:
    """What was done to one object, in order."""
    return events.where((F.col("target_type") == target_type) & (F.col("target_id") == target_id)).orderBy("created_at", "id")


def guidance(findings: DataFrame, texts: DataFrame) -> DataFrame:
    """Each finding with its rule's guidance, or the one kept under ``default``."""
    default = texts.where("rule_id = 'default'").select(F.col("guidance").alias("_default")).limit(1).collect()
    own = texts.where("rule_id <> 'default'").select("rule_id", "guidance")
    return findings.join(own, "rule_id", "left").withColumn("guidance", F.coalesce("guidance", F.lit(default[0]["_default"] if default else None)))


def unauthorised(validations: DataFrame, policies: DataFrame) -> DataFrame:
    """Validation results that no enabled policy for their rule, provider and contract allowed."""
    keys = ["rule_id", "provider", "contract_version"]
    return validations.join(policies.where("enabled").select(*keys), keys, "left_anti")


def fetch_tallies(units: DataFrame) -> DataFrame:
    """A row per source of units: how many were scanned, skipped and failed."""
    count = lambda what: F.count_if(F.col("outcome") == what).alias(what)
    return units.groupBy("connector_type").agg(F.count(F.lit(1)).alias("units"), count("scanned"), count("skipped"), count("failed"))
