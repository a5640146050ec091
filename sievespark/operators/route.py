"""Owners and deadlines of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import at_least

#: Hours to respond by severity.
RESPONSE_HOURS = {"critical": 24, "high": 72, "medium": 336, "low": 720}
#: Routing rules are written by people; more than this many are refused, as they all stand in the plan.
MOST_RULES = 2_000


def live_rules(rules: DataFrame, groups: DataFrame) -> DataFrame:
    """Enabled rules whose owner group isn't disabled."""
    open_groups = groups.where(~F.coalesce(F.col("disabled"), F.lit(False))).select(F.col("id").alias("owner_group_id"))
    return rules.where("enabled").join(open_groups, "owner_group_id")


def first_owner(findings: DataFrame, rules: DataFrame, groups: DataFrame, tags: Column | None = None) -> DataFrame:
    """Adds ``routed_group_id``: the group of the first rule by (priority, created_at, id) that matches, or null.

    A rule matches if each thing it names does: source, rule, least severity, and tags that the source must all
    have in any case. The rules become one expression, so findings are neither shuffled nor paired with rules.
    """
    ordered = live_rules(rules, groups).orderBy("priority", "created_at", "id").limit(MOST_RULES + 1).collect()
    if len(ordered) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} routing rules")
    have = F.transform(F.coalesce(tags if tags is not None else F.array().cast("array<string>"), F.array().cast("array<string>")), F.lower)
    cases = []
    for r in ordered:
        test = F.lit(True)
        if r["source_id"] is not None:
            test = test & (F.col("source_id") == r["source_id"])
        if r["rule_id"] is not None:
            test = test & (F.col("rule_id") == r["rule_id"])
        if r["min_severity"] is not None:
            test = test & at_least(F.col("severity"), F.lit(r["min_severity"]))
        if r["source_tags"]:
            wanted = F.array(*[F.lit(t.lower()) for t in r["source_tags"]])
            test = test & (F.size(F.array_except(wanted, have)) == 0)
        cases.append(F.when(test, F.lit(r["owner_group_id"])))
    return findings.withColumn("routed_group_id", F.coalesce(*cases) if cases else F.lit(None).cast("string"))


def route(findings: DataFrame, rules: DataFrame, groups: DataFrame, tags: Column | None = None) -> DataFrame:
    """Owners set where there is none and nobody has pinned that; the others stay."""
    found = first_owner(findings, rules, groups, tags)
    free = F.col("owner_group_id").isNull() & ~F.coalesce(F.col("owner_pinned"), F.lit(False))
    return found.withColumn("owner_group_id", F.when(free, F.col("routed_group_id")).otherwise(F.col("owner_group_id"))).drop("routed_group_id")


def deadline(at: Column, severity: Column, hours: dict[str, int] = RESPONSE_HOURS) -> Column:
    """``at`` plus the severity's hours; null for a severity without a target."""
    table = F.create_map(*[F.lit(x) for pair in hours.items() for x in pair])
    return F.timestamp_seconds(F.unix_timestamp(at) + F.element_at(table, severity) * 3600)


def start_clock(findings: DataFrame, at: Column, restart: Column | None = None, hours: dict[str, int] = RESPONSE_HOURS) -> DataFrame:
    """Deadlines set where missing, and anew where ``restart`` holds."""
    due = F.when(F.col("due_at").isNull() | (restart if restart is not None else F.lit(False)), deadline(at, F.col("severity"), hours)).otherwise(F.col("due_at"))
    return findings.withColumn("due_at", due)


def overdue(as_of: Column) -> Column:
    """Open, unsuppressed and past its deadline; a finding without a deadline isn't overdue."""
    return actionable() & F.coalesce(F.col("due_at") < as_of, F.lit(False))


def actionable() -> Column:
    return (F.col("state") == "open") & F.col("suppressed_at").isNull()
