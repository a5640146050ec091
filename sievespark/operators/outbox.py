"""Announcements, escalations and hand-overs: what is due to whom, once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import at_least
from .route import overdue

BACKOFF_SECONDS, MOST_ATTEMPTS, SILENCE_HOURS, SNIPPET, MOST_ACTIONS = 60, 5, 72, 500, 10
#: Shares of a finding's actions that are ranked apart before the rest is.
SHARES = 64
#: States at the other end.
CLOSED_THERE, LIVE_THERE = ("resolved", "rejected", "cancelled"), ("open", "in_progress")
#: Channels are set up by people; more than this many are refused, as every row holds those that want it.
MOST_CHANNELS = 1_000


def wants() -> Column:
    """Channel ``c`` (a struct with ``min_severity, source_ids``) accepts the finding."""
    return at_least(F.col("severity"), F.col("c.min_severity")) & (F.coalesce(F.size("c.source_ids"), F.lit(0)).isin(-1, 0) | F.array_contains("c.source_ids", F.col("source_id")))


def targets(findings: DataFrame, channels: DataFrame) -> DataFrame:
    """A row per finding and enabled channel that wants it; channels ride along as one array, bounded in number."""
    listed = channels.where("enabled").select("id", "min_severity", "source_ids").limit(MOST_CHANNELS + 1).collect()
    if len(listed) > MOST_CHANNELS:
        raise ValueError(f"more than {MOST_CHANNELS} channels")
    kind = "array<struct<id:string,min_severity:string,source_ids:array<string>>>"
    import json

    ride = F.from_json(F.lit(json.dumps([r.asDict() for r in listed])), kind)
    return findings.withColumn("c", F.explode(ride)).where(wants()).withColumn("channel_id", F.col("c.id")).drop("c")


def enqueue(newly_open: DataFrame, channels: DataFrame, deliveries: DataFrame, scan_id: str) -> DataFrame:
    """New announcements ``(channel_id, source_id, fingerprint, scan_id)``, none that exists."""
    rows = targets(newly_open, channels).select("channel_id", "source_id", "fingerprint", F.lit(scan_id).alias("scan_id"))
    return rows.join(deliveries, ["channel_id", "source_id", "fingerprint", "scan_id"], "left_anti")


def escalations(findings: DataFrame, channels: DataFrame, groups: DataFrame, sent: DataFrame, as_of: Column) -> DataFrame:
    """Overdue findings to escalate ``(channel_id, source_id, fingerprint, due_at)``, once per deadline.

    A finding of a live group goes to that group's channel if it is enabled, else to nobody; one without an
    owner, or whose group is disbanded, goes to every channel that wants it.
    """
    late = findings.where(overdue(as_of)).join(sent, ["source_id", "fingerprint", "due_at"], "left_anti")
    live = groups.where(~F.coalesce("disabled", F.lit(False))).select(F.col("id").alias("owner_group_id"), F.col("notification_channel_id").alias("_channel"), F.lit(True).alias("_live"))
    rows = late.join(live, "owner_group_id", "left")
    on = channels.where("enabled").select(F.col("id").alias("_channel"))
    owned = rows.where("_live").join(on, "_channel").withColumn("channel_id", F.col("_channel"))
    free = targets(rows.where("_live is null"), channels)
    names = ["channel_id", "source_id", "fingerprint", "due_at"]
    return owned.select(*names).union(free.select(*names))


def after_attempt(ok: Column, permanent: Column, attempts: Column, at: Column) -> Column:
    """``struct(status, attempts, next_attempt_at)`` once an attempt is made: delivered, pending again later, or failed."""
    n = attempts + 1
    later = F.timestamp_seconds(F.unix_timestamp(at) + BACKOFF_SECONDS * F.pow(F.lit(2.0), n - 1).cast("bigint"))
    status = F.when(ok, "delivered").when(permanent | (n >= MOST_ATTEMPTS), "failed").otherwise("pending")
    return F.struct(status.alias("status"), n.alias("attempts"), F.when(status == "pending", later).alias("next_attempt_at"))


def due(deliveries: DataFrame, as_of: Column, batch: int = 50) -> DataFrame:
    """The next deliveries to attempt, the longest due first."""
    return deliveries.where((F.col("status") == "pending") & (F.col("next_attempt_at") <= as_of)).orderBy("next_attempt_at", "id").limit(batch)


def pending(deliveries: DataFrame) -> DataFrame:
    """How many deliveries of each channel are queued; channels without any have no row."""
    return deliveries.where("status = 'pending'").groupBy("channel_id").agg(F.count(F.lit(1)).alias("pending"))


def payload(as_of: Column) -> Column:
    """JSON of an overdue announcement: a fixed list of fields, a bounded snippet, whole hours late."""
    hours = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp("due_at")) / 3600)
    return F.to_json(F.struct("source_id", "fingerprint", "rule_id", "severity", F.left("redacted_snippet", F.lit(SNIPPET)).alias("snippet"), hours.alias("overdue_by_hours")))


def conflict(external: Column, state: Column, dismissed: Column) -> Column:
    """What two systems disagree on, or null; a state that was dismissed is silent."""
    found = F.when(external.isin(*CLOSED_THERE) & (state == "open"), F.concat(F.lit("external_"), external, F.lit("_finding_open")))
    found = found.when(external.isin(*LIVE_THERE) & (state != "open"), F.concat(F.lit("finding_"), state, F.lit("_external_open")))
    return F.when(~F.coalesce(external == dismissed, F.lit(False)), found)


def silent(handoffs: DataFrame, as_of: Column, hours: int = SILENCE_HOURS) -> DataFrame:
    """Delivered hand-overs whose other end has not called back for ``hours``."""
    since = F.coalesce("last_callback_at", "delivered_at")
    return handoffs.where((F.col("status") == "delivered") & (F.unix_timestamp(as_of) - F.unix_timestamp(since) > hours * 3600))


def callbacks(handoffs: DataFrame, calls: DataFrame) -> DataFrame:
    """External states after callbacks in any order: the newest by its own time wins, every call marks its arrival."""
    seen = calls.groupBy("handoff_id").agg(F.max_by("state", F.struct("state_at", "received_at")).alias("_state"), F.max("state_at").alias("_at"), F.max("received_at").alias("_got"))
    rows = handoffs.join(seen, handoffs.id == seen.handoff_id, "left")
    newer = F.col("_at").isNotNull() & (F.col("external_state_at").isNull() | (F.col("_at") > F.col("external_state_at")))
    put = {"external_state": F.when(newer, F.col("_state")).otherwise(F.col("external_state")), "external_state_at": F.when(newer, F.col("_at")).otherwise(F.col("external_state_at")), "last_callback_at": F.greatest("last_callback_at", "_got")}
    return rows.select(*[put[c].alias(c) if c in put else handoffs[c] for c in handoffs.columns])


def first_actions(actions: DataFrame, most: int = MOST_ACTIONS) -> DataFrame:
    """Per finding its first actions by time as one array, at most ``most``.

    Rows are ranked first, in a task's share of a finding and then among what the shares leave, so that no task
    takes all actions of a busy one and no array holds more than ``most``.
    """
    from pyspark.sql import Window

    order = (F.col("occurred_at").asc_nulls_first(), F.col("kind").asc_nulls_first())
    rows = actions.select("finding_id", "occurred_at", "kind").withColumn("_share", F.pmod(F.xxhash64("occurred_at", "kind"), F.lit(SHARES)))
    for key in (("finding_id", "_share"), ("finding_id",)):
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
    ordered = F.slice(F.array_sort(F.collect_list(F.struct("occurred_at", "kind"))), 1, most)
    return rows.groupBy("finding_id").agg(ordered.alias("actions"))


def request(wanted: DataFrame, existing: DataFrame, allowed: Column) -> tuple[DataFrame, DataFrame]:
    """New hand-overs ``(target_id, source_id, fingerprint, idempotency_key)`` and the requests refused.

    A pair that exists is neither: asking again changes nothing. ``allowed`` is the target's filter.
    """
    keys = ["target_id", "source_id", "fingerprint"]
    fresh = wanted.join(existing.select(*keys), keys, "left_anti").dropDuplicates(keys)
    key = F.concat_ws("-", F.lit("handoff"), "target_id", "source_id", "fingerprint")
    ok = F.coalesce(allowed, F.lit(False))
    return fresh.where(ok).select(*keys, key.alias("idempotency_key")), fresh.where(~ok).select(*keys)


def replay(handoffs: DataFrame, which: Column, at: Column) -> DataFrame:
    """Failed hand-overs that ``which`` holds for are pending again, from no attempts, under the same key."""
    hit = (F.col("status") == "failed") & F.coalesce(which, F.lit(False))
    put = {"status": F.when(hit, "pending").otherwise(F.col("status")), "attempts": F.when(hit, 0).otherwise(F.col("attempts")), "next_attempt_at": F.when(hit, at).otherwise(F.col("next_attempt_at"))}
    return handoffs.select(*[put[c].alias(c) if c in put else F.col(c) for c in handoffs.columns])


def health(handoffs: DataFrame, as_of: Column) -> DataFrame:
    """One row: conflicts and silent hand-overs. ``handoffs`` has the finding's state beside its own columns."""
    found = conflict(F.col("external_state"), F.col("state"), F.col("conflict_dismissed_state"))
    since = F.coalesce("last_callback_at", "delivered_at")
    quiet = (F.col("status") == "delivered") & (F.unix_timestamp(as_of) - F.unix_timestamp(since) > SILENCE_HOURS * 3600)
    return handoffs.agg(F.count(found).alias("conflicts"), F.count_if(F.coalesce(quiet, F.lit(False))).alias("silent"))
