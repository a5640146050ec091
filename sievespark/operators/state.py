"""The finding table over time: upserts of scan batches, absence, triage, retention.

A state is a DataFrame with one row per (source_id, fingerprint). Every operation gives the next state as a plan
over the last one (copy on write) and, where there are any, the events to append. ``save`` keeps states as
numbered Parquet folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What triage may do to a state.
TRANSITIONS = (("open", "false_positive"), ("open", "accepted_risk"), ("open", "resolved"), ("false_positive", "open"), ("accepted_risk", "open"), ("resolved", "open"))
_CONTENT = ("rule_id", "rulepack_version", "resource_locator", "redacted_snippet", "entropy", "confidence", "severity")
EVENT = ("source_id", "fingerprint", "kind", "from_value", "to_value", "scan_id", "at")


def one_per_fingerprint(batch: DataFrame, order: str = "ord") -> DataFrame:
    """The last payload of each (source, fingerprint) by ``order``, and ``n_payloads``, how many there were."""
    rest = [c for c in batch.columns if c not in ("source_id", "fingerprint")]
    return batch.groupBy("source_id", "fingerprint").agg(F.max_by(F.struct(*rest), F.col(order)).alias("_p"), F.count(F.lit(1)).alias("n_payloads")).select("source_id", "fingerprint", "_p.*", "n_payloads")


def plan_ingest(state: DataFrame, batch: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Payloads with what becomes of them: ``action`` is below_threshold, create, refresh, reopen or rekey.

    ``stored_fingerprint`` names the stored row. A payload that misses under its fingerprint is held against its
    previous one, as after a change of pepper; it takes that row if its previous secret hash is null or equal.
    """
    current = state.select("source_id", F.col("fingerprint").alias("_fp"), F.col("state").alias("_state"))
    rows = one_per_fingerprint(batch)
    rows = rows.join(current.withColumnRenamed("_fp", "fingerprint").withColumn("_hit", F.lit(True)), ["source_id", "fingerprint"], "left")
    older = state.select("source_id", F.col("fingerprint").alias("previous_fingerprint"), F.col("secret_hash").alias("_old_hash"), F.col("state").alias("_old_state"), F.lit(True).alias("_old_hit"))
    rows = rows.join(older, ["source_id", "previous_fingerprint"], "left")
    moved = F.col("_hit").isNull() & F.col("_old_hit").isNotNull() & (F.col("previous_secret_hash").isNull() | (F.col("previous_secret_hash") == F.col("_old_hash")))
    was = F.when(F.col("_hit").isNotNull(), F.col("_state")).when(moved, F.col("_old_state"))
    low = F.col("confidence").isNotNull() & (F.col("confidence") < threshold)
    action = F.when(low, "below_threshold").when(was.isNull(), "create").when(was == "resolved", "reopen").when(moved, "rekey").otherwise("refresh")
    stored = F.when(F.col("_hit").isNotNull(), F.col("fingerprint")).when(moved, F.col("previous_fingerprint"))
    return rows.withColumn("action", action).withColumn("stored_fingerprint", stored).withColumn("moved", F.coalesce(moved, F.lit(False))).drop("_hit", "_state", "_old_hash", "_old_state", "_old_hit")


def upsert(state: DataFrame, plan: DataFrame, scan_id: str, at: Column) -> DataFrame:
    """The state after a planned batch: one full outer join on the stored identity.

    A sighting renews content and ``last_seen_scan_id``, fills a missing correlation only, and opens what was
    resolved; whatever people have decided otherwise stays. A new finding's ``id`` is a hash of its identity, and
    a finding keeps its id when its fingerprint moves.
    """
    seen = plan.where("action <> 'below_threshold'")
    brought = ("fingerprint", "secret_hash", "correlation_id", "action", *_CONTENT, *[c for c in ("validation",) if c in plan.columns])
    new = seen.select("source_id", F.coalesce("stored_fingerprint", "fingerprint").alias("_key"), F.struct(*map(F.col, brought)).alias("_n"))
    old = state.select("source_id", F.col("fingerprint").alias("_key"), F.struct(*state.columns).alias("_o"))
    both = old.join(new, ["source_id", "_key"], "full_outer")
    hit, made = F.col("_n").isNotNull(), F.col("_o").isNull()
    opened = F.col("_n.action") == "reopen"
    take = lambda c: F.when(hit, F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")).alias(c)
    columns = {c: F.col(f"_o.{c}").alias(c) for c in state.columns} | {c: take(c) for c in ("fingerprint", "secret_hash", *_CONTENT)}
    columns |= _validated(state, plan, hit, at)
    columns |= {
        "source_id": F.col("source_id"),
        "id": F.coalesce("_o.id", F.sha2(F.concat_ws("|", "source_id", "_key"), 256)).alias("id"),
        "correlation_id": F.coalesce("_o.correlation_id", "_n.correlation_id").alias("correlation_id"),
        "state": F.when(made | F.coalesce(opened, F.lit(False)), "open").otherwise(F.col("_o.state")).alias("state"),
        "resolution": F.when(~made & ~F.coalesce(opened, F.lit(False)), F.col("_o.resolution")).alias("resolution"),
        "first_seen_scan_id": F.coalesce("_o.first_seen_scan_id", F.lit(scan_id)).alias("first_seen_scan_id"),
        "last_seen_scan_id": F.when(hit, F.lit(scan_id)).otherwise(F.col("_o.last_seen_scan_id")).alias("last_seen_scan_id"),
        "created_at": F.coalesce("_o.created_at", at).alias("created_at"),
        "updated_at": F.when(hit, at).otherwise(F.col("_o.updated_at")).alias("updated_at"),
    }
    return both.select(*[columns[c] for c in state.columns])


#: What tells one validation of a secret from another.
VALIDATION = ("provider", "validator_id", "contract_version", "status", "reason")


def _told_anew(new: Column, old: Column) -> Column:
    """A validation is there and some part of it is another than before, null being a value of its own."""
    same = F.lit(True)
    for part in VALIDATION:
        same = same & new[part].eqNullSafe(old[part])
    return new.isNotNull() & ~same


def _validated(state: DataFrame, plan: DataFrame, hit: Column, at: Column) -> dict[str, Column]:
    """The columns ``validation`` and ``validated_at`` after a batch, where state and batch have them: only a validation
    that differs is taken, and a payload without one leaves what is known."""
    if "validation" not in state.columns or "validation" not in plan.columns:
        return {}
    anew = hit & _told_anew(F.col("_n.validation"), F.col("_o.validation"))
    put = {"validation": F.col("_n.validation"), "validated_at": at}
    return {c: F.when(anew, v).otherwise(F.col(f"_o.{c}")).alias(c) for c, v in put.items() if c in state.columns}


def validation_events(state: DataFrame, plan: DataFrame, scan_id: str, at: Column) -> DataFrame:
    """An event per finding whose validation a batch tells anew, from the old status to the new, with what told it as ``comment``."""
    seen = plan.where("action <> 'below_threshold' AND validation IS NOT NULL").withColumn("_key", F.coalesce("stored_fingerprint", "fingerprint"))
    old = state.select("source_id", F.col("fingerprint").alias("_key"), F.col("validation").alias("_was"))
    rows = seen.join(old, ["source_id", "_key"], "left").where(_told_anew(F.col("validation"), F.col("_was")))
    told = F.concat_ws(":", *[F.coalesce(f"validation.{c}", F.lit("")) for c in ("provider", "validator_id", "contract_version", "reason")])
    return rows.select("source_id", "fingerprint", F.lit("validation").alias("kind"), F.col("_was.status").alias("from_value"), F.col("validation.status").alias("to_value"), F.lit(scan_id).alias("scan_id"), at.alias("at"), told.alias("comment"))


def ingest_events(plan: DataFrame, scan_id: str, at: Column) -> DataFrame:
    """An event per re-opened finding."""
    rows = plan.where("action = 'reopen'")
    return rows.select("source_id", "fingerprint", F.lit("reopened").alias("kind"), F.lit("resolved").alias("from_value"), F.lit("open").alias("to_value"), F.lit(scan_id).alias("scan_id"), at.alias("at"))


def ingest_tallies(plan: DataFrame) -> DataFrame:
    """One row: payloads ingested, created, refreshed, reopened, rekeyed and below the threshold."""
    kept = F.col("action") != "below_threshold"
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n_payloads"))), F.lit(0)).alias
    return plan.agg(count(kept)("ingested"), count(~kept)("below_threshold"), F.count_if(F.col("action") == "create").alias("created"), F.count_if(F.col("action") == "reopen").alias("reopened"), F.count_if(F.col("moved") & kept).alias("rekeyed"))


def resolve_absent(state: DataFrame, source_id: str, scan_id: str, at: Column, *, scan_status: str, coverage: str, mode: str, fetch_tasks: int) -> DataFrame:
    """Open, unsuppressed findings that a scan did not see become resolved, if its silence is evidence.

    That takes a completed full scan with complete coverage and at least one fetch; else the state is unchanged.
    """
    if (scan_status, coverage, mode) != ("completed", "complete", "full") or fetch_tasks < 1:
        return state
    gone = (F.col("source_id") == source_id) & (F.col("state") == "open") & F.col("suppressed_at").isNull() & ~F.col("last_seen_scan_id").eqNullSafe(F.lit(scan_id))
    put = lambda c, v: F.when(gone, v).otherwise(F.col(c)).alias(c)
    changed = {"state": put("state", F.lit("resolved")), "resolution": put("resolution", F.lit("auto")), "updated_at": put("updated_at", at)}
    return state.select(*[changed.get(c, F.col(c)) for c in state.columns])


def changes(before: DataFrame, after: DataFrame, scan_id: str | None, at: Column) -> DataFrame:
    """An event per finding whose state two snapshots tell differently."""
    a = before.select("source_id", "fingerprint", F.col("state").alias("from_value"))
    b = after.select("source_id", "fingerprint", F.col("state").alias("to_value"))
    rows = a.join(b, ["source_id", "fingerprint"]).where("from_value <> to_value")
    return rows.select("source_id", "fingerprint", F.lit("state_change").alias("kind"), "from_value", "to_value", F.lit(scan_id).cast("string").alias("scan_id"), at.alias("at"))


def triage(state: DataFrame, requests: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """The next state and the requests refused.

    ``requests`` has ``source_id, fingerprint, to_state`` and optionally ``assignee_id, notes``, one per finding; a
    request is taken whole or not at all, and only where the transition is allowed.
    """
    spark = state.sparkSession
    allowed = spark.createDataFrame(list(TRANSITIONS), "state string, to_state string").withColumn("_ok", F.lit(True))
    extra = [c for c in ("assignee_id", "notes") if c in requests.columns]
    asked = requests.join(state.select("source_id", "fingerprint", "state"), ["source_id", "fingerprint"], "left").join(F.broadcast(allowed), ["state", "to_state"], "left")
    fine = asked.where("_ok").select("source_id", "fingerprint", "to_state", *[F.col(c).alias(f"_{c}") for c in extra])
    rows = state.join(fine, ["source_id", "fingerprint"], "left")
    hit = F.col("to_state").isNotNull()
    new = {
        "resolution": F.when(hit, F.when(F.col("to_state") == "resolved", "manual")).otherwise(F.col("resolution")).alias("resolution"),
        "state": F.coalesce("to_state", "state").alias("state"),
        "updated_at": F.when(hit, at).otherwise(F.col("updated_at")).alias("updated_at"),
    } | {c: F.coalesce(f"_{c}", c).alias(c) for c in extra}
    return rows.select(*[new.get(c, F.col(c)) for c in state.columns]), asked.where("_ok is null").select(*requests.columns)


def purge(state: DataFrame, cutoff: Column) -> DataFrame:
    """The state without what retention lets go: resolved by absence, unsuppressed, untouched since before the cutoff."""
    gone = (F.col("state") == "resolved") & (F.col("resolution") == "auto") & F.col("suppressed_at").isNull() & (F.col("updated_at") < cutoff)
    return state.where(~F.coalesce(gone, F.lit(False)))


def correlate(state: DataFrame, derive: Column, redo: bool = False) -> DataFrame:
    """Correlation ids filled where missing, or with ``redo`` wherever they differ from ``derive``."""
    return state.withColumn("correlation_id", derive if redo else F.coalesce("correlation_id", derive))


def scrub(actions: DataFrame, closed: DataFrame, at: Column) -> DataFrame:
    """Remediation rows whose finding is closed keep their links' labels only and lose their note."""
    rows = actions.join(closed.select("finding_id").distinct().withColumn("_closed", F.lit(True)), "finding_id", "left")
    hit = F.col("_closed").isNotNull() & F.col("scrubbed_at").isNull()
    bare = F.transform("evidence_links", lambda x: F.struct(F.lit(None).cast("string").alias("url"), x["label"].alias("label"), F.lit(True).alias("scrubbed")))
    rows = rows.withColumn("evidence_links", F.when(hit, bare).otherwise(F.col("evidence_links"))).withColumn("note", F.when(~hit, F.col("note"))).withColumn("scrubbed_at", F.when(hit, at).otherwise(F.col("scrubbed_at")))
    return rows.select(*actions.columns)


def qualifies(actions: DataFrame, reopened: DataFrame) -> DataFrame:
    """Actions that count as evidence: not retracted, with a link that has an address, not older than the last re-opening."""
    last = reopened.groupBy("finding_id").agg(F.max("at").alias("_last"))
    linked = F.exists("evidence_links", lambda x: F.coalesce(F.trim(x["url"]) != "", F.lit(False)))
    rows = actions.join(last, "finding_id", "left").where(F.col("retracted_at").isNull() & linked)
    return rows.where(F.col("_last").isNull() | (F.col("created_at") >= F.col("_last"))).select(*actions.columns)


def history(events: DataFrame) -> DataFrame:
    """Events numbered within their finding by (at, kind)."""
    return events.withColumn("n", F.row_number().over(Window.partitionBy("source_id", "fingerprint").orderBy("at", "kind")))


def save(state: DataFrame, folder: str) -> int:
    """Write the state as the folder's next version and return its number; earlier versions stay readable."""
    version = (latest(state.sparkSession, folder) or 0) + 1
    state.write.parquet(f"{folder}/v={version}")
    return version


def latest(spark: SparkSession, folder: str) -> int | None:
    """The newest complete version (one whose write Spark has marked as done), or None."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = [int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max(found, default=None)


def load(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{folder}/v={latest(spark, folder) if version is None else version}")


def verify(actions: DataFrame, requests: DataFrame, at: Column) -> DataFrame:
    """Remediation rows after verifications ``(id, actor_id)``: set once, and never on a row taken back."""
    return _once(actions, requests, at, {"verified_at": at, "verified_by": F.col("actor_id")}, "verified_at")


def retract(actions: DataFrame, requests: DataFrame, at: Column) -> DataFrame:
    """Remediation rows after being taken back by ``(id, actor_id, reason)``; the first time counts, nothing is deleted."""
    return _once(actions, requests, at, {"retracted_at": at, "retracted_by": F.col("actor_id"), "retracted_reason": F.col("reason")}, "retracted_at")


def _once(actions: DataFrame, requests: DataFrame, at: Column, values: dict[str, Column], mark: str) -> DataFrame:
    asked = requests.dropDuplicates(["id"]).withColumn("_asked", F.lit(True))
    rows = actions.join(asked, "id", "left")
    hit = F.col("_asked").isNotNull() & F.col(mark).isNull() & F.col("retracted_at").isNull()
    return rows.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in actions.columns])


def audit(actor_id: str | None, action: str, changed: DataFrame, target_type: str, at: Column, id_col: str = "id") -> DataFrame:
    """Rows to append to the audit log: one per changed row with ``from_value`` and ``to_value``."""
    return changed.select(F.lit(actor_id).cast("string").alias("actor_id"), F.lit(action).alias("action"), F.lit(target_type).alias("target_type"), F.col(id_col).cast("string").alias("target_id"), "from_value", "to_value", at.alias("created_at"))
