"""The end of scans: what was covered, what its silence proves, and how far the next scan may start, decided together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import Change, Layout, Store
from . import coverage, cursors, state

ACTIVE_TASKS = ("queued", "leased", "running")


def outcomes(scans: DataFrame, tasks: DataFrame, reports: DataFrame) -> DataFrame:
    """The coverage of each of the ``scans`` ``(id, source_id, mode)`` that has only finished tasks, and what it allows.

    ``trusted``: all of it completed, nothing was skipped or failed, no report is missing; cursors may advance.
    ``silent``: trusted, full, with at least one task; what it did not see is gone.
    """
    open_ = tasks.where(F.col("status").isin(*ACTIVE_TASKS)).select("scan_id").distinct()
    found = coverage.manifest(tasks, reports).join(open_, "scan_id", "left_anti")
    rows = scans.select(F.col("id").alias("scan_id"), "source_id", "mode").join(found, "scan_id")
    trusted = (F.col("status") == "completed") & (F.col("coverage") == "complete")
    return rows.withColumn("trusted", trusted).withColumn("silent", trusted & (F.col("mode") == "full") & (F.col("tasks") > 0))


def resolved(findings: DataFrame, ended: DataFrame, at: Column) -> DataFrame:
    """The findings with those resolved that a silent scan of their source did not see, and ``gone``, which these are.

    Open and unsuppressed ones only. Of several silent scans of one source the largest id speaks.
    """
    silent = ended.where("silent").groupBy("source_id").agg(F.max("scan_id").alias("_scan"))
    rows = findings.join(silent, "source_id", "left")
    gone = F.col("_scan").isNotNull() & (F.col("state") == "open") & F.col("suppressed_at").isNull() & ~F.col("last_seen_scan_id").eqNullSafe(F.col("_scan"))
    rows = rows.withColumn("gone", gone)
    put = {"state": F.lit("resolved"), "resolution": F.lit("auto"), "updated_at": at}
    return rows.select(*[F.when(F.col("gone"), put[c]).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in findings.columns], "gone", "_scan")


def events(after: DataFrame, at: Column) -> DataFrame:
    """An event per finding that ``resolved`` has closed."""
    rows = after.where("gone")
    return rows.select("source_id", "fingerprint", F.lit("state_change").alias("kind"), F.lit("open").alias("from_value"), F.lit("resolved").alias("to_value"), F.col("_scan").alias("scan_id"), at.alias("at"))


def announcements(after: DataFrame, ended: DataFrame, reopened: DataFrame, at: Column) -> DataFrame:
    """``(source_id, fingerprint, scan_id, status, queued_at)``: findings that trusted scans have opened and that are still open."""
    trusted = ended.where("trusted").select("scan_id")
    still = after.where((F.col("state") == "open") & F.col("suppressed_at").isNull() & F.col("source_id").isNotNull() & F.col("fingerprint").isNotNull())
    again = reopened.where("kind = 'reopened'").select("source_id", "fingerprint", "scan_id").join(still.select("source_id", "fingerprint"), ["source_id", "fingerprint"], "left_semi")
    opened = still.select("source_id", "fingerprint", F.col("first_seen_scan_id").alias("scan_id")).unionByName(again)
    rows = opened.join(trusted, "scan_id", "left_semi").distinct()
    return rows.select("source_id", "fingerprint", "scan_id", F.lit("pending").alias("status"), at.alias("queued_at"))


def advanced(held: DataFrame, proposals: DataFrame, ended: DataFrame, at: Column) -> DataFrame:
    """The cursors after the proposals ``(scan_id, …)`` of trusted scans."""
    fine = proposals.join(ended.where("trusted").select("scan_id"), "scan_id", "left_semi").drop("scan_id")
    return cursors.commit(held, fine, at)


def finalize(store: Store, scans: DataFrame, tasks: DataFrame, reports: DataFrame, proposals: DataFrame, at: Column, writer: str | None = None, sequence: int | None = None) -> int:
    """Freeze the manifests, resolve what is gone, log it, advance cursors and queue announcements, in one version.

    Only the ranges of findings with a change are written again. Tables: ``findings``, ``events``, ``manifests``,
    ``cursors``, ``outbox``. The outcomes and the touched ranges, which several of them are made from, are written first,
    so tasks and reports are read and added up once. If anything fails on the way the last version stands whole; a repeat with the same
    ``sequence`` changes nothing.
    """
    base = store.head()
    layout: Layout = store.layouts["findings"]
    if writer is not None and store.describe(base)["sequences"].get(writer, -1) >= sequence:
        return base
    held: list[str] = []
    try:
        ended = store.staged(outcomes(scans, tasks, reports), held)
        found = resolved(store.read("findings", base), ended, at)
        touched = store.staged(found.where("gone").select(layout.range_of().alias("range")).distinct(), held)
        after = resolved(store.read("findings", base, touched), ended, at)
        changes = {
            "findings": Change(after.drop("gone", "_scan"), "ranges", touched),
            "events": Change(events(found, at), "append"),
            "manifests": Change(ended, "append"),
            "cursors": Change(advanced(store.read("cursors", base), proposals, ended, at)),
            "outbox": Change(announcements(found, ended, store.read("events", base), at), "append"),
        }
        return store.commit(changes, base, writer, sequence)
    finally:
        store.unstage(held)


def cancel(tasks: DataFrame, scans: DataFrame, at: Column) -> DataFrame:
    """The tasks after their scans ``(scan_id)`` are cancelled.

    Finished tasks stay. Another one becomes cancelled, and its report keeps what it has counted so far and gains one
    gap of that reason: ``reasons`` is a map from (disposition, reason) to counts, to which ``{scope_gap, cancelled: 1}``
    is added key by key, null being the empty map. As a cancelled task is finished, cancelling twice is cancelling once.
    A task of Spark holds the ids of its scans only, the fetch tasks stream past them and are not sorted.
    """
    asked = scans.select("scan_id").distinct().withColumn("_asked", F.lit(True)).hint("shuffle_hash")
    rows = tasks.join(asked, "scan_id", "left")
    hit = F.col("_asked").isNotNull() & F.col("status").isin(*ACTIVE_TASKS)
    gap = F.create_map(F.struct(F.lit("scope_gap").alias("disposition"), F.lit("cancelled").alias("reason")), F.lit(1).cast("bigint"))
    new = {
        "reasons": F.when(hit, added(F.col("reasons"), gap)).otherwise(F.col("reasons")),
        "gaps_omitted": F.when(hit, F.coalesce("gaps_omitted", F.lit(0)) + 1).otherwise(F.col("gaps_omitted")),
        "finished_at": F.when(hit, at).otherwise(F.col("finished_at")),
        "status": F.when(hit, "cancelled").otherwise(F.col("status")),
    }
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in tasks.columns])


def added(a: Column, b: Column) -> Column:
    """Two maps of counts added key by key; null is the empty map, a null count none."""
    total = F.map_zip_with(F.coalesce(a, F.map_from_arrays(F.array(), F.array())), b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(total)


def map_sums(rows: DataFrame, key: str, maps: str, names: list | None = None) -> DataFrame:
    """``(key, maps)``: the maps of all rows of a key added up.

    Null maps and null counts add nothing; a key with no entry at all has an empty map. Where the maps' ``names`` are
    known, as reasons are, each is a sum of its own and tasks add up before the one shuffle; entries of other names are
    left out. Otherwise entries are added up by key and name first, then gathered by key.
    """
    if names is not None:
        sums = [F.sum(F.coalesce(F.element_at(maps, F.lit(n)), F.when(F.map_contains_key(maps, F.lit(n)), F.lit(0)))).alias(f"_{i}") for i, n in enumerate(names)]
        cells = F.array(*[F.struct(F.lit(n).alias("k"), F.col(f"_{i}").alias("v")) for i, n in enumerate(names)])
        return rows.groupBy(key).agg(*sums).select(key, F.map_from_entries(F.array_sort(F.filter(cells, lambda x: x["v"].isNotNull()))).alias(maps))
    cells = rows.select(key, F.explode_outer(maps).alias("_k", "_v")).groupBy(key, "_k").agg(F.sum("_v").alias("_v"))
    some = F.filter(F.collect_list(F.struct("_k", F.coalesce("_v", F.lit(0)))), lambda x: x["_k"].isNotNull())
    return cells.groupBy(key).agg(F.map_from_entries(F.array_sort(some)).alias(maps))
