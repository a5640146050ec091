"""Cursors: how far each scope of a source has been read, and when that no longer counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def invalid_reason(as_of: Column) -> Column:
    """Why a cursor can't be used, by the first of these that holds, or null.

    Columns of the cursor joined with its source: ``invalidated_at, invalidation_reason, rulepack_version,
    source_configuration_version, minted_at`` and ``current_rulepack, current_configuration, pepper_rotating,
    full_scan_interval_days``.
    """
    age = F.unix_timestamp(as_of) - F.unix_timestamp("minted_at")
    return (
        F.when(F.col("minted_at").isNull(), "no_cursor")
        .when(F.col("invalidated_at").isNotNull(), F.coalesce("invalidation_reason", F.lit("operator_requested")))
        .when(~F.col("source_configuration_version").eqNullSafe(F.col("current_configuration")), "source_configuration_changed")
        .when(F.col("current_rulepack").isNull() | ~F.col("rulepack_version").eqNullSafe(F.col("current_rulepack")), "rulepack_changed")
        .when(F.coalesce("pepper_rotating", F.lit(False)), "pepper_rotating")
        .when(age >= F.col("full_scan_interval_days") * 86_400, "interval_elapsed")
    )


def plan_mode(cursors: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """A row per source: incremental if it has live cursors and none is invalid, else full, with the reason and baseline."""
    live = cursors.where("invalidated_at is null")
    rows = sources.join(live, sources.id == live.source_id, "left").withColumn("reason", invalid_reason(as_of))
    found = rows.groupBy(sources.id.alias("source_id")).agg(F.min("reason").alias("reason"), F.min("minted_at").alias("baseline"))
    return found.select("source_id", F.when(F.col("reason").isNull(), "incremental").otherwise("full").alias("mode"), "reason", F.when(F.col("reason").isNull(), F.col("baseline")).alias("baseline"))


def baseline(cursors: DataFrame) -> DataFrame:
    """Per source the oldest time its live cursors were minted: before it nothing of an incremental scan looked."""
    return cursors.where("invalidated_at is null").groupBy("source_id").agg(F.min("minted_at").alias("baseline"))


def commit(cursors: DataFrame, proposals: DataFrame, at: Column) -> DataFrame:
    """Cursors after completed tasks' proposals: one row per (source, scope); a retired row comes to life again.

    ``proposals`` has ``source_id, scope, position, rulepack_version, source_configuration_version, status``.
    """
    done = proposals.where("status = 'completed'").groupBy("source_id", "scope").agg(F.max_by(F.struct("position", "rulepack_version", "source_configuration_version"), F.col("position")).alias("_n"))
    rows = cursors.join(done, ["source_id", "scope"], "full_outer")
    hit = F.col("_n").isNotNull()
    fields = ("position", "rulepack_version", "source_configuration_version")
    return rows.select(
        "source_id", "scope", *[F.when(hit, F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c) for c in fields],
        F.when(hit, at).otherwise(F.col("minted_at")).alias("minted_at"),
        F.when(~hit, F.col("invalidated_at")).alias("invalidated_at"), F.when(~hit, F.col("invalidation_reason")).alias("invalidation_reason"),
    )


def invalidate(cursors: DataFrame, which: Column, reason: str, at: Column) -> DataFrame:
    """Live cursors that ``which`` holds for are retired with a reason; retired ones keep theirs."""
    hit = F.coalesce(which, F.lit(False)) & F.col("invalidated_at").isNull()
    return cursors.withColumn("invalidation_reason", F.when(hit, F.lit(reason)).otherwise(F.col("invalidation_reason"))).withColumn("invalidated_at", F.when(hit, at).otherwise(F.col("invalidated_at")))


def changed(specs: DataFrame, cursors: DataFrame) -> DataFrame:
    """Specs of scopes without a live cursor, and those whose revision is beyond it; an undated one is always read."""
    live = cursors.where("invalidated_at is null").select("source_id", "scope", "position")
    rows = specs.join(live, ["source_id", "scope"], "left")
    return rows.where(F.col("position").isNull() | F.col("revision").isNull() | (F.col("revision") > F.col("position"))).select(*specs.columns)


def windows(bounds: DataFrame, most: int = 64, ladder: tuple[int, ...] = (7, 30, 90, 365, 1825, 3650)) -> DataFrame:
    """Half-open time windows per project from its oldest to newest record: at most ``most``, of the first width that does.

    ``bounds`` has ``project, oldest, newest``. The first window has no lower bound and the last ends a minute
    after the newest record.
    """
    days = (F.unix_timestamp("newest") - F.unix_timestamp("oldest")) / 86_400
    width = F.coalesce(*[F.when(F.ceil((days + 1 / 1440) / w) <= most, F.lit(w)) for w in ladder], F.ceil((days + 1 / 1440) / most).cast("int"))
    n = F.greatest(F.lit(1), F.ceil((days + 1 / 1440) / F.col("width"))).cast("int")
    rows = bounds.withColumn("width", width).withColumn("windows", n).select("*", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("w"))
    edge = lambda i: F.timestamp_seconds(F.unix_timestamp("oldest") + i * F.col("width") * 86_400)
    end = F.timestamp_seconds(F.unix_timestamp(F.date_trunc("minute", "newest")) + 60)
    return rows.select("project", F.col("w").alias("window"), F.when(F.col("w") > 0, edge(F.col("w"))).alias("from_at"), F.when(F.col("w") < F.col("windows") - 1, edge(F.col("w") + 1)).otherwise(end).alias("to_at"))


def read_windows(records: DataFrame, windows: DataFrame, failures: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(fresh, gaps)``: what a run over windows delivers, and the windows that it could not read.

    A source answers by the minute, so a window's answer begins at the start of its first minute and overlaps the one
    before. ``records`` has ``project, issue_id, revision, updated_at``; ``windows`` as ``windows`` makes them, at most
    ``most`` a project; ``failures`` has ``project, window, reason``; ``seen`` has ``project, issue_id, revision`` of
    earlier runs. A record comes once, from the first of its windows that was read (``window``), unless an earlier run
    has delivered that revision; one that stands only in failed windows is covered by their gaps and comes with a later
    run. Nothing is told twice: a window fails with the first of its reasons.
    """
    failed = failures.groupBy("project", "window").agg(F.min("reason").alias("reason"))
    marked = windows.join(failed, ["project", "window"], "left")
    gaps = marked.where("reason IS NOT NULL").select("project", "window", "from_at", "to_at", "reason")
    answers = F.array_sort(F.collect_list(F.struct("window", F.date_trunc("minute", "from_at").alias("from_at"), "to_at")))
    answered = marked.where("reason IS NULL").groupBy("project").agg(answers.alias("_windows"))  # bounded by the windows of a project
    holds = lambda w: (w["from_at"].isNull() | (F.col("updated_at") >= w["from_at"])) & (F.col("updated_at") < w["to_at"])
    rows = records.join(answered, "project").withColumn("window", F.get(F.filter("_windows", holds), F.lit(0))["window"]).where("window IS NOT NULL")
    first = rows.groupBy("project", "issue_id", "revision").agg(F.min("window").alias("window"))
    return first.join(seen.select("project", "issue_id", "revision").distinct(), ["project", "issue_id", "revision"], "left_anti"), gaps
