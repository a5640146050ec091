"""Versions of several tables, ranges written again, replays, conflicts, failures on the way; finalising and cancelling scans."""

import pytest
from pyspark.sql import functions as F

from sievespark.operators import finalize, state
from sievespark.plans import mapping
from sievespark.sources.store import Change, Conflict, Layout, Store
from sievespark.streaming import ingest
from tests.test_state_and_streams import PAYLOAD, at, payload


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store with space", {"findings": Layout(width=1)})


def numbers(spark, *ids):
    return spark.createDataFrame([("s1", f"f{i}", i) for i in ids], "source_id string, fingerprint string, n int")


def held(store, table="findings", version=None):
    return sorted(r.n for r in store.read(table, version).collect())


def test_versions_of_several_tables(spark, store):
    assert store.head() == 0 and store.tables() == []
    assert store.commit({"findings": Change(numbers(spark, 1, 2)), "other": Change(numbers(spark, 7))}) == 1
    assert store.commit({"other": Change(numbers(spark, 8), "append")}) == 2
    assert held(store) == [1, 2] and held(store, "other") == [7, 8] and held(store, "other", 1) == [7]
    assert store.tables() == ["findings", "other"]


def test_touched_ranges_only_are_written_again(spark, store):
    layout = store.layouts["findings"]
    store.commit({"findings": Change(numbers(spark, *range(200)))})
    first = {r.path: r.range for r in store.files("findings").collect()}
    assert len(set(first.values())) == 16
    touched = numbers(spark, 5).select(layout.range_of().alias("range"))
    part = store.read("findings", ranges=touched)
    assert 0 < part.count() < 40
    store.commit({"findings": Change(part.withColumn("n", F.col("n") + 1000), "ranges", touched)})
    second = {r.path: r.range for r in store.files("findings").collect()}
    assert {second[p] for p in second.keys() - first.keys()} == {first[p] for p in first.keys() - second.keys()} == {touched.first().range}
    assert len(held(store)) == 200 and 1005 in held(store) and held(store, version=1) == list(range(200))


def test_a_replay_changes_nothing_and_gaps_are_refused(spark, store):
    for _ in range(2):
        assert store.commit({"findings": Change(numbers(spark, 1), "append")}, writer="w", sequence=0) == 1
    with pytest.raises(ValueError):
        store.commit({"findings": Change(numbers(spark, 2), "append")}, writer="w", sequence=2)
    assert held(store) == [1] and store.commit({"findings": Change(numbers(spark, 2), "append")}, writer="w", sequence=1) == 2


def test_the_second_of_two_writers_is_refused(spark, store):
    store.commit({"findings": Change(numbers(spark, 1))})
    store.commit({"findings": Change(numbers(spark, 2), "append")}, base=1)
    with pytest.raises(Conflict):
        store.commit({"findings": Change(numbers(spark, 3), "append")}, base=1)
    with pytest.raises(Conflict):
        store._publish(2, {})
    assert held(store) == [1, 2]


def test_a_failure_between_two_tables_leaves_the_old_version(spark, store):
    store.commit({"findings": Change(numbers(spark, 1)), "other": Change(numbers(spark, 1))})
    broken = numbers(spark, 2).withColumn("n", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"findings": Change(numbers(spark, 2)), "other": Change(broken)})
    assert store.head() == 1 and held(store) == [1] and held(store, "other") == [1]


def test_old_versions_go_with_the_files_only_they_name(spark, store):
    store.commit({"findings": Change(numbers(spark, *range(50)))})
    layout = store.layouts["findings"]
    for i in range(3):
        touched = numbers(spark, i).select(layout.range_of().alias("range"))
        store.commit({"findings": Change(store.read("findings", ranges=touched), "ranges", touched)})
    before = held(store)
    gone = store.expire(keep=2)
    assert gone >= 1 and store.versions() == [3, 4] and held(store) == held(store, version=3) == before
    assert store.expire(keep=2) == 0


def test_an_empty_table_keeps_its_columns(spark, store):
    store.commit({"findings": Change(numbers(spark))})
    assert store.read("findings").columns == ["source_id", "fingerprint", "n"] and held(store) == []


def test_a_batch_is_kept_once_and_moves_between_ranges(spark, store, sf_dir):
    empty = mapping.findings(spark, sf_dir).limit(0)
    batch = lambda *rows: spark.createDataFrame(list(rows), PAYLOAD)
    for _ in range(2):
        assert ingest.keep(store, batch(payload("a"), payload("b"), payload("c", confidence=0.1)), empty, "n1", at(), "w", 0) == 1
    assert ingest.keep(store, batch(payload("A", old="a", old_hash="h"), payload("b")), empty, "n2", at(), "w", 1) == 2
    assert sorted((r.fingerprint, r.first_seen_scan_id, r.last_seen_scan_id) for r in store.read("findings").collect()) == [("A", "n1", "n2"), ("b", "n1", "n2")]
    assert sorted(r.fingerprint for r in store.read("findings", 1).collect()) == ["a", "b"]


def scan_tables(spark):
    scans = spark.createDataFrame([("n1", "s1", "full"), ("n2", "s2", "incremental"), ("n3", "s3", "full"), ("n4", "s4", "full")], "id string, source_id string, mode string")
    task = "scan_id string, id int, status string, error string, created_at timestamp, requested bigint, discovered bigint, scanned bigint, skipped bigint, failed bigint"
    row = lambda scan, i, status, skipped=0: (scan, i, status, None, None, 1, 1, 1 - skipped, skipped, 0)
    tasks = spark.createDataFrame([row("n1", 1, "completed"), row("n2", 1, "completed"), row("n3", 1, "completed", 1), row("n4", 1, "completed"), row("n4", 2, "running")], task)
    return scans, tasks, tasks


def test_scans_end_in_one_version(spark, store, sf_dir):
    empty = mapping.findings(spark, sf_dir).limit(0)
    batch = spark.createDataFrame([payload("seen"), payload("gone")], PAYLOAD)
    for n, source in enumerate(("s1", "s2", "s3", "s4")):
        ingest.keep(store, batch.withColumn("source_id", F.lit(source)), empty, "old", at(), "w", n)
    base = ingest.keep(store, batch.where("fingerprint = 'seen'"), empty, "n1", at(), "w", 4)
    cursor = "source_id string, scope string, position bigint, rulepack_version string, source_configuration_version string, minted_at timestamp, invalidated_at timestamp, invalidation_reason string"
    store.commit({"cursors": Change(spark.createDataFrame([("s3", "x", 1, None, None, None, None, None)], cursor))})
    proposals = spark.createDataFrame([(f"n{i}", f"s{i}", "x", 9, "v", "c", "completed") for i in (1, 2, 3, 4)], "scan_id string, source_id string, scope string, position bigint, rulepack_version string, source_configuration_version string, status string")
    scans, tasks, reports = scan_tables(spark)

    broken = proposals.withColumn("position", F.raise_error(F.lit("lost")).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        finalize.finalize(store, scans, tasks, reports, broken, at())
    assert store.head() == base + 1 and "manifests" not in store.tables()

    for _ in range(2):
        version = finalize.finalize(store, scans, tasks, reports, proposals, at(), "ends", 0)
    assert version == base + 2
    assert [(r.source_id, r.fingerprint) for r in store.read("findings").where("state = 'resolved'").collect()] == [("s1", "gone")]
    assert [(r.source_id, r.fingerprint, r.scan_id) for r in store.read("events").where("kind = 'state_change'").collect()] == [("s1", "gone", "n1")]
    assert sorted((r.source_id, r.position) for r in store.read("cursors").collect()) == [("s1", 9), ("s2", 9), ("s3", 1)]
    assert sorted((r.scan_id, r.coverage) for r in store.read("manifests").collect()) == [("n1", "complete"), ("n2", "complete"), ("n3", "partial")]
    assert store.read("outbox").count() == 0
    kept = {r.path for r in store.files("findings").collect()} & {r.path for r in store.files("findings", base).collect()}
    assert len(kept) == store.files("findings", base).count() - 1


def counted(spark, monkeypatch, module, name, column, kind):
    """How many rows of what the module's function gives are worked out, by a column that several tables need."""
    seen, whole = spark.sparkContext.accumulator(0), getattr(module, name)

    @F.udf(kind)
    def same(value):
        seen.add(1)
        return value

    monkeypatch.setattr(module, name, lambda *a: whole(*a).withColumn(column, same(column)))
    return seen


def test_the_outcomes_of_scans_are_worked_out_once(spark, store, sf_dir, monkeypatch):
    scans, tasks, reports = scan_tables(spark)
    ended = finalize.outcomes(scans, tasks, reports).count()
    ingest.keep(store, spark.createDataFrame([payload("seen"), payload("gone")], PAYLOAD), mapping.findings(spark, sf_dir).limit(0), "old", at(), "w", 0)
    cursor = "source_id string, scope string, position bigint, rulepack_version string, source_configuration_version string, minted_at timestamp, invalidated_at timestamp, invalidation_reason string"
    store.commit({"cursors": Change(spark.createDataFrame([], cursor))})
    proposals = spark.createDataFrame([], "scan_id string, source_id string, scope string, position bigint, rulepack_version string, source_configuration_version string, status string")
    seen = counted(spark, monkeypatch, finalize, "outcomes", "silent", "boolean")
    finalize.finalize(store, scans, tasks, reports, proposals, at())
    assert seen.value == ended
    fs, staged = store._fs(f"{store.folder}/staged")
    assert len(fs.listStatus(staged)) == 0


def test_a_batch_is_planned_once(spark, store, sf_dir, monkeypatch):
    seen = counted(spark, monkeypatch, state, "plan_ingest", "action", "string")
    ingest.keep(store, spark.createDataFrame([payload("a"), payload("b"), payload("a")], PAYLOAD), mapping.findings(spark, sf_dir).limit(0), "s", at(), "w", 0)
    assert seen.value == 2 and store.read("findings").count() == 2


def test_cancelling_twice_is_cancelling_once(spark):
    schema = "scan_id string, id int, status string, reasons map<struct<disposition:string,reason:string>,bigint>, gaps_omitted bigint, finished_at timestamp"
    kind = lambda *x: {"disposition": x[0], "reason": x[1]}
    rows = [("n1", 1, "completed", None, 0, None), ("n1", 2, "running", None, None, None), ("n2", 3, "running", None, 0, None)]
    tasks = spark.createDataFrame(rows, schema)
    tasks = tasks.withColumn("reasons", F.when(F.col("id") == 3, F.expr("map(named_struct('disposition', 'scope_gap', 'reason', 'cancelled'), 2L, named_struct('disposition', 'skipped', 'reason', 'empty_content'), cast(null as bigint))")).otherwise(F.col("reasons")))
    asked = spark.createDataFrame([("n1",), ("n2",), ("n2",), ("none",)], "scan_id string")
    once = finalize.cancel(tasks, asked, at())
    twice = finalize.cancel(once, asked, at())
    plain = lambda df: {r.id: (r.status, r.gaps_omitted, sorted((k.disposition, k.reason, v) for k, v in (r.reasons or {}).items())) for r in df.collect()}
    assert plain(once) == plain(twice) == {1: ("completed", 0, []), 2: ("cancelled", 1, [("scope_gap", "cancelled", 1)]), 3: ("cancelled", 1, [("scope_gap", "cancelled", 3), ("skipped", "empty_content", 0)])}


def test_validation_is_told_only_when_it_changes(spark, sf_dir):
    kind = "struct<provider:string,validator_id:string,contract_version:string,status:string,reason:string>"
    before = mapping.findings(spark, sf_dir).limit(0).withColumn("validation", F.lit(None).cast(kind)).withColumn("validated_at", F.lit(None).cast("timestamp"))
    batch = lambda *rows: spark.createDataFrame([(*payload(fp), v) for fp, v in rows], f"{PAYLOAD}, validation {kind}")
    told, log = ("aws", "v", "1", "active", None), []
    for n, rows in enumerate([[("a", told), ("b", None)], [("a", told), ("b", ("aws", "v", "1", None, None))], [("a", None), ("b", ("aws", "v", "2", None, None))], [("a", ("aws", "v", "1", "revoked", "gone"))]]):
        plan = state.plan_ingest(before, batch(*rows))
        log.append(sorted((r.fingerprint, r.from_value, r.to_value, r.comment) for r in state.validation_events(before, plan, f"n{n}", at()).collect()))
        after = state.upsert(before, plan, f"n{n}", at())
        before = spark.createDataFrame(after.collect(), after.schema)
    assert log == [[("a", None, "active", "aws:v:1:")], [("b", None, None, "aws:v:1:")], [("b", None, None, "aws:v:2:")], [("a", "active", "revoked", "aws:v:1:gone")]]
    assert {r.fingerprint: tuple(r.validation) for r in before.collect()} == {"a": ("aws", "v", "1", "revoked", "gone"), "b": ("aws", "v", "2", None, None)}


def test_cancelling_sorts_no_tasks(spark):
    """Only the scans' ids are held in memory, however many fetch tasks there are."""
    gap = F.expr("cast(null as map<struct<disposition: string, reason: string>, bigint>)")
    tasks = spark.range(1000).select(F.concat(F.lit("n"), F.col("id") % 50).alias("scan_id"), "id", F.lit("running").alias("status"), gap.alias("reasons"), F.lit(0).cast("bigint").alias("gaps_omitted"), F.lit(None).cast("timestamp").alias("finished_at"))
    asked = spark.range(200).select(F.concat(F.lit("n"), F.col("id") % 20).alias("scan_id"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        after = finalize.cancel(tasks, asked, at())
        assert after.where("status = 'cancelled'").count() == 400 and after.count() == 1000
        plan = after._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "ShuffledHashJoin" in plan and "Sort" not in plan, plan
