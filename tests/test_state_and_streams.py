"""The finding table over scans, versions on disk, and streaming ingest."""

import datetime

from pyspark.sql import functions as F

from sievespark.operators import detect, state
from sievespark.plans import mapping, rules
from sievespark.sources.store import Store
from sievespark.streaming import ingest

def at():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")

PAYLOAD = "source_id string, fingerprint string, previous_fingerprint string, previous_secret_hash string, secret_hash string, correlation_id string, rule_id string, rulepack_version string, resource_locator map<string,string>, redacted_snippet string, entropy double, confidence double, severity string, ord int"


def payload(fp, ord=0, old=None, old_hash=None, confidence=0.9):
    return ("s1", fp, old, old_hash, "h", "c", "r", "v", {"path": "p"}, "x", 1.0, confidence, "high", ord)


def empty(spark, sf_dir):
    return mapping.findings(spark, sf_dir).limit(0)


def step(spark, before, batch, scan):
    plan = state.plan_ingest(before, spark.createDataFrame(batch, PAYLOAD))
    return state.upsert(before, plan, scan, at()), plan


def test_life_of_a_finding(spark, sf_dir):
    zero = empty(spark, sf_dir)
    one, plan = step(spark, zero, [payload("a"), payload("a", 1), payload("b"), payload("low", confidence=0.1), payload("null", confidence=None)], "n1")
    assert state.ingest_tallies(plan).first().asDict() == {"ingested": 4, "below_threshold": 1, "created": 3, "reopened": 0, "rekeyed": 0}
    assert sorted((r.fingerprint, r.state, r.first_seen_scan_id) for r in one.collect()) == [("a", "open", "n1"), ("b", "open", "n1"), ("null", "open", "n1")]

    two, _ = step(spark, one, [payload("a")], "n2")
    for gate in ({"mode": "incremental"}, {"coverage": "partial"}, {"scan_status": "partial"}, {"fetch_tasks": 0}):
        args = {"scan_status": "completed", "coverage": "complete", "mode": "full", "fetch_tasks": 1} | gate
        assert state.resolve_absent(two, "s1", "n2", at(), **args) is two
    gone = state.resolve_absent(two, "s1", "n2", at(), scan_status="completed", coverage="complete", mode="full", fetch_tasks=1)
    assert {r.fingerprint: (r.state, r.resolution) for r in gone.collect()} == {"a": ("open", None), "b": ("resolved", "auto"), "null": ("resolved", "auto")}
    assert sorted(r.fingerprint for r in state.changes(two, gone, "n2", at()).collect()) == ["b", "null"]

    back, plan = step(spark, gone, [payload("b")], "n3")
    assert {r.fingerprint: r.state for r in back.collect()}["b"] == "open"
    assert [(r.kind, r.fingerprint) for r in state.ingest_events(plan, "n3", at()).collect()] == [("reopened", "b")]


def test_change_of_pepper(spark, sf_dir):
    one, _ = step(spark, empty(spark, sf_dir), [payload("a"), payload("b"), payload("c")], "n1")
    two, plan = step(spark, one, [payload("A", old="a", old_hash="h"), payload("B", old="b", old_hash="other"), payload("C", old="c")], "n2")
    assert {r.fingerprint: r.action for r in plan.collect()} == {"A": "rekey", "B": "create", "C": "rekey"}
    assert sorted((r.fingerprint, r.first_seen_scan_id) for r in two.collect()) == [("A", "n1"), ("B", "n2"), ("C", "n1"), ("b", "n1")]


def test_triage_refuses_what_is_not_allowed(spark, sf_dir):
    one, _ = step(spark, empty(spark, sf_dir), [payload("a"), payload("b")], "n1")
    asked = spark.createDataFrame([("s1", "a", "false_positive"), ("s1", "b", "open"), ("s1", "none", "resolved")], "source_id string, fingerprint string, to_state string")
    after, refused = state.triage(one, asked, at())
    assert {r.fingerprint: r.state for r in after.collect()} == {"a": "false_positive", "b": "open"}
    assert sorted(r.fingerprint for r in refused.collect()) == ["b", "none"]


def test_evidence(spark):
    t = lambda d: datetime.datetime(2026, 1, d)
    link = lambda u: [{"url": u, "label": "l", "scrubbed": False}]
    rows = [("f1", t(2), None, link("http://x"), "note", None), ("f1", t(1), None, link("http://x"), "n", None), ("f2", t(1), None, link(" "), "n", None), ("f3", t(1), t(2), link("http://x"), "n", None)]
    actions = spark.createDataFrame(rows, "finding_id string, created_at timestamp, retracted_at timestamp, evidence_links array<struct<url:string,label:string,scrubbed:boolean>>, note string, scrubbed_at timestamp")
    opened = spark.createDataFrame([("f1", t(2))], "finding_id string, at timestamp")
    assert [(r.finding_id, r.created_at) for r in state.qualifies(actions, opened).collect()] == [("f1", t(2))]
    bare = state.scrub(actions, spark.createDataFrame([("f2",)], "finding_id string"), at()).where("finding_id = 'f2'").first()
    assert bare.note is None and bare.evidence_links[0].url is None and bare.evidence_links[0].scrubbed


def test_versions(spark, sf_dir, tmp_path):
    folder = f"file://{tmp_path}/state"
    assert state.latest(spark, folder) is None
    one, _ = step(spark, empty(spark, sf_dir), [payload("a")], "n1")
    assert state.save(one, folder) == 1
    two, _ = step(spark, state.load(spark, folder), [payload("b")], "n2")
    assert state.save(two, folder) == 2
    assert state.load(spark, folder).count() == 2 and state.load(spark, folder, 1).count() == 1


def test_stream_of_units(spark, sf_dir, tmp_path):
    folder, inbox = f"file://{tmp_path}/live", f"file://{tmp_path}/inbox"
    schema = "connector_type string, resource_id string, sub_resource string, origin string, text string"
    key = "AK" + "IAQ7RSTUVWXYZ23BC"
    put = lambda *rows: spark.createDataFrame([("wiki", i, None, "body", t) for i, t in rows], schema).write.mode("append").parquet(inbox)
    run = lambda: ingest.start(spark.readStream.schema(schema).parquet(inbox), rules.load(), detect.Keys(b"p" * 16), folder, empty(spark, sf_dir), "n1", "s1", lambda n: F.lit(f"2024-01-0{n + 1} 00:00:00").cast("timestamp")).awaitTermination()
    store = Store(spark, f"{folder}/tables")
    put(("p1", f"aws key {key}D"), ("p2", "nothing"))
    run()
    assert store.read("findings").count() == 1
    put(("p1", f"aws key {key}D again"), ("p3", f"aws key {key}E"))
    run()
    rows = store.read("findings").collect()
    assert sorted(r.resource_locator["resource_id"] for r in rows) == ["p1", "p3"]
    assert {r.resource_locator["resource_id"]: r.created_at.day for r in rows} == {"p1": 1, "p3": 2}
    run()
    assert store.head() == 2 and store.describe(2)["sequences"] == {"stream": 1}


def test_windows_on_a_stream_equal_the_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    q = ingest.rate_windows(stream, "user_id").writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.sql("select * from rates").collect())) == sorted(map(tuple, ingest.rate_windows(events, "user_id").collect()))


def test_late_events_on_a_stream(spark, tmp_path):
    t = lambda m: datetime.datetime(2026, 1, 1, 0, m)
    put = lambda *rows: spark.createDataFrame(list(rows), "k string, v string, at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = []

    def run():
        stream = spark.readStream.schema("k string, v string, at timestamp").parquet(f"{tmp_path}/in")
        q = ingest.newest_on_stream(stream, "k", "v", "at").writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True)
        q.foreachBatch(lambda b, n: out.append(sorted((r.k, r.v) for r in b.collect()))).start().awaitTermination()

    put(("a", "open", t(5)), ("a", "early", t(1)), ("b", "x", t(2)))
    run()
    put(("a", "late", t(3)), ("b", "y", t(9)))
    run()
    assert [b for b in out if b] == [[("a", "open"), ("b", "x")], [("b", "y")]]


def test_remediation_is_set_once(spark):
    schema = "id string, finding_id string, verified_at timestamp, verified_by string, retracted_at timestamp, retracted_by string, retracted_reason string"
    actions = spark.createDataFrame([("1", "f", None, None, None, None, None), ("2", "f", None, None, None, None, None)], schema)
    ask = lambda *rows: spark.createDataFrame(list(rows), "id string, actor_id string, reason string")
    one = state.verify(actions, ask(("1", "u1", None)), at())
    two = state.retract(state.verify(one, ask(("1", "u2", None), ("2", "u2", None)), at()), ask(("2", "u3", "wrong")), at())
    three = {r.id: r for r in state.retract(state.verify(two, ask(("2", "u9", None)), at()), ask(("2", "u9", "again")), at()).collect()}
    assert (three["1"].verified_by, three["1"].retracted_by) == ("u1", None)
    assert (three["2"].verified_by, three["2"].retracted_by, three["2"].retracted_reason) == ("u2", "u3", "wrong")
    log = state.audit("u3", "retract", two.select("id", F.lit(None).cast("string").alias("from_value"), F.lit("x").alias("to_value")), "action", at())
    assert log.count() == 2
