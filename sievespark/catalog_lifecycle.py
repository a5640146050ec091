"""Registered queries of what changes several tables over time: the store, the end of scans, cancellations, beats, validations.

As in :mod:`sievespark.catalog`, whose register they join: whole tables, each query beside its SQL twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _BATCH_SQL, _SQL, AT, F_, S_, T_, _batch, _cursors, query
from .operators import cursors, finalize, rounds, state, suppress
from .plans import mapping as m
from .sources.store import Change, Layout, Store, new_folder
from .streaming import ingest


def _store(spark: SparkSession, width: int = 0, **tables: DataFrame) -> Store:
    """A new store, its findings in 16^width ranges a source."""
    store = Store(spark, new_folder(spark, "store"), {"findings": Layout(width=width)})
    store.commit({name: Change(rows) for name, rows in tables.items()})
    return store


@query(_SQL["mrg_upsert"])
def str_range_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch of ``mrg_upsert`` kept in a store of ranges, and offered a second time, as Spark would after a failure."""
    store = _store(spark, findings=m.findings(spark, sf_dir))
    for _ in range(2):
        ingest.keep(store, _batch(spark, sf_dir), m.findings(spark, sf_dir), "scan9", m.as_of(), "stream", 0)
    return store.read("findings").select("source_id", "fingerprint", "state", "resolution", "rulepack_version", "correlation_id", "first_seen_scan_id", "last_seen_scan_id", "assignee_id", "owner_group_id")


_RANGE = "substring(md5(source_id), 1, 8) || '-' || substring(md5({}), 1, 1)"


@query(
    f"""with {_BATCH_SQL}, few as (select * from raw where source_id = 's3' and start_at % 13 = 0),
    touched as (select {_RANGE.format('fingerprint')} as r from few union select {_RANGE.format('old')} from few where old is not null)
    select {_RANGE.format('fingerprint')} as range, count(*) as n, bool_and({_RANGE.format('fingerprint')} not in (select r from touched)) as kept from finding group by 1"""
)
def str_ranges_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each range of the stored findings with its rows, and whether a small batch of one source has left its files as they were."""
    store = _store(spark, 1, findings=m.findings(spark, sf_dir))
    few = _batch(spark, sf_dir).where("source_id = 's3' AND ord % 10000 % 13 = 0")
    ingest.keep(store, few, m.findings(spark, sf_dir), "scan9", m.as_of(), "stream", 0)
    after = store.files("findings").select("path", F.lit(True).alias("there"))
    before = store.files("findings", 1).join(after, "path", "left")
    return before.groupBy("range").agg(F.sum("n").alias("n"), F.bool_and(F.coalesce("there", F.lit(False))).alias("kept"))


_ENDED = """st as (select scan_id, count(*) as tasks, case when bool_or(status = 'cancelled') then 'cancelled' when count_if(status = 'completed') = count(*) then 'completed'
    when count_if(status = 'completed') > 0 then 'partial' else 'failed' end as status from task group by scan_id),
    re as (select scan_id, sum(skipped) as skipped, count(*) as reports from task where reported group by scan_id),
    sc as (select 'n' || cast(o_orderkey as varchar) as scan_id, 'q' || cast(o_orderkey % 20 as varchar) as source_id, case when o_orderkey % 4 = 0 then 'incremental' else 'full' end as mode from orders),
    ended as (select scan_id, source_id, mode, status, case when status <> 'completed' then status when coalesce(skipped, 0) > 0 or tasks > coalesce(reports, 0) then 'partial' else 'complete' end as coverage
    from sc join st using (scan_id) left join re using (scan_id)),
    trusted as (select * from ended where status = 'completed' and coverage = 'complete'),
    silent as (select source_id, max(scan_id) as spoke from trusted where mode = 'full' group by source_id)"""


@query(
    f"""with {F_}, {T_}, {_ENDED},
    f as (select id, 'q' || cast(cast(substring(id, 2) as bigint) % 20 as varchar) as source_id, fingerprint, state, resolution, suppressed_at, 'n' || substring(id, 2) as seen from finding),
    g as (select f.*, spoke, coalesce(state = 'open' and suppressed_at is null and seen <> spoke, false) as gone from f left join silent using (source_id)),
    cur as (select 's' || cast(c_custkey % 400 as varchar) as source_id, 'scope' || cast(c_custkey as varchar) as scope, c_custkey as position from customer),
    prop as (select 's' || cast(c_custkey % 400 as varchar) as source_id, 'scope' || cast(c_custkey + 100 as varchar) as scope, c_custkey + 1000 as position from customer where 'n' || cast(c_custkey as varchar) in (select scan_id from trusted))
    select 'finding' as kind, id as name, case when gone then 'resolved auto' else state || ' ' || coalesce(resolution, '') end as value from g
    union all select 'event', fingerprint, spoke from g where gone
    union all select 'manifest', scan_id, status || ' ' || coverage from ended
    union all select 'outbox', fingerprint, seen from g where not gone and state = 'open' and suppressed_at is null and seen in (select scan_id from trusted)
    union all select 'cursor', coalesce(cur.source_id, prop.source_id) || ' ' || coalesce(cur.scope, prop.scope), cast(coalesce(prop.position, cur.position) as varchar)
    from cur full outer join prop on cur.source_id = prop.source_id and cur.scope = prop.scope"""
)
def lif_finalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scans ended in one version: the gate, absence, events, cursors and announcements read back together."""
    number = F.substring("id", 2, 20)
    scan = F.concat(F.lit("n"), number)
    held = m.findings(spark, sf_dir).withColumns({"source_id": F.concat(F.lit("q"), (number.cast("bigint") % 20).cast("string")), "first_seen_scan_id": scan, "last_seen_scan_id": scan})
    none = held.limit(0).select("source_id", "fingerprint", F.lit("").alias("kind"), F.lit("").alias("from_value"), F.lit("").alias("to_value"), F.lit("").alias("scan_id"), m.as_of().alias("at"))
    store = _store(spark, findings=held, cursors=_cursors(spark, sf_dir), events=none)
    orders = m.table(spark, sf_dir, "orders")
    scans = orders.select(F.expr("'n' || cast(o_orderkey as string)").alias("id"), F.expr("'q' || cast(o_orderkey % 20 as string)").alias("source_id"), F.expr("if(o_orderkey % 4 = 0, 'incremental', 'full')").alias("mode"))
    tasks = m.tasks(spark, sf_dir)
    proposals = m.table(spark, sf_dir, "customer").select(
        F.expr("'n' || cast(c_custkey as string)").alias("scan_id"), F.expr("'s' || cast(c_custkey % 400 as string)").alias("source_id"), F.expr("'scope' || cast(c_custkey + 100 as string)").alias("scope"),
        (F.col("c_custkey") + 1000).cast("bigint").alias("position"), F.lit("v1").alias("rulepack_version"), F.lit("cfg").alias("source_configuration_version"), F.lit("completed").alias("status"),
    )
    finalize.finalize(store, scans, tasks, tasks.where("reported"), proposals, m.as_of())
    parts = {
        "finding": (store.read("findings"), "id", F.concat_ws(" ", "state", F.coalesce("resolution", F.lit("")))),
        "event": (store.read("events"), "fingerprint", F.col("scan_id")),
        "manifest": (store.read("manifests"), "scan_id", F.concat_ws(" ", "status", "coverage")),
        "outbox": (store.read("outbox"), "fingerprint", F.col("scan_id")),
        "cursor": (store.read("cursors").withColumn("name", F.concat_ws(" ", "source_id", "scope")), "name", F.col("position").cast("string")),
    }
    found = [rows.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), value.alias("value")) for kind, (rows, name, value) in parts.items()]
    return found[0].union(found[1]).union(found[2]).union(found[3]).union(found[4])


@query(
    f"""with {T_}, t as (select scan_id, id, skipped, case when id % 2 = 0 and status = 'completed' then 'running' else status end as status, cast(substring(scan_id, 2) as bigint) % 3 = 0 as asked from task)
    select scan_id, id, case when asked and status = 'running' then 'cancelled' else status end as status, cast(case when asked and status = 'running' then 1 else 0 end as bigint) as gaps_omitted,
    case when asked and status = 'running' then 'scope_gap/cancelled=1' || case when id % 3 = 0 then '' else ',skipped/empty_content=' || cast(skipped as varchar) end
    when id % 3 <> 0 then 'skipped/empty_content=' || cast(skipped as varchar) end as reasons from t"""
)
def lif_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third scan cancelled, twice: running tasks gain one gap on what they have counted, finished ones stay."""
    counted = F.create_map(F.struct(F.lit("skipped").alias("disposition"), F.lit("empty_content").alias("reason")), F.col("skipped"))
    tasks = m.tasks(spark, sf_dir).select(
        "scan_id", "id", F.expr("if(id % 2 = 0 and status = 'completed', 'running', status)").alias("status"), F.when(F.col("id") % 3 != 0, counted).alias("reasons"),
        F.lit(0).cast("bigint").alias("gaps_omitted"), F.lit(None).cast("timestamp").alias("finished_at"),
    )
    asked = m.table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.expr("'n' || cast(o_orderkey as string)").alias("scan_id"))
    after = finalize.cancel(finalize.cancel(tasks, asked, m.as_of()), asked, m.as_of())
    told = F.transform(F.map_entries("reasons"), lambda x: F.concat(x["key"]["disposition"], F.lit("/"), x["key"]["reason"], F.lit("="), x["value"].cast("string")))
    return after.select("scan_id", "id", "status", "gaps_omitted", F.array_join(F.array_sort(told), ",").alias("reasons"))


@query(
    f"""with {F_}, {S_}, r0 as (select *, suppressed_by_id is not null and not exists (select 1 from sup where sid = suppressed_by_id and (sexpires is null or sexpires > {AT})) as lapsed from finding),
    r1 as (select *, suppressed_at is not null and lapsed as h1 from r0), r2 as (select * replace (case when h1 then null else suppressed_at end as suppressed_at) from r1),
    r3 as (select *, state = 'open' and suppressed_at is null and coalesce(due_at < {AT}, false) as h2, correlation_id is null as h3 from r2),
    r4 as (select *, coalesce(state = 'resolved' and resolution = 'auto' and suppressed_at is null and updated_at < {AT} - interval 200 day, false) as h4 from r3)
    select id, suppressed_at is not null as suppressed, h2 as escalated, coalesce(correlation_id, md5('c' || id)) as correlation_id,
    concat_ws(',', case when h1 then 'released' end, case when h2 then 'escalated' end, case when h3 then 'correlated' end) as done from r4 where not h4"""
)
def lif_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A beat over all findings: lapsed suppressions, then what is overdue without them, missing correlations, retention."""
    live = suppress.applicable(m.suppressions(spark), m.as_of()).select(F.col("id").alias("suppressed_by_id"), F.lit(True).alias("_live"))
    rows = m.findings(spark, sf_dir).join(live, "suppressed_by_id", "left")
    rows = rows.withColumn("lapsed", F.col("suppressed_by_id").isNotNull() & F.col("_live").isNull()).drop("_live").withColumn("escalated_at", F.lit(None).cast("timestamp"))
    after = rounds.run(rows, rounds.beat(m.as_of(), F.md5(F.concat(F.lit("c"), "id")), 200))
    return after.select("id", F.col("suppressed_at").isNotNull().alias("suppressed"), F.col("escalated_at").isNotNull().alias("escalated"), "correlation_id", F.array_join("done", ",").alias("done"))


@query(
    f"""with {_BATCH_SQL} select source_id, fingerprint, case when stored is not null and start_at % 2 = 0 then 'active' end as from_value, case when start_at % 11 = 0 then 'revoked' else 'active' end as to_value,
    'aws:v1:' || case when start_at % 4 = 0 then '2' else '1' end || ':ok' as comment from acted
    where action <> 'below_threshold' and start_at % 7 <> 0 and not (stored is not null and start_at % 2 = 0 and start_at % 4 <> 0 and start_at % 11 <> 0 and start_at % 5 <> 0)"""
)
def mrg_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validations that a batch tells anew: some stored without one or without a reason, some payloads without one."""
    told = lambda contract, status, reason: F.struct(F.lit("aws").alias("provider"), F.lit("v1").alias("validator_id"), contract.alias("contract_version"), status.alias("status"), reason.alias("reason"))
    s, o = F.col("start"), F.col("ord") % 10_000
    before = m.findings(spark, sf_dir).withColumn("validation", F.when(s % 2 == 0, told(F.lit("1"), F.lit("active"), F.when(s % 5 != 0, "ok"))))
    brought = told(F.when(o % 4 == 0, "2").otherwise("1"), F.when(o % 11 == 0, "revoked").otherwise("active"), F.lit("ok"))
    plan = state.plan_ingest(before, _batch(spark, sf_dir).withColumn("validation", F.when(o % 7 != 0, brought)))
    return state.validation_events(before, plan, "scan9", m.as_of()).select("source_id", "fingerprint", "from_value", "to_value", "comment")


@query(
    """with rows as (select 'n' || cast(l_orderkey as varchar) as scan_id, l_linenumber % 5 <> 0 as told, case when l_linenumber % 3 <> 0 then l_linenumber else 0 end as a, 'k' || cast(l_suppkey % 3 as varchar) as k from lineitem),
    cells as (select scan_id, 'a' as k, a as v from rows where told union all select scan_id, k, 1 from rows where told), sums as (select scan_id, k, sum(v) as v from cells group by all),
    told as (select scan_id, string_agg(k || '=' || cast(cast(v as bigint) as varchar), ',' order by k) as sums from sums group by scan_id)
    select scan_id, coalesce(sums, '') as sums from (select distinct scan_id from rows) left join told using (scan_id)"""
)
def agg_map_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of counts added key by key, with null maps, null counts and keys that only some rows have."""
    counts = F.create_map(F.lit("a"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber").cast("bigint")), F.concat(F.lit("k"), (F.col("l_suppkey") % 3).cast("string")), F.lit(1).cast("bigint"))
    rows = m.table(spark, sf_dir, "lineitem").select(F.expr("'n' || cast(l_orderkey as string)").alias("scan_id"), F.when(F.col("l_linenumber") % 5 != 0, counts).alias("counts"))
    told = F.transform(F.map_entries("counts"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    return finalize.map_sums(rows, "scan_id", "counts").select("scan_id", F.array_join(told, ",").alias("sums"))


@query(
    """with rec as (select 'p' || cast(o_custkey % 5 as varchar) as project, o_orderkey as issue_id, o_orderkey % 3 as revision, o_orderdate + to_seconds(cast(o_orderkey % 86400 as bigint)) as moment from orders),
    win as (select 'p' || cast(p as varchar) as project, w as "window", case when w > 0 then timestamp '1995-01-01 00:00:30' + to_days(cast(365 * (w - 1) as int)) end as from_at,
        timestamp '1995-01-01 00:00:30' + to_days(cast(365 * w as int)) as to_at from range(0, 5) a(p), range(0, 6) b(w)),
    run as (select *, (p % 2 = 0 and w = 2) as f1, (p = 3 and w in (0, 4)) as f2 from (select project, "window", from_at, to_at, cast(substring(project, 2) as int) as p, "window" as w from win)),
    held as (select rec.project, issue_id, revision, "window", f1, f2 from rec join run on rec.project = run.project and (from_at is null or moment >= date_trunc('minute', from_at)) and moment < to_at),
    one as (select project, issue_id, revision, min("window") as "window" from held where not f1 group by all),
    two as (select project, issue_id, revision, min("window") as "window" from held where not f2 group by all)
    select 'fresh 1' as kind, project, cast(issue_id as varchar) as name, cast("window" as int) as "window" from one
    union all select 'fresh 2', project, cast(issue_id as varchar), cast("window" as int) from two t where not exists (select 1 from one where one.project = t.project and one.issue_id = t.issue_id and one.revision = t.revision)
    union all select 'gap 1', project, 'rate_limited', cast("window" as int) from run where f1 union all select 'gap 2', project, 'timeout', cast("window" as int) from run where f2"""
)
def cur_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over overlapping windows of which some fail: every record once, what a gap held with the second run."""
    orders = m.table(spark, sf_dir, "orders")
    at = F.timestamp_seconds(F.unix_timestamp("o_orderdate") + F.col("o_orderkey") % 86_400)
    records = orders.select(F.expr("'p' || cast(o_custkey % 5 as string)").alias("project"), F.col("o_orderkey").alias("issue_id"), (F.col("o_orderkey") % 3).alias("revision"), at.alias("updated_at"))
    edge = lambda n: F.expr(f"timestamp '1995-01-01 00:00:30' + make_interval(0, 0, 0, cast(365 * ({n}) as int))")
    cells = records.select("project").distinct().select("project", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("window"))
    spans = cells.select("project", "window", F.when(F.col("window") > 0, edge("window - 1")).alias("from_at"), edge("window").alias("to_at"))
    p = F.substring("project", 2, 9).cast("int")
    first = cells.where((p % 2 == 0) & (F.col("window") == 2)).withColumn("reason", F.lit("rate_limited"))
    second = cells.where((p == 3) & F.col("window").isin(0, 4)).withColumn("reason", F.lit("timeout"))
    none = records.select("project", "issue_id", "revision").limit(0)
    fresh1, gaps1 = cursors.read_windows(records, spans, first, none)
    fresh2, gaps2 = cursors.read_windows(records, spans, second.unionByName(second.withColumn("reason", F.lit("z"))), fresh1)
    told = lambda kind, rows, name: rows.select(F.lit(kind).alias("kind"), "project", F.col(name).cast("string").alias("name"), "window")
    return told("fresh 1", fresh1, "issue_id").union(told("fresh 2", fresh2, "issue_id")).union(told("gap 1", gaps1, "reason")).union(told("gap 2", gaps2, "reason"))
