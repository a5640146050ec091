"""Every registered query of the engine with its SQL twin, where SQL can say it.

Each query applies an operator to whole tables, seen through :mod:`sievespark.plans.mapping`. Times are returned as
strings and doubles rounded, so that both engines' values compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import documents, extract, identity, markup, scoring
from .operators import coverage, cursors, detect, outbox, reads, route, schedule, state, suppress
from .plans import mapping as m
from .plans import rules as packs
from .sources import fake, units
from .streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
PEPPER, CORRELATION_KEY = b"test pepper of 32 bytes, no more", b"test correlation key of 32 bytes"
F_, G_, N_, T_, P_, S_, C_ = m.FINDING_SQL, m.GROUP_SQL, m.SCAN_SQL, m.TASK_SQL, m.PLANTED_SQL, m.SUPPRESSION_SQL, m.CHANNEL_SQL
AT = f"timestamp '{m.AS_OF}'"
ACTIONABLE = "state = 'open' and suppressed_at is null"
OVERDUE = f"({ACTIONABLE} and coalesce(due_at < {AT}, false))"


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def _text(*names: str) -> list:
    """Times as strings."""
    return [F.date_format(n, "yyyy-MM-dd HH:mm:ss").alias(n) for n in names]


def _ts(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S') as {name}"


# Detection


def _pad(key: bytes, x: int) -> str:
    return bytes(b ^ x for b in key.ljust(64, b"\0")).hex()


def _hmac_sql(key: bytes, purpose: str, message: str) -> str:
    domain = f"{identity.DOMAIN}.{purpose}.v1".encode().hex() + "00"
    return f"sha256(unhex('{_pad(key, 0x5C)}') || unhex(sha256(unhex('{_pad(key, 0x36)}') || unhex('{domain}') || {message})))"


@query(
    f"""with {P_}, hit as (
    select doc_id, 'aws-access-key-id' as rule_id, unnest(regexp_extract_all(text, '\\b(?:AKIA|ASIA)[0-9A-Z]{{16}}\\b')) as secret from planted
    union all select doc_id, 'password-assignment', unnest(regexp_extract_all(text, '(?i)\\b(?:password|passwd|pwd)\\s*[:=]\\s*["'']?([^\\s"''{{}}<>,;]{{8,128}})', 1)) from planted)
    select doc_id, rule_id, secret from hit"""
)
def det_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack = packs.load()
    two = packs.RulePack(pack.version, tuple(r for r in pack.rules if r.id in ("aws-access-key-id", "password-assignment")))
    return detect.native_candidates(m.planted(spark, sf_dir), two, "doc_id").withColumnRenamed("id", "doc_id")


@query(
    f"""with {P_}, hit as (select doc_id, unnest(regexp_extract_all(text, '\\b(?:AKIA|ASIA)[0-9A-Z]{{16}}\\b')) as secret from planted)
    select doc_id, round(list_aggregate(string_split(secret, ''), 'entropy'), 6) as bits, secret[1:4] || '…[' || cast(length(secret) - 4 as varchar) || ' chars redacted]' as mask,
    cast(round(least(1.0, greatest(0.0, 0.8 + 0.15)), 6) as double) as score from hit"""
)
def det_entropy_mask_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack = packs.load()
    one = packs.RulePack(pack.version, pack.rules[:1])
    rows = detect.native_candidates(m.planted(spark, sf_dir), one, "doc_id")
    s = F.col("secret")
    score = scoring.confidence(F.lit(0.8), scoring.entropy(s), F.lit(None).cast("double"), F.lit(True), F.lit(True))
    return rows.select(F.col("id").alias("doc_id"), F.round(scoring.entropy(s), 6).alias("bits"), scoring.mask(s, F.lit("keep_prefix"), F.lit(4)).alias("mask"), F.round(score, 6).alias("score"))


@query()
def det_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.findings(m.planted_units(spark, sf_dir), packs.load(), detect.Keys(PEPPER))
    return found.withColumns({"entropy": F.round("entropy", 9), "confidence": F.round("confidence", 9)})


@query()
def det_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.tallies(m.planted_units(spark, sf_dir), packs.load())


_BITS = "list_aggregate(string_split(secret, ''), 'entropy')"
_PASSES = f"""{_BITS} >= case when rule_id in ('aws-secret-access-key', 'azure-storage-account-key') then 4.0 when rule_id = 'azure-client-secret' then 3.5
    when rule_id = 'basic-auth-header' then 3.0 when rule_id = 'generic-high-entropy' then 4.2 else 0.0 end"""


@query(
    f"""with {m.SEEDED_SQL} select cast(doc_id as varchar) as resource_id, rule_id, cast(length(head) as integer) as "start", cast(length(head) + length(secret) as integer) as "end",
    round(list_aggregate(string_split(secret, ''), 'entropy'), 6) as bits, {_hmac_sql(PEPPER, 'secret', 'encode(secret)')} as secret_hash from seeded where {_PASSES}"""
)
def det_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shipped rules over whole texts, each of which ends in a credential of one of the seventeen formats: rule, place, entropy, hash."""
    found = detect.findings(m.seeded_units(spark, sf_dir), packs.load(), detect.Keys(PEPPER))
    return found.select("resource_id", "rule_id", "start", "end", F.round("entropy", 6).alias("bits"), "secret_hash")


@query(f"with {m.SEEDED_SQL} select cast(doc_id as varchar) as resource_id, case when {_PASSES} then 1 else 0 end as reported, false as truncated from seeded")
def det_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.tallies(m.seeded_units(spark, sf_dir), packs.load()).select("resource_id", "reported", "truncated")


@query(
    f"""with {P_}, hit as (select source, 'k' || cast(doc_id % 97 as varchar) as secret, doc_id from planted)
    select secret, count(*) as findings, count(distinct source) as sources, min(doc_id) as first_doc from hit group by secret"""
)
def det_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One secret found in many places: the planted key of each group, by its hash alone."""
    pack = packs.load()
    one = packs.RulePack(pack.version, pack.rules[:1])
    docs = m.planted(spark, sf_dir)
    last = F.regexp_extract("text", "aws access key (AK" + "IA[0-9A-Z]{16})", 1)
    names = docs.select(identity.secret_hash(last, PEPPER).alias("secret_hash"), F.concat(F.lit("k"), (F.col("doc_id") % 97).cast("string")).alias("secret")).distinct()
    found = detect.findings(m.planted_units(spark, sf_dir), one, detect.Keys(PEPPER))
    rows = found.join(names, "secret_hash").join(docs.select(F.col("doc_id").cast("string").alias("resource_id"), "doc_id", "source"), "resource_id")
    return rows.groupBy("secret").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("source").alias("sources"), F.min("doc_id").alias("first_doc"))


# Identity


@query(f"select doc_id, case when length(text) > 0 then {_hmac_sql(PEPPER, 'secret', 'encode(text)')} end as secret_hash from documents")
def idn_secret_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.table(spark, sf_dir, "documents").select("doc_id", identity.secret_hash(F.col("text"), PEPPER).alias("secret_hash"))


def _part(x: str) -> str:
    return f"cast(octet_length(encode({x})) as varchar) || ':' || {x} || '|'"


@query(
    f"""with {F_} select id, {_hmac_sql(PEPPER, 'fingerprint', 'encode(' + ' || '.join(_part(x) for x in ("'files'", 'path', "''", 'rule_id', 'secret_hash')) + ')')} as fp,
    {_hmac_sql(CORRELATION_KEY, 'correlation', 'encode(secret_hash)')} as cid from finding"""
)
def idn_fingerprint_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    fp = identity.fingerprint(F.lit("files"), F.col("path"), F.lit(None).cast("string"), F.col("rule_id"), F.col("secret_hash"), PEPPER)
    return m.findings(spark, sf_dir).select("id", fp.alias("fp"), identity.correlation_id(F.col("secret_hash"), CORRELATION_KEY).alias("cid"))


# Filters


def _keep(sql: str):
    return query(f"with {F_} select id from finding where {sql}")


@_keep(f"source_id = 's3' and state = 'open' and {m.RANK_SQL} >= 2")
def flt_source_state_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.filtered(m.findings(spark, sf_dir), m.as_of(), source_id="s3", state="open", min_severity="high").select("id")


@_keep(OVERDUE)
def flt_overdue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.filtered(m.findings(spark, sf_dir), m.as_of(), overdue=True).select("id")


@_keep(f"not {OVERDUE}")
def flt_not_overdue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.filtered(m.findings(spark, sf_dir), m.as_of(), overdue=False).select("id")


@_keep("owner_group_id is null and suppressed_at is not null")
def flt_unowned_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.filtered(m.findings(spark, sf_dir), m.as_of(), unowned=True, suppressed=True).select("id")


@_keep("confidence is null or confidence >= 0.5")
def flt_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.findings(spark, sf_dir).where(F.col("confidence").isNull() | (F.col("confidence") >= 0.5)).select("id")


@query(
    f"""with {F_}, {S_}, hit as (select id, sid, screated from finding join sup on (ssource is null or ssource = source_id) and (sexpires is null or sexpires > {AT})
    and case scope when 'fingerprint' then pattern = fingerprint when 'rule' then pattern = rule_id else regexp_matches(path, pattern) or regexp_matches(id, pattern) end)
    select f.id, s.sid as suppression_id from finding f left join (select id, arg_min(sid, row(screated, sid)) as sid from hit group by id) s on f.id = s.id"""
)
def flt_first_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.first_match(m.findings(spark, sf_dir), m.suppressions(spark), m.as_of()).select("id", "suppression_id")


@query(
    f"""with {F_} select id, case when rule_id = 'rule-3' then case when 5 % 6 = 5 then null else 'g5' end end as unused,
    case when source_id = 's1' then 'g1' when rule_id = 'rule-2' then 'g2' when {m.RANK_SQL} >= 3 and source_id = 's4' then 'g3' when {m.RANK_SQL} >= 2 then 'g6' end as routed_group_id from finding"""
)
def flt_first_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array(F.col("source_id"), F.lit("Prod"))
    found = route.first_owner(m.findings(spark, sf_dir), m.routing_rules(spark), m.groups(spark, sf_dir), tags)
    return found.select("id", F.lit(None).cast("string").alias("unused"), "routed_group_id")


@query(f"with {F_}, {C_} select id, cid as channel_id from finding join chan on enabled and {m.RANK_SQL} >= least and (only_sources is null or list_contains(only_sources, source_id))")
def flt_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.targets(m.findings(spark, sf_dir), m.channels(spark)).select("id", "channel_id")


@query(f"with {N_} select id from scan where status in ('queued', 'discovering', 'running') and source_id = 's4'")
def flt_active_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.scans(spark, sf_dir).where(F.col("status").isin(*reads.ACTIVE_SCANS) & (F.col("source_id") == "s4")).select("id")


# Joins


@query(f"with {F_} select f.id, s.s_name as source_name from finding f join supplier s on f.source_id = 's' || cast(s.s_suppkey as varchar)")
def jon_source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = m.table(spark, sf_dir, "supplier").select(F.expr("'s' || cast(s_suppkey as string)").alias("source_id"), F.col("s_name").alias("source_name"))
    return m.findings(spark, sf_dir).join(names, "source_id").select("id", "source_name")


_CLUSTER_COLUMNS = f"""correlation_id, count(*) as findings, count(distinct source_id) as sources, count_if(state = 'open') as open_findings, arg_max(severity, {m.RANK_SQL}) as severity,
    strftime(min(created_at), '%Y-%m-%d %H:%M:%S') as first_at, strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') as last_at"""


@query(f"with {F_} select {_CLUSTER_COLUMNS} from finding where correlation_id in (select correlation_id from finding where source_id = 's2') group by correlation_id")
def jon_clusters_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.clusters(m.findings(spark, sf_dir), source_id="s2").withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_at", "last_at")})


@query(f"with {F_}, {G_} select id, gid, channel from finding join grp on owner_group_id = gid where not disabled")
def jon_live_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = m.groups(spark, sf_dir).where(~F.col("disabled")).select(F.col("id").alias("gid"), F.col("notification_channel_id").alias("channel"))
    return m.findings(spark, sf_dir).join(live, F.col("owner_group_id") == F.col("gid")).select("id", "gid", "channel")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = m.table(spark, sf_dir, "events")
    return rows.select("event_id", F.col("ts").cast("timestamp").alias("at"), F.expr("'f' || cast(user_id as string)").alias("finding_id"), F.expr("case event_type when 'error' then 'reopened' else event_type end").alias("kind"))


@query("select 'f' || cast(user_id as varchar) as finding_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_at, arg_max(event_id, row(ts, event_id)) as event_id from events where event_type = 'error' group by user_id")
def jon_latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).where("kind = 'reopened'")
    last = rows.groupBy("finding_id").agg(F.max("at").alias("last_at"), F.max_by("event_id", F.struct("at", "event_id")).alias("event_id"))
    return last.withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"with {F_} select event_id from events where not exists (select 1 from finding where id = 'f' || cast(user_id as varchar) and state = 'open')")
def jon_events_of_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    still = m.findings(spark, sf_dir).where("state = 'open'").select(F.col("id").alias("finding_id"))
    return _events(spark, sf_dir).join(still, "finding_id", "left_anti").select("event_id")


# Aggregates


@query(f"with {F_} select {_CLUSTER_COLUMNS} from finding where correlation_id is not null group by correlation_id having count(*) >= 3")
def agg_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.clusters(m.findings(spark, sf_dir), least=3).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_at", "last_at")})


@query(f"with {F_} select correlation_id, source_id, count(*) as findings, count_if(state = 'open') as open_findings from finding where correlation_id is not null group by correlation_id, source_id")
def agg_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.footprint(m.findings(spark, sf_dir).where("correlation_id is not null")).select("correlation_id", "source_id", "findings", "open_findings")


@query(f"with {F_} select owner_group_id, count(*) as open_findings, count_if({OVERDUE}) as overdue_findings from finding where {ACTIONABLE} group by owner_group_id")
def agg_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.workload(m.findings(spark, sf_dir), m.as_of())


@query(
    f"""with {F_} select count_if({ACTIONABLE}) as open_findings, count_if({ACTIONABLE} and severity = 'critical') as critical_findings, count_if({ACTIONABLE} and coalesce(assignee_id = 'u3', false)) as mine,
    count_if({OVERDUE}) as overdue_findings, count_if({ACTIONABLE} and owner_group_id is null) as unowned from finding"""
)
def agg_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.overview(m.findings(spark, sf_dir), m.as_of(), "u3")


@query(f"with {F_}, x as (select first_seen_scan_id as scan_id, 1 as n, 0 as s from finding union all select last_seen_scan_id, 0, 1 from finding) select scan_id, cast(sum(n) as bigint) as new_findings, cast(sum(s) as bigint) as seen_findings from x group by scan_id")
def agg_scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.scan_counts(m.findings(spark, sf_dir))


@query(
    f"""with {T_} select scan_id, case when count(requested) = count(*) then cast(sum(requested) as bigint) end as requested, cast(sum(discovered) as bigint) as discovered, cast(sum(scanned) as bigint) as scanned,
    cast(sum(skipped) as bigint) as skipped, cast(sum(failed) as bigint) as failed, count(*) as reports from task where reported group by scan_id"""
)
def agg_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.merged(m.tasks(spark, sf_dir).where("reported"))


@query(
    f"""with {T_}, st as (select scan_id, count(*) as tasks, case when bool_or(status = 'cancelled') then 'cancelled' when count_if(status = 'completed') = count(*) then 'completed'
    when count_if(status = 'completed') > 0 then 'partial' else 'failed' end as status, arg_min(case when status = 'failed' then error end, case when status = 'failed' and error is not null then row(created_at, id) end) as error from task group by scan_id),
    re as (select scan_id, cast(sum(scanned) as bigint) as scanned, cast(sum(skipped) as bigint) as skipped, count(*) as reports from task where reported group by scan_id)
    select scan_id, status, case when status <> 'completed' then status when coalesce(skipped, 0) > 0 or tasks > coalesce(reports, 0) then 'partial' else 'complete' end as coverage, tasks, tasks - coalesce(reports, 0) as unreported,
    coalesce(scanned, 0) as scanned, error from st left join re using (scan_id)"""
)
def agg_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = m.tasks(spark, sf_dir)
    return coverage.manifest(rows, rows.where("reported")).select("scan_id", "status", "coverage", "tasks", "unreported", "scanned", "error")


def _reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.expr("array(named_struct('disposition', 'skipped', 'reason', 'unsupported_type', 'count', l_linenumber), named_struct('disposition', if(l_linenumber % 2 = 0, 'failed', 'skipped'), 'reason', 'timeout', 'count', 1))")
    return m.table(spark, sf_dir, "lineitem").select(F.expr("'n' || cast(l_orderkey as string)").alias("scan_id"), kinds.alias("reasons"))


_REASON_SQL = """reason as (select 'n' || cast(l_orderkey as varchar) as scan_id, 'skipped' as disposition, 'unsupported_type' as reason, l_linenumber as n from lineitem
    union all select 'n' || cast(l_orderkey as varchar), case when l_linenumber % 2 = 0 then 'failed' else 'skipped' end, 'timeout', 1 from lineitem)"""


@query(f"with {_REASON_SQL} select scan_id, disposition, reason, cast(sum(n) as bigint) as n from reason group by all")
def agg_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.merged_reasons(_reasons(spark, sf_dir))


@query(f"with {_REASON_SQL} select scan_id, disposition, reason, cast(sum(n) as bigint) as n from reason where disposition = 'skipped' and reason = 'timeout' group by all")
def agg_illegal_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.illegal_reasons(coverage.merged_reasons(_reasons(spark, sf_dir)))


def _engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack = F.expr("if(c_custkey % 10 = 0, null, named_struct('version', 'v' || cast(c_nationkey % 3 as string), 'rules', array(named_struct('id', 'rule-' || cast(c_custkey % 17 as string), 'description', c_mktsegment))))")
    return m.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr("if(c_acctbal > 0, 'active', 'offline')").alias("status"), pack.alias("rulepack"))


@query(
    """with e as (select 'v' || cast(c_nationkey % 3 as varchar) as version, 'rule-' || cast(c_custkey % 17 as varchar) as rule_id, c_mktsegment as d from customer where c_custkey % 10 <> 0)
    select rule_id, arg_min(d, row(version, d)) as description, array_to_string(list_sort(list(distinct version)), ',') as versions from e group by rule_id"""
)
def agg_rules_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.rules_in_force(_engines(spark, sf_dir)).withColumn("versions", F.array_join("versions", ","))


@query("select case when count(distinct c_nationkey % 3) = 1 then max('v' || cast(c_nationkey % 3 as varchar)) end as version from customer where c_acctbal > 0 and c_custkey % 10 <> 0")
def agg_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.consensus(_engines(spark, sf_dir))


# Order, pages, windows


@query(f"with {F_} select id, {_ts('created_at')} from finding where (created_at, id) > (timestamp '1996-03-01', 'f500') order by finding.created_at, id limit 51")
def ord_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reads.page(m.findings(spark, sf_dir), ["created_at", "id"], ("1996-03-01 00:00:00", "f500"))
    return found.select("id", *_text("created_at"))


@query(f"with {F_} select correlation_id, count(*) as findings from finding where correlation_id > '5' group by correlation_id order by correlation_id limit 21")
def ord_cluster_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reads.clusters(m.findings(spark, sf_dir)).select("correlation_id", "findings")
    return reads.page(found, ["correlation_id"], ("5",), size=20)


@query(f"with {N_} select source_id, arg_max(id, row(finished_at, created_at, id)) as id from scan where status in ('completed', 'partial', 'failed', 'cancelled') group by source_id")
def ord_latest_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.latest_terminal(m.scans(spark, sf_dir)).select("source_id", "id")


@query(f"with {F_} select id from (select id, row_number() over (partition by source_id order by {m.RANK_SQL} desc, confidence desc nulls last, start_at, fingerprint) as n from finding) where n <= 100")
def ord_most_severe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.most_severe(m.findings(spark, sf_dir), ["source_id"], 100).select("id")


@query(f"with {F_} select id from finding where {ACTIONABLE} and due_at <= {AT} order by due_at, id limit 200")
def ord_due_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.findings(spark, sf_dir).where(route.actionable() & (F.col("due_at") <= m.as_of())).orderBy("due_at", "id").limit(200).select("id")


# Sets


def _reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = m.findings(spark, sf_dir)
    return f.where("start % 7 = 0").select("source_id", "fingerprint", F.lit("reopened").alias("kind"), F.lit("scan1").alias("scan_id"), F.col("updated_at").alias("at"))


@query(f"with {F_} select id from finding where first_seen_scan_id = 'scan1' or start_at % 7 = 0")
def set_newly_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.newly_open(m.findings(spark, sf_dir), _reopened(spark, sf_dir), "scan1").select("id")


@query(f"with {F_} select id from finding where state = 'open' except select id from finding where last_seen_scan_id = 'scan2'")
def set_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = m.findings(spark, sf_dir)
    return f.where("state = 'open'").select("id").subtract(f.where("last_seen_scan_id = 'scan2'").select("id"))


@query("select distinct lower(source) as scope from documents where lower(source) not in (select lower(source) from documents where lang = 'en' and doc_id % 2 = 0 and source < 'src5')")
def set_scopes_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = m.table(spark, sf_dir, "documents")
    done = d.where("lang = 'en' and doc_id % 2 = 0 and source < 'src5'")
    return d.select(F.lower("source").alias("scope")).subtract(done.select(F.lower("source").alias("scope")))


# The state over time


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan's payloads: every third finding again, some under a new pepper, some new, some twice."""
    f = m.findings(spark, sf_dir).where("start % 3 = 0")
    moved, new, guard = F.col("start") % 5 == 0, F.col("start") % 4 == 0, F.col("start") % 2 == 0
    fp = F.when(moved, F.md5(F.concat(F.lit("new"), "fingerprint"))).when(new, F.md5(F.concat(F.lit("made"), "fingerprint"))).otherwise(F.col("fingerprint"))
    rows = f.select(
        "source_id", fp.alias("fingerprint"), F.when(moved, F.col("fingerprint")).alias("previous_fingerprint"), F.when(moved & guard, F.lit("other")).alias("previous_secret_hash"), F.lit("h2").alias("secret_hash"),
        F.lit("c2").alias("correlation_id"), "rule_id", F.lit("v2").alias("rulepack_version"), "resource_locator", F.lit("seen").alias("redacted_snippet"), "entropy", "confidence", F.lit("high").alias("severity"), F.col("start").alias("ord"),
    )
    return rows.unionByName(rows.where("ord % 6 = 0").withColumn("ord", F.col("ord") + 10_000))


_BATCH_SQL = f"""{F_}, raw as (select source_id, case when start_at % 5 = 0 then md5('new' || fingerprint) when start_at % 4 = 0 then md5('made' || fingerprint) else fingerprint end as fingerprint,
    case when start_at % 5 = 0 then fingerprint end as old, case when start_at % 5 = 0 and start_at % 2 = 0 then 'other' end as old_hash, confidence, start_at, case when start_at % 6 = 0 then 2 else 1 end as n from finding where start_at % 3 = 0),
    planned as (select r.source_id, r.fingerprint, r.n, r.confidence, r.start_at, case when c.id is not null then c.fingerprint when r.old_hash is null or r.old_hash = o.secret_hash then o.fingerprint end as stored,
    case when c.id is not null then c.state when r.old_hash is null or r.old_hash = o.secret_hash then o.state end as was, c.id is null and o.id is not null and (r.old_hash is null or r.old_hash = o.secret_hash) as moved
    from raw r left join finding c on c.source_id = r.source_id and c.fingerprint = r.fingerprint left join finding o on o.source_id = r.source_id and o.fingerprint = r.old),
    acted as (select *, case when confidence < 0.5 then 'below_threshold' when was is null then 'create' when was = 'resolved' then 'reopen' when moved then 'rekey' else 'refresh' end as action from planned)"""


@query(f"with {_BATCH_SQL} select source_id, fingerprint, stored as stored_fingerprint, action, cast(n as bigint) as n_payloads from acted")
def mrg_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.plan_ingest(m.findings(spark, sf_dir), _batch(spark, sf_dir)).select("source_id", "fingerprint", "stored_fingerprint", "action", "n_payloads")


@query(
    f"""with {_BATCH_SQL}, kept as (select * from acted where action <> 'below_threshold')
    select coalesce(f.source_id, k.source_id) as source_id, coalesce(k.fingerprint, f.fingerprint) as fingerprint, case when f.id is null or k.action = 'reopen' then 'open' else f.state end as state,
    case when k.action = 'reopen' or f.id is null then null else f.resolution end as resolution, case when k.action is not null then 'v2' else f.rulepack_version end as rulepack_version, coalesce(f.correlation_id, case when k.action is not null then 'c2' end) as correlation_id,
    coalesce(f.first_seen_scan_id, 'scan9') as first_seen_scan_id, case when k.action is not null then 'scan9' else f.last_seen_scan_id end as last_seen_scan_id, f.assignee_id, f.owner_group_id
    from finding f full outer join kept k on f.source_id = k.source_id and f.fingerprint = coalesce(k.stored, k.fingerprint)"""
)
def mrg_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = m.findings(spark, sf_dir)
    after = state.upsert(before, state.plan_ingest(before, _batch(spark, sf_dir)), "scan9", m.as_of())
    return after.select("source_id", "fingerprint", "state", "resolution", "rulepack_version", "correlation_id", "first_seen_scan_id", "last_seen_scan_id", "assignee_id", "owner_group_id")


@query(
    f"""with {_BATCH_SQL} select cast(coalesce(sum(n) filter (where action <> 'below_threshold'), 0) as bigint) as ingested, cast(coalesce(sum(n) filter (where action = 'below_threshold'), 0) as bigint) as below_threshold,
    count_if(action = 'create') as created, count_if(action = 'reopen') as reopened, count_if(moved and action <> 'below_threshold') as rekeyed from acted"""
)
def mrg_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.ingest_tallies(state.plan_ingest(m.findings(spark, sf_dir), _batch(spark, sf_dir)))


_GONE = "source_id = 's5' and state = 'open' and suppressed_at is null and last_seen_scan_id <> 'scan2'"


@query(f"with {F_} select id, case when {_GONE} then 'resolved' else state end as state, case when {_GONE} then 'auto' else resolution end as resolution from finding")
def mrg_resolve_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = state.resolve_absent(m.findings(spark, sf_dir), "s5", "scan2", m.as_of(), scan_status="completed", coverage="complete", mode="full", fetch_tasks=3)
    return after.select("id", "state", "resolution")


@query(f"with {F_} select source_id, fingerprint, 'state_change' as kind, 'open' as from_value, 'resolved' as to_value, 'scan2' as scan_id from finding where {_GONE}")
def mrg_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = m.findings(spark, sf_dir)
    after = state.resolve_absent(before, "s5", "scan2", m.as_of(), scan_status="completed", coverage="complete", mode="full", fetch_tasks=3)
    return state.changes(before, after, "scan2", m.as_of()).drop("at")


_ASKED = "case start_at % 3 when 0 then 'resolved' when 1 then 'open' else 'accepted_risk' end"
_ALLOWED = f"(state = 'open' and {_ASKED} <> 'open' or state <> 'open' and {_ASKED} = 'open')"


@query(f"with {F_} select id, case when {_ALLOWED} then {_ASKED} else state end as state, case when {_ALLOWED} then case when {_ASKED} = 'resolved' then 'manual' end else resolution end as resolution, case when {_ALLOWED} then 'u9' else assignee_id end as assignee_id from finding")
def mrg_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = m.findings(spark, sf_dir)
    asked = before.select("source_id", "fingerprint", F.expr(_ASKED.replace("start_at", "start")).alias("to_state"), F.lit("u9").alias("assignee_id"))
    return state.triage(before, asked, m.as_of())[0].select("id", "state", "resolution", "assignee_id")


@query(f"with {F_} select id from finding where not coalesce(state = 'resolved' and resolution = 'auto' and suppressed_at is null and updated_at < {AT}, false)")
def mrg_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.purge(m.findings(spark, sf_dir), m.as_of()).select("id")


_MATCH = f"""hit as (select id, scope, sid, screated from finding join sup on (ssource is null or ssource = source_id) and (sexpires is null or sexpires > {AT})
    and case scope when 'fingerprint' then pattern = fingerprint when 'rule' then pattern = rule_id else regexp_matches(path, pattern) or regexp_matches(id, pattern) end),
    wide as (select id, arg_min(sid, row(screated, sid)) as sid from hit where scope <> 'path_glob' group by id), globs as (select id, arg_min(sid, row(screated, sid)) as sid from hit where scope = 'path_glob' group by id),
    whole as (select id, arg_min(sid, row(screated, sid)) as sid from hit group by id)"""


@query(f"with {F_}, {S_}, {_MATCH} select f.id, coalesce(f.suppressed_by_id, wide.sid, case when f.state = 'open' then globs.sid end) as suppressed_by_id from finding f left join wide on wide.id = f.id left join globs on globs.id = f.id")
def mrg_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.apply(m.findings(spark, sf_dir), m.suppressions(spark), m.as_of()).select("id", "suppressed_by_id")


@query(
    f"""with {F_}, {S_}, {_MATCH} select f.id, case when f.suppressed_by_id is null or f.suppressed_by_id in (select sid from sup where sexpires is null or sexpires > {AT}) then f.suppressed_by_id else whole.sid end as suppressed_by_id
    from finding f left join whole on whole.id = f.id"""
)
def mrg_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.release(m.findings(spark, sf_dir), m.suppressions(spark), m.as_of()).select("id", "suppressed_by_id")


@query(
    f"""with {F_}, r as (select *, case when source_id = 's1' then 'g1' when rule_id = 'rule-2' then 'g2' when {m.RANK_SQL} >= 2 then 'g6' end as g from finding)
    select id, case when owner_group_id is null and not owner_pinned then g else owner_group_id end as owner_group_id from r"""
)
def mrg_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.route(m.findings(spark, sf_dir), m.routing_rules(spark), m.groups(spark, sf_dir)).select("id", "owner_group_id")


@query(f"with {F_} select id, strftime(coalesce(due_at, created_at + to_hours(case severity when 'critical' then 24 when 'high' then 72 when 'medium' then 336 else 720 end)), '%Y-%m-%d %H:%M:%S') as due_at from finding")
def mrg_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.start_clock(m.findings(spark, sf_dir), F.col("created_at")).select("id", *_text("due_at"))


@query(f"with {F_} select id, coalesce(correlation_id, {_hmac_sql(CORRELATION_KEY, 'correlation', 'encode(secret_hash)')}) as correlation_id from finding")
def mrg_correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.correlate(m.findings(spark, sf_dir), identity.correlation_id(F.col("secret_hash"), CORRELATION_KEY)).select("id", "correlation_id")


# Cursors


def _cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = m.table(spark, sf_dir, "customer")
    at = F.timestamp_seconds(F.unix_timestamp(m.as_of()) - F.expr("(c_custkey % 12) * 86400"))
    return rows.select(
        F.expr("'s' || cast(c_custkey % 400 as string)").alias("source_id"), F.expr("'scope' || cast(c_custkey as string)").alias("scope"), F.col("c_custkey").cast("bigint").alias("position"), F.expr("if(c_custkey % 400 % 3 = 0, 'v0', 'v1')").alias("rulepack_version"),
        F.expr("'cfg' || cast(c_custkey % 400 % 2 as string)").alias("source_configuration_version"), at.alias("minted_at"), F.when(F.expr("c_custkey % 31 = 0"), at).alias("invalidated_at"), F.expr("if(c_custkey % 31 = 0, 'source_rejected_cursor', null)").alias("invalidation_reason"),
    )


def _sources(spark: SparkSession) -> DataFrame:
    ids = spark.range(450)
    return ids.select(F.expr("'s' || cast(id as string)").alias("id"), F.lit("v1").alias("current_rulepack"), F.expr("if(id % 5 = 0, 'cfg9', 'cfg' || cast(id % 2 as string))").alias("current_configuration"), F.lit(False).alias("pepper_rotating"), F.lit(11).alias("full_scan_interval_days"))


@query(
    """with cur as (select c_custkey % 400 as s, c_custkey % 12 as age from customer where c_custkey % 31 <> 0), src as (select unnest(range(450)) as s),
    j as (select src.s, age, case when age is null then 'no_cursor' when src.s % 5 = 0 then 'source_configuration_changed' when src.s % 3 = 0 then 'rulepack_changed' when age >= 11 then 'interval_elapsed' end as reason from src left join cur on cur.s = src.s)
    select 's' || cast(s as varchar) as source_id, case when min(reason) is null then 'incremental' else 'full' end as mode, min(reason) as reason, case when min(reason) is null then cast(max(age) as bigint) end as baseline_days from j group by s"""
)
def cur_plan_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cursors.plan_mode(_cursors(spark, sf_dir), _sources(spark), m.as_of())
    days = ((F.unix_timestamp(m.as_of()) - F.unix_timestamp("baseline")) / 86_400).cast("bigint")
    return found.select("source_id", "mode", "reason", days.alias("baseline_days"))


@query(
    """with prop as (select 's' || cast(c_custkey % 400 as varchar) as source_id, 'scope' || cast(c_custkey + 100 as varchar) as scope, c_custkey + 1000 as position from customer where c_custkey % 4 <> 0),
    cur as (select 's' || cast(c_custkey % 400 as varchar) as source_id, 'scope' || cast(c_custkey as varchar) as scope, c_custkey as position, c_custkey % 31 = 0 as dead from customer)
    select coalesce(cur.source_id, prop.source_id) as source_id, coalesce(cur.scope, prop.scope) as scope, cast(coalesce(prop.position, cur.position) as bigint) as position, prop.scope is null and cur.dead as dead
    from cur full outer join prop on cur.source_id = prop.source_id and cur.scope = prop.scope"""
)
def cur_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = m.table(spark, sf_dir, "customer")
    proposals = rows.select(F.expr("'s' || cast(c_custkey % 400 as string)").alias("source_id"), F.expr("'scope' || cast(c_custkey + 100 as string)").alias("scope"), (F.col("c_custkey") + 1000).cast("bigint").alias("position"), F.lit("v1").alias("rulepack_version"), F.lit("cfg").alias("source_configuration_version"), F.expr("if(c_custkey % 4 = 0, 'failed', 'completed')").alias("status"))
    return cursors.commit(_cursors(spark, sf_dir), proposals, m.as_of()).select("source_id", "scope", "position", F.col("invalidated_at").isNotNull().alias("dead"))


@query("select doc_id from documents where doc_id % 7 = 0 or source = 'src3' or doc_id > 500")
def cur_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undated documents, those of a scope without a cursor, and those beyond it."""
    docs = m.table(spark, sf_dir, "documents")
    specs = docs.select("doc_id", F.lit("s1").alias("source_id"), F.col("source").alias("scope"), F.when(F.col("doc_id") % 7 != 0, F.col("doc_id")).alias("revision"))
    live = docs.select("source").distinct().where("source <> 'src3'").select(F.lit("s1").alias("source_id"), F.col("source").alias("scope"), F.lit(500).cast("bigint").alias("position"), F.lit(None).cast("timestamp").alias("invalidated_at"))
    return cursors.changed(specs, live).select("doc_id")


@query(
    """with b as (select 's' || cast(o_custkey % 20 as varchar) as project, min(o_orderdate) as oldest, max(o_orderdate) as newest from orders group by 1),
    w as (select *, (epoch(newest) - epoch(oldest)) / 86400 + 1.0 / 1440 as days from b), x as (select *, case when ceil(days / 7) <= 64 then 7 when ceil(days / 30) <= 64 then 30 when ceil(days / 90) <= 64 then 90 when ceil(days / 365) <= 64 then 365 else 1825 end as width from w),
    y as (select *, cast(greatest(1, ceil(days / width)) as int) as n from x), z as (select *, unnest(range(n)) as i from y)
    select project, cast(i as int) as "window", case when i > 0 then strftime(oldest + to_days(cast(i * width as int)), '%Y-%m-%d %H:%M:%S') end as from_at,
    strftime(case when i < n - 1 then oldest + to_days(cast((i + 1) * width as int)) else date_trunc('minute', newest) + to_minutes(1) end, '%Y-%m-%d %H:%M:%S') as to_at from z"""
)
def cur_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = m.scans(spark, sf_dir).groupBy(F.col("source_id").alias("project")).agg(F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))
    return cursors.windows(bounds).select("project", "window", *_text("from_at", "to_at"))


# Outbox


@query(
    f"""with {F_}, {C_} select cid as channel_id, source_id, fingerprint, 'scan1' as scan_id from finding join chan on enabled and {m.RANK_SQL} >= least and (only_sources is null or list_contains(only_sources, source_id))
    where (first_seen_scan_id = 'scan1' or start_at % 7 = 0) and not (cid = 'ch0' and start_at % 2 = 0)"""
)
def out_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = m.findings(spark, sf_dir)
    sent = f.where("start % 2 = 0").select(F.lit("ch0").alias("channel_id"), "source_id", "fingerprint", F.lit("scan1").alias("scan_id"))
    return outbox.enqueue(reads.newly_open(f, _reopened(spark, sf_dir), "scan1"), m.channels(spark), sent, "scan1")


@query(
    f"""with {F_}, {G_}, {C_}, late as (select * from finding where {OVERDUE} and start_at % 2 = 1)
    select channel as channel_id, source_id, fingerprint from late join grp on owner_group_id = gid and not disabled join chan on cid = channel and enabled
    union all select cid, source_id, fingerprint from late join chan on enabled and {m.RANK_SQL} >= least and (only_sources is null or list_contains(only_sources, source_id))
    where owner_group_id is null or owner_group_id not in (select gid from grp where not disabled)"""
)
def out_escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = m.findings(spark, sf_dir)
    sent = f.where("start % 2 = 0").select("source_id", "fingerprint", "due_at").where("due_at is not null")
    return outbox.escalations(f, m.channels(spark).withColumn("enabled", F.col("enabled")), m.groups(spark, sf_dir), sent, m.as_of()).drop("due_at")


@query(
    f"""with a as (select event_id, event_type = 'view' as ok, event_type = 'error' as perm, event_id % 6 + 1 as n from events)
    select event_id, case when ok then 'delivered' when perm or n >= 5 then 'failed' else 'pending' end as status, cast(n as bigint) as attempts,
    case when not ok and not perm and n < 5 then strftime({AT} + to_seconds(cast(60 * power(2, n - 1) as bigint)), '%Y-%m-%d %H:%M:%S') end as next_attempt_at from a"""
)
def out_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = m.table(spark, sf_dir, "events")
    done = outbox.after_attempt(F.col("event_type") == "view", F.col("event_type") == "error", F.col("event_id") % 6, m.as_of())
    return e.select("event_id", done.alias("d")).select("event_id", "d.status", F.col("d.attempts").cast("bigint").alias("attempts"), F.date_format("d.next_attempt_at", "yyyy-MM-dd HH:mm:ss").alias("next_attempt_at"))


_EXTERNAL = "case o % 5 when 0 then 'resolved' when 1 then 'open' when 2 then 'rejected' when 3 then 'in_progress' end"


@query(
    f"""with {F_}, h as (select id, state, start_at as o from finding), x as (select id, state, {_EXTERNAL} as ext, case when o % 3 = 0 then 'resolved' end as gone from h),
    y as (select id, case when ext in ('resolved', 'rejected', 'cancelled') and state = 'open' then 'external_' || ext || '_finding_open' when ext in ('open', 'in_progress') and state <> 'open' then 'finding_' || state || '_external_open' end as conflict, ext, gone from x)
    select id, conflict from y where conflict is not null and not coalesce(ext = gone, false)"""
)
def out_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = m.findings(spark, sf_dir).withColumn("ext", F.expr(_EXTERNAL.replace("case o %", "case start %"))).withColumn("gone", F.expr("if(start % 3 = 0, 'resolved', null)"))
    return f.select("id", outbox.conflict(F.col("ext"), F.col("state"), F.col("gone")).alias("conflict")).where("conflict is not null")


@query("select user_id as handoff_id, arg_max(event_type, row(ts, event_id)) as state, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as state_at from events group by user_id")
def out_callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = m.table(spark, sf_dir, "events").select(F.col("user_id").alias("handoff_id"), F.col("event_type").alias("state"), F.col("ts").cast("timestamp").alias("state_at"), F.col("event_id").alias("received_at"))
    return ingest.latest_by_time(e, "handoff_id", "state", "state_at", "received_at").select("handoff_id", "state", *_text("state_at"))


@query(f"with {F_} select id, '{{\"rule_id\":\"' || rule_id || '\",\"hours\":' || cast(cast(floor((epoch({AT}) - epoch(due_at)) / 3600) as bigint) as varchar) || '}}' as payload from finding where {OVERDUE}")
def out_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = m.findings(spark, sf_dir).where(route.overdue(m.as_of()))
    whole = F.from_json(outbox.payload(m.as_of()), "rule_id string, overdue_by_hours bigint")
    return f.select("id", F.to_json(F.struct(whole["rule_id"].alias("rule_id"), whole["overdue_by_hours"].alias("hours"))).alias("payload"))


# Streams, as batches


@query("select user_id, strftime(to_timestamp(floor(epoch(ts) / 60) * 60)::timestamp, '%Y-%m-%d %H:%M:%S') as window_start, count(*) as n from events group by user_id, floor(epoch(ts) / 60)")
def str_rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.rate_windows(m.table(spark, sf_dir, "events"), "user_id").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 3599999999 preceding and current row) as n from events")
def str_sliding_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = m.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.sliding_count(e, "user_id", "event_id", seconds=3600).select("event_id", "n")


@query("select user_id, event_type, min(1) as kept from events group by user_id, event_type")
def str_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.once(m.table(spark, sf_dir, "events").select("user_id", "event_type", "ts"), ["user_id", "event_type"]).select("user_id", "event_type", F.lit(1).alias("kept"))


@query(f"select o_orderkey from orders where o_orderkey % 3 <> 0 and epoch({AT}) - epoch(o_orderdate) > 900")
def str_timed_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = m.table(spark, sf_dir, "orders").withColumn("beat", F.when(F.expr("o_orderkey % 3 <> 0"), F.col("o_orderdate").cast("timestamp")))
    return ingest.timed_out(o, "beat", m.as_of(), 900).select("o_orderkey")


# Text and sources


@query("select page_id, case when lower(url) like '%.html' then 'text' end as kind from pages")
def txt_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = m.table(spark, sf_dir, "pages")
    return p.select("page_id", F.when(F.lower("url").endswith(".html"), extract.kind_of(F.col("url"))).alias("kind"))


@query()
def txt_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.table(spark, sf_dir, "pages").select("page_id", markup.storage_to_text(F.col("html")).alias("text"))


@query()
def txt_wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.table(spark, sf_dir, "documents").select("doc_id", markup.wiki_to_text(F.col("text")).alias("text"))


@query("select doc_id, source || chr(10) || 'id & ' || cast(doc_id as varchar) || chr(10) || 'x<' || lang || '>' || chr(10) || 'a' || chr(10) || 'b c' as text from documents where source is not null and lang is not null")
def txt_storage_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        F.lit("<h1>"), F.col("source"), F.lit("</h1><p>id &amp; "), F.col("doc_id").cast("string"), F.lit('</p><ac:structured-macro ac:name="code"><ac:parameter ac:name="language">sh</ac:parameter><ac:plain-text-body><![CDATA[x<'),
        F.col("lang"), F.lit('>]]></ac:plain-text-body></ac:structured-macro><ri:page ri:title="t"/><ul><li>a</li><li>b <strong>c</strong></li></ul>'),
    ]
    rows = m.table(spark, sf_dir, "documents").where("source is not null and lang is not null")
    return rows.select("doc_id", markup.storage_to_text(F.concat(*parts)).alias("text"))


@query("select doc_id, source || chr(10) || 'item ' || lang || ' see http://h/' || cast(doc_id as varchar) || chr(10) || '* ' || lang || chr(10) || 'name value' as text from documents where source is not null and lang is not null")
def txt_wiki_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.lit("h2. "), F.col("source"), F.lit("\n* item {{"), F.col("lang"), F.lit("}} [see|http://h/"), F.col("doc_id").cast("string"), F.lit("]\n{code:sh}\n* "), F.col("lang"), F.lit("\n{code}\n||name||value||")]
    rows = m.table(spark, sf_dir, "documents").where("source is not null and lang is not null")
    return rows.select("doc_id", markup.wiki_to_text(F.concat(*parts)).alias("text"))


@query("select cast(conv_id as varchar) as resource_id, 'comment:' || cast(turn as varchar) as sub_resource, 'comment' as origin, length(text) as n_chars from conversations")
def src_comment_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = m.table(spark, sf_dir, "conversations")
    found = units.units(c, "conversations", F.col("conv_id"), F.col("text"), sub_resource=F.concat(F.lit("comment:"), F.col("turn").cast("string")), origin="comment", display={"role": F.col("role")})
    return found.select("resource_id", "sub_resource", "origin", F.length("text").cast("bigint").alias("n_chars"))


@query(
    """with h as (select conv_id as issue_id, turn as entry, role as field, case when turn > 0 then 'was ' || cast(turn as varchar) end as from_text, text as to_text from conversations)
    select issue_id, field, to_text as text, entry from h where to_text <> '' union all select issue_id, field, arg_min_null(from_text, entry), min(entry) from h group by issue_id, field having arg_min_null(from_text, entry) is not null"""
)
def src_field_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = m.table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").alias("issue_id"), F.col("turn").alias("entry"), F.col("role").alias("field"), F.expr("if(turn > 0, 'was ' || cast(turn as string), null)").alias("from_text"), F.col("text").alias("to_text"))
    return units.field_history(rows)


@query("select * from (values ('a', 2), ('b', 1)) t(space, pages)")
def src_fake(spark: SparkSession, sf_dir: str) -> DataFrame:
    fake.register(spark)
    spaces = '{"a": [{"id": 1, "text": "x", "revision": 5}, {"id": 2, "text": "y"}, {"id": 3, "text": "z", "revision": 2}], "b": [{"id": 4, "text": "w", "skip": true}]}'
    read = spark.read.format("sieve_fake").option("spaces", spaces).option("since", "3").load()
    return read.groupBy("space").agg(F.count(F.lit(1)).cast("int").alias("pages"))


# Roles, differences, silence, schedules


@query(f"with {F_} select id, null as correlation_id, null as notes, source_id, state from finding")
def flt_for_viewer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.for_role(m.findings(spark, sf_dir), "viewer").select("id", "correlation_id", "notes", "source_id", "state")


@query(
    f"""with {T_}, now as (select scan_id, sum(discovered) as d, sum(scanned) as s, sum(skipped) as k from task where reported group by scan_id),
    old as (select scan_id, sum(discovered) as d, sum(scanned) as s, sum(skipped) as k from task where reported and id <= 2 group by scan_id)
    select scan_id, cast(now.d - coalesce(old.d, 0) as bigint) as discovered, cast(now.s - coalesce(old.s, 0) as bigint) as scanned, cast(now.k - coalesce(old.k, 0) as bigint) as skipped from now left join old using (scan_id)"""
)
def agg_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = m.tasks(spark, sf_dir).where("reported")
    return coverage.delta(coverage.merged(rows), coverage.merged(rows.where("id <= 2"))).select("scan_id", "discovered", "scanned", "skipped")


_GAP = "select 's' || cast(o_custkey % 20 as {t}) as scan_id, 'gap' || cast(o_orderkey as {t}) as reference from orders"


@query(f"with g as ({_GAP.format(t='varchar')}) select scan_id, reference from (select *, row_number() over (partition by scan_id order by reference) as n from g) where n <= 300")
def agg_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = m.table(spark, sf_dir, "orders").selectExpr("'s' || cast(o_custkey % 20 as string) as scan_id", "'gap' || cast(o_orderkey as string) as reference")
    return coverage.merged_gaps(gaps, most=300)[0]


@query(f"with g as ({_GAP.format(t='varchar')}) select scan_id, greatest(count(*) - 300, 0) as gaps_omitted from g group by scan_id")
def agg_gaps_omitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = m.table(spark, sf_dir, "orders").selectExpr("'s' || cast(o_custkey % 20 as string) as scan_id", "'gap' || cast(o_orderkey as string) as reference")
    return coverage.merged_gaps(gaps, most=300)[1]


@query("select l_orderkey, l_linenumber from lineitem where cast(l_quantity as int) <> cast(l_quantity as int) - 1 + case when l_suppkey % 7 = 0 then 1 else 0 end + l_linenumber % 2")
def agg_unlawful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports whose counts don't add up."""
    q = F.col("l_quantity").cast("int")
    rows = m.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", q.alias("discovered"), (q - 1).alias("scanned"), F.expr("if(l_suppkey % 7 = 0, 1, 0)").alias("skipped"), F.expr("l_linenumber % 2").alias("failed"))
    return coverage.lawful(rows).select("l_orderkey", "l_linenumber")


@query("select l_orderkey, l_linenumber, case when l_returnflag = 'R' then 'failed' when l_suppkey % 5 = 0 or l_linenumber % 4 = 3 then 'failed' else 'completed' end as outcome from lineitem")
def agg_task_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = m.table(spark, sf_dir, "lineitem")
    said = F.when(F.col("l_returnflag") == "R", "failed").otherwise("completed")
    return rows.select("l_orderkey", "l_linenumber", coverage.task_outcome(said, F.expr("if(l_suppkey % 5 = 0, 1, 0)"), F.lit(None).cast("int"), F.expr("if(l_linenumber % 4 = 3, 2, 0)")).alias("outcome"))


@query(f"select o_orderkey from orders where o_orderstatus = 'O' and epoch({AT}) - epoch(case when o_orderkey % 3 = 0 then o_orderdate + to_days(100) else o_orderdate end) > 72 * 3600")
def out_silent(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = m.table(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", F.expr("if(o_orderstatus = 'O', 'delivered', 'pending')").alias("status"), F.col("o_orderdate").cast("timestamp").alias("delivered_at"), F.when(F.expr("o_orderkey % 3 = 0"), F.timestamp_seconds(F.unix_timestamp("o_orderdate") + 100 * 86_400)).alias("last_callback_at"))
    return outbox.silent(rows, m.as_of()).select("o_orderkey")


@query(
    """with n as (select *, row_number() over (partition by user_id order by ts, event_type) as i from events)
    select user_id as finding_id, string_agg(event_type, ',' order by ts, event_type) as kinds from n where i <= 10 group by user_id"""
)
def out_first_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = m.table(spark, sf_dir, "events").select(F.col("user_id").alias("finding_id"), F.col("ts").alias("occurred_at"), F.col("event_type").alias("kind"))
    return outbox.first_actions(e).select("finding_id", F.array_join(F.transform("actions", lambda a: a["kind"]), ",").alias("kinds"))


@query(f"with {F_} select id from finding where state = 'open' and due_at <= {AT} order by due_at, id limit 50")
def out_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = m.findings(spark, sf_dir).select("id", F.when(F.col("state") == "open", "pending").otherwise("delivered").alias("status"), F.col("due_at").alias("next_attempt_at"))
    return outbox.due(rows, m.as_of()).select("id")


@query("select 'scope' || cast(c_custkey as varchar) as scope, case when c_custkey % 31 = 0 then 'source_rejected_cursor' when c_custkey % 400 < 10 then 'operator_requested' end as reason from customer")
def cur_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cursors(spark, sf_dir)
    found = cursors.invalidate(rows, F.expr("cast(substring(source_id, 2) as int) < 10"), "operator_requested", m.as_of())
    return found.select("scope", F.col("invalidation_reason").alias("reason"))


@query("select c_custkey from customer where c_acctbal > 0 and (c_custkey % 7 = 0 or c_custkey % 5 < 3)")
def lif_due_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = F.when(F.expr("c_custkey % 7 <> 0"), F.timestamp_seconds(F.unix_timestamp(m.as_of()) + F.expr("(c_custkey % 5 - 2) * 60")))
    rows = m.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("enabled"), when.alias("next_run_at"))
    return schedule.due(rows, m.as_of()).select("c_custkey")


@query("select event_id, strftime(date_trunc('hour', ts) + case when extract(minute from ts) < 30 then to_minutes(30) else to_minutes(90) end, '%Y-%m-%d %H:%M:%S') as next_at from events")
def lif_next_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = m.table(spark, sf_dir, "events")
    return e.select("event_id", F.date_format(schedule.next_run(F.lit("30 * * * *"), F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("next_at"))


@query(f"select o_orderkey, case when o_orderstatus in ('O', 'P') and o_orderkey % 3 <> 0 and epoch({AT}) - epoch(o_orderdate) > 900 then 'offline' when o_orderstatus = 'O' then 'active' when o_orderstatus = 'P' then 'draining' else 'offline' end as status from orders")
def lif_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = m.table(spark, sf_dir, "orders").select("o_orderkey", F.expr("case o_orderstatus when 'O' then 'active' when 'P' then 'draining' else 'offline' end").alias("status"), F.when(F.expr("o_orderkey % 3 <> 0"), F.col("o_orderdate").cast("timestamp")).alias("last_heartbeat_at"))
    return schedule.fleet(rows, m.as_of()).select("o_orderkey", "status")


@query("select doc_id from documents where not (source < 'src5' and doc_id % 2 = 0) or lang <> 'en'")
def src_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a resumed read still has to fetch: those not seen at the checkpoint."""
    d = m.table(spark, sf_dir, "documents")
    return d.join(d.where("source < 'src5' and doc_id % 2 = 0 and lang = 'en'").select("doc_id", "lang"), ["doc_id", "lang"], "left_anti").select("doc_id")


# Hand-overs, guidance, audits


def _handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = m.findings(spark, sf_dir)
    return f.select(
        "source_id", "fingerprint", "state", F.expr("case start % 4 when 0 then 'failed' when 1 then 'pending' else 'delivered' end").alias("status"), (F.col("start") % 6).alias("attempts"), F.col("created_at").alias("delivered_at"),
        F.lit(None).cast("timestamp").alias("last_callback_at"), F.expr(_EXTERNAL.replace("case o %", "case start %")).alias("external_state"), F.expr("if(start % 3 = 0, 'resolved', null)").alias("conflict_dismissed_state"), F.lit(None).cast("timestamp").alias("next_attempt_at"),
    )


@query(f"with {F_} select 't1' as target_id, source_id, fingerprint, 'handoff-t1-' || source_id || '-' || fingerprint as idempotency_key from finding where start_at % 5 <> 0 and {m.RANK_SQL} >= 2")
def out_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = m.findings(spark, sf_dir).withColumn("target_id", F.lit("t1"))
    from .functions.severity import at_least

    return outbox.request(f.unionByName(f), f.where("start % 5 = 0"), at_least(F.col("severity"), F.lit("high")))[0]


@query(f"with {F_} select source_id, fingerprint, case when start_at % 4 = 0 and source_id = 's1' then 'pending' when start_at % 4 = 0 then 'failed' when start_at % 4 = 1 then 'pending' else 'delivered' end as status, case when start_at % 4 = 0 and source_id = 's1' then 0 else start_at % 6 end as attempts from finding")
def out_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.replay(_handoffs(spark, sf_dir), F.col("source_id") == "s1", m.as_of()).select("source_id", "fingerprint", "status", "attempts")


@query(
    f"""with {F_}, h as (select state, start_at as o, created_at from finding), x as (select *, {_EXTERNAL} as ext, case when o % 3 = 0 then 'resolved' end as gone from h)
    select count_if((ext in ('resolved', 'rejected', 'cancelled') and state = 'open' or ext in ('open', 'in_progress') and state <> 'open') and not coalesce(ext = gone, false)) as conflicts,
    count_if(o % 4 >= 2 and epoch({AT}) - epoch(created_at) > 72 * 3600) as silent from x"""
)
def agg_handoff_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.health(_handoffs(spark, sf_dir), m.as_of())


@query(
    f"""with {_BATCH_SQL}, kept as (select * from acted where action <> 'below_threshold')
    select count_if(action = 'create') as new_findings, count(*) as seen_findings, 0 as resolved_findings, count_if(action = 'reopen') as reopened_findings from kept"""
)
def agg_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = m.findings(spark, sf_dir)
    plan = state.plan_ingest(before, _batch(spark, sf_dir))
    found = reads.reconciliation(before, state.upsert(before, plan, "scan9", m.as_of()), "scan9")
    return found


@query(f"with {F_} select id, case when rule_id in ('rule-1', 'rule-2') then 'rotate ' || rule_id else 'ask' end as guidance from finding")
def jon_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = m.rows(spark, "rule_id string, guidance string", ("rule-1", "rotate rule-1"), ("rule-2", "rotate rule-2"), ("default", "ask"))
    return reads.guidance(m.findings(spark, sf_dir), texts).select("id", "guidance")


@query(f"with {F_} select id from finding where rule_id not in ('rule-1', 'rule-3')")
def jon_unauthorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = m.findings(spark, sf_dir).withColumns({"provider": F.lit("p"), "contract_version": F.lit(1)})
    policies = m.rows(spark, "rule_id string, provider string, contract_version int, enabled boolean", ("rule-1", "p", 1, True), ("rule-2", "p", 1, False), ("rule-3", "p", 1, True), ("rule-4", "q", 1, True))
    return reads.unauthorised(f, policies).select("id")


@query("select event_id from events where event_type = 'view' and user_id = 7 order by ts, event_id")
def ord_audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = m.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("target_type"), F.col("user_id").cast("string").alias("target_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"))
    return reads.audit_trail(e, "view", "7").select("event_id")


@query("select lang as connector_type, count(*) as units, count_if(doc_id % 5 > 1) as scanned, count_if(doc_id % 5 = 0) as skipped, count_if(doc_id % 5 = 1) as failed from documents group by lang")
def agg_fetch_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = m.table(spark, sf_dir, "documents").select(F.col("lang").alias("connector_type"), F.expr("case doc_id % 5 when 0 then 'skipped' when 1 then 'failed' else 'scanned' end").alias("outcome"))
    return reads.fetch_tallies(d)


@query(f"with {T_} select scan_id, id, row_number() over (partition by scan_id order by created_at, id) as n from task")
def ord_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.in_order(m.tasks(spark, sf_dir)).select("scan_id", "id", F.col("n").cast("bigint").alias("n"))


@query("select 's' || cast(c_custkey % 400 as varchar) as source_id, cast(max(c_custkey % 12) as bigint) as baseline_days from customer where c_custkey % 31 <> 0 group by 1")
def agg_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = (F.unix_timestamp(m.as_of()) - F.unix_timestamp("baseline")) / 86_400
    return cursors.baseline(_cursors(spark, sf_dir)).select("source_id", days.cast("bigint").alias("baseline_days"))


@query("select 'c' || cast(o_custkey % 50 as varchar) as channel_id, count(*) as pending from orders where o_orderstatus = 'O' group by 1")
def agg_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as deliveries, the open ones queued."""
    rows = m.table(spark, sf_dir, "orders").select(F.expr("'c' || cast(o_custkey % 50 as string)").alias("channel_id"), F.expr("if(o_orderstatus = 'O', 'pending', 'delivered')").alias("status"))
    return outbox.pending(rows)


#: A document tree around every text: marks, a table, nodes that are none, lists of seven depths, and some too deep to be read.
_TREE = """'{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"' || regexp_replace(replace(replace(coalesce(text, ''), chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), '[[:cntrl:]]', '  ', 'g')
    || '"},{"type":"text","text":" here","marks":[{"type":"strong"},{"type":"link","attrs":{"href":"http://x/' || cast(doc_id as string) || '"}}]}]},7,null,{"type":"table","content":[{"type":"tableRow","content":[
    {"type":"tableCell","content":[{"type":"paragraph","content":[{"type":"text","text":"' || coalesce(source, '') || '"}]}]},{"type":"tableHeader","content":[{"type":"paragraph","content":[{"type":"text","text":" ' || coalesce(lang, '') || '  x"}]}]}]}]},
    {"type":"mention","attrs":{"text":"@' || cast(doc_id as string) || '"}},' || repeat('{"type":"bulletList","content":[{"type":"listItem","content":[', cast(case when doc_id % 50 = 0 then 60 else doc_id % 7 end as int))
    || '{"type":"text","text":5},{"type":"inlineCard","attrs":{"url":"u' || cast(doc_id as string) || '"}}' || repeat(']}]}', cast(case when doc_id % 50 = 0 then 60 else doc_id % 7 end as int)) || ']}'"""
_EDGE = documents.EDGE.replace("\\x0b", "\\x{0b}")


@query(
    f"""with recursive doc as (select doc_id, {_TREE.replace('as string)', 'as varchar)')} as j from documents),
    walk as (select doc_id, '' as p, cast(j as json) as node, 0 as depth, false as cell from doc
    union all select doc_id, p || printf('%05x', i - 1), c, depth + 1, cell or coalesce(node->>'type' in ('tableCell', 'tableHeader'), false) from (select *, unnest(json_extract(node, '$.content[*]')) as c, generate_subscripts(json_extract(node, '$.content[*]'), 1) as i
    from walk where json_type(node, '$.content') = 'ARRAY' and depth <= {documents.MOST_DEPTH}) where json_type(c) = 'OBJECT'),
    said as (select doc_id, p as k, case when json_type(node, '$.text') = 'VARCHAR' then node->>'text' when node->>'type' in ('emoji', 'mention', 'status') then coalesce(node->'attrs'->>'text', '') else '' end
    || coalesce(' ' || coalesce(node->'attrs'->>'url', [x->'attrs'->>'href' for x in json_extract(node, '$.marks[*]') if x->>'type' = 'link'][1]), '') as piece from walk
    union all select doc_id, p || '~', case when cell then ' ' else chr(10) end from walk where node->>'type' in ({', '.join(f"'{b}'" for b in documents.BLOCKS)})),
    whole as (select doc_id, string_agg(piece, '' order by k) as t from said group by doc_id),
    deep as (select doc_id from walk group by doc_id having max(depth) > {documents.MOST_DEPTH} or count(*) > {documents.MOST_NODES})
    select doc_id, case when doc_id not in (select doc_id from deep) then array_to_string([x for x in [regexp_replace(l, '^{_EDGE}|{_EDGE}$', '', 'g') for l in string_split_regex(regexp_replace(t, '[ \\t\\f\\x0b]{{2,}}', ' ', 'g'), '{documents.LINE_BREAK}')] if x <> ''], chr(10)) end as text from whole"""
)
def txt_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text in a document tree, taken apart again; the twin walks the same JSON by recursion."""
    m.table(spark, sf_dir, "documents").createOrReplaceTempView("_tree_documents")
    rows = spark.sql(f"select doc_id, {_TREE.replace(', chr(92), chr(92) || chr(92))', ', char(92), char(92) || char(92))').replace('chr(92)', 'char(92)')} as j from _tree_documents".replace("'[[:cntrl:]]', '  ', 'g')", "'\\\\p{Cntrl}', '  ')"))
    return rows.select("doc_id", documents.document_text(F.try_parse_json("j")).alias("text"))



def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the planted documents, gathered into clusters of one secret."""
    found = detect.findings(m.planted_units(spark, sf_dir), packs.load(), detect.Keys(PEPPER))
    rows = found.select(F.col("secret_hash").alias("correlation_id"), F.col("connector_type").alias("source_id"), F.lit("open").alias("state"), "severity", F.col("start").alias("created_at"), F.col("start").alias("updated_at"))
    return reads.clusters(rows, least=2)


from . import catalog_lifecycle  # noqa: E402, F401  its queries join the register above
