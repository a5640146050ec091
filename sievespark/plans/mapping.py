"""The test tables seen as the tables of this engine, in Spark and in the SQL of the oracles.

``orders`` stand for findings and scans, ``customer`` for engines' reports, ``documents`` for pages with planted
credentials. Both sides are given by the same column rules, so what is compared is what the operators do with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1997-01-01 00:00:00"
#: Rules for columns that both dialects read alike.
_FINDING = {
    "id": "'f' || cast(o_orderkey as string)",
    "source_id": "'s' || cast(o_custkey % 20 as string)",
    "fingerprint": "md5('f' || cast(o_orderkey as string))",
    "secret_hash": "md5('s' || cast(o_orderkey % 5000 as string))",
    "correlation_id": "case when o_orderkey % 5 <> 0 then md5('c' || cast(o_orderkey % 5000 as string)) end",
    "rule_id": "'rule-' || cast(o_orderkey % 17 as string)",
    "rulepack_version": "'v1'",
    "severity": "case substring(o_orderpriority, 1, 1) when '1' then 'critical' when '2' then 'high' when '3' then 'medium' else 'low' end",
    "redacted_snippet": "'snippet ' || cast(o_orderkey as string)",
    "entropy": "cast(o_orderkey % 50 as double) / 10",
    "confidence": "case when o_orderkey % 9 <> 0 then cast(o_orderkey % 100 as double) / 100 end",
    "state": "case o_orderstatus when 'O' then 'open' when 'F' then 'resolved' when 'P' then case when o_orderkey % 2 = 0 then 'open' else 'false_positive' end end",
    "resolution": "case when o_orderstatus = 'F' then case when o_orderkey % 2 = 0 then 'auto' else 'manual' end end",
    "assignee_id": "case when o_orderkey % 3 <> 0 then 'u' || cast(o_custkey % 7 as string) end",
    "owner_group_id": "case when o_orderkey % 4 <> 0 then 'g' || cast(o_custkey % 25 as string) end",
    "owner_pinned": "o_orderkey % 11 = 0",
    "notes": "case when o_orderkey % 8 = 0 then 'note' end",
    "path": "'team' || cast(o_custkey % 10 as string) || '/doc' || cast(o_orderkey as string) || '.txt'",
    "first_seen_scan_id": "'scan' || cast(o_orderkey % 3 as string)",
    "last_seen_scan_id": "'scan' || cast(o_orderkey % 5 as string)",
    "suppressed_by_id": "case when o_orderkey % 13 = 0 then 'sup' || cast(o_orderkey % 4 as string) end",
    "start": "cast(o_orderkey % 1000 as int)",
}
_HOURS = "case substring(o_orderpriority, 1, 1) when '1' then 24 when '2' then 72 when '3' then 336 else 720 end"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plus(column: str, seconds: str) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.col(column)) + F.expr(seconds))


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored findings."""
    rows = table(spark, sf_dir, "orders")
    times = {
        "created_at": F.col("o_orderdate").cast("timestamp"),
        "updated_at": _plus("o_orderdate", "(o_orderkey % 30) * 86400"),
        "due_at": F.when(F.expr("o_orderkey % 6 <> 0"), _plus("o_orderdate", f"({_HOURS}) * 3600")),
        "suppressed_at": F.when(F.expr("o_orderkey % 13 = 0"), F.col("o_orderdate").cast("timestamp")),
    }
    out = rows.select(*[F.expr(v).alias(k) for k, v in _FINDING.items()], *[v.alias(k) for k, v in times.items()])
    return out.withColumn("resource_locator", F.create_map(F.lit("path"), F.col("path"), F.lit("resource_id"), F.col("id")))


FINDING_SQL = (
    "finding as (select "
    + ", ".join(f"{v} as {'start_at' if k == 'start' else k}" for k, v in _FINDING.items()).replace("as string)", "as varchar)")
    + f""", o_orderdate as created_at, o_orderdate + to_days(cast(o_orderkey % 30 as int)) as updated_at,
    case when o_orderkey % 6 <> 0 then o_orderdate + to_hours({_HOURS}) end as due_at,
    case when o_orderkey % 13 = 0 then o_orderdate end as suppressed_at from orders)"""
)


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scans, twenty sources with many each."""
    rows = table(spark, sf_dir, "orders")
    status = "case o_orderkey % 5 when 0 then 'running' when 1 then 'failed' when 2 then 'partial' else 'completed' end"
    return rows.select(
        F.expr("'n' || cast(o_orderkey as string)").alias("id"), F.expr("'s' || cast(o_custkey % 20 as string)").alias("source_id"), F.expr(status).alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"), F.when(F.expr("o_orderkey % 5 <> 0"), _plus("o_orderdate", "3600 * (o_orderkey % 7)")).alias("finished_at"),
    )


SCAN_SQL = """scan as (select 'n' || cast(o_orderkey as varchar) as id, 's' || cast(o_custkey % 20 as varchar) as source_id,
    case o_orderkey % 5 when 0 then 'running' when 1 then 'failed' when 2 then 'partial' else 'completed' end as status,
    o_orderdate as created_at, case when o_orderkey % 5 <> 0 then o_orderdate + to_hours(cast(o_orderkey % 7 as int)) end as finished_at from orders)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as fetch tasks of the scan that is their order."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.expr("'n' || cast(l_orderkey as string)").alias("scan_id"), F.expr("cast(l_linenumber as int)").alias("id"),
        F.expr("case when l_quantity < 3 then 'cancelled' when l_returnflag = 'R' then 'failed' else 'completed' end").alias("status"),
        F.expr("case when l_returnflag = 'R' then 'error ' || cast(l_linenumber as string) end").alias("error"), F.col("l_shipdate").cast("timestamp").alias("created_at"),
        F.expr("case when l_partkey % 10 = 0 then null else cast(l_quantity as bigint) end").alias("requested"), F.expr("cast(l_quantity as bigint)").alias("discovered"),
        F.expr("cast(l_quantity as bigint) - case when l_suppkey % 7 = 0 then 1 else 0 end").alias("scanned"), F.expr("cast(case when l_suppkey % 7 = 0 then 1 else 0 end as bigint)").alias("skipped"),
        F.lit(0).cast("bigint").alias("failed"), (F.expr("l_suppkey % 11 <> 0")).alias("reported"),
    )


TASK_SQL = """task as (select 'n' || cast(l_orderkey as varchar) as scan_id, cast(l_linenumber as int) as id,
    case when l_quantity < 3 then 'cancelled' when l_returnflag = 'R' then 'failed' else 'completed' end as status,
    case when l_returnflag = 'R' then 'error ' || cast(l_linenumber as varchar) end as error, l_shipdate as created_at,
    case when l_partkey % 10 = 0 then null else cast(l_quantity as bigint) end as requested, cast(l_quantity as bigint) as discovered,
    cast(l_quantity as bigint) - case when l_suppkey % 7 = 0 then 1 else 0 end as scanned, cast(case when l_suppkey % 7 = 0 then 1 else 0 end as bigint) as skipped,
    cast(0 as bigint) as failed, l_suppkey % 11 <> 0 as reported from lineitem)"""


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a made-up access key, and a password in every fifth, written behind the text."""
    key = F.concat(F.lit("\naws access key AK"), F.lit("IA"), F.upper(F.substring(F.md5((F.col("doc_id") % 97).cast("string").cast("binary")), 1, 16)))
    word = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(' login credential password = "Tr0ub4dor&'), F.col("doc_id").cast("string"), F.lit('x"'))).otherwise("")
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", F.concat(F.coalesce("text", F.lit("")), key, word).alias("text"))


PLANTED_SQL = """planted as (select doc_id, source, lang, coalesce(text, '') || chr(10) || 'aws access key AK' || 'IA' || upper(substring(md5(cast(doc_id % 97 as varchar)), 1, 16))
    || case when doc_id % 5 = 0 then ' login credential password = "Tr0ub4dor&' || cast(doc_id as varchar) || 'x"' else '' end as text from documents)"""


def planted_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.units import units

    return units(planted(spark, sf_dir), "documents", F.col("doc_id"), F.col("text"), display={"space": F.col("source")})


_A, _B = "md5('a' || cast(doc_id as string))", "translate(md5('b' || cast(doc_id as string)), '0123456789abcdef', 'GKRJPZMXWVQLTHYN')"
_MIXED = f"substring({_A}, 1, 24) || substring({_B}, 1, 24)"
#: A unit for each shipped rule, by doc_id: what stands before the secret, the secret and what stands behind it, as SQL
#: that both engines read. Key formats are parted, so that no whole credential stands in the source.
SEEDED = [
    ("aws-access-key-id", "'aws access key '", f"'AK' || 'IA' || upper(substring({_A}, 1, 16))", "' .'"),
    ("aws-secret-access-key", "'aws_secret_access_key = '", f"substring({_MIXED}, 1, 40)", "' .'"),
    ("gcp-api-key", "'google maps api key '", f"'AI' || 'za' || substring({_MIXED}, 1, 35)", "' .'"),
    ("azure-storage-account-key", "'azure storage connection AccountKey='", f"{_MIXED} || {_A}", "' .'"),
    ("github-token", "'github token '", f"'gh' || 'p_' || substring({_MIXED}, 1, 36)", "' .'"),
    ("github-fine-grained-pat", "'github token '", f"'github' || '_pat_' || {_MIXED} || {_A}", "' .'"),
    ("slack-token", "'slack bot '", f"'xo' || 'xb-' || substring({_A}, 1, 24)", "' .'"),
    ("slack-webhook-url", "'slack notify '", f"'https://hooks.slack' || '.com/services/T' || upper(substring({_A}, 1, 8)) || '/B' || upper(substring({_A}, 9, 8)) || '/' || substring({_A}, 1, 24)", "' .'"),
    ("stripe-api-key", "'stripe payment '", f"'sk' || '_live_' || substring({_A}, 1, 24)", "' .'"),
    ("json-web-token", "'authorization bearer '", f"'ey' || 'J' || substring({_A}, 1, 20) || '.ey' || 'J' || substring({_A}, 1, 24) || '.' || substring({_A}, 3, 20)", "' .'"),
    ("connection-string-password", "'database uri postgres://app:'", f"substring({_A}, 1, 14)", "'@db.local/x'"),
    ("password-assignment", "'login credential password = \"'", f"'Tr0ub4dor&' || substring({_A}, 1, 6)", "'\" .'"),
    ("gcp-service-account-key", "'google {\"type\": \"service_' || 'account\", \"private_key_id\": \"'", f"substring({_A} || {_A}, 5, 40)", "'\" }'"),
    ("azure-client-secret", "'azure tenant client_secret = '", f"substring({_MIXED}, 1, 40)", "' .'"),
    ("private-key-block", "'ssh '", f"'-----BEGIN RSA PRIV' || 'ATE KEY----- ' || {_A} || ' -----END'", "' RSA .'"),
    ("basic-auth-header", "'curl header authorization: ba' || 'sic '", f"{_MIXED}", "' .'"),
    ("generic-high-entropy", "'the token '", f"{_MIXED}", "' .'"),
]


def _seeded_sql(text: str) -> str:
    pick = lambda at: "case " + " ".join(f"when doc_id % {len(SEEDED)} = {i} then {x[at]}" for i, x in enumerate(SEEDED)) + " end"
    rule = "case " + " ".join(f"when doc_id % {len(SEEDED)} = {i} then '{x[0]}'" for i, x in enumerate(SEEDED)) + " end"
    return f"select doc_id, {rule} as rule_id, {text} || {pick(1)} as head, {pick(2)} as secret, {pick(3)} as tail from documents"


#: The documents' own texts, a line break, then the credential.
SEEDED_SQL = "seeded as (" + _seeded_sql("coalesce(text, '') || chr(10)").replace("as string)", "as varchar)") + ")"


def seeded_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a credential of one of the shipped rules written behind its text."""
    from ..sources.units import units

    table(spark, sf_dir, "documents").createOrReplaceTempView("_seeded_documents")
    rows = spark.sql(_seeded_sql("coalesce(text, '') || char(10)").replace("from documents", "from _seeded_documents"))
    return units(rows.select("doc_id", F.concat("head", "secret", "tail").alias("text")), "documents", F.col("doc_id"), F.col("text"))


def rows(spark: SparkSession, schema: str, *values: tuple) -> DataFrame:
    return spark.createDataFrame(list(values), schema)


def suppressions(spark: SparkSession) -> DataFrame:
    return rows(
        spark, "id string, scope string, pattern string, source_id string, created_at string, expires_at string",
        ("sup0", "path_glob", "team3/*", None, "1996-01-01 00:00:00", None),
        ("sup1", "rule", "rule-5", "s3", "1996-01-02 00:00:00", None),
        ("sup2", "path_glob", "team[12]/doc?5*.txt", "s7", "1996-01-03 00:00:00", "1998-01-01 00:00:00"),
        ("sup3", "rule", "rule-6", None, "1996-01-04 00:00:00", "1996-06-01 00:00:00"),
        ("sup4", "fingerprint", "a87ff679a2f3e71d9181a67b7542122c", None, "1995-01-01 00:00:00", None),
        ("sup5", "rule", "rule-7", None, "1996-01-05 00:00:00", None),
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "expires_at")})


SUPPRESSION_SQL = """sup as (select * from (values
    ('sup0', 'path_glob', '^team3/.*$', null, timestamp '1996-01-01', null), ('sup1', 'rule', 'rule-5', 's3', timestamp '1996-01-02', null),
    ('sup2', 'path_glob', '^team[12]/doc.5.*\\.txt$', 's7', timestamp '1996-01-03', timestamp '1998-01-01'), ('sup3', 'rule', 'rule-6', null, timestamp '1996-01-04', timestamp '1996-06-01'),
    ('sup4', 'fingerprint', 'a87ff679a2f3e71d9181a67b7542122c', null, timestamp '1995-01-01', null), ('sup5', 'rule', 'rule-7', null, timestamp '1996-01-05', null)
    ) t(sid, scope, pattern, ssource, screated, sexpires))"""


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as owner groups."""
    return table(spark, sf_dir, "nation").select(F.expr("'g' || cast(n_nationkey as string)").alias("id"), F.expr("n_nationkey % 6 = 5").alias("disabled"), F.expr("case when n_nationkey % 4 <> 0 then 'ch' || cast(n_nationkey % 3 as string) end").alias("notification_channel_id"))


GROUP_SQL = "grp as (select 'g' || cast(n_nationkey as varchar) as gid, n_nationkey % 6 = 5 as disabled, case when n_nationkey % 4 <> 0 then 'ch' || cast(n_nationkey % 3 as varchar) end as channel from nation)"


def routing_rules(spark: SparkSession) -> DataFrame:
    return rows(
        spark, "id string, priority int, created_at string, owner_group_id string, source_id string, rule_id string, min_severity string, source_tags array<string>, enabled boolean",
        ("r1", 10, "1995-01-01", "g1", "s1", None, None, None, True),
        ("r2", 20, "1995-01-01", "g2", None, "rule-2", None, None, True),
        ("r3", 20, "1995-01-02", "g3", None, None, "critical", ["S4", "prod"], True),
        ("r4", 5, "1995-01-01", "g4", None, "rule-9", None, None, False),
        ("r5", 1, "1995-01-01", "g5", None, "rule-3", None, None, True),
        ("r6", 90, "1995-01-01", "g6", None, None, "high", [], True),
    )


def channels(spark: SparkSession) -> DataFrame:
    return rows(
        spark, "id string, min_severity string, source_ids array<string>, enabled boolean",
        ("ch0", "high", None, True), ("ch1", None, ["s1", "s2"], True), ("ch2", "critical", [], False), ("ch3", "critical", [], True),
    )


CHANNEL_SQL = "chan as (select * from (values ('ch0', 2, null, true), ('ch1', 0, ['s1', 's2'], true), ('ch2', 3, null, false), ('ch3', 3, null, true)) t(cid, least, only_sources, enabled))"
RANK_SQL = "case severity when 'critical' then 3 when 'high' then 2 when 'medium' then 1 else 0 end"
